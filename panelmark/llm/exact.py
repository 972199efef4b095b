"""Exact dedup by counting quotient filters.

Each partition of the fingerprints becomes a counting quotient filter, cut into shards by the leading
bits. The filters of a shard merge without loss: quotient and remainder together are the whole
fingerprint, and runs are kept as sorted remainders, so a merge adds the counts of equal ones. Only rows
whose fingerprint counts above one go on to the comparison of bytes.

A null text counts as empty and all texts without other characters are equal. Of equal texts the one with the
most code points stays, then the smallest doc_id; a null doc_id loses every tie. Of repeated rows (same
doc_id and text) one stays. An empty table gives an empty result; extra columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmark.llm.common import checked, no_space, saved, text_of

QUOTIENT_BITS = 20
SHARD_ROWS = 1 << 18
BROADCAST_ROWS = 500_000


class CountingQuotientFilter:
    """Fingerprints of 64 bits with counts. runs: how many remainders each occupied quotient has."""

    def __init__(self, quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.runs, self.remainders, self.counts = quotients, runs, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        order = np.argsort(fingerprints, kind="stable")
        fingerprints, counts = fingerprints[order], counts[order]
        starts = np.flatnonzero(np.r_[True, fingerprints[1:] != fingerprints[:-1]]) if len(fingerprints) else np.zeros(0, np.int64)
        counts = np.add.reduceat(counts, starts) if len(starts) else counts
        return cls._of_sorted(fingerprints[starts], counts)

    def fingerprints(self) -> np.ndarray:
        return np.repeat(self.quotients.astype(np.uint64), self.runs) << np.uint64(64 - QUOTIENT_BITS) | self.remainders

    def merged(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both filters' remainders in their order, quotient by quotient; counts of equal ones add up. Neither is sorted again."""
        own, new, counts = self.fingerprints(), other.fingerprints(), self.counts.copy()
        at = np.searchsorted(own, new)
        there = at < len(own)
        there[there] = own[at[there]] == new[there]
        counts[at[there]] += other.counts[there]
        own, counts = np.insert(own, at[~there], new[~there]), np.insert(counts, at[~there], other.counts[~there])
        return self._of_sorted(own, counts)

    @classmethod
    def _of_sorted(cls, fingerprints: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """Of distinct fingerprints in order."""
        low = np.uint64(64 - QUOTIENT_BITS)
        high = fingerprints >> low
        starts = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(high) else np.zeros(0, np.int64)
        runs = np.diff(np.r_[starts, len(high)])
        return cls(high[starts].astype("<u4"), runs.astype("<u4"), (fingerprints & ((np.uint64(1) << low) - np.uint64(1))).astype("<u8"), counts.astype("<u8"))

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.quotients), len(self.remainders)], "<u8")
        return b"".join(a.tobytes() for a in (sizes, self.quotients, self.runs, self.remainders, self.counts))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q, n = (int(x) for x in np.frombuffer(data, "<u8", 2))
        at = [16, 16 + 4 * q, 16 + 8 * q, 16 + 8 * q + 8 * n]
        return cls(np.frombuffer(data, "<u4", q, at[0]), np.frombuffer(data, "<u4", q, at[1]), np.frombuffer(data, "<u8", n, at[2]), np.frombuffer(data, "<u8", n, at[3]))


def _filters(batches: Iterator[pa.RecordBatch], shard_bits: int) -> Iterator[pa.RecordBatch]:
    def out(f: CountingQuotientFilter) -> pa.RecordBatch:
        all_, counts = f.fingerprints(), f.counts
        shards = (all_ >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(all_), np.int64)
        ids, starts = np.unique(shards, return_index=True)
        parts = [CountingQuotientFilter.of(a, c).to_bytes() for a, c in zip(np.split(all_, starts[1:]), np.split(counts, starts[1:]))]
        return pa.record_batch({"shard": pa.array(ids, pa.int64()), "filter": pa.array(parts, pa.binary())})

    own = None
    for batch in batches:
        new = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        new = CountingQuotientFilter.of(new, np.ones(len(new), np.uint64))
        own = own.merged(new) if own else new
        if len(own.remainders) > 4 * SHARD_ROWS:
            yield out(own)
            own = None
    if own and len(own.remainders):
        yield out(own)


def _repeated(parts: pa.Table) -> pa.Table:
    own = [CountingQuotientFilter.from_bytes(x) for x in parts.column("filter").to_pylist()]
    while len(own) > 1:  # two at a time, so that each fingerprint is copied as often as the number of filters can be halved
        own = [a.merged(*b) for a, *b in (own[i : i + 2] for i in range(0, len(own), 2)) if b] + (own[-1:] if len(own) % 2 else [])
    whole = own[0]
    again = whole.fingerprints()[whole.counts > 1].view(np.int64)
    return pa.table({"fp": pa.array(again, pa.int64())})


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """The values of prints' only column, a long, that occur more than once. rows: about how many there are."""
    bits = max(4, (rows // SHARD_ROWS).bit_length())
    filters = prints.mapInArrow(lambda it: _filters(it, bits), "shard long, filter binary")
    return filters.groupBy("shard").applyInArrow(_repeated, "fp long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 and n_chars (code points)."""
    text = text_of()
    whole = docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), no_space(text).alias("norm"))
    prints = saved(whole.select("doc_id", "n_chars", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row")))
    again = saved(repeated_fingerprints(prints.select("fp"), prints.count()))
    routed = whole.withColumn("fp", F.xxhash64("norm")).join(checked(again, BROADCAST_ROWS), "fp", "left_semi")
    classes = (
        routed.groupBy("norm")  # the bytes themselves are the key; copies collapse before the shuffle
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("n_chars", (-F.col("doc_id")).alias("minus"))).alias("best"))
        .select(F.sha2("norm", 256).alias("text_sha256"), "group_size", F.col("best.n_chars").alias("keep_chars"), (-F.col("best.minus")).alias("class_keep"))
    )
    # of repeated rows that could stay the one with the least number does; partial sums first, so that no task gathers a class
    able = (F.col("n_chars") == F.col("keep_chars")) & F.col("doc_id").eqNullSafe(F.col("class_keep"))
    known = prints.join(checked(saved(classes), BROADCAST_ROWS), "text_sha256").where(able)
    known = known.groupBy("text_sha256").agg(F.min("row").alias("keep_row"), F.first("group_size").alias("group_size"), F.first("class_keep").alias("class_keep"))
    joined = prints.join(checked(saved(known), BROADCAST_ROWS), "text_sha256", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("class_keep")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("keep_row").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
        "n_chars",
    )


def _matching(docs: DataFrame, keyed: DataFrame, keys: dict, how: str) -> DataFrame:
    named = docs.withColumns({f"__{k}": e for k, e in keys.items()})
    there = keyed.select(*[F.col(k).alias(f"__right_{k}") for k in keys])
    same = [F.col(f"__{k}").eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    return named.join(checked(there, BROADCAST_ROWS), same, how).select(*docs.columns)


def without_rows(docs: DataFrame, gone: DataFrame, keys: dict) -> DataFrame:
    """docs without the rows whose keys are in gone. keys: gone's columns by expressions over docs; nulls are equal."""
    return _matching(docs, gone, keys, "left_anti")


def with_rows(docs: DataFrame, there: DataFrame, keys: dict) -> DataFrame:
    """The rows of docs whose keys are in there."""
    return _matching(docs, there, keys, "left_semi")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    groups = saved(exact_groups(docs))
    own = {"doc_id": F.col("doc_id"), "text_sha256": F.sha2(no_space(text_of()), 256), "n_chars": F.length(text_of()).cast("long")}
    keys = list(own)
    gone = groups.where(~F.col("kept")).select(*keys).distinct()
    twice = saved(gone.intersect(groups.where("kept").select(*keys)))  # rows that are dropped and kept: repeated ones
    rest = without_rows(docs, saved(gone), own)
    if twice.isEmpty():
        return rest
    back = with_rows(docs.withColumn("__sha", own["text_sha256"]), twice, own).dropDuplicates(["doc_id", "__sha"])
    return rest.unionByName(back.select(*docs.columns))
