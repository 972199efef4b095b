"""SimHash near-dedup: 64-bit fingerprints linked at a small Hamming distance, found in BK-trees.

Fingerprints are dealt to shards that any two within the radius must share: the bits are cut into blocks, and
with at most `radius` differing bits some choice of the other blocks agrees in full. A shard's distinct
fingerprints form one BK-tree (children keyed by their integer distance to the parent), a search follows
only the edges within the radius, and found fingerprints leave the tree, so a dense group costs no
pairs. The trees travel by shuffle and not by broadcast, as their size has no bound. The number of blocks
follows the number of fingerprints; shards that are large all the same are dealt again by more blocks, as often as that helps.

Null and empty texts have the fingerprint zero and link like any other. A null doc_id takes part; a group
of null ids only has a null component. Repeated rows stay rows of their own. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmark.llm.common import partitions, saved
from panelmark.llm.components import components
from panelmark.llm.exact import with_rows, without_rows

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Mean fingerprints of a shard, and how many make a shard large.
SHARD_MEAN, SHARD_LARGE = 8, 4096
#: Blocks up to which large shards are dealt again, with more of them each time.
MOST_BLOCKS = 13


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of UTF-8 text as a signed 64-bit integer."""
    words = text.lower().split()  # bytes.lower and bytes.split know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_digest
    total, n = np.zeros(64, np.int64), len(words) - k + 1
    starts, ends = starts[:n].tolist(), ends[k - 1 :].tolist()
    for at in range(0, n, 1 << 15):
        part = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])])
        total += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > n).view(">i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array([fingerprint(t or b"", shingle) for t in texts], pa.int64())})


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (long) of every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_fingerprints, shingle=shingle), "doc_id long, fp long")


class BKTree:
    """Children keyed by the integer Hamming distance to their parent; taken items leave their subtree's count."""

    def __init__(self, items: list[int]):
        self.items, self.children, self.parent, self.alive = items, [{} for _ in items], [-1] * len(items), [1] * len(items)
        for i in range(1, len(items)):
            at, x = 0, items[i]
            while True:
                self.alive[at] += 1
                d = (items[at] ^ x).bit_count()
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d], self.parent[i] = i, at
                    break
                at = nxt
        self.there = [True] * len(items)

    def take(self, i: int) -> None:
        self.there[i] = False
        while i >= 0:
            self.alive[i] -= 1
            i = self.parent[i]

    def near(self, x: int, radius: int) -> list[int]:
        """The items left within the radius of x."""
        found, todo = [], [0] if self.alive[0] else []
        while todo:
            at = todo.pop()
            d = (self.items[at] ^ x).bit_count()
            if d <= radius and self.there[at]:
                found.append(at)
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius and self.alive[child]:
                    todo.append(child)
        return found


def linked(items: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges that span the groups of distinct unsigned items linked within the radius."""
    if len(items) == 2:
        return [(items[0], items[1])] if (items[0] ^ items[1]).bit_count() <= radius else []
    tree, edges = BKTree(items), []
    for i in range(len(items)):
        if not tree.there[i]:
            continue
        tree.take(i)
        todo = [i]
        while todo:
            for j in tree.near(items[todo.pop()], radius):
                tree.take(j)
                todo.append(j)
                edges.append((items[i], items[j]))
    return edges


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    def out(items: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        edges = []
        ends = np.r_[starts[1:], len(items)]
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            edges += linked(items[a:b].tolist(), radius)
        pairs = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.record_batch({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    held: list[np.ndarray] = []  # rows of the shard that may go on in the next batch
    for batch in batches:
        now = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if held and now.shape[1] and (held[-1][:2, -1] == now[:2, -1]).all():
            held.append(now)
            continue
        rows = np.concatenate([*held, now], axis=1)
        if not rows.shape[1]:
            continue
        starts = np.flatnonzero(np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])
        held = [rows[:, starts[-1] :]]
        yield out(rows[2, : starts[-1]].view(np.uint64), starts[:-1])
    if held:
        rows = np.concatenate(held, axis=1)
        starts = np.flatnonzero(np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])
        yield out(rows[2].view(np.uint64), starts)


def masks(blocks: int, radius: int) -> list[int]:
    """For each choice of the blocks that must agree, their bits, signed."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    own = [sum(1 << bit for bit in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    each = [sum(chosen) for chosen in combinations(own, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in each]


def blocks_for(n: int, radius: int) -> int:
    """The fewest blocks whose agreeing bits leave n evenly spread fingerprints about SHARD_MEAN to a shard."""
    blocks = radius + 1
    while 64 * (blocks - radius) // blocks < 62 and n / 2.0 ** (64 * (blocks - radius) // blocks) > SHARD_MEAN:
        blocks += 1
    return blocks


def _dealt(distinct: DataFrame, blocks: int, radius: int) -> DataFrame:
    cases = F.array(*[F.struct(F.lit(i).cast("long").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("agreed")) for i, m in enumerate(masks(blocks, radius))])
    return distinct.select(F.explode(cases).alias("k"), "fp").select("k.choice", "k.agreed", "fp")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct: distinct values fp (long), saved. Edges (a, b) that span all groups linked within the radius."""
    spark = distinct.sparkSession
    blocks, choices, parts = blocks_for(distinct.count(), radius), 0, []
    while True:
        dealt = _dealt(distinct, blocks, radius).withColumn("choice", F.col("choice") + choices)
        large = saved(dealt.groupBy("choice", "agreed").count().where(F.col("count") > SHARD_LARGE).select("choice", "agreed"))
        if blocks + 3 > MOST_BLOCKS or large.isEmpty():  # what is large by the most blocks differs in few bits only: a dense group, which trees take at once
            parts.append(dealt)
            break
        parts.append(dealt.join(large, ["choice", "agreed"], "left_anti"))
        distinct = saved(dealt.join(large, ["choice", "agreed"], "left_semi").select("fp").distinct())
        choices, blocks = choices + comb(blocks, radius), blocks + 3
    sorted_ = reduce(DataFrame.union, parts).repartition(partitions(spark), "choice", "agreed").sortWithinPartitions("choice", "agreed")
    return sorted_.mapInArrow(partial(_search, radius=radius), "a long, b long")


def _grouped(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """One row per row of docs: doc_id, fp, root, a number of its group, and component_id, the group's smallest doc_id."""
    prints = saved(fingerprints(docs, shingle))
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = saved(components(links(distinct.select("fp"), radius)))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_print = rooted.join(of_root, "root").select("fp", "root", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "root", "component_id")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id, its smallest doc_id."""
    return _grouped(docs, shingle, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each group, the one with the smallest doc_id (null last), with all columns of docs.

    Of several rows with that id the one with the least fingerprint, and of these with the least text, stays. One id
    can lead several groups, and a null id leads all groups of null ids only; each of them keeps its row.
    """
    groups = saved(_grouped(docs, shingle, radius))
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    twice = groups.groupBy("doc_id").count().where("count > 1").select("doc_id")
    twice = saved(twice)
    rest = without_rows(docs, saved(gone.union(twice).distinct()), {"doc_id": F.col("doc_id")})
    if twice.isEmpty():
        return rest
    # repeated ids: the row is chosen among all with the id, for each group that the id leads; equal rows are one
    own = {"doc_id": F.col("doc_id")}
    leads = with_rows(groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))), twice, own)
    leads = leads.groupBy("root").agg(F.first("doc_id").alias("doc_id"), F.min("fp").alias("fp")).select("doc_id", "fp")
    prints = with_rows(docs, twice, own).select("doc_id", "text").distinct().mapInArrow(partial(_printed, shingle=shingle), "doc_id long, text string, fp long")
    chosen = with_rows(prints, saved(leads), {"doc_id": F.col("doc_id"), "fp": F.col("fp")})
    firsts = saved(chosen.groupBy("doc_id", "fp").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))
    back = with_rows(docs.withColumn("__text", F.coalesce("text", F.lit(""))), firsts, {"doc_id": F.col("doc_id"), "text": F.col("__text")})
    return rest.unionByName(back.dropDuplicates(["doc_id", "__text"]).select(*docs.columns))


def _printed(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        yield pa.record_batch({"doc_id": batch.column(0), "text": batch.column(1), "fp": pa.array([fingerprint(t or b"", shingle) for t in texts], pa.int64())})
