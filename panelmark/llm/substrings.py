"""Suffix-array dedup: repeated byte strings of LEAST bytes and more, found as maximal repeats.

Equal strings of LEAST bytes choose equal anchors (the leftmost of the least hashes of their GRAM-byte parts), so strings
are dealt by the anchor's hash: (1) anchors that occur once are dropped, by counting hashes gathered by part;
(2) the runs of strings about a repeated anchor go to the anchor's bucket, a run that a part has already sent is not
sent again but removed at once; (3) a bucket sorts its suffixes into an enhanced suffix array, a stack
scans the common prefixes into the interval tree, and an interval whose occurrences differ in the byte to their left (or
have none in the bucket) is a maximal repeat; all its occurrences but the first are removed; (4) removed
spans go back to their documents. Anchors with very many occurrences are dealt string by string.

Hashes only deal out work; bytes decide. A null text is empty. The order of documents is doc_id, null last, rows with
equal doc_id by the hash of their text. Matches never cross rows. Texts below LEAST bytes and empty tables give rows
without removals, and an empty result. Removal may cut a character's bytes, so what is kept is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmark.llm.common import partitions, saved, text_of

LEAST = 100
GRAM = 32
#: Bytes hashed at once; suffixes sorted at once (more if one anchor has more); occurrences of a very frequent anchor.
BLOCK, SUFFIXES, FREQUENT = 1 << 19, 150_000, 20_000
#: Bytes of text in a part, about; parts are at least as many as shuffle partitions.
PART = 1 << 24

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]  # any odd numbers
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def anchored_runs(text: np.ndarray, ends: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchor's hash, first and last start of each run of strings with one anchor. text: bytes of documents that end at ends."""
    n = len(text)
    if n < least:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1)).copy().view("<u8").ravel()
    m = n - gram + 1
    h = np.zeros(m, np.uint64)
    for i in range(0, gram, 8):
        h = (h ^ words[i : i + m]) * _ODD[i // 8 % 4]
        h ^= h >> np.uint64(31)
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    h ^= h >> np.uint64(32)
    key = (h & _HIGH) | np.arange(m, dtype=np.uint64)
    wide, span = least - gram + 1, 1
    while 2 * span <= wide:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if wide > span:
        key = np.minimum(key[: span - wide], key[wide - span :])
    at = (key & _LOW).astype(np.int64)
    inside = np.ones(n + least, bool)
    for e in ends.tolist():
        inside[max(0, e - least + 1) : e] = False  # strings that would begin here cross the end
    start = np.flatnonzero(inside[: len(at)])
    if not len(start):
        return np.zeros(0, np.uint64), start, start
    at = at[start]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    return h[at[first]], start[first], start[np.r_[first[1:], len(start)] - 1]


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The first text's number, the bytes and the ends of consecutive texts of about BLOCK bytes."""
    at = 0
    while at < len(texts):
        k, size = at, 0
        while k < len(texts) and (k == at or size + len(texts[k]) <= BLOCK):
            size += len(texts[k])
            k += 1
        yield at, np.frombuffer(b"".join(texts[at:k]), np.uint8), np.cumsum([len(t) for t in texts[at:k]])
        at = k


def _texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _count_anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, packed): hash, part and occurrences of each anchor."""
    kind = np.dtype([("h", "<u8"), ("part", "<u4"), ("n", "<u4")])
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows["part"], rows["h"]))]
        held.clear()
        first = np.flatnonzero(np.r_[True, (rows["h"][1:] != rows["h"][:-1]) | (rows["part"][1:] != rows["part"][:-1])])
        n = np.add.reduceat(rows["n"], first)
        rows = rows[first]
        rows["n"] = n
        bucket = (rows["h"] % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        ids, starts = np.unique(bucket[order], return_index=True)
        return pa.record_batch({"bucket": pa.array(ids, pa.int32()), "packed": pa.array([x.tobytes() for x in np.split(rows[order], starts[1:])], pa.binary())})

    for batch in batches:
        parts, texts = batch.column(0).to_numpy(), _texts(batch.column(1))
        for at, text, ends in _blocks(texts):
            h, first, _ = anchored_runs(text, ends)
            rows = np.empty(len(h), kind)
            rows["h"], rows["part"], rows["n"] = h, parts[at + np.searchsorted(ends, first, side="right")], 1
            if len(rows):
                held.append(rows)
        if sum(map(len, held)) > 1_000_000:
            yield out()
    if held:
        yield out()


def _repeated_anchors(rows: pa.Table) -> pa.Table:
    """Rows (part, anchors, frequent) of the anchors that occur more than once, for each part that has them."""
    kind = np.dtype([("h", "<u8"), ("part", "<u4"), ("n", "<u4")])
    all_ = np.frombuffer(b"".join(rows.column("packed").to_pylist()), kind)
    all_ = all_[np.argsort(all_["h"], kind="stable")]
    first = np.flatnonzero(np.r_[True, all_["h"][1:] != all_["h"][:-1]])
    total = np.repeat(np.add.reduceat(all_["n"].astype(np.int64), first), np.diff(np.r_[first, len(all_)]))
    all_, total = all_[total > 1], total[total > 1]
    order = np.argsort(all_["part"], kind="stable")
    all_, total = all_[order], total[order]
    ids, starts = np.unique(all_["part"], return_index=True)
    cut = lambda x: [y.tobytes() for y in np.split(x, starts[1:])] if len(ids) else []
    return pa.table({"part": pa.array(ids.astype(np.int32), pa.int32()), "anchors": pa.array(cut(all_["h"]), pa.binary()), "frequent": pa.array(cut((total > FREQUENT).astype(np.uint8)), pa.binary())})


def _in_order(docs: pa.Table) -> pa.Table:
    """A part's documents in their order; `hash` orders equal ids and equal texts need no order."""
    return docs.take(pc.sort_indices(docs, sort_keys=[("doc_id", "ascending"), ("hash", "ascending")], null_placement="at_end"))


_RUNS = "bucket int, anchor long, doc_id long, part int, place int, start int, stop int, run binary"
_SPANS = "part int, place int, start int, stop int"


def _send_runs(docs: pa.Table, hits: pa.Table, buckets: int) -> pa.Table:
    """The part's runs about repeated anchors; repeats within the part as spans to remove, without bytes."""
    names = [x.split()[0] for x in _RUNS.split(", ")]
    schema = pa.schema(list(zip(names, [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()])))
    out: list[tuple] = []
    if hits.num_rows and docs.num_rows:
        anchors = np.frombuffer(b"".join(hits.column("anchors").to_pylist()), "<u8")
        frequent = np.frombuffer(b"".join(hits.column("frequent").to_pylist()), np.uint8)
        order = np.argsort(anchors)
        anchors, frequent = anchors[order], frequent[order]
        docs = _in_order(docs)
        part, ids, texts = docs.column("part")[0].as_py(), [(1 << 63) - 1 if i is None else i for i in docs.column("doc_id").to_pylist()], _texts(docs.column("text"))
        sent: set[bytes] = set()

        def send(anchor: int, doc: int, start: int, run: bytes) -> None:
            if run in sent:  # sent from an earlier place of this part
                out.append((-1, 0, ids[doc], part, doc, start, start + len(run), None))
            else:
                sent.add(run)
                out.append((anchor % buckets, anchor - (1 << 64) if anchor >> 63 else anchor, ids[doc], part, doc, start, start + len(run), run))

        for at, text, ends in _blocks(texts):
            h, first, last = anchored_runs(text, ends)
            where = np.searchsorted(anchors, h)
            where[where == len(anchors)] = 0
            there = np.flatnonzero(anchors[where] == h)
            doc = np.searchsorted(ends, first[there], side="right")
            base = np.r_[0, ends[:-1]][doc]
            for anchor, many, d, a, b in zip(h[there].tolist(), frequent[where[there]].tolist(), (at + doc).tolist(), (first[there] - base).tolist(), (last[there] - base + LEAST).tolist()):
                if many:
                    for s in range(a, b - LEAST + 1):
                        one = texts[d][s : s + LEAST]
                        send(xxhash.xxh64_intdigest(one), d, s, one)
                else:
                    send(anchor, d, a, texts[d][a:b])
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 8, schema)], schema=schema)


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """The tree of common-prefix intervals with a length of at least `least`, children first: (length, first, last, items).

    lcp[i] is the common prefix of the suffixes i - 1 and i; lcp[0] is not read. items: the interval's own suffixes and,
    as -1 - k, the k-th interval yielded before for each child.
    """
    stack: list[list] = []  # length, first, items
    done = 0
    n = len(lcp)
    for i in range(1, n + 1):
        now = lcp[i] if i < n else 0
        begin, carried = i - 1, i - 1
        while stack and stack[-1][0] > now:
            length, begin, items = stack.pop()
            if carried is not None:
                items.append(carried)
            yield length, begin, i - 1, items
            carried = -1 - done
            done += 1
        if now < least:
            continue  # the stack is empty: everything on it was longer
        if not stack or stack[-1][0] < now:
            stack.append([now, begin, [carried]])
        else:
            stack[-1][2].append(carried)


def maximal_repeats(runs: list[bytes], least: int = LEAST) -> Iterator[tuple[int, list[tuple[int, int]], list[tuple[int, int]]]]:
    """Maximal repeats of the runs: length, all occurrences (run, start), and those to remove that no longer repeat has removed.

    An occurrence's order is its run's number, then its start. Occurrences of a maximal repeat but the first are all in the
    third list of it or of a longer repeat that they start.
    """
    width = max(map(len, runs))
    text = np.zeros((len(runs), width), np.uint8)
    lengths = np.array([len(r) for r in runs])
    text[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(runs), np.uint8)
    n_of = np.maximum(lengths - least + 1, 0)
    run = np.repeat(np.arange(len(runs)), n_of)
    start = np.arange(len(run)) - np.repeat(np.cumsum(n_of) - n_of, n_of)
    if not len(run):
        return
    flat = np.concatenate([text.ravel(), np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.as_strided(flat, (len(flat) - width + 1, width), (1, 1))[run * width + start]
    left = np.where(start > 0, flat[np.maximum(run * width + start - 1, 0)].astype(np.int32), -1 - np.arange(len(run)))  # no byte: unlike any other
    size = lengths[run] - start
    rows[np.arange(width) >= size[:, None]] = 0
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
    rows, left, size = rows[order], left[order], size[order]
    same = rows[1:] == rows[:-1]
    lcp = np.where(same.all(axis=1), width, same.argmin(axis=1))
    lcp = np.r_[0, np.minimum(lcp, np.minimum(size[1:], size[:-1]))]
    changes = np.cumsum(np.r_[0, left[1:] != left[:-1]])
    bounds = np.flatnonzero(np.r_[lcp, 0] < least)
    sa, order_ = list(zip(run[order].tolist(), start[order].tolist())), order.tolist()  # order is by run and start, so it ranks occurrences
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a < 2:
            continue
        best: list[int] = []
        for length, first, last, items in intervals([0, *lcp[a + 1 : b].tolist()], least):
            own = [a + i if i >= 0 else best[-1 - i] for i in items]
            least_one = min(own, key=order_.__getitem__)
            best.append(least_one)
            if changes[a + last] > changes[a + first]:
                yield length, sa[a + first : a + last + 1], [sa[i] for i in own if i != least_one]


def _resolve(rows: pa.Table) -> pa.Table:
    """Spans to remove, of the runs of one bucket."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[(k, "ascending") for k in ("anchor", "doc_id", "part", "place", "start")]))
    anchors, runs = rows.column("anchor").to_numpy(), rows.column("run").to_pylist()
    part, place, start = (rows.column(k).to_pylist() for k in ("part", "place", "start"))
    cuts = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1], True]).tolist()
    out: list[tuple[int, int, int, int]] = []
    held: list[int] = []  # runs of several anchors, sorted together; strings of different anchors are never equal
    size = 0

    def solve() -> None:
        stops: dict[int, list[tuple[int, int]]] = {}
        for length, _, gone in maximal_repeats([runs[i] for i in held]):
            for run, s in gone:
                stops.setdefault(held[run], []).append((s, s + length))
        for i, spans in stops.items():
            out.extend((part[i], place[i], start[i] + x, start[i] + y) for x, y in union(spans))

    for a, b in zip(cuts, cuts[1:]):
        distinct: set[bytes] = set()
        own = []
        for i in range(a, b):
            if runs[i] in distinct:  # a whole run from an earlier place
                out.append((part[i], place[i], start[i], start[i] + len(runs[i])))
            else:
                distinct.add(runs[i])
                own.append(i)
        if len(own) > 1:
            held += own
            size += sum(len(runs[i]) - LEAST + 1 for i in own)
        if size > SUFFIXES:
            solve()
            held, size = [], 0
    if held:
        solve()
    return pa.table([pa.array(c, pa.int32()) for c in (zip(*out) if out else [[]] * 4)], names=["part", "place", "start", "stop"])


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans merged where they overlap or touch, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_KEPT = "doc_id long, n_bytes long, removed array<struct<start: long, stop: long>>, kept binary, kept_sha256 string"


def _apply(docs: pa.Table, spans: pa.Table) -> pa.Table:
    docs = _in_order(docs)
    by: dict[int, list[tuple[int, int]]] = {}
    for p, a, b in zip(*(spans.column(k).to_pylist() for k in ("place", "start", "stop"))):
        by.setdefault(p, []).append((a, b))
    texts = _texts(docs.column("text"))
    gone = [union(by.get(i, [])) for i in range(len(texts))]
    kept = []
    for text, cut in zip(texts, gone):
        at, pieces = 0, []
        for a, b in cut:
            pieces.append(text[at:a])
            at = b
        kept.append(b"".join([*pieces, text[at:]]) if cut else text)
    removed = pa.array([[{"start": a, "stop": b} for a, b in g] for g in gone], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
    return pa.table({
        "doc_id": docs.column("doc_id"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "removed": removed,
        "kept": pa.array(kept, pa.binary()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
    })


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, the removed spans of bytes, the kept bytes and their SHA-256."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(docs.sparkSession), -(-size // PART))  # parts and buckets are groups in memory: they follow the bytes
    hash_ = F.xxhash64("doc_id", "text")
    dealt = docs.select(F.col("doc_id").cast("long"), text_of().cast("binary").alias("text")).withColumn("hash", hash_).withColumn("part", F.pmod("hash", F.lit(n)).cast("int"))
    counted = dealt.select("part", "text").mapInArrow(partial(_count_anchors, buckets=n), "bucket int, packed binary")
    hits = saved(counted.groupBy("bucket").applyInArrow(_repeated_anchors, "part int, anchors binary, frequent binary"))
    runs = saved(dealt.groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(partial(_send_runs, buckets=n), _RUNS))
    found = runs.where("bucket >= 0").groupBy("bucket").applyInArrow(_resolve, _SPANS)
    spans = saved(found.union(runs.where("bucket < 0").select("part", "place", "start", "stop")))
    return dealt.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(_apply, _KEPT)
