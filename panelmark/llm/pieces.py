"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut where no piece can lie across (between two characters that stand side by side in no piece). Each
distinct stretch is encoded once: its substrings of bounded length are exploded and equi-joined to the piece
table, the edges are grouped by stretch, and Spark's higher-order aggregate folds them. What is folded follows the
model: for a unigram table Viterbi, the best score up to every character, where ties go to the longer last piece; for a
table made by merges the merges, as the library does them: of all neighbours that together are a piece those with the best
score, the leftmost first, become one. (The highest sum of such a table's ranks is another segmentation.) Both give
the library's ids. Characters without a piece are written as byte pieces.

Chunks of the corpus number their own words and get the encoded ones back, so that texts are not shuffled: chunks are
stored in buckets and the encoded stretches travel to them.

A null text counts as empty and has no ids. Decoding is exact but for the character U+2581, which stands for the space.
Repeated rows and null ids are rows like others; an empty table gives an empty result. Stretches of over LONG
characters (LONG_MERGED for merges) are folded outside Spark by the same rule, as a fold's steps grow with the square.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmark.llm.chunks import offsets_of, packed, slices, strings_of, unified, unpacked
from panelmark.llm.common import partitions, saved_by, text_of
from panelmark.llm.minhash import let

#: The vocabulary file that the query uses; a parameter of everything below.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Bytes of text that number their words together, and bytes that are cut into words at once (more if one text has more).
CHUNK, SLICE = 1 << 25, 1 << 20
#: Words or stretches that are worked on at once in what has some bytes for each character.
SOME = 1 << 15
#: Characters of a stretch that is folded in Spark: by Viterbi; by merges, where all borders fit one long.
LONG, LONG_MERGED = 512, 61
#: Bits of an edge's key below the one that says that its piece is odd(): its rank, first character and length.
RANK_BITS, START_BITS, LENGTH_BITS = 22, 6, 5


@dataclass(frozen=True)
class Pieces:
    """Pieces that texts can have by surface, with id and score; the ids of the 256 byte pieces; surfaces of all ids.

    merges: whether the table was made by merges, and not as a unigram model.
    """

    scores: dict[str, tuple[int, float]]
    bytes_: tuple[int, ...]
    surfaces: tuple[bytes, ...]
    merges: bool = False

    @classmethod
    def load(cls, model: str = MODEL) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = proto.SentencePiece
        scores, surfaces, bytes_ = {}, [], [next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                bytes_[value] = i
                surfaces.append(bytes([value]))
            elif p.type in (kinds.CONTROL, kinds.UNKNOWN):
                surfaces.append(b"")
            else:
                scores[p.piece] = (i, p.score)
                surfaces.append(p.piece.replace(SPACE, " ").encode())
        return cls(scores, tuple(bytes_), tuple(surfaces), proto.trainer_spec.model_type == proto.trainer_spec.BPE)

    @property
    def longest(self) -> int:
        return max(map(len, self.scores), default=1)

    @property
    def most(self) -> int:
        """Characters of the longest stretches that are folded in Spark."""
        return LONG_MERGED if self.merges else LONG

    @property
    def unknown(self) -> float:
        return min((s for _, s in self.scores.values()), default=0.0) - UNKNOWN_PENALTY

    def joints(self) -> set[str]:
        return {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}

    def ranks(self) -> dict[str, int]:
        """The pieces' places by score, the best first; equal scores are one place."""
        place = {s: i for i, s in enumerate(sorted({s for _, s in self.scores.values()}, reverse=True))}
        return {p: place[s] for p, (_, s) in self.scores.items()}

    def odd(self) -> set[str]:
        """Pieces that merging does not make from their own characters by better scores only, and those that share a score.

        Without one of them in a stretch no merge makes a better one possible that was not possible before: what lies between the
        ends of a better piece has by then been merged as it would be alone, to that piece.
        """
        place, shared = self.ranks(), Counter(s for _, s in self.scores.values())

        def regular(p: str) -> bool:
            steps = [place[q] for q in self._merges(p)]
            return bool(steps) and steps[-1] == place[p] and steps == sorted(steps) and self.merged(p) == [self.scores[p][0]]

        return {p for p, (_, s) in self.scores.items() if len(p) > 1 and (shared[s] > 1 or not regular(p))}

    def viterbi(self, stretch: str) -> list[int]:
        """The ids of a stretch by the best sum of scores; -1 - c for a character c without a piece."""
        best, back = [0.0] + [-np.inf] * len(stretch), [(0, 0)] * (len(stretch) + 1)
        for end in range(1, len(stretch) + 1):
            for start in range(max(0, end - self.longest), end):
                i, s = self.scores.get(stretch[start:end], (None, 0.0))
                if i is None:
                    if end - start > 1:
                        continue
                    i, s = -1 - ord(stretch[start]), self.unknown
                if best[start] + s > best[end]:
                    best[end], back[end] = best[start] + s, (start, i)
        ids, at = [], len(stretch)
        while at:
            at, i = back[at]
            ids.append(i)
        return ids[::-1]

    def _merges(self, stretch: str, ends: list[int] | None = None) -> Iterator[str]:
        """The pieces that merging makes, in its order, from a heap. ends: where the token that begins at a place ends, 0 if none begins there."""
        n = len(stretch)
        ends = ends if ends is not None else list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(start: int) -> None:
            middle = ends[start]
            if middle < n and (found := self.scores.get(stretch[start : ends[middle]])):
                heapq.heappush(heap, (-found[1], start, middle, ends[middle]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, start, middle, end = heapq.heappop(heap)
            if ends[start] != middle or ends[middle] != end:
                continue
            ends[start], ends[middle] = end, 0
            yield stretch[start:end]
            if end < n:
                before[end] = start
            if start:
                offer(before[start])
            offer(start)

    def merged(self, stretch: str) -> list[int]:
        """The ids of a stretch by merges; -1 - c for a character c that is left alone."""
        ends = list(range(1, len(stretch) + 1))
        for _ in self._merges(stretch, ends):
            pass
        ids, at = [], 0
        while at < len(stretch):
            ids.append(-1 - ord(stretch[at]) if ends[at] == at + 1 else self.scores[stretch[at : ends[at]]][0])
            at = ends[at]
        return ids

    def segmented(self, stretch: str) -> list[int]:
        return self.merged(stretch) if self.merges else self.viterbi(stretch)

    def ids_of(self, token: str) -> list[int]:
        """The id of a piece, else the byte pieces of a character."""
        found = self.scores.get(token)
        return [found[0]] if found else [self.bytes_[b] for b in token.encode("utf-8", "surrogatepass")]

    def spelt(self, ids: list[int]) -> list[int]:
        """ids with characters as their pieces, or byte pieces where they have none."""
        return [j for i in ids for j in ([i] if i >= 0 else self.ids_of(chr(-1 - i)))]

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.surfaces[i] for i in ids])
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


_ENCODED = "chunk long, doc_id long, ids binary, lengths binary, inner binary, stretches array<string>"
_SCHEMA = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("inner", pa.binary()), ("stretches", pa.list_(pa.large_string()))])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of non-empty texts one after the other, each with the spaces before it as SPACE, and how many each text has.

    Spaces at a text's end are a word; one more space stands before each text.
    """
    split = pc.split_pattern(texts.cast(pa.large_string()), " ")
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), split.flatten(), pa.scalar("", pa.large_string()))
    offsets = offsets_of(words)
    empty = np.diff(offsets) == len(SPACE.encode())
    if empty.any():  # what stands between two spaces goes to the word after it
        begins = np.cumsum(counts) - counts
        starts = np.r_[True, ~empty[:-1]]
        starts[begins] = True
        counts = np.add.reduceat(starts.astype(np.int64), begins)
        words = strings_of(np.r_[offsets[:-1][starts], offsets[-1]], words.buffers()[2])
    return words, counts


@cache
def _classes(joints: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """The class of each character, and whether two classes are side by side in a piece; class 0 is in no joint."""
    chars = sorted({c for j in joints for c in j})
    of = np.zeros(0x110000, np.uint16)
    of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
    table = np.zeros((len(chars) + 1, len(chars) + 1), bool)
    for j in joints:
        table[of[ord(j[0])], of[ord(j[1])]] = True
    return of, table


def stretches_of(words: pa.Array, joints: frozenset[str]) -> tuple[pa.Array, np.ndarray]:
    """The stretches of the words one after the other, and how many each word has."""
    offsets, data = offsets_of(words), words.buffers()[2]
    whole = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    of, table = _classes(joints)
    kind = of[np.frombuffer(whole.tobytes().decode().encode("utf-32-le"), np.uint32)]
    at = np.flatnonzero((whole & 0xC0) != 0x80) + offsets[0]  # where characters begin
    first = np.zeros(len(at), bool)
    first[np.searchsorted(at, offsets[:-1])] = True
    begins = first | np.r_[True, ~table[kind[:-1], kind[1:]]]
    counts = np.add.reduceat(begins.astype(np.int64), np.flatnonzero(first))
    return strings_of(np.r_[at[begins], offsets[-1]].astype(np.int64), data), counts


def _cut(batches: Iterator[pa.RecordBatch], joints: frozenset[str], most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """For each chunk a row a document with its words' numbers, and a row with its words' stretches."""
    chunk, size = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24, 0
    doc_ids: list[pa.Array] = []
    counts: list[np.ndarray] = []
    words: list[pa.DictionaryArray] = []

    def numbered() -> Iterator[pa.RecordBatch]:
        numbers, vocabulary = unified(words)
        words.clear()
        own = iter(numbers)
        for docs, n in zip(doc_ids, counts):
            ends = np.cumsum(n)
            flat = next(own) if n.any() else None  # of a slice without words nothing was kept
            ids = [packed(flat[a:b]) if b > a else b"" for a, b in zip((ends - n).tolist(), ends.tolist())]
            none = pa.nulls(len(ids))
            yield pa.record_batch([pa.array(np.full(len(ids), chunk)), docs, pa.array(ids, pa.binary()), none.cast(pa.binary()), none.cast(pa.binary()), none.cast(_SCHEMA.field("stretches").type)], schema=_SCHEMA)
        if len(vocabulary):
            parts, lengths = zip(*(stretches_of(vocabulary[i : i + SOME], joints) for i in range(0, len(vocabulary), SOME)))
            inner, stretches = unified([x.dictionary_encode() for x in parts])
            one = pa.ListArray.from_arrays(pa.array([0, len(stretches)], pa.int32()), stretches)
            inner = np.diff(np.concatenate(inner), prepend=np.uint32(0))  # mostly one more than before: the next that is new
            yield pa.record_batch([[chunk], pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), [packed(np.concatenate(lengths))], [packed(inner)], one], schema=_SCHEMA)

    for batch in slices(batches, min(SLICE, most)):
        texts = batch.column(1).fill_null("")
        there = pc.not_equal(pc.binary_length(texts), 0)
        n = np.zeros(len(texts), np.int64)
        if pc.any(there).as_py():
            own, n[there.to_numpy(zero_copy_only=False)] = words_of(texts.filter(there))
            words.append(own.dictionary_encode())
        doc_ids.append(batch.column(0))
        counts.append(n)
        size += pc.sum(pc.binary_length(texts)).as_py() or 0
        if size > most:
            yield from numbered()
            chunk, size = chunk + 1, 0
            doc_ids, counts, words = [], [], []
    if doc_ids:
        yield from numbered()


def lattice(stretches: DataFrame, pieces: Pieces) -> DataFrame:
    """Edges of the distinct strings `stretch`: stretch, start, end, id, score, rank and odd.

    Of a table made by merges, single characters are no edges: they are what is left alone.
    """
    spark, least = stretches.sparkSession, 2 if pieces.merges else 1
    ranks, odd = pieces.ranks(), pieces.odd() if pieces.merges else set()
    rows = [(p, i, float(s), ranks[p], p in odd) for p, (i, s) in pieces.scores.items() if len(p) >= least]
    table = spark.createDataFrame(rows, "piece string, id int, score double, rank int, odd boolean")
    spans = stretches.select("stretch", F.length("stretch").alias("n")).where(F.col("n") >= least).select("stretch", "n", F.explode(F.sequence(F.lit(0), F.col("n") - least)).alias("start"))
    spans = spans.select("stretch", "start", F.explode(F.sequence(F.col("start") + least, F.least(F.col("start") + pieces.longest, F.col("n")))).alias("end"))
    spans = spans.withColumn("piece", F.coalesce(F.expr("substring(stretch, start + 1, end - start)"), F.lit("")))  # never null: no filter works it out a second time
    if pieces.merges:
        return spans.join(F.broadcast(table), "piece").select("stretch", "start", "end", "id", "score", "rank", "odd")  # the vocabulary: at most as large as the model's file
    edges = spans.join(F.broadcast(table), "piece", "left")
    unknown = -1 - F.ascii("piece")
    edges = edges.where("id IS NOT NULL OR end - start = 1")
    return edges.select("stretch", "start", "end", F.coalesce("id", unknown).alias("id"), F.coalesce("score", F.lit(pieces.unknown)).alias("score"), "rank", "odd")


def viterbi(edges: Column) -> Column:
    """Folds an array of (end, start, id, score) to the ids of the best path. Each end from 1 on has an edge of length 1.

    The state has for every place the best score and the edge it comes from, start and id in one long.
    """
    empty = F.struct(F.array(F.lit(0.0)).alias("best"), F.array(F.lit(0).cast("long")).alias("link"))

    def step(a: Column, e: Column) -> Column:
        total = F.get(a.best, e.start) + e.score
        last = F.size(a.best) - 1
        link = F.shiftleft(e.start.cast("long"), 32).bitwiseOR(e.id.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
        put = lambda x, v: F.concat(F.slice(x, 1, e.end), F.array(v))
        return F.when((e.end > last) | (total > F.get(a.best, last)), F.struct(put(a.best, total).alias("best"), put(a.link, link).alias("link"))).otherwise(a)

    def walk(a: Column) -> Column:
        start = F.struct((F.size(a.link) - 1).alias("at"), F.array().cast("array<int>").alias("ids"))

        def back(s: Column, _: Column) -> Column:
            link = F.get(a.link, s.at)
            low = F.shiftright(F.shiftleft(link, 32), 32).cast("int")  # with its sign
            return F.when(s.at > 0, F.struct(F.shiftrightunsigned(link, 32).cast("int").alias("at"), F.concat(F.array(low), s.ids).alias("ids"))).otherwise(s)

        return F.aggregate(a.link, start, back, lambda s: s.ids)

    return F.aggregate(F.array_sort(edges), empty, step, walk)


ODD_BIT = RANK_BITS + START_BITS + LENGTH_BITS


def merging_edge() -> Column:
    """An edge of a stretch of at most LONG_MERGED characters: a key, whose order is by odd, rank, then start, the bits of its ends and of
    the borders that can lie between them."""
    up = lambda x, n: F.call_function("shiftleft", x, n)
    key, length, one = F.col("odd").cast("long"), F.col("end") - F.col("start"), F.lit(1).cast("long")
    for part, bits in ((F.col("rank"), RANK_BITS), (F.col("start"), START_BITS), (length, LENGTH_BITS)):
        key = F.shiftleft(key, bits).bitwiseOR(part.cast("long"))
    return F.struct(key.alias("key"), up(up(one, length) + 1, F.col("start")).alias("ends"), up(up(one, length) - 2, F.col("start")).alias("inner"))


def merged(stretch: Column, edges: Column) -> Column:
    """Folds merging_edge()s to the borders between the tokens that merging gives, a long with a bit for each.

    An edge can be merged when both its ends are borders and exactly one border is inside, which goes. Without an odd() piece one
    walk over the edges by rank and start does all merges in their order; with one, each step looks for the first edge that can be merged.
    """
    n, one, odd = F.length(stretch), F.lit(1).cast("long"), 1 << ODD_BIT
    begin = F.call_function("shiftleft", one, n + 1) - 1
    able = lambda b, e: (b.bitwiseAND(e.ends) == e.ends) & (F.bit_count(b.bitwiseAND(e.inner)) == 1)

    def walk(own: Column) -> Column:
        return F.aggregate(own, begin, lambda b, e: F.when(able(b, e), b.bitwiseAND(F.bitwise_not(e.inner))).otherwise(b))

    def steps(own: Column) -> Column:
        first = lambda b: F.aggregate(own, F.lit(0).cast("long"), lambda a, e: F.when(a != 0, a).when(able(b, e), e.inner).otherwise(a))
        return F.aggregate(F.sequence(F.lit(2), n), begin, lambda b, _: b.bitwiseAND(F.bitwise_not(first(b))))

    plain = F.sort_array(F.transform(edges, lambda e: e.withField("key", e.key.bitwiseAND(F.lit(odd - 1)))))
    return let(F.sort_array(edges), lambda own: F.when(F.element_at(own, -1).key < odd, walk(own)).otherwise(let(plain, steps)))


def encoded_stretches(stretches: DataFrame, pieces: Pieces) -> DataFrame:
    """stretch and ids of distinct strings of the column `stretch`; -1 - c for a character c without a piece.

    For a table made by merges, stretch and merged()'s borders; stretches in which nothing is merged have no row.
    """
    edges = lattice(stretches, pieces)
    edge, fold = (merging_edge(), merged(F.col("stretch"), F.col("edges")).alias("borders")) if pieces.merges else (F.struct("end", "start", "id", "score"), viterbi(F.col("edges")).alias("ids"))
    return edges.select("stretch", edge.alias("edge")).groupBy("stretch").agg(F.collect_list("edge").alias("edges")).select("stretch", fold)


def _begins(first: np.ndarray, sizes: np.ndarray, found: pa.Table, stretches: pa.Array, pieces: Pieces) -> np.ndarray:
    """Whether a token begins at a character, for all characters of the stretches."""
    begins = np.ones(int(sizes.sum()), bool)
    widths = np.ones(len(pieces.surfaces), np.int64)
    widths[[i for i, _ in pieces.scores.values()]] = [len(p) for p in pieces.scores]
    number = found.column("number").to_numpy()

    def put(k: int, ids: np.ndarray) -> None:
        begins[first[k] : first[k] + sizes[k]] = False
        begins[first[k] + np.cumsum(np.r_[0, np.where(ids < 0, 1, widths[np.maximum(ids, 0)])[:-1]])] = True

    if pieces.merges:
        borders = np.full(len(sizes), -1)
        borders[number] = found.column("borders").to_numpy()
        for a in range(0, len(sizes), SOME):
            n = sizes[a : a + SOME]
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            begins[first[a] : first[a] + len(place)] = np.repeat(borders[a : a + SOME], n) >> np.minimum(place, 63) & 1 == 1
    else:
        lists = found.column("ids").combine_chunks()
        for k, ids in zip(number.tolist(), np.split(lists.flatten().to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy())[:-1])):
            put(k, ids)
    for k in np.flatnonzero(sizes > pieces.most).tolist():
        put(k, np.array(pieces.segmented(stretches[k].as_py())))
    return begins


def _tokens(stretches: pa.Array, found: pa.Table, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the stretches one after the other, and how many each has."""
    sizes = pc.utf8_length(stretches).to_numpy().astype(np.int64)
    first = np.cumsum(sizes) - sizes
    begins = _begins(first, sizes, found, stretches, pieces)
    flat, counts, known = [], [], {}
    for a in range(0, len(sizes), SOME):
        own, data = offsets_of(stretches[a : a + SOME]), stretches.buffers()[2]
        at = np.flatnonzero((np.frombuffer(data, np.uint8)[own[0] : own[-1]] & 0xC0) != 0x80) + own[0]  # where characters begin
        here = begins[first[a] : first[a] + len(at)]
        coded = strings_of(np.r_[at[here], own[-1]], data).dictionary_encode()
        of = [known[t] if t in known else known.setdefault(t, pieces.ids_of(t)) for t in coded.dictionary.to_pylist()]
        width, which = np.array([len(x) for x in of]), coded.indices.to_numpy()
        flat.append(_ranges(np.concatenate(of).astype(np.int32), np.cumsum(width) - width, width, which))
        counts.append(np.add.reduceat(width[which], np.cumsum(here)[first[a : a + SOME] - first[a]] - 1))
    return np.concatenate(flat), np.concatenate(counts)


def _fold(docs: pa.Table, found: pa.Table, pieces: Pieces, decode: bool) -> pa.Table:
    """The ids of a chunk's documents; with decode the SHA-256 of the text that they decode to as well."""
    pa.default_memory_pool().release_unused()  # what the chunk before took
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), *([("decoded_sha256", pa.string())] * decode)])
    rows = docs.filter(pc.is_valid(docs.column("ids")))
    head = docs.filter(pc.is_valid(docs.column("stretches")))
    if head.num_rows:
        flat, own = _tokens(head.column("stretches").combine_chunks().flatten().cast(pa.large_string()), found, pieces)
        inner = np.cumsum(unpacked(head.column("inner")[0].as_py()), dtype=np.uint32)
        lengths = unpacked(head.column("lengths")[0].as_py()).astype(np.int64)
        words = _ranges(flat, np.cumsum(own) - own, own, inner)
        per_word = np.add.reduceat(own[inner], np.cumsum(lengths) - lengths)
        begins = np.cumsum(per_word) - per_word
        del flat, own, inner, lengths
    n = np.array([per_word[unpacked(b.as_py())].sum() if b.as_py() else 0 for b in rows.column("ids")], np.int64)
    part, out = np.cumsum(n) // SLICE, []
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist() if len(part) else []
    for a, b in zip(cuts, [*cuts[1:], len(n)]):  # about SLICE ids a batch: the JVM holds one batch at a time
        ends = np.cumsum(n[a:b])
        values = np.empty(int(n[a:b].sum()), np.int32)
        for x, first, end in zip(rows.column("ids").slice(a, b - a), (ends - n[a:b]).tolist(), ends.tolist()):
            if end > first:
                values[first:end] = _ranges(words, begins, per_word, unpacked(x.as_py()))
        cols = [rows.column("doc_id").slice(a, b - a).combine_chunks(), pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values))]
        cols += [_digests(np.split(values, ends[:-1]), pieces)] if decode else []
        out.append(pa.record_batch(cols, schema=schema))
    return pa.Table.from_batches(out, schema)


def _ranges(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """flat's ranges number `which`, one after the other."""
    n = sizes[which]
    at = np.repeat(begins[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return flat[at]


def encoded(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, decode: bool = False) -> DataFrame:
    """One row per row of docs: doc_id and ids, with decode as by with_decoded(), in the same workers. chunk: bytes of text that number their words together."""
    pieces = Pieces.load(model)
    own = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    cut = saved_by(own.mapInArrow(partial(_cut, joints=frozenset(pieces.joints()), most=chunk), _ENCODED), "chunk", partitions(docs.sparkSession))
    places = cut.where("stretches IS NOT NULL").select(F.col("chunk").alias("to"), F.posexplode("stretches").alias("number", "stretch"))
    places = places.where(F.length("stretch").between(2 if pieces.merges else 1, pieces.most)).repartition(partitions(docs.sparkSession), "stretch")  # dealt once, for the next two
    # a place is asked for so that both uses read the same columns, which lets Spark deal them once
    distinct = places.groupBy("stretch").agg(F.max(F.xxhash64("to", "number")).alias("place")).where("place IS NOT NULL").select("stretch")
    known = encoded_stretches(distinct, pieces)
    found = places.join(known.hint("merge"), "stretch").drop("stretch")
    return cut.groupBy("chunk").cogroup(found.groupBy("to")).applyInArrow(partial(_fold, pieces=pieces, decode=decode), "doc_id long, ids array<int>" + ", decoded_sha256 string" * decode)


def _decode(batches: Iterator[pa.RecordBatch], pieces: Pieces) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array([pieces.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())})


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""
    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(partial(_decode, pieces=Pieces.load(model)), "doc_id long, text string")


def _digests(rows: Iterable[np.ndarray], pieces: Pieces) -> pa.Array:
    """The SHA-256 of the text that each row's ids decode to, as UTF-8."""
    widths = np.array([len(x) for x in pieces.surfaces])
    whole, begins = np.frombuffer(b"".join(pieces.surfaces), np.uint8), np.cumsum(widths) - widths
    out = []
    for ids in rows:
        text = _ranges(whole, begins, widths, ids).tobytes() if len(ids) else b""
        text = text[1:] if text[:1] == b" " else text
        out.append(hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest())
    return pa.array(out, pa.string())


def _with_decoded(batches: Iterator[pa.RecordBatch], pieces: Pieces) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = (ids.values.to_numpy() if ids.is_valid else np.zeros(0, np.int32) for ids in batch.column(1))  # a row's ids at a time
        yield pa.record_batch({"doc_id": batch.column(0), "ids": batch.column(1), "decoded_sha256": _digests(rows, pieces)})


def with_decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """rows (doc_id, ids) with decoded_sha256, of the text that the ids decode to as UTF-8."""
    return rows.select("doc_id", "ids").mapInArrow(partial(_with_decoded, pieces=Pieces.load(model)), "doc_id long, ids array<int>, decoded_sha256 string")
