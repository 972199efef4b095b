"""LM scoring: a log-bilinear neural model in numpy, trained by noise-contrastive estimation.

Words are scored as unit and word: P(w|h) = P(unit(w)|h) P(w|unit). Words that are learnt from at least least_count(N) times
of N tokens are units of their own, other words share units by shape. The units of words are cut by frequency into about as
many classes as a class has words: P(unit|h) = P(class|h) P(unit|class, h), each normalised; a shared unit is a class of
its own. The log-bilinear model predicts both from the CONTEXT units before: the contexts' vectors, each scaled
by a vector for its place, add up to the predicted representation, whose products with the classes' and the units' vectors plus
biases are the scores. Training sees every learning token once, in ROUNDS shares: each task
takes noise-contrastive steps from the round's parameters, for the class and for the word in it, and the results are averaged
by tokens. Scores are normalised by batched matrix products over all classes and over all words of the class. Within a shared unit words have their share of counts and unseen words the share of hapaxes.

Counting: each chunk numbers its own words, the chunks' counts are summed by word, and the sums go back by a join to
the chunks that have the word, so that neither texts nor word occurrences are shuffled.

A null text is empty and has the end token only. Null and repeated ids are rows like others. With nothing to learn
from, counts are 0 and the model uniform. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmark.llm.chunks import offsets_of, packed, slices, strings_of, unified, unpacked
from panelmark.llm.common import in_fold, partitions, saved, saved_by, text_of

FOLDS = 10
#: A word is a unit from N ** (2 / 3) / RARER learning occurrences on: the units grow with the cube root of N about.
RARER = 100
CONTEXT, DIMENSIONS, NOISE, NOISE_IN_CLASS = 2, 24, 24, 8
ROUNDS, BATCH, RATE = 2, 1024, 0.3
#: Words of one class whose products with the class's noise are taken together.
ROW = 8
#: Tokens of which contexts are held at once.
BLOCK = 1 << 19
#: Bytes of text that number their words together, and that are cut into words at once.
CHUNK, SLICE = 1 << 25, 1 << 20
#: Bytes of parameters that are averaged together, whole numbers of floats.
PART = 1 << 16
END = b"\n"  # no word has white space
SHAPES = 4 * 3 * 4 * 2


_ENCODED = "chunk long, doc_id long, held_out boolean, ids binary, words array<string>, counts array<long>"
_SCHEMA = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("words", pa.list_(pa.large_string())), ("counts", pa.list_(pa.int64()))])
#: A-Z in lower case, white space as the space, all other bytes as they are.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[9:14] = 32


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts without nulls one after the other, and how many each text has."""
    texts = texts.cast(pa.large_string())
    offsets = offsets_of(texts)
    data = _PLAIN[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    split = pc.split_pattern(strings_of(offsets - offsets[0], pa.py_buffer(data)), " ")
    flat = split.flatten()
    there = pc.not_equal(pc.binary_length(flat), 0)
    ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
    before = np.r_[0, np.cumsum(there.to_numpy(zero_copy_only=False))]
    return flat.filter(there), np.diff(before[np.r_[0, ends].astype(np.int64)])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a document with its words' numbers, and last for each chunk a row with its words, the end among them, and learning counts."""
    chunk, size = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24, 0
    docs: list[pa.RecordBatch] = []
    sizes: list[np.ndarray] = []
    words: list[pa.DictionaryArray] = []

    def numbered() -> Iterator[pa.RecordBatch]:
        numbers, vocabulary = unified([*words, pa.array([END.decode()], pa.large_string()).dictionary_encode()])
        words.clear()
        end, counts = numbers.pop()[0], np.zeros(len(vocabulary), np.int64)
        for own, n, flat in zip(docs, sizes, numbers):
            held = own.column(1).to_numpy(zero_copy_only=False)
            counts += np.bincount(flat[~np.repeat(held, n)], minlength=len(counts))
            counts[end] += (~held).sum()
            at = np.cumsum(n)
            ids = [packed(np.append(flat[a:b], end)) for a, b in zip((at - n).tolist(), at.tolist())]
            none = pa.nulls(len(ids))
            yield pa.record_batch([pa.array(np.full(len(ids), chunk)), own.column(0), own.column(1), pa.array(ids, pa.binary()), none.cast(_SCHEMA.field("words").type), none.cast(_SCHEMA.field("counts").type)], schema=_SCHEMA)
        one = pa.ListArray.from_arrays(pa.array([0, len(vocabulary)], pa.int32()), vocabulary)
        yield pa.record_batch([[chunk], pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.binary()), one, [counts.tolist()]], schema=_SCHEMA)

    for batch in slices(batches, SLICE, 2):
        own, n = words_of(batch.column(2).fill_null(""))
        words.append(own.dictionary_encode())
        docs.append(batch.select([0, 1]))
        sizes.append(n)
        size += pc.sum(pc.binary_length(batch.column(2))).as_py() or 0
        if size > CHUNK:
            yield from numbered()
            chunk, size, docs, sizes = chunk + 1, 0, [], []
    if docs:
        yield from numbered()


def shape(word: bytes) -> int:
    """0 to SHAPES - 1: how the word ends and begins, its length, and whether it is ASCII."""
    last, first = word[-1:], word[:1]
    end = 0 if last.isalpha() else 1 if last in b".,;:!?" else 2 if last.isascii() else 3
    begin = 0 if first.isalpha() else 1 if first.isdigit() else 2
    n = len(word)
    return ((end * 3 + begin) * 4 + (0 if n <= 4 else 1 if n <= 8 else 2 if n <= 12 else 3)) * 2 + (not word.isascii())


def least_count(n: int) -> int:
    """Occurrences in n learning tokens from which a word is a unit; a word seen once stands for the unseen ones."""
    return max(2, ceil(n ** (2 / 3) / RARER))


def unit_of(words: list[bytes], top: dict[bytes, int]) -> np.ndarray:
    own = len(top)
    return np.fromiter((i if (i := top.get(w)) is not None else own + shape(w) for w in words), np.int64, len(words))


def unit_type(units: int) -> type:
    return np.uint16 if units <= 1 << 16 else np.uint32


def _unit_counts(batches: Iterator[pa.RecordBatch], top: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    units = len(top) + SHAPES
    total, once = np.zeros(units), np.zeros(units)
    for batch in batches:
        c = batch.column(1).to_numpy()
        u = unit_of(batch.column(0).cast(pa.binary()).to_pylist(), top)
        total += np.bincount(u, c, units)
        once += np.bincount(u, c == 1, units)
    yield pa.record_batch({"unit": pa.array(range(units), pa.int32()), "total": total.astype(np.int64), "once": once.astype(np.int64)})


_SCORED = "chunk long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, in_unit double, units binary"


def _look_up(docs: pa.Table, found: pa.Table, top: dict[bytes, int], total: np.ndarray, once: np.ndarray, n: int, v: int) -> pa.Table:
    """Counts and units of a chunk's words to its documents."""
    texts = docs.filter(pc.is_valid(docs.column("ids")))
    words = [w.encode() for row in docs.column("words").to_pylist() if row for w in row]
    counts = np.zeros(len(words), np.int64)
    counts[found.column("id").to_numpy()] = found.column("n").to_numpy()
    unit = unit_of(words, top)
    base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
    unseen = np.where(total > 0, (once + 0.5) / (total + 1.0), 1.0)
    own = unit >= len(top)
    seen = np.where(own, (1 - unseen[unit]) * counts / np.maximum(total[unit], 1), 1.0)
    within = np.log10(np.where(counts > 0, np.maximum(seen, 1e-300), np.where(own, unseen[unit], 1.0)))
    ids = [unpacked(b.as_py()) for b in texts.column("ids")]
    k = len(ids)
    flat = np.concatenate(ids) if k else np.zeros(0, np.uint32)
    starts = np.cumsum([0, *map(len, ids)])[:-1] if k else np.zeros(0, np.int64)
    sums = lambda x: np.add.reduceat(x[flat], starts) if k else np.zeros(0)
    short = unit.astype(unit_type(len(total)))
    return pa.table({
        "chunk": texts.column("chunk"), "doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
        "n_known": pa.array(sums((counts > 0).astype(np.int64)), pa.int64()), "base_score": pa.array(sums(base), pa.float64()), "in_unit": pa.array(sums(within), pa.float64()),
        "units": pa.array([short[i].tobytes() for i in ids], pa.binary()),
    })


def _logistic(x: np.ndarray) -> np.ndarray:
    e = np.clip(x, -30, 30)
    np.negative(e, out=e)
    np.exp(e, out=e)
    e += 1
    return np.reciprocal(e, out=e)


def _normalised(s: np.ndarray) -> np.ndarray:
    s -= s.max(axis=1, keepdims=True)
    return s - np.log(np.exp(s).sum(axis=1, keepdims=True))


def _begins(x: np.ndarray) -> np.ndarray:
    """Where x, not empty, differs from what stands before."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new


def _add(sums: np.ndarray, index: np.ndarray, each: np.ndarray) -> None:
    """Adds rows (or numbers) to those of sums that index names, repeated ones too; flat, as numpy adds single numbers fast."""
    if each.ndim > 1:
        index = (index[:, None] * each.shape[1] + np.arange(each.shape[1])).ravel()
    np.add.at(sums.reshape(-1), index, each.ravel())


class LogBilinear:
    """Parameters over `units` units, the first `words` of them in classes; one more context vector stands before the first token."""

    def __init__(self, units: int, noise: np.ndarray, words: int = 0, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.words, self.width = words, isqrt(words - 1) + 1 if words else 1
        self.classes = -(-words // self.width)
        self.class_of = np.r_[np.arange(words) // self.width, self.classes + np.arange(units - words)]
        self.noise, self.class_noise = noise, np.bincount(self.class_of, noise)
        self.r = rng.normal(0, 0.1, (units + 1, DIMENSIONS)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (len(self.class_noise), DIMENSIONS)).astype(np.float32)
        self.c = np.full((CONTEXT, DIMENSIONS), 0.5, np.float32)
        self.b = np.log(self.class_noise).astype(np.float32)
        self.q_in = rng.normal(0, 0.1, (words, DIMENSIONS)).astype(np.float32)
        self.b_in = np.log(noise[:words] / self.class_noise[self.class_of[:words]]).astype(np.float32)
        self.log_noise_in = self.b_in + np.float32(np.log(NOISE_IN_CLASS))
        self.past = [np.full(p.shape, 1e-3, np.float32) for p in self.parts()]  # sums of squared gradients

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.q, self.c, self.b, self.q_in, self.b_in]

    def to_bytes(self) -> bytes:
        return b"".join(p.astype("<f4").tobytes() for p in self.parts())

    def load(self, data: bytes) -> LogBilinear:
        at = 0
        for p in self.parts():
            p[...] = np.frombuffer(data, "<f4", p.size, at).reshape(p.shape)
            at += 4 * p.size
        return self

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        return sum(self.r[contexts[:, j]] * self.c[j] for j in range(CONTEXT))

    def of_classes(self, h: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalised: a row a representation, a column a class."""
        return _normalised(h @ self.q.T + self.b)

    def in_class(self, h: np.ndarray, class_: int) -> np.ndarray:
        own = slice(class_ * self.width, min((class_ + 1) * self.width, self.words))
        return _normalised(h @ self.q_in[own].T + self.b_in[own])

    def log_probabilities(self, contexts: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalised: a row a context, a column a unit."""
        h = self.predicted(contexts)
        out = self.of_classes(h)[:, self.class_of]
        for k in range(self.classes):
            out[:, k * self.width : min((k + 1) * self.width, self.words)] += self.in_class(h, k)
        return out

    def _step(self, index: np.ndarray, gradients: dict[int, np.ndarray]) -> None:
        """An Adagrad step for the rows `index` (repeated ones are summed) of the parts that have gradients."""
        order = np.argsort(index.astype(unit_type(len(self.r))), kind="stable")
        new = _begins(index.take(order))
        rows, rank = index.take(order[new]), np.empty(len(index), np.int64)
        rank[order] = np.cumsum(new) - 1
        for part, each in gradients.items():
            g = np.zeros((len(rows), *each.shape[1:]), np.float32)
            _add(g, rank, each)
            s = g * g
            s += self.past[part].take(rows, axis=0)
            self.past[part][rows] = s
            self._descend(self.parts()[part], rows, g, s)

    def _step_all(self, gradients: dict[int, np.ndarray]) -> None:
        """An Adagrad step for all rows of the parts: rows whose gradients are 0 stay."""
        for part, g in gradients.items():
            self.past[part] += g * g
            self._descend(self.parts()[part], slice(None), g, self.past[part])

    @staticmethod
    def _descend(part: np.ndarray, rows: np.ndarray | slice, g: np.ndarray, s: np.ndarray) -> None:
        g *= RATE
        g /= np.sqrt(s)
        part[rows] -= g

    def train(self, contexts: np.ndarray, targets: np.ndarray, rng: np.random.Generator) -> None:
        """One pass of noise-contrastive steps (Adagrad); a batch shares its noise classes, and its words of one class share noise from it.

        A batch is sorted by unit, so that its words come first and a class's words are neighbours. They are cut into rows of at most
        ROW words with the class's noise, so that the products of all classes are taken by one call.
        """
        log_noise = np.log(NOISE * self.class_noise).astype(np.float32)
        cumulative, edges = np.cumsum(self.class_noise), np.concatenate([[0.0], np.cumsum(self.noise[: self.words])])
        for at in range(0, len(targets), BATCH):
            unit = targets[at : at + BATCH]
            order = np.argsort(unit.astype(unit_type(len(self.r))), kind="stable")
            x, unit = contexts[at : at + BATCH].take(order, axis=0), unit.take(order)
            n, y, k = len(unit), self.class_of.take(unit), int(np.searchsorted(unit, self.words))
            drawn = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), len(cumulative) - 1)
            before = [self.r.take(x[:, j], axis=0) for j in range(CONTEXT)]
            h = before[0] * self.c[0]
            for j in range(1, CONTEXT):
                h += before[j] * self.c[j]
            q, q_drawn = self.q.take(y, axis=0), self.q.take(drawn, axis=0)
            g = (_logistic(np.einsum("ij,ij->i", h, q) + self.b.take(y) - log_noise.take(y)) - 1) / n
            g_fake = h @ q_drawn.T
            g_fake += self.b.take(drawn) - log_noise.take(drawn)
            g_fake = _logistic(g_fake)
            g_fake /= n
            q *= g[:, None]
            g_h = g_fake @ q_drawn
            g_h += q
            g_q, g_b = np.zeros_like(self.q), np.zeros_like(self.b)
            _add(g_q, y, g[:, None] * h)
            _add(g_q, drawn, g_fake.T @ h)
            _add(g_b, y, g)
            _add(g_b, drawn, np.ones(n, np.float32) @ g_fake)
            own = None
            if k:
                w, h_own = unit[:k], h[:k]
                begins = np.flatnonzero(_begins(y[:k]))
                sizes = np.diff(np.append(begins, k))
                first = y[begins] * self.width
                last = np.minimum(first + self.width, self.words)
                low = edges[first][:, None]
                noise = np.searchsorted(edges, low + (edges[last][:, None] - low) * rng.random((len(begins), NOISE_IN_CLASS)), "right") - 1
                noise = np.clip(noise, first[:, None], last[:, None] - 1)
                cuts = -(-sizes // ROW)
                tops = np.cumsum(cuts) - cuts  # a class's first row
                of = np.repeat(np.arange(len(begins)), cuts)
                place = np.arange(k) + np.repeat(tops * ROW - begins, sizes)  # of a word among the rows' places
                padded = np.zeros((len(of) * ROW, DIMENSIONS), np.float32)
                padded[place] = h_own
                padded = padded.reshape(-1, ROW, DIMENSIONS)
                there = np.zeros(len(of) * ROW, np.float32)
                there[place] = 1 / n
                q_noise = self.q_in.take(noise.take(of, axis=0), axis=0)
                g_noise = padded @ q_noise.transpose(0, 2, 1)
                g_noise += (self.b_in.take(noise) - self.log_noise_in.take(noise)).take(of, axis=0)[:, None]
                g_noise = _logistic(g_noise)
                g_noise *= there.reshape(-1, ROW, 1)
                q = self.q_in.take(w, axis=0)
                g = (_logistic(np.einsum("ij,ij->i", q, h_own) + self.b_in.take(w) - self.log_noise_in.take(w)) - 1) / n
                q *= g[:, None]
                q += (g_noise @ q_noise).reshape(-1, DIMENSIONS).take(place, axis=0)
                g_h[:k] += q
                each = np.add.reduceat(g_noise.transpose(0, 2, 1) @ padded, tops, axis=0)
                sums = np.add.reduceat(g_noise.sum(axis=1), tops, axis=0)
                own = (np.concatenate([w, noise.ravel()]), {4: np.concatenate([g[:, None] * h_own, each.reshape(-1, DIMENSIONS)]), 5: np.concatenate([g, sums.ravel()])})
            g_r = np.concatenate([g_h * c for c in self.c])
            g_c = np.stack([np.einsum("ij,ij->j", g_h, r) for r in before])
            self._step_all({1: g_q, 3: g_b})
            if own:
                self._step(*own)
            self._step(x.T.ravel(), {0: g_r})
            self._step_all({2: g_c})


def blocks(units: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Consecutive documents of BLOCK tokens together (more if one has more)."""
    at, size = 0, 0
    for i, u in enumerate(units):
        if size and size + len(u) > BLOCK:
            yield at, i
            at, size = i, 0
        size += len(u)
    if size:
        yield at, len(units)


def grams(units: list[np.ndarray], before: int) -> tuple[np.ndarray, np.ndarray]:
    """The contexts and targets of documents; `before` stands before the first token."""
    flat = np.concatenate([np.r_[np.full(CONTEXT, before), u] for u in units]).astype(np.int64)
    begins = np.cumsum([0, *(len(u) + CONTEXT for u in units)])
    target = np.ones(len(flat), bool)
    for j in range(CONTEXT):
        target[begins[:-1] + j] = False
    at = np.flatnonzero(target)
    return np.stack([flat[at - 1 - j] for j in range(CONTEXT)], axis=1), flat[at]


def _train(batches: Iterator[pa.RecordBatch], params: bytes, noise: np.ndarray, words: int, round_: int) -> Iterator[pa.RecordBatch]:
    model, n = LogBilinear(len(noise), noise, words).load(params), 0
    rng = np.random.default_rng(round_)
    for batch in batches:
        units = [np.frombuffer(b, unit_type(len(noise))) for b in batch.column(0).to_pylist()]
        for a, b in blocks(units):
            contexts, targets = grams(units[a:b], len(noise))
            order = rng.permutation(np.arange(round_, len(targets), ROUNDS))
            model.train(contexts[order], targets[order], rng)
            n += len(order)
    if n:
        data = model.to_bytes()
        parts = [data[i : i + PART] for i in range(0, len(data), PART)]
        yield pa.record_batch({"part": pa.array(range(len(parts)), pa.int32()), "n": pa.array([n] * len(parts), pa.int64()), "params": pa.array(parts, pa.binary())})


def _mean(rows: pa.Table) -> pa.Table:
    """A part of the parameters, averaged over the tasks by their tokens."""
    each = sorted(zip(rows.column("n").to_pylist(), rows.column("params").to_pylist()))
    n = sum(x for x, _ in each)
    mean = sum(np.frombuffer(p, "<f4").astype(np.float64) * (x / n) for x, p in each)
    return pa.table({"part": rows.column("part").slice(0, 1), "params": pa.array([mean.astype("<f4").tobytes()], pa.binary())})


def _log10(model: LogBilinear, units: list[np.ndarray]) -> np.ndarray:
    """The units' log10 probability, by document."""
    before = len(model.noise)
    contexts, targets = grams(units, before)
    code = (contexts * (before + 1) ** np.arange(CONTEXT)).sum(axis=1)
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)  # a context's products are taken once
    order = np.argsort(inverse, kind="stable")
    logs, h = np.empty(len(targets), np.float32), model.predicted(contexts[first])
    class_ = model.class_of[targets]
    cuts = np.searchsorted(inverse[order], np.arange(0, len(first) + BATCH, BATCH))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        table = model.of_classes(h[i * BATCH : (i + 1) * BATCH])
        logs[order[a:b]] = table[inverse[order[a:b]] - i * BATCH, class_[order[a:b]]]
    order = order[np.argsort(class_[order].astype(unit_type(len(model.class_noise))), kind="stable")]  # by class, then context
    cuts = np.searchsorted(class_[order], np.arange(model.classes + 1))
    for k, (begin, end) in enumerate(zip(cuts[:-1], cuts[1:])):
        for a in range(begin, end, 16 * BATCH):
            own = order[a : min(a + 16 * BATCH, end)]
            new = np.r_[True, inverse[own[1:]] != inverse[own[:-1]]]
            table = model.in_class(h[inverse[own[new]]], k)
            logs[own] += table[np.cumsum(new) - 1, targets[own] - k * model.width]
    return np.add.reduceat(logs.astype(np.float64), np.cumsum([0, *map(len, units)])[:-1]) / np.log(10)


def _score(batches: Iterator[pa.RecordBatch], params: bytes, noise: np.ndarray, words: int, n: int) -> Iterator[pa.RecordBatch]:
    model = LogBilinear(len(noise), noise, words).load(params)
    for batch in batches:
        units = [np.frombuffer(b, unit_type(len(noise))) for b in batch.column("units").to_pylist()]
        if not units:
            continue
        score = np.concatenate([_log10(model, units[a:b]) for a, b in blocks(units)]) + batch.column("in_unit").to_numpy()
        cols = {k: batch.column(k) for k in ("doc_id", "held_out", "n_tokens", "n_known")}
        yield pa.record_batch({**cols, "train_tokens": pa.array([n] * len(units), pa.int64()), "base_score": batch.column("base_score"), "score": pa.array(score, pa.float64())})


def scored(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    own = docs.select(F.col("doc_id").cast("long"), in_fold(F.col("doc_id"), FOLDS).alias("held_out"), text_of().alias("text"))
    n_parts = partitions(docs.sparkSession)
    encoded = saved_by(own.mapInArrow(_encode, _ENCODED), "chunk", n_parts)
    words = encoded.where("words IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("id", "x"))
    words = words.select("chunk", F.col("id").cast("long"), F.col("x.words").alias("word"), F.col("x.counts").alias("n")).repartition(n_parts, "word")
    # a word's sum goes to all chunks that have it, by a join: no row holds a word's chunks; its first chunk keeps the word itself
    sums = words.groupBy("word").agg(F.sum("n").alias("sum"), F.min(F.struct("chunk", "id")).alias("first"))
    here = F.when((F.col("first.chunk") == F.col("chunk")) & (F.col("first.id") == F.col("id")), F.col("word"))
    places = words.join(sums.hint("merge"), "word").select("chunk", "id", F.col("sum").alias("n"), here.alias("word"))
    places = saved_by(places.repartition(n_parts, "chunk"), "chunk", n_parts)
    vocabulary = places.where("word IS NOT NULL").select("word", "n")
    sums = vocabulary.agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("v")).first()
    n, v = sums.n or 0, sums.v or 0
    top = {r.word.encode(): i for i, r in enumerate(vocabulary.where(F.col("n") >= least_count(n)).orderBy(F.desc("n"), "word").select("word").collect())}  # at most RARER * n ** (1 / 3)
    units = vocabulary.where("n > 0").select("word", "n").mapInArrow(partial(_unit_counts, top=top), "unit int, total long, once long")
    rows = units.groupBy("unit").agg(F.sum("total").alias("total"), F.sum("once").alias("once")).collect()  # a row a unit
    total, once = np.zeros(len(top) + SHAPES), np.zeros(len(top) + SHAPES)
    for r in rows:
        total[r.unit], once[r.unit] = r.total, r.once
    look_up = partial(_look_up, top=top, total=total, once=once, n=n, v=v)
    units_of = saved(encoded.groupBy("chunk").cogroup(places.drop("word").groupBy("chunk")).applyInArrow(look_up, _SCORED))
    noise = (total + 1) / (total + 1).sum()
    params = LogBilinear(len(noise), noise, len(top)).to_bytes()
    for i in range(ROUNDS):
        trained = units_of.where("NOT held_out").select("units").mapInArrow(partial(_train, params=params, noise=noise, words=len(top), round_=i), "part int, n long, params binary")
        parts = trained.groupBy("part").applyInArrow(_mean, "part int, params binary").collect()  # together as large as the parameters
        params = b"".join(bytes(r.params) for r in sorted(parts)) or params
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return units_of.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "in_unit", "units").mapInArrow(partial(_score, params=params, noise=noise, words=len(top), n=n), schema)
