"""Document fingerprints by one-permutation MinHash.

The hashes of a document's word shingles are dealt once to BINS bins by their leading bits and each bin keeps
its least. Empty bins are filled by optimal densification: a bin draws other bins by a fixed universal
hash of its number and the attempt until one has a value; after DRAWS attempts it goes on through all bins in an order
of its own, so that the draws end. Of every bin BITS low-order bits are stored, packed as
hexadecimal digits. Likeness is the share of equal bins, corrected for equal low bits by chance.

Built-in functions only. A null text counts as empty; empty texts have a fingerprint of their own, likeness 1 to each
other and 0 to all others. A text of fewer words than a shingle is one shingle. Rows with a null doc_id come last in
the order of documents, repeated ids in the order of their texts. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmark.llm.common import SPACE, text_of

BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 8
SHINGLE = 5
#: Independent draws of a bin; then it draws without repetition.
DRAWS = 24
LOW = (1 << (64 - BIN_BITS)) - 1


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """The hashes of the word shingles, an array of longs; empty for a text without words. text: without nulls."""
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")

    def of(w: Column) -> Column:
        several = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - shingle, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(shingle)]))
        return F.when(F.size(w) == 0, F.array().cast("array<long>")).otherwise(several)

    return let(F.transform(words, lambda x: F.xxhash64(x)), of)


def let(value: Column, body) -> Column:
    """body over value, evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bins_of(hashes: Column) -> Column:
    """The least hash of each bin, BINS longs in the bins' order; a bin without hashes has all low bits set.

    One such value a bin is added before sorting, so that every bin has a first value in the sorted array.
    """
    ends = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("long"), 64 - BIN_BITS).bitwiseOR(F.lit(LOW)))
    # sorting is by signed values, which only turns the bins' order; equal bins stay together
    return let(F.sort_array(F.concat(hashes, ends)), lambda s: F.filter(s, lambda h, i: (i == 0) | (F.shiftrightunsigned(h, 64 - BIN_BITS) != F.shiftrightunsigned(F.get(s, i - 1), 64 - BIN_BITS))))


def _empty(value: Column) -> Column:
    return value.bitwiseAND(F.lit(LOW)) == LOW


def densified(bins: Column) -> Column:
    """bins with the empty ones filled; all empty if they were."""

    def fill(b: Column) -> Column:
        def drawn(filled: Column) -> Column:
            def draw(i: Column) -> Column:
                def step(acc: Column, t: Column) -> Column:
                    there = F.get(b, F.xxhash64(i, t).bitwiseAND(F.lit(BINS - 1)).cast("int"))
                    return F.when(acc.isNotNull(), acc).when(~_empty(there), there)

                # a bin's order of all bins is by a hash too, of the bins' leading bits; the first one with a value has the least
                rank = lambda v: F.xxhash64(i, F.shiftrightunsigned(v, 64 - BIN_BITS))
                onward = F.aggregate(filled, F.get(filled, F.lit(0)), lambda acc, v: F.when(rank(v) < rank(acc), v).otherwise(acc))
                return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(DRAWS)), F.lit(None).cast("long"), step), onward)

            return F.transform(b, lambda v, i: F.when(_empty(v), draw(i)).otherwise(v))

        return F.when(F.exists(b, _empty) & F.exists(b, lambda v: ~_empty(v)), let(F.filter(b, lambda v: ~_empty(v)), drawn)).otherwise(b)

    return let(bins, fill)


def sketch(text: Column, shingle: int = SHINGLE) -> Column:
    """The low-order bits of each bin, BINS bytes; empty for a text without words."""
    low = F.transform(densified(bins_of(shingle_hashes(text, shingle))), lambda v: (v.bitwiseAND(F.lit((1 << BITS) - 1)) - (1 << (BITS - 1))).cast("byte"))
    return F.when(text.rlike(f"[^{SPACE}]"), low).otherwise(F.array().cast("array<byte>"))


def packed(sketched: Column) -> Column:
    """A sketch as hexadecimal digits."""
    return F.lower(F.concat_ws("", F.transform(sketched, lambda v: F.lpad(F.hex((v.cast("int") + (1 << (BITS - 1))).cast("long")), BITS // 4, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """Of two sketches, 0 to 1: the estimated share of common shingles."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    chance = 2.0**-BITS
    found = F.greatest((equal / F.lit(float(BINS)) - chance) / (1 - chance), F.lit(0.0))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), ((F.size(a) == 0) & (F.size(b) == 0)).cast("double")).otherwise(found)


def with_next(docs: DataFrame, slices: int) -> DataFrame:
    """docs (doc_id, text, sketch) with next_text and next_sketch, of the next document in descending doc_id; after the last the first.

    Ids are cut into slices at their quantiles, a window looks ahead in each. The first row of a slice is also a guest at
    the end of the slice before it (the last slice's is the first one's), so that texts are dealt once.
    """
    cuts = docs.agg(F.percentile_approx("doc_id", [i / slices for i in range(1, slices)], 10_000).alias("c")).first().c if slices > 1 else None
    cuts = sorted(set(cuts or []))
    edges, steps = F.array(*map(F.lit, cuts)), F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    # how many cuts are at most doc_id, by halves: the expression does not grow with the slices
    above = F.aggregate(steps, F.lit(0), lambda n, k: F.when((n + k <= len(cuts)) & (F.get(edges, n + k - 1) <= F.col("doc_id")), n + k).otherwise(n)) if cuts else F.lit(0)
    slice_ = F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(slices)).cast("int")).otherwise(above)
    sliced = docs.withColumn("slice", slice_)
    heads = sorted(((r.slice, r.top) for r in sliced.groupBy("slice").agg(F.max("doc_id").alias("top")).collect()), key=lambda h: -h[0])  # at most twice the slices
    if not heads:
        return docs.withColumns({"next_text": F.lit(""), "next_sketch": F.col("sketch")})
    at_head = F.col("doc_id").isNull() | F.col("doc_id").isin([top for _, top in heads if top is not None])
    before = F.create_map(*[F.lit(x) for (s, _), (host, _) in zip(heads, heads[-1:] + heads[:-1]) for x in (s, host)])
    guests = sliced.where(at_head).groupBy("slice").agg(F.min(F.struct((-F.col("doc_id")).alias("minus"), "text", "sketch")).alias("g"))
    guests = guests.select(F.lit(None).cast("long").alias("doc_id"), "g.text", "g.sketch", before[F.col("slice")].alias("slice"), F.lit(1).alias("guest"))
    order = Window.partitionBy("slice").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    both = sliced.withColumn("guest", F.lit(0)).unionByName(guests)
    return both.withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)}).where("guest = 0").drop("guest", "slice")


def edited_fingerprints(docs: DataFrame, slices: int) -> DataFrame:
    """One row per row of docs with its fingerprint and that of its text edited by the next document's head."""
    own = docs.select("doc_id", text_of().alias("text")).withColumn("sketch", sketch(F.col("text")))
    both = with_next(own, slices).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    both = both.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited")))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("sketch")).alias("fingerprint"), packed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
