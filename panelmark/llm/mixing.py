"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words. Every source has a target of words. The mix takes each document of a
source as often as the target holds the whole source; for what remains, documents are counted by exact size, each size
gives its proportional share, and a bounded-knapsack dynamic program over bits fits the last words. The
chosen number of documents of each size is then selected by a seeded hash of doc_id.

A null text has size 0; size-0 documents are never taken. The null source is a source, the last one. Repeated rows
count as documents of their own; of rows with equal doc_id and size it makes no difference which is taken.
Empty tables give empty results. Sources must be few enough for one row each on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmark.llm.common import WORD, checked, saved, text_of

#: Words that the dynamic program fits, a parameter; what proportional shares leave beyond them goes to the largest sizes first.
FIT_WORDS = 1 << 15
#: Expected documents of one size that are ranked together.
RANKED = 256
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BROADCAST_ROWS = 100_000


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = MOST) -> list[float]:
    """Shares of total by weight; none above most times its size, the excess shared again by weight."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = total
    while open_:
        each = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if each * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = each * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def fit(sizes: Sequence[int], counts: Sequence[int], budget: int, words: int = FIT_WORDS) -> list[int]:
    """How many documents of each size to take, at most its count, so that the words come to the budget or just below."""
    whole = sum(s * c for s, c in zip(sizes, counts))
    share = min(1.0, budget / whole) if whole else 0.0
    taken = [min(c, floor(c * share)) if s else 0 for s, c in zip(sizes, counts)]
    left = budget - sum(s * k for s, k in zip(sizes, taken))
    down = sorted((i for i, s in enumerate(sizes) if s), key=lambda i: -sizes[i])
    for i in down:
        if left > words:
            more = min(counts[i] - taken[i], (left - words + sizes[i] - 1) // sizes[i], left // sizes[i])
            taken[i] += more
            left -= more * sizes[i]
    if left > words or left <= 0:  # above it only documents of more words each are left
        for i in down:
            more = min(counts[i] - taken[i], max(0, left) // sizes[i])
            taken[i] += more
            left -= more * sizes[i]
        return taken
    mask, reach = (1 << (left + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # size's index, documents, what was reached before
    for i in down:
        free, part = min(counts[i] - taken[i], left // sizes[i]), 1
        while free > 0 and not reach >> left & 1:
            part = min(part, free)
            steps.append((i, part, reach))
            reach |= (reach << (part * sizes[i])) & mask
            free -= part
            part *= 2
    at = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += part
            at -= part * sizes[i]
    return taken


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11, fit_words: int = FIT_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken."""
    return mix_sizes(saved(sized(docs)), weights, share, most, seed, fit_words)


def mix_sizes(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11, fit_words: int = FIT_WORDS) -> DataFrame:
    """As mixed(), from rows (doc_id, source, size)."""
    spark = rows.sparkSession
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    rows = rows.withColumn("key", key)
    counts = saved(rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")))
    own = sorted((r.key, r.words) for r in counts.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect())
    own = [x for x in own if x[0] != "null"] + [x for x in own if x[0] == "null"]  # a real source's key starts with s
    sizes = [w for _, w in own]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(own))], share * sum(sizes), most) if own else []
    per = {k: (w, t) for (k, w), t in zip(own, goal)}
    passes = {k: min(int(t // w), int(most)) if w else 0 for k, (w, t) in per.items()}
    budget = {k: int(round(t)) - passes[k] * w if passes[k] < most else 0 for k, (w, t) in per.items()}

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        return pdf.assign(more=np.array(fit(pdf["size"].tolist(), pdf["n"].tolist(), max(0, budget[pdf["key"].iloc[0]]), fit_words), np.int64))

    plan = saved(counts.groupBy("key").applyInPandas(fitted, "key string, size long, n long, more long"))
    by_source = spark.createDataFrame([(k, w, t, passes[k]) for k, (w, t) in per.items()], "key string, source_size long, target double, passes int")
    plan = checked(plan, BROADCAST_ROWS)
    joined = rows.join(plan, ["key", "size"])
    draw = F.xxhash64("doc_id", F.lit(seed))
    at = (draw.bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)) * F.ceil(F.col("n") / F.lit(RANKED))).cast("long")
    joined = joined.withColumns({"draw": draw, "slot": at})
    part = joined.where((F.col("more") > 0) & (F.col("more") < F.col("n")))
    slots = part.groupBy("key", "size", "slot").count()
    before = slots.select("key", "size", "slot", (F.sum("count").over(Window.partitionBy("key", "size").orderBy("slot")) - F.col("count")).alias("before"))
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("key", "size", "slot").orderBy("draw", "doc_id"))).join(before, ["key", "size", "slot"])
    one = ranked.withColumn("again", (F.col("rank") + F.col("before") <= F.col("more")).cast("int"))
    rest = joined.where(~((F.col("more") > 0) & (F.col("more") < F.col("n")))).withColumn("again", (F.col("more") > 0).cast("int"))
    cols = ["key", "doc_id", "source", "size", "again"]
    return (
        one.select(*cols).union(rest.select(*cols)).join(F.broadcast(by_source), "key")  # one row a source
        .select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("again"))).alias("taken"))
    )


def repeated(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it. taken: doc_id, size, taken, one row per row of docs.

    Of rows with equal doc_id and size the takes are dealt to any of them.
    """
    times = taken.groupBy("doc_id", "size").agg(F.sort_array(F.collect_list(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int"))).alias("__times"))
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    place = F.row_number().over(Window.partitionBy("doc_id", "__size").orderBy(F.lit(1)))
    numbered = docs.withColumn("__size", size).withColumn("__place", place)
    joined = numbered.join(times.select(F.col("doc_id").alias("__id"), F.col("size").alias("__of"), "__times"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__size") == F.col("__of")))
    return joined.withColumn("__time", F.explode(F.array_repeat(F.lit(1), F.get("__times", F.col("__place") - 1)))).select(*docs.columns)


def audit(rows: Iterable[tuple[str | None, int, int, float]]) -> dict:
    """Words taken and the target by source, of (source, size, taken, target) rows."""
    out: dict = {}
    for source, _, taken, target in rows:
        out[source] = (out.get(source, (0, 0.0))[0] + taken, target)
    return out
