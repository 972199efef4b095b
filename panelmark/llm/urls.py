"""URL filters: longest-match rules, and a tree of path templates judged by labelled purity.

Per host, path segments that vary become wildcards: those with digits, and those under a branch where most values
are new ones. Branches of the tree that differ in their first segment only and whose share of bad pages is statistically
alike are merged into one wildcard branch; branches that part further down are not merged. A template is rejected when its share of bad labelled pages, smoothed towards its host's
and that towards the whole's, reaches a threshold. A rule that fits a url comes before the template.

Built-in DataFrame functions only. A null url has an empty host and path and is judged as such; a page without labels on
its template is judged by its host, without any by the whole. Repeated rows are judged alike; null labels are ignored.
Empty tables give empty results; without labels every url is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: A position's values under one branch are variable from so many distinct ones, and so large a share of its pages.
VARIED_VALUES, VARIED_SHARE = 20, 0.5
#: Branches are alike below so many standard errors from what their siblings have together.
ALIKE_Z = 2.0
#: Labelled pages that the prior counts as, and the share of bad pages from which a template is rejected.
PRIOR_PAGES, REJECT_FROM = 10.0, 0.5


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, like `net/`, and its verdict; nulls if none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _general(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages (host, path, ...) with segs, its segments with coded ones as wildcards; and by host and segs the general
    form, where values that vary under their branch are wildcards too."""
    raw = F.filter(F.split("path", "/"), lambda s: s != "")
    coded = F.transform(raw, lambda s: F.when(s.rlike("[0-9]") | (F.length(s) > 40), F.lit("*")).otherwise(s))
    pages = pages.withColumn("segs", coded)
    branches = pages.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("pages"))
    nodes = branches.select("host", "pages", F.posexplode("segs").alias("at", "seg"), "segs").withColumn("branch", F.array_join(F.slice("segs", F.lit(1), F.col("at")), "/"))
    values = nodes.groupBy("host", "at", "branch", "seg").agg(F.sum("pages").alias("pages"))
    varied = values.groupBy("host", "at", "branch").agg(F.count(F.lit(1)).alias("values"), F.sum("pages").alias("pages"))
    varied = varied.where((F.col("values") >= VARIED_VALUES) & (F.col("values") >= VARIED_SHARE * F.col("pages")))
    marked = nodes.join(varied.select("host", "at", "branch", F.lit(True).alias("varies")), ["host", "at", "branch"], "left")
    general = marked.groupBy("host", "segs").agg(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("varies"), "*").otherwise(F.col("seg")).alias("seg")))).alias("s"))
    return pages, general.select("host", "segs", F.transform("s", lambda x: x.seg).alias("general"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages: page_id, url, bad (1 bad, 0 good, null unlabelled). Adds host, path, rule, template, purity and verdict."""
    pages = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    pages, general = _general(pages)
    seen = pages.groupBy("host", "segs").agg(F.count("bad").alias("n"), F.sum("bad").alias("bad"))
    leaves = seen.join(general, ["host", "segs"], "left").withColumn("general", F.coalesce("general", F.array().cast("array<string>")))
    # siblings: branches that differ in their first segment only
    leaf = leaves.groupBy("host", "general").agg(F.sum("n").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    rest = F.when(F.size("general") > 1, F.array_join(F.slice("general", 2, F.greatest(F.size("general") - 1, F.lit(1))), "/")).otherwise("")
    leaf = leaf.withColumns({"rest": rest, "depth": F.size("general")})
    siblings = Window.partitionBy("host", "depth", "rest")
    own, all_n, all_bad = F.col("bad") / F.greatest("n", F.lit(1)), F.sum("n").over(siblings), F.sum("bad").over(siblings)
    pooled = all_bad / F.greatest(all_n, F.lit(1))
    error = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-4)) / F.greatest("n", F.lit(1)))
    alike = (F.col("depth") > 0) & ((F.col("n") == 0) | (F.abs(own - pooled) < ALIKE_Z * error))
    tail = F.when(F.col("rest") == "", "").otherwise(F.concat(F.lit("/"), "rest"))
    leaf = leaf.withColumn("template", F.concat(F.lit("/"), F.when(alike, F.concat(F.lit("*"), tail)).otherwise(F.array_join("general", "/"))))
    total = leaf.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + PRIOR_PAGES)).alias("whole"))
    hosts = leaf.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("bad").alias("hb"))
    merged = leaf.groupBy("host", "template").agg(F.sum("n").alias("tn"), F.sum("bad").alias("tb"))
    of_host = (F.col("hb") + PRIOR_PAGES * total.scalar()) / (F.col("hn") + PRIOR_PAGES)
    share = (F.col("tb") + PRIOR_PAGES * of_host) / (F.col("tn") + PRIOR_PAGES)
    scored = merged.join(hosts, "host").withColumn("purity", 1 - share)
    by_leaf = leaves.select("host", "segs", "general").join(leaf.select("host", "general", "template"), ["host", "general"]).join(scored.select("host", "template", "purity"), ["host", "template"])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = pages.join(by_leaf.select("host", "segs", "template", "purity"), ["host", "segs"], "left")
    by_template = F.when(F.col("purity") <= 1 - REJECT_FROM, "block").otherwise("allow")
    return out.select("page_id", "url", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_template).alias("verdict"), "template", "purity")


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """pages with bad, from the labels (doc_id, quality) of the document whose number ends the path."""
    number = F.regexp_extract(path_of(F.col("url")), "/([0-9]{1,18})(?:\\.[a-z]+)?/?$", 1)
    own = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") < 0.5).cast("int").alias("bad"))
    numbered = pages.select("page_id", "url", F.when(number != "", number).cast("long").alias("doc_id"))
    return numbered.join(own, "doc_id", "left").select("page_id", "url", "bad")
