"""Gates, names, orders and comparisons on small cases, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelmark.functions import elements, names, policies
from panelmark.operators import choices


def rows_of(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", f(F.col("v"))).orderBy("i").collect()]


def test_every_code_of_the_table_has_its_category(spark):
    codes = [c for c in elements.CATEGORY_OF if not c[-1].isdigit() and c[-1] not in "BV"]  # the others lose their last sign
    assert rows_of(spark, elements.category, codes) == [elements.CATEGORY_OF[c] for c in codes]
    assert rows_of(spark, elements.category, [c + "4" for c in codes]) == [elements.CATEGORY_OF[c] for c in codes]
    assert rows_of(spark, elements.category, ["OFSt+OFStMb2", "PStL+PStM", "SlLi4+RoLi4*", "4Wz", "GW1Sq2Se", "aSP3V", "A+2x", "zzz"]) == ["Step Sequence", "Step Sequence", "Lift", "Jump", "Pattern dance", "aSP3", "Jump", "zzz"]


def test_persons(spark):
    pairs = [
        ("Christian Baumann", "BAUMANN Christian", True), ("Christopher Buchanan", "Chris BUCHANAN", True), ("C. Buchanan", "Chris Buchanan", True), ("Anna Lee", "Annabel Lee-Kim", False), ("Ann Lee", "Bob Lee", False),
        ("", "", True), (None, "x", False), ("Lee", "Lee", True), ("Lee", "Ann Lee", False), ("ＡＮＮ  Lee", "ann lee", True), ("O'Neil, Pat", "pat o neil", False),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    keyed = df.select("i", names.person_key(F.col("a")).alias("a"), names.person_key(F.col("b")).alias("b"))
    got = [r.same for r in keyed.select("i", names.same_person(F.col("a"), F.col("b")).alias("same")).orderBy("i").collect()]
    want = [w for _, _, w in pairs]
    want[-1] = sorted("o neil pat".split()) == sorted("pat o neil".split())  # the same words in another order
    assert got == want


def test_identity_labels(spark):
    own = spark.createDataFrame([(1, "Ann Lee"), (1, "A. Lee"), (1, "zed"), (1, "Ann Lee"), (2, "Bo Diaz"), (2, "DIAZ Bo"), (3, None), (4, "x")], "identity int, judge_name string")
    directory = spark.createDataFrame([(1, "Annabel Lee"), (2, "  "), (5, "No One")], "identity int, full_name string")
    assert {r.identity: r.label for r in names.identity_labels(own, directory, " (linked)").collect()} == {1: "Annabel Lee · zed", 2: "Bo Diaz (linked)", 4: "x (linked)"}
    assert names.identity_labels(own.limit(0)).count() == 0


def test_dates_and_judges(spark):
    lines = ["01/02/2024 - 01/05/2024 (EST)", "1/2/2024", "02.01.2024 - 05.01.2024", "Boston", None, "13/45/2024", "01/02/2024 - Boston"]
    d = dt.date
    got = rows_of(spark, policies.slash_dates, lines)
    assert [(r.first, r.last) for r in got] == [(d(2024, 1, 2), d(2024, 1, 5)), (d(2024, 1, 2), d(2024, 1, 2)), (d(2024, 1, 2), d(2024, 1, 5)), (None, None), (None, None), (None, None), (None, None)]
    assert policies.judge_names(" a b,\n;c, a b") == ("a b", "c") and policies.judge_names(None) == ()
    assert rows_of(spark, lambda c: policies.judge_in(c, "a b;c"), ["a b", "c", "a"]) == [True, True, False]
    assert policies.run_key({"b": 1, "a": "x"}) == policies.run_key({"a": "x", "b": 1}) != policies.run_key({"a": "x", "b": 2})
    with pytest.raises(KeyError):
        policies.level_in(F.lit("Senior"), "unknown")


def test_a_shards_key_is_the_runs(spark):
    df = spark.createDataFrame([(1, "a")], "n long, s string")
    got = df.select(policies.shard_key({"n": F.col("n"), "s": F.col("s"), "none": F.lit(None).cast("string")})).first()[0]
    assert got == policies.run_key({"n": 1, "s": "a", "none": None})


def test_compared_pools_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(k, float(rng.randrange(-4, 5)), rng.random() < 0.4) for k in (1, 2) for _ in range(60)] + [(3, 1.0, True), (3, None, False)]
    got = {r.k: r for r in choices.compared_pools(spark.createDataFrame(rows, "k int, v double, late boolean"), ["k"], "v", F.col("late")).collect()}
    for k in (1, 2):
        x, y = [v for a, v, late in rows if a == k and not late], [v for a, v, late in rows if a == k and late]
        u = sum((p > q) + (p == q) / 2 for p in x for q in y)
        d = max(abs(sum(p <= v for p in x) / len(x) - sum(q <= v for q in y) / len(y)) for v in {*x, *y})
        assert (got[k].nx, got[k].ny, got[k].u) == (len(x), len(y), u) and abs(got[k].d - d) < 1e-6
    assert (got[3].nx, got[3].ny, got[3].u, got[3].t) == (0, 1, None, None)


def test_trends(spark):
    years = spark.createDataFrame([(1, 2000 + i, v) for i, v in enumerate([1.0, 2.0, 2.5, 4.5])] + [(2, 2000, 1.0), (3, 2000, 1.0), (3, 2001, 1.0), (3, 2002, 1.0)], "j int, season_start int, value double")
    got = {r.j: r for r in choices.trends(years, "j").collect()}
    assert abs(got[1].slope - 1.1) < 1e-6 and abs(got[1].r - 0.964764) < 1e-5 and abs(got[1].p - 0.035236) < 1e-4
    assert got[2].p is None and got[3].p is None


def test_landed_lists(spark):
    rows = spark.createDataFrame([("a", "1", None), ("b", " ", "yes"), ("c", "3", "No"), ("d", "4", "YES")], "name string, year string, row_ok string")
    assert [r.name for r in choices.valid_rows(rows, ["name", "year"]).collect()] == ["a", "d"]
    assert choices.valid_rows(rows.drop("row_ok"), ["year"]).count() == 3


def test_seminars_without_a_window_are_not_met(spark):
    own = spark.createDataFrame([(1, 2009, True), (1, 2009, None), (2, 2001, True)], "official_id int, season int, in_person boolean")
    got = {r.official_id: (r.way, r.met) for r in choices.seminar_alternatives(own, 2009, [{"requirements": [{"min": 1}]}, {"label": "any", "requirements": [{"season_window": 1, "min": 2}]}]).collect()}
    assert got == {1: ("any", True), 2: (None, False)}
    assert {r.official_id: r.n for r in choices.seminar_counts(own, 2009, 1, 1, True).collect()} == {1: 1, 2: 0}
