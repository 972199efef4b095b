"""The library on small fixtures: panels, bins, lookups, profiles, identities, activity, rules, functions, sinks, streams."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmark.functions import classify, elements, predicates, scoring, seasons, stats
from panelmark.operators import activity, identity, profiles, rates, rules, sigma, sinks
from panelmark.sources import protocols
from panelmark.streaming import ingest


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def rows_of(spark, column, values, kind):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(column(F.col("x"))).collect()]


def test_thrown_out(spark):
    panels = {1: [1, 2, 3], 2: [1, 1, 1, 2], 3: [2, 2], 4: [None, 3, 4]}
    df = spark.createDataFrame([(e, i, None if s is None else float(s)) for e, p in panels.items() for i, s in enumerate(p)], "element_id long, judge_id long, judge_score double")
    got = {(r.element_id, r.judge_id): r.thrown_out for r in scoring.with_panel(df).collect()}
    want = {1: [True, False, True], 2: [False, False, False, True], 3: [True, True], 4: [False, True, True]}
    assert got == {(e, i): t for e, p in want.items() for i, t in enumerate(p)}


def test_bins_caps_thresholds(spark):
    assert rows_of(spark, scoring.legacy_bin, [0.25, 1.0, 1.25, 2.0, 2.25, 7.75], "double") == [1, 1, 2, 2, 3, 8]
    assert rows_of(spark, scoring.bin_label, [1, 2], "int") == ["0.25–1.00", "1.25–2.00"]
    assert rows_of(spark, lambda x: scoring.component_bin(x, 0.25), [7.12, 7.13], "double") == [7.0, 7.25]
    assert rows_of(spark, scoring.control_bin, [2.5, 3.5, -0.5], "double") == [2, 4, 0]
    assert rows_of(spark, scoring.falls, ["F", "qF", "Fx", "fx", None, "q"], "string") == [1, 1, 2, 2, 0, 0]
    assert rows_of(spark, scoring.fall_cap, [0, 1, 2, 5], "int") == [None, 9.5, 8.75, 8.75]
    assert rows_of(spark, scoring.allowed_anomalies, [10, 11, 20, 21], "int") == [1, 2, 2, 3]
    assert rows_of(spark, lambda x: scoring.is_anomaly(x, F.lit(False), 1.5), [1.5, -1.5, 1.4999], "double") == [True, True, False]
    r = one(spark, a=scoring.quadratic_sigma(F.lit(5.0), F.lit(0.0), F.lit(0.0), F.lit(0.09)), b=scoring.quadratic_sigma(F.lit(2.0), F.lit(-0.01), F.lit(0.1), F.lit(0.2)))
    assert math.isclose(r.a, 0.3) and math.isclose(r.b, 0.6)


def test_buckets_and_levels(spark):
    cases = [(True, True, False, 4, "international"), (False, True, False, 4, "championships"), (False, True, False, 2, "sectionals"), (False, True, True, 10, "nqs"), (False, False, False, 11, "non_qualifying"), (None, None, None, 11, "non_qualifying")]
    df = spark.createDataFrame([c[:4] for c in cases], "international boolean, qualifying boolean, nqs boolean, competition_type_id int")
    assert [r.bucket for r in activity.bucketed(df).collect()] == [c[4] for c in cases]
    jr = spark.createDataFrame([("Senior", 4), ("Senior", 3), ("Novice", 9)], "l string, t int").select(scoring.is_junior_senior(F.col("l"), F.col("t"), 3)).collect()
    assert [r[0] for r in jr] == [True, False, False]


def test_scopes_and_dates(spark):
    df = spark.createDataFrame([(10, date(2020, 1, 1), 2020, 1), (4, None, 2020, 2), (16, date(2019, 1, 1), 2018, None), (11, date(2021, 5, 5), 2020, 3)], "competition_type_id int, event_date date, season_start int, discipline_type_id int")
    n = lambda **k: predicates.narrowed(df, **k).count()
    assert n() == 4 and n(first="2020-01-01") == 2 and n(last="2020-01-01") == 2 and n(seasons=[]) == 4 and n(disciplines=[]) == 0 and n(disciplines=[1, 2]) == 2
    assert df.where(predicates.scope(F.col("competition_type_id"), "qualifying")).count() == 2
    with pytest.raises(KeyError):
        predicates.scope(F.col("competition_type_id"), "unknown")
    pattern = predicates.event_pattern(["Senior"], ["Singles"])
    assert rows_of(spark, lambda x: x.rlike(pattern), ["Championship Women Free", "senior pairs", "Junior Men"], "string") == [True, False, False]


def marks_for_bins(spark):
    out = []
    for j in range(40):
        out.append((j, j % 4, 1, 1, 0.0, 0.5 if j % 2 else -0.5))
    return spark.createDataFrame(out, "element_id long, judge_id long, discipline_type_id int, element_type_id int, control_score double, error double")


def test_sigma_lookup_probes_in_order(spark):
    bins = spark.createDataFrame([(1, 1, 0, 40, 0.5), (1, 1, 2, 40, 0.9)], "discipline_type_id int, element_type_id int, control_bin int, n_marks long, sigma double")
    marks = spark.createDataFrame([(c, 1, 1, float(c), 0.3) for c in (0, 1, 2, 5, -3)], "element_id long, discipline_type_id int, element_type_id int, control_score double, error double")
    got = {r.element_id: (r.sigma_source, r.sigma_hat) for r in sigma.with_sigma(marks, bins, F.lit(0.01)).collect()}
    assert got == {0: ("fitted", 0.5), 1: ("neighbor", 0.5), 2: ("fitted", 0.9), 5: ("fallback", 0.05), -3: ("fallback", 0.05)}
    assert sigma.element_bins(marks_for_bins(spark)).first().n_marks == 40 and sigma.element_bins(marks_for_bins(spark), 41).count() == 0


def test_partials_merge(spark):
    rows = [("A", 0.2, 0.1), ("A", -0.2, -0.1), ("B", 0.5, 0.2), ("B", 0.5, 0.2), ("B", -0.5, -0.2)]
    df = spark.createDataFrame([(j, m, e, 1.0, i) for i, (j, m, e) in enumerate(rows)], "judge_id string, m double, error double, sigma_hat double, i int")
    whole = sigma.summary(df).orderBy("judge_id").collect()
    parts = sigma.partial_summary(df.where("i < 2")).union(sigma.partial_summary(df.where("i >= 2")))
    assert whole == sigma.finished(parts).orderBy("judge_id").collect() and [r.marking_score for r in whole] == [0.2, 0.5]
    assert [(r.judge_id, r.rank) for r in sigma.ranked(sigma.summary(df), 3).collect()] == [("B", 1)]


def test_quadratic_fit(spark):
    f = lambda c: 0.02 * c * c - 0.3 * c + 1.4
    bins = spark.createDataFrame([(1, "SS", 20 + i, c, f(c)) for i, c in enumerate(np.arange(4, 9, 0.5).tolist())], "discipline_type_id int, pcs_type_id string, n_marks long, x double, variance double")
    r = sigma.quadratics(bins).first()
    assert np.allclose([r.a, r.b, r.c], [0.02, -0.3, 1.4]) and sigma.quadratics(bins.limit(3)).count() == 0


def test_profiles_are_mergeable_in_parts(spark):
    rows = [(j, seg * 10 + k, seg, 1, 1, k + 0.1 * j + 0.05 * (1 if j else -1), k + 0.05, seg * 10 + k) for seg in range(4) for k in range(5) for j in range(2)]
    df = spark.createDataFrame(rows, "judge_id long, skater_segment_id long, segment_id int, discipline_type_id int, pcs_type_id int, pcs_score double, control_score double, element_id long")
    got = profiles.component_profiles(df).collect()
    assert all(r.ranking_score == 1.0 and r.n_marks == 20 and r.diff_score > 0.95 for r in got)
    parts = profiles.sums(df.where("segment_id < 2")).union(profiles.sums(df.where("segment_id >= 2"))).groupBy("judge_id").agg(F.sum("sx").alias("s")).orderBy("judge_id").collect()
    assert [round(r.s, 9) for r in parts] == [round(r.sx, 9) for r in profiles.sums(df).orderBy("judge_id").collect()]
    assert profiles.judge_profiles(profiles.component_profiles(df)).count() == 2


def test_identities_and_names(spark):
    links = spark.createDataFrame([(1, "u1"), (2, "u1"), (2, "i7"), (3, "i7"), (4, "u9"), (None, "u9")], "judge_id long, official string")
    assert {r.judge_id: r.identity for r in identity.identities(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert rows_of(spark, identity.sorted_key, ["Mr. John  SMITH", "smith, john"], "string") == ["john smith", "john smith"]
    assert rows_of(spark, lambda x: identity.nfkc(x), ["ﬁn", None], "string") == ["fin", None]
    left = spark.createDataFrame([(1, "Jonathan Q. Smith"), (2, "Someone Else")], "left_id long, name string")
    right = spark.createDataFrame([(10, "Jonathan Smith"), (11, "Mary Smith")], "right_id long, name string")
    assert [(r.left_id, r.right_id) for r in identity.fuzzy(left, right).collect()] == [(1, 10)]


def test_activity(spark):
    served = spark.createDataFrame([(1, 2019, 5), (1, 2019, 5), (1, 2020, 6), (2, 2020, 6)], "official_id long, year int, competition_id long")
    appointed = spark.createDataFrame([(1, 2018), (1, 2016), (3, 2025)], "official_id long, achieved_year int")
    got = {r.official_id: r for r in activity.matrix(served, appointed, [2019, 2020], 2021, 2015).collect()}
    assert (got[1].y2019, got[1].y2020, got[1].years_served, got[1].years_in_grade, got[1].eligible_years) == (1, 1, 2, 5, 5) and got[3].eligible_years == 0
    assert rows_of(spark, activity.availability_code, [None, " ", "Yes, available", "Not available", "Maybe", "does not apply"], "string") == ["no_reply", "no_reply", "available", "unavailable", "if_needed", "not_applicable"]


def test_rules_and_cover(spark):
    assert rules.coverable([[1, 2], [1], [2, 3]]) and not rules.coverable([[1], [1]]) and rules.coverable([])
    assert rules.coverable_counts([(2, [1, 2, 3]), (1, [3])]) and not rules.coverable_counts([(2, [1, 3]), (1, [3])])
    df = spark.createDataFrame([([[1], [1, 2]],), ([[1], [1]],), (None,)], "p array<array<int>>")
    assert [r[0] for r in df.select(rules.distinct_cover("p")).collect()] == [True, False, None]
    own = rules.parsed(spark.createDataFrame([(1, "maintain", 1, "competitions", 2, 2, '{"scope": "a"}'), (1, "maintain", 1, "years_in_grade", 3, 0, "{}")], rules.RULE))
    served = spark.createDataFrame([(7, 2020, 1, "a"), (7, 2019, 2, "a"), (7, 2018, 3, "a"), (8, 2020, 1, "b")], "official_id long, season_code int, competition_id long, scope string")
    who = spark.createDataFrame([(7, 1, 2016), (8, 1, 2019), (9, 2, 2000)], "official_id long, appointment_type_id int, achieved_season int")
    got = {(r.official_id, r.metric): (r.actual, r.met) for r in rules.evaluated(own, who, served, 2020).collect()}
    assert got == {(7, "competitions"): (2, True), (7, "years_in_grade"): (4, True), (8, "competitions"): (0, False), (8, "years_in_grade"): (1, False)}
    assert {r.official_id: r.met for r in rules.sets_met(rules.evaluated(own, who, served, 2020)).collect()} == {7: True, 8: False}


def test_seasons(spark):
    r = one(
        spark, a=seasons.of_date(F.lit(date(2025, 7, 1))), b=seasons.of_date(F.lit(date(2025, 6, 30))), c=seasons.last_codes(F.lit(2526), 4), d=seasons.before_listing(F.lit(2728), 3), e=seasons.ending_in(F.lit(2026)),
        f=seasons.years_in_grade(F.lit(date(2025, 9, 1)), F.lit(2627)), g=seasons.years_in_grade(F.lit(date(2025, 9, 1)), F.lit(2728)), h=seasons.age_at(F.lit(date(2000, 7, 2)), F.lit(2627)), i=seasons.first_listing_at_age(F.lit(date(2000, 7, 2)), 26),
        j=seasons.last_codes(F.lit(1), 2), k=seasons.years_in_grade(F.lit(date(2026, 7, 1)), F.lit(2627)),
    )
    assert r.asDict() == {"a": 2526, "b": 2425, "c": [2223, 2324, 2425, 2526], "d": [2425, 2526, 2627], "e": 2526, "f": 1, "g": 2, "h": 25, "i": 2728, "j": [9900, 1], "k": 1}
    assert rows_of(spark, seasons.of_text, ["2526", "2026", "2024", "abc", None], "string") == [2526, 2526, 2324, None, None]
    assert rows_of(spark, seasons.parsed_date, ["2020-01-02", "1/2/2020", "2.1.2020", "x"], "string") == [date(2020, 1, 2)] * 3 + [None]


def test_classification(spark):
    names = ["Championship Women Free", "Men Short", "Solo Dance", "Ice Dance", "Pairs", "Team", "Nothing"]
    assert rows_of(spark, classify.discipline, names, "string") == ["Singles", "Singles", "Solo Dance", "Ice Dance", "Pairs", "Synchronized", "Uncategorized"]
    assert rows_of(spark, classify.level, ["Advanced Novice Girls", "151Bronze", "12Junior Men", "Pre-Juvenile Girls", None], "string") == ["Advanced Novice", "Unspecified", "Junior", "Pre Juvenile", "Unspecified"]
    assert rows_of(spark, classify.component, ["Skating Skills", "composition / x", "Other", " "], "string") == ["SS", "CO", "Other", None]
    assert rows_of(spark, classify.country, ["Jane DOE usa", "Band THE", "x Ab"], "string") == ["USA", None, None]
    assert rows_of(spark, classify.major_event, ["ISU World Junior Championships", "World Championships 2020", "Grand Prix Final", "Synchronized World Championships", "Local Open"], "string") == ["junior_worlds", "worlds", "grand_prix_final", None, None]
    assert rows_of(spark, classify.stored_url, ["http://a/b/", "http://a/INDEX.htm", "http://a/leaderboard/results/2020/77", " "], "string") == ["http://a/b/index.htm", "http://a/INDEX.htm", "http://a/leaderboard/results/2020/77/index.asp", ""]
    goe = lambda e, n, v="": one(spark, x=classify.max_goe(F.lit(e), F.lit(n).cast("string"), F.lit(v))).x
    assert [goe("3Lz", None), goe("3Lz<<", None), goe("3Lz", "F"), goe("3F!", "e"), goe("3Lzq", "q"), goe("2A+COMBO", None, "Short Program"), goe("4S<", None)] == [5, -1, -3, -1, 3, -5, 3]
    assert rows_of(spark, classify.score_tokens, ["2 2 - 1.5 x -3"], "string") == [[2.0, 2.0, None, 1.5, None, -3.0]]
    assert one(spark, x=classify.padded(F.array(F.lit(1.0), F.lit(2.0)), 4, 2)).x == [1.0, None, 2.0, None]


def test_statistics():
    assert abs(stats.t_two_sided(2.228, 10) - 0.05) < 1e-4 and abs(stats.t_two_sided(0.5, 3) - 0.6514) < 1e-3
    assert abs(stats.chi2_one(3.841) - 0.05) < 1e-3
    w, p = stats.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert abs(w - 0.79) < 0.01 and abs(p - 0.0067) < 0.002
    u, p = stats.mann_whitney(np.array([1.0, 2, 3, 4, 5]), np.array([6.0, 7, 8, 9, 10]))
    assert u == 0 and abs(p - 0.0122) < 1e-3
    assert stats.kolmogorov_smirnov(np.arange(10.0), np.arange(10.0) + 100)[0] == 1.0
    t, p = stats.welch(np.array([1.0, 2, 3]), np.array([4.0, 5, 6]))
    assert abs(t + 3.674) < 1e-3 and abs(p - 0.0213) < 1e-3


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, 1, "a", "p"), (2, 5, "b", "p"), (3, 1, "c", "q")], "k int, v int, x string, part string")
    new = spark.createDataFrame([(1, 2, "A", "p"), (2, 4, "B", "p"), (4, 1, "D", "r"), (4, 1, "D", "r")], "k int, v int, x string, part string")
    assert sorted((r.k, r.x) for r in sinks.upserted(old, new, ["k"], "v").collect()) == [(1, "A"), (2, "b"), (3, "c"), (4, "D")]
    assert [r.k for r in sinks.insert_ignored(old, new, ["k"]).collect()] == [4]
    path = str(tmp_path / "t")
    sinks.replace_partitions(old, path, ["part"])
    sinks.replace_partitions(new.where("part = 'p'"), path, ["part"])
    assert sorted((r.k, r.x) for r in spark.read.parquet(path).collect()) == [(1, "A"), (2, "B"), (3, "c")]
    assert sinks.without_partitions(old, new, ["part"]).count() == 1 and sinks.existing(old, str(tmp_path / "none")).count() == 0


def test_stream_ingest_is_idempotent(spark, tmp_path):
    landing, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "k int, v int, x string, part string"
    spark.createDataFrame([(1, 1, "a", "p"), (2, 1, "b", "q")], schema).write.parquet(landing)
    run = lambda: ingest.ingest(spark, landing, schema, table, str(tmp_path / "cp"), ["k"], "v", ["part"]).awaitTermination()
    run()
    spark.createDataFrame([(1, 2, "A", "p")], schema).write.mode("append").parquet(landing)
    run()
    run()
    assert sorted((r.k, r.x) for r in spark.read.parquet(table).collect()) == [(1, "A"), (2, "b")]


def test_protocols(spark):
    html = '<table><tr class="h"><td>x</td></tr><tr><td class="num">1</td><td>3Lz</td><td>2</td><td></td><td>-1.5</td></tr><tr><td class="num">2</td><td>2A</td><td>-</td></tr><tr><td class="cn">Skills</td><td>8.25</td><td>9</td></tr></table>'
    got = protocols.protocols(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert [(r.kind, r.name, r.position, r.score) for r in got] == [("element", "3Lz", 1, 2.0), ("element", "3Lz", 2, None), ("element", "3Lz", 3, -1.5), ("component", "Skills", 1, 8.25), ("component", "Skills", 2, 9.0)]
    rows = spark.createDataFrame([(1, [2.0, None, 3.0], ["a", "b", "c"])], "element_id long, scores array<double>, judges array<string>")
    assert [(r.position, r.judge, r.score) for r in protocols.positions(rows).collect()] == [(1, "a", 2.0), (3, "c", 3.0)]


def test_rates_edge_cases(spark):
    marks = spark.createDataFrame([(1, 1, 1, 0.0, False, False, 5)], "judge_id long, competition_id int, segment_id int, deviation double, thrown_out boolean, is_rule_error boolean, season_start int")
    own = rates.five_measures(marks, ["judge_id"])
    assert rates.heatmap(own, "rule_errors").count() == 0 and rates.heatmap(own, "anomaly_rate").first().value == 0.0
    assert rates.consistency(rates.yearly(marks)).first().trend == "insufficient_data"
    assert rates.five_measures(marks.limit(0), ["judge_id"]).count() == 0


def test_yearly_ties_do_not_follow_the_order_of_rows(spark):
    own = [19 / 4, 32 / 7, 8 / 5, 4 / 5, 11 / 5, 17 / 7]  # their mean is 2.725, which sums of doubles miss in some orders
    for deviations in (own, own[::-1], [*own[:4], own[5], own[4]]):
        marks = [(1, 2000, d) for d in deviations] + [(1, 2001, 2.0), (1, 2002, 3.0)]
        years = rates.yearly(spark.createDataFrame(marks, "judge_id long, season_start int, deviation double").coalesce(1))
        assert sorted(r.value for r in years.collect()) == [2.0, 2.73, 3.0]
        got = rates.consistency(years).first()
        assert (got.n_years, got.slope, got.trend, got.consistency) == (3, 0.135, "increasing", 28.63)


def test_trend_ties_do_not_follow_the_order_of_rows(spark):
    own = [1.61, 1.97, 2.85, 1.55, 1.64, 2.05, 1.58, 2.76]  # their mean is 2.00125
    for values in (own, [1.64, 1.58, 1.97, 2.76, 2.05, 1.55, 2.85, 1.61]):
        years = spark.createDataFrame([(2000, v) for v in values], "season_start int, value double").coalesce(1)
        got = rates.overall_trend(years).first()
        assert (got.mean, got.median, got.std, got.n_judges) == (2.0013, 1.805, 0.4955, 8)


def test_element_categories(spark):
    codes = {
        "CCoSp3": "Spin", "CoSp3p4": "Spin", "FCSp4V": "Spin", "FSSp3V1": "Spin", "StSq4": "Step Sequence", "3Lz<<": "Jump", "2A": "Jump", "ChSq1": "ChSq", "5TLi4": "Lift", "3Tw2": "Twist", "BiDs3": "Death Spiral",
        "PCoSp4": "Pairs Spin", "2LoTh": "Throw Jump", "PB3": "Pivoting Block", "Cr1": "Creative", "SyTwL+SyTwM3": "Twizzle", "StSq3+kp": "Step Sequence", "1A+fm": "Moves Element", "I4+pi2": "Intersection", "NHE2": "No Hold Element", "xyz": "xyz", "": "",
    }
    assert rows_of(spark, elements.category, list(codes), "string") == list(codes.values())
    assert rows_of(spark, elements.category, [None], "string") == [""]


def test_form_cells(spark):
    cells = ["Yes", "TRUE", "1.0", "no", None, "", "I am NOT interested in officiating all qualifying events", "I would like to opt out", "maybe"]
    assert rows_of(spark, elements.opts_out, cells, "string") == [True, True, True, False, False, False, True, True, False]
    lookup = {"eastern": "East", "upper great lakes": "Midwest", "great lakes": "Midwest B"}
    assert rows_of(spark, lambda x: elements.section(x, lookup), ["Eastern Section", "the Upper  Great Lakes area", " ", None, "moon"], "string") == ["East", "Midwest", "(Unspecified)", "(Unspecified)", "(Other)"]
