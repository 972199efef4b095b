"""Queries of eras, gates, presets, orders, sets, labels, forms, seminars and comparisons, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.functions import classify, names, policies, predicates
from panelmark.functions.scoring import rounded
from panelmark.operators import activity, choices, rates, rules, sigma
from panelmark.plans.catalog import _SERVICE, YEARS, component_marks, panel_marks, query, service
from panelmark.sources import protocols
from panelmark.sources.tables import MARKS_SQL, marks, table

_GATES = """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + INTERVAL 22 YEAR END AS s, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) + INTERVAL 24 YEAR END AS e,
CASE o_orderkey % 5 WHEN 0 THEN '2425' WHEN 1 THEN ' 2324 ' WHEN 2 THEN '' END AS y FROM orders)"""


@query(_GATES + """SELECT o_orderkey, coalesce(coalesce(s, e) >= DATE '2018-07-01', true) AS elements, CASE WHEN trim(y) <> '' THEN trim(y) >= '2425' ELSE coalesce(coalesce(s, e) >= DATE '2024-07-01', true) END AS falls,
coalesce(s >= greatest(DATE '2022-07-01', DATE '2021-01-01'), false) AS in_era FROM c""")
def rule_error_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, date = F.col("o_orderkey"), F.to_date("o_orderdate")
    start, end = F.when(k % 3 != 0, F.add_months(date, 22 * 12)), F.when(k % 4 != 0, F.add_months(date, 24 * 12))
    season = F.when(k % 5 == 0, "2425").when(k % 5 == 1, " 2324 ").when(k % 5 == 2, "")
    era = F.coalesce(policies.in_era(start, policies.COMPONENTS_FROM, "2021-01-01"), F.lit(False))
    return table(spark, sf_dir, "orders").select("o_orderkey", policies.flags_elements(start, end).alias("elements"), policies.flags_falls(season, start, end).alias("falls"), era.alias("in_era"))


#: Names of segments by p_partkey % 10, and what gates say of them.
_SEGMENTS = (
    "Junior Women - Free Skate", "MEN_SHORT_PROGRAM", "Men_Single_Skating___Short_Program", "Pair_Skating___Free_Skating", "Senior Pairs Short", "Rhythm Dance Senior", "Solo Combined Dance", "Synchronized Junior", "Showcase Womwn", "",
)


def _segment_case() -> str:
    return "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SEGMENTS)) + " END"


@query(f"""WITH s AS (SELECT p_partkey, {_segment_case()} AS n FROM part), w AS (SELECT *, upper(n) AS u, string_split_regex(replace(upper(n), '-', '_'), '_+') AS t,
list_filter(string_split_regex(upper(regexp_replace(n, '[^A-Za-z0-9]+', '_', 'g')), '_+'), lambda x: x <> '' AND x NOT IN ('SINGLE', 'SKATING')) AS k FROM s),
e AS (SELECT *, list_has_any(t, ['PAIR', 'PAIRS']) OR (contains(u, 'PAIR') AND contains(u, 'SKATING')) AS pairs FROM w),
f AS (SELECT *, pairs OR list_has_any(t, ['WOMEN', 'MEN', 'BOYS', 'GIRLS', 'LADIES', 'LADY', 'GIRL', 'BOY']) OR (contains(u, 'SINGLE') AND contains(u, 'MEN')) AS elements FROM e)
SELECT p_partkey, pairs, elements, elements OR contains(u, 'SYNCHRO') OR (contains(u, 'SOLO') AND contains(u, 'DANCE')) OR (contains(u, 'ICE') AND contains(u, 'DANCE')) OR (contains(u, 'DANCE') AND list_has_any(t, ['RHYTHM', 'PATTERN', 'FREE'])) AS falls,
array_to_string(list_transform(k, lambda x: CASE WHEN x = 'WOMWN' THEN 'WOMEN' ELSE x END), '_') AS segment_key FROM f""")
def segment_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, _SEGMENTS)), (F.col("p_partkey") % 10).cast("int"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", policies.is_pairs(name).alias("pairs"), policies.checks_elements(name).alias("elements"), policies.checks_falls(name).alias("falls"), policies.segment_key(name).alias("segment_key"),
    )


@query(MARKS_SQL + """SELECT judge_id, count(*) AS n_marks FROM marks JOIN supplier ON s_suppkey = judge_id WHERE event_date >= DATE '1996-07-01' AND list_extract(['Senior', 'Novice', 'Junior', 'Juvenile', 'Advanced Novice', 'Adult'], element_type_id) IN ('Novice', 'Advanced Novice', 'Junior', 'Senior')
AND list_extract(['Singles', 'Showcase ', 'Pairs', 'Ice Dance', 'Uncategorized'], discipline_type_id) NOT IN ('Showcase ', 'Uncategorized') AND s_name IN ('Supplier#000000001', 'Supplier#000000002', 'Supplier#000000005') GROUP BY judge_id""")
def preset_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks in an era, of a preset's levels, of disciplines with elements, of named judges."""
    own = marks(spark, sf_dir).join(table(spark, sf_dir, "supplier"), F.col("judge_id") == F.col("s_suppkey"))
    level = F.get(F.array(*map(F.lit, ("Senior", "Novice", "Junior", "Juvenile", "Advanced Novice", "Adult"))), F.col("element_type_id") - 1)
    discipline = F.get(F.array(*map(F.lit, ("Singles", "Showcase ", "Pairs", "Ice Dance", "Uncategorized"))), F.col("discipline_type_id") - 1)
    own = own.where(policies.in_era(F.col("event_date"), "1996-07-01", "1995-01-01") & policies.level_in(level, "novice_junior_senior") & policies.has_elements(discipline))
    return own.where(policies.judge_in(F.col("s_name"), "Supplier#000000001; Supplier#000000002,\n Supplier#000000005;")).groupBy("judge_id").agg(F.count(F.lit(1)).alias("n_marks"))


_ORDER = "CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END"


@query(f"""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {_ORDER} DESC NULLS LAST, CAST(year(o_orderdate) AS VARCHAR), lower(o_orderpriority), o_orderkey) AS newest,
row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce({_ORDER}, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) - 3 END) DESC NULLS LAST, CASE WHEN regexp_matches(o_orderstatus || o_orderpriority[1], '^[0-9]+$') THEN CAST(o_orderpriority[1] AS INTEGER) ELSE 0 END DESC, o_orderpriority, o_orderkey) AS active FROM orders""")
def competition_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    date = F.to_date("o_orderdate")
    end, start = F.when(F.col("o_orderkey") % 7 != 0, date), F.when(F.col("o_orderkey") % 2 == 0, F.date_sub(date, 3))
    season = F.concat("o_orderstatus", F.substring("o_orderpriority", 1, 1))
    one = choices.newest_first(end, F.year(date), F.col("o_orderpriority"))
    two = choices.activity_order(start, end, season, F.col("o_orderpriority"))
    by = lambda order: F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order, "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", by(one).alias("newest"), by(two).alias("active"))


@query(MARKS_SQL + """, s AS (SELECT judge_id, list(DISTINCT segment_id) FILTER (judge_score > 0) AS a, list(DISTINCT segment_id) FILTER (is_rule_error) AS b FROM marks GROUP BY judge_id), t AS (SELECT judge_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM s)
SELECT judge_id, array_to_string(list_sort(list_intersect(a, b)), ' ') AS both, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ' ') AS unused FROM t""")
def segment_id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = marks(spark, sf_dir).groupBy("judge_id").agg(F.collect_set(F.when(F.col("judge_score") > 0, F.col("segment_id"))).alias("a"), F.collect_set(F.when(F.col("is_rule_error"), F.col("segment_id"))).alias("b"))
    shown = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return own.select("judge_id", shown(choices.in_common(F.col("a"), F.col("b"))).alias("both"), shown(choices.unused(F.col("a"), F.col("b"))).alias("unused"))


@query("SELECT l_suppkey, max(CASE WHEN l_returnflag = 'R' THEN year(l_shipdate) END) AS last_returned, max(CASE WHEN l_linestatus = 'O' AND l_quantity > 45 THEN year(l_shipdate) END) AS last_open FROM lineitem GROUP BY l_suppkey")
def last_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, year = table(spark, sf_dir, "lineitem"), F.year("l_shipdate").cast("long")
    return own.groupBy("l_suppkey").agg(F.max(F.when(F.col("l_returnflag") == "R", year)).alias("last_returned"), F.max(F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45), year)).alias("last_open"))


@query("""WITH c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) END AS s, CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_orderdate AS DATE) END AS e, CASE WHEN o_orderkey % 3 = 0 THEN '1920' END AS y,
CASE WHEN o_orderkey % 5 < 3 THEN CAST(year(o_orderdate) + 1 AS VARCHAR) || ' World Championships' ELSE 'Cup' END AS n, o_orderkey % 2 = 0 AS major FROM orders), t AS (SELECT *, CAST(nullif(regexp_extract(n, '\\b((?:19|20)[0-9]{2})\\b', 1), '') AS INTEGER) AS ty FROM c)
SELECT k AS o_orderkey, CAST(coalesce(year(s), year(e), CASE WHEN major THEN ty END, 2000 + CAST(y AS INTEGER) % 100, ty) AS INTEGER) AS calendar_year FROM t""")
def calendar_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, date = F.col("o_orderkey"), F.to_date("o_orderdate")
    name = F.when(k % 5 < 3, F.concat((F.year(date) + 1).cast("string"), F.lit(" World Championships"))).otherwise("Cup")
    year = policies.calendar_year(F.when(k % 4 == 0, date), F.when(k % 4 == 1, date), F.when(k % 3 == 0, F.lit("1920")), name, k % 2 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", year.alias("calendar_year"))


@query("""WITH p AS (SELECT c_custkey, 'Regional ' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' | ' || c_mktsegment END || CASE WHEN c_custkey % 3 = 2 THEN ' | Nov 3-5, 20' || lpad(CAST(c_custkey % 30 AS VARCHAR), 2, '0') ELSE '' END || '?' AS t FROM customer), q AS (SELECT c_custkey, string_split(rtrim(t, '?'), '|') AS x, t FROM p)
SELECT c_custkey, trim(x[1]) AS title, trim(x[2]) AS location, trim(x[3]) AS dates, nullif(regexp_extract(t, '(20[0-9]{2})', 1), '') AS year FROM q""")
def form_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    place = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" | "), "c_mktsegment"))
    dates = F.when(k % 3 == 2, F.concat(F.lit(" | Nov 3-5, 20"), F.lpad((k % 30).cast("string"), 2, "0"))).otherwise("")
    parts = policies.prompt_parts(F.concat(F.lit("Regional "), k.cast("string"), place, dates, F.lit("?")))
    return table(spark, sf_dir, "customer").select("c_custkey", parts.alias("p")).select("c_custkey", "p.*")


@query("""WITH d AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INTEGER) AS b FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 5 < 4 THEN strftime(a, '%Y-%m-%d') END AS first, CASE WHEN k % 5 IN (0, 1) THEN strftime(b, '%Y-%m-%d') WHEN k % 5 < 4 THEN strftime(a, '%Y-%m-%d') END AS last FROM d""")
def index_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of index pages: two dates with a zone, two dates, one with points, one with slashes, none."""
    k, a = F.col("o_orderkey"), F.to_date("o_orderdate")
    b = F.expr("date_add(to_date(o_orderdate), cast(o_orderkey % 4 as int))")
    us, eu = (lambda d: F.date_format(d, "MM/dd/yyyy")), (lambda d: F.date_format(d, "dd.MM.yyyy"))
    line = F.when(k % 5 == 0, F.concat(us(a), F.lit("  - "), us(b), F.lit(" (GMT -05:00)"))).when(k % 5 == 1, F.concat(eu(a), F.lit(" - "), eu(b))).when(k % 5 == 2, eu(a)).when(k % 5 == 3, F.concat(us(a), F.lit(" (EST)"))).otherwise("Ice House, Boston")
    return table(spark, sf_dir, "orders").select("o_orderkey", policies.slash_dates(line).alias("d")).select("o_orderkey", F.col("d.first").cast("string").alias("first"), F.col("d.last").cast("string").alias("last"))


@query("""SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 11 WHEN 3 THEN 9 WHEN 4 THEN 8 WHEN 5 THEN 9 END AS appointment_type_id FROM supplier""")
def role_appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = ("Judge No. 3", "Event Referee", "Technical Controller", "Assistant Technical Specialist", "Replay operator", " Technical Specialist", "Announcer")
    role = F.get(F.array(*map(F.lit, roles)), (F.col("s_suppkey") % 7).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", policies.appointment(role).alias("appointment_type_id"))


@query("""SELECT c_custkey, substr(sha256('{"discipline": ' || CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE CAST(c_custkey % 5 AS VARCHAR) END || ', "scope": "' || c_mktsegment || '", "season": "' || (c_nationkey + 1800) || '"}'), 1, 24) AS shard_key,
'{"name":"' || c_name || '","nation":' || c_nationkey || ',"day":"2024-07-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') || '","none":null}' AS cells FROM customer""")
def shard_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"season": (F.col("c_nationkey") + 1800).cast("string"), "scope": F.col("c_mktsegment"), "discipline": F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 5)}
    own = table(spark, sf_dir, "customer").withColumns({
        "name": F.col("c_name"), "nation": F.col("c_nationkey"), "day": F.expr("date_add(date'2024-07-01', cast(c_custkey % 28 as int))"), "none": F.lit(None).cast("string"),
    })
    return own.select("c_custkey", policies.shard_key(parts).alias("shard_key"), policies.safe_cells(["name", "nation", "day", "none"]).alias("cells"))


@query("""SELECT s_suppkey AS judge_id, b || CASE WHEN row_number() OVER (PARTITION BY b ORDER BY s_suppkey) > 1 THEN ' [judge id ' || s_suppkey || ']' ELSE '' END AS label
FROM (SELECT s_suppkey, 'Judge ' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN ' (Club ' || s_nationkey % 3 || ')' ELSE '' END AS b FROM supplier)""")
def singleton_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("judge_id"), F.concat(F.lit("Judge "), F.col("s_nationkey").cast("string")).alias("judge_name"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Club "), (F.col("s_nationkey") % 3).cast("string"))).alias("location"))
    return names.singleton_labels(own)


@query("""WITH m AS (SELECT s_nationkey AS identity, max(CASE WHEN s_suppkey % 4 = 0 THEN 'Alexandra Family' || s_nationkey END) AS whole, max(CASE WHEN s_suppkey % 4 = 1 THEN 'A. Family' || s_nationkey END) AS initial,
max(CASE WHEN s_suppkey % 4 = 2 THEN 'FAMILY' || s_nationkey || ' Alex' END) AS turned, max(CASE WHEN s_suppkey % 4 = 3 THEN 'Zoe Maiden' END) AS other FROM supplier GROUP BY s_nationkey)
SELECT identity, CASE WHEN identity % 2 = 0 THEN concat_ws(' · ', 'Alex Family' || identity, other) ELSE concat_ws(' · ', coalesce(whole, initial), turned, other) || ' (linked)' END AS label FROM m""")
def identity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in four forms by judge: in full, an initial, family name first, another person's."""
    family = F.concat(F.lit("Family"), F.col("s_nationkey").cast("string"))
    k = F.col("s_suppkey") % 4
    name = F.when(k == 0, F.concat(F.lit("Alexandra "), family)).when(k == 1, F.concat(F.lit("A. "), family)).when(k == 2, F.concat(F.upper(family), F.lit(" Alex"))).otherwise("Zoe Maiden")
    own = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("identity"), name.alias("judge_name"))
    directory = own.where("identity % 2 = 0").select("identity", F.concat(F.lit("Alex Family"), F.col("identity").cast("string")).alias("full_name")).distinct()
    return names.identity_labels(own, directory, " (linked)")


_SEMINARS = "WITH s AS (SELECT user_id AS official_id, 2000 + day(ts) % 10 AS season, event_type IN ('click', 'view', 'signup') AS in_person FROM events)"


@query(_SEMINARS + """, c AS (SELECT official_id, count(*) AS n_seminars, count(*) FILTER (season BETWEEN 2006 AND 2009) AS n, count(*) FILTER (season BETWEEN 2008 AND 2009 AND in_person) AS p, count(*) FILTER (season BETWEEN 2005 AND 2009 AND NOT in_person) AS o, count(*) FILTER (season BETWEEN 2008 AND 2009) AS q FROM s GROUP BY official_id)
SELECT official_id, n, n >= 12 AS enough, n_seminars, CASE WHEN p >= 6 THEN 'In person' WHEN o >= 8 AND q >= 5 THEN 'Online' END AS way, p >= 6 OR (o >= 8 AND q >= 5) AS met FROM c""")
def seminar_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("official_id"), (2000 + F.dayofmonth("ts") % 10).alias("season"), F.col("event_type").isin("click", "view", "signup").alias("in_person"))
    ways = [
        {"label": "In person", "requirements": [{"season_window": 2, "min": 6, "in_person": True}]}, {"label": "Online", "requirements": [{"season_window": 5, "min": 8, "in_person": False}, {"season_window": 2, "min": 5}]},
        {"label": "Never", "requirements": [{"min": 1}]},
    ]
    counts = choices.seminar_counts(own, 2009, 4, 12).withColumnRenamed("met", "enough")
    return counts.join(choices.seminar_alternatives(own, 2009, ways), "official_id")


@query(MARKS_SQL + """, p AS (SELECT judge_id, list(DISTINCT competition_id) FILTER (season_start = 1997 AND competition_type_id IN (2, 3)) AS a, list(DISTINCT competition_id) FILTER (season_start >= 1996 AND competition_type_id IN (3, 4)) AS b FROM marks GROUP BY judge_id)
SELECT judge_id, len(coalesce(a, [])) >= 2 AND len(coalesce(b, [])) >= 1 AND len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) >= 3 AS met FROM p""")
def distinct_cover_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two competitions of the last season of one kind and one of another kind, none used twice."""
    pool = lambda c: F.collect_set(F.when(c, F.col("competition_id")))
    last, recent = rules.in_window(F.col("season_start"), 1997, F.lit(1)), F.col("season_start") >= 1996
    own = marks(spark, sf_dir).groupBy("judge_id").agg(pool(last & F.col("competition_type_id").isin(2, 3)).alias("a"), pool(recent & F.col("competition_type_id").isin(3, 4)).alias("b"))
    return own.select("judge_id", rules.distinct_cover(F.array("a", "a", "b")).alias("met"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS line FROM lineitem WHERE l_orderkey % 10 = 0), c AS (SELECT l_orderkey AS page_id, CAST(line AS INTEGER) AS line, CASE WHEN l_linenumber % 3 = 0 THEN 'component' ELSE 'element' END AS kind,
CASE WHEN l_linenumber % 3 = 0 THEN 'Skills ' || l_linenumber ELSE '3Lz ' || l_partkey END AS name, [CAST(CAST(l_quantity AS INTEGER) AS DOUBLE), CASE WHEN l_linenumber % 2 = 0 THEN CAST(-(l_suppkey % 5) AS DOUBLE) END] AS s FROM l)
SELECT page_id, line, kind, name, CAST(p AS INTEGER) AS position, s[p] + 0.0 AS score FROM (SELECT *, unnest([1, 2]) AS p FROM c)""")
def protocol_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protocols in HTML, made of every tenth order's lines, parsed to marks; a blank cell is a mark without a score."""
    cell = lambda *c: F.concat(F.lit("<td>"), *c, F.lit("</td>"))
    scores = F.concat(cell(F.col("l_quantity").cast("int").cast("string")), cell(F.when(F.col("l_linenumber") % 2 == 0, (-(F.col("l_suppkey") % 5)).cast("string")).otherwise("")))
    component = F.concat(F.lit('<tr><td class="cn">Skills '), F.col("l_linenumber").cast("string"), F.lit("</td>"), scores, F.lit("</tr>"))
    element = F.concat(F.lit('<tr><td class="num">1</td>'), cell(F.lit("3Lz "), F.col("l_partkey").cast("string")), scores, F.lit("</tr>"))
    rows = table(spark, sf_dir, "lineitem").where("l_orderkey % 10 = 0").select(F.col("l_orderkey").alias("page_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.when(F.col("l_linenumber") % 3 == 0, component).otherwise(element).alias("tr")).alias("r"))
    pages = rows.groupBy("page_id").agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r.tr), "\n"), F.lit("</table>")).alias("html"))
    return protocols.protocols(pages)


@query("""SELECT k AS category, n, running FROM (SELECT CAST(o_orderpriority AS VARCHAR) AS k, n, round(100.0 * sum(n) OVER (ORDER BY n DESC, o_orderpriority) / sum(n) OVER (), 4) + 0.0 AS running FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
UNION ALL SELECT 'Total', count(*), 100.0 FROM orders)""")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return choices.with_total(counts, "category")


_POOLS = MARKS_SQL + """, b AS (SELECT discipline_type_id, judge_score AS v, count(*) FILTER (season_start < 1997) AS x, count(*) FILTER (season_start >= 1997) AS y FROM marks GROUP BY ALL), r AS (SELECT *, sum(x) OVER w AS rx, sum(y) OVER w AS ry, sum(x) OVER a AS nx, sum(y) OVER a AS ny FROM b WINDOW w AS (PARTITION BY discipline_type_id ORDER BY v), a AS (PARTITION BY discipline_type_id)),
g AS (SELECT discipline_type_id, CAST(any_value(nx) AS BIGINT) AS nx, CAST(any_value(ny) AS BIGINT) AS ny, sum(x * (ry - y / 2)) AS u, max(abs(rx / nx - ry / ny)) AS d, sum(x * v) AS sx, sum(y * v) AS sy, sum(x * v * v) AS qx, sum(y * v * v) AS qy FROM r GROUP BY discipline_type_id)"""


@query(_POOLS + "SELECT discipline_type_id, nx, ny, round(u, 1) + 0.0 AS u, round(d, 6) + 0.0 AS d, round((sx / nx - sy / ny) / sqrt((qx - sx * sx / nx + qy - sy * sy / ny) / (nx + ny - 2) * (1 / nx + 1 / ny)), 6) + 0.0 AS t FROM g")
def compared_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choices.compared_pools(marks(spark, sf_dir), ["discipline_type_id"], "judge_score", F.col("season_start") >= 1997)


_TREND = MARKS_SQL + ", y AS (SELECT segment_id, season_start, CAST(sum(judge_score) AS BIGINT) * 1.0 / count(*) AS value FROM marks GROUP BY ALL)"


@query(_TREND + "SELECT segment_id, count(*) AS n_years, round(regr_slope(value, season_start), 6) + 0.0 AS slope, round(corr(value, season_start), 6) + 0.0 AS r FROM y GROUP BY segment_id")
def segment_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = marks(spark, sf_dir).groupBy("segment_id", "season_start").agg((F.sum("judge_score") / F.count(F.lit(1))).alias("value"))
    return choices.trends(own, "segment_id").drop("p")


@query(None)
def segment_trend_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the two-sided p of each slope, which SQL has no function for."""
    own = marks(spark, sf_dir).groupBy("segment_id", "season_start").agg((F.sum("judge_score") / F.count(F.lit(1))).alias("value"))
    return choices.trends(own, "segment_id")


@query("""SELECT c_custkey, p AS position, j AS judge, s AS score FROM (SELECT c_custkey, unnest([1, 2, 3]) AS p, unnest([c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE 'third' END]) AS j, unnest([CAST(c_nationkey AS VARCHAR), CAST(c_custkey % 7 AS VARCHAR), NULL]) AS s FROM customer) WHERE trim(coalesce(j, '')) <> ''""")
def wide_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    sheet = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("j1"), F.col("c_nationkey").alias("s1"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("j2"), (k % 7).alias("s2"), F.when(k % 3 == 0, " ").otherwise("third").alias("j3"), F.lit(None).cast("int").alias("s3"), F.lit("").alias("n"))
    return choices.wide_triples(sheet, "c_custkey", [("j1", "s1", "n"), ("j2", "s2", "n"), ("j3", "s3", "n")]).drop("note")


@query(MARKS_SQL + """, e AS (SELECT pcs_type_id, discipline_type_id, m AS control, pcs_score - m AS error FROM (SELECT *, median(pcs_score) OVER (PARTITION BY element_id) AS m FROM marks)),
b AS (SELECT discipline_type_id, pcs_type_id, round_even(control / 0.25, 0) * 0.25 AS bin, count(*) AS n, avg(control) - 5 AS x, sqrt(var_samp(error)) AS y FROM e GROUP BY ALL HAVING count(*) >= 30 AND var_samp(error) > 0),
s AS (SELECT discipline_type_id, pcs_type_id, count(*) AS n_bins, sum(n * n) AS s0, sum(n * n * x) AS s1, sum(n * n * x ** 2) AS s2, sum(n * n * x ** 3) AS s3, sum(n * n * x ** 4) AS s4, sum(n * n * y) AS t0, sum(n * n * x * y) AS t1, sum(n * n * x ** 2 * y) AS t2 FROM b GROUP BY ALL HAVING count(*) >= 3),
d AS (SELECT *, s4 * (s2 * s0 - s1 * s1) - s3 * (s3 * s0 - s1 * s2) + s2 * (s3 * s1 - s2 * s2) AS det, t2 * (s2 * s0 - s1 * s1) - s3 * (t1 * s0 - s1 * t0) + s2 * (t1 * s1 - s2 * t0) AS da, s4 * (t1 * s0 - s1 * t0) - t2 * (s3 * s0 - s1 * s2) + s2 * (s3 * t0 - t1 * s2) AS db, s4 * (s2 * t0 - t1 * s1) - s3 * (s3 * t0 - t1 * s2) + t2 * (s3 * s1 - s2 * s2) AS dc FROM s)
SELECT discipline_type_id, pcs_type_id, n_bins, round(greatest(0.05, da / det * (7 - 5) ** 2 + db / det * (7 - 5) + dc / det), 5) + 0.0 AS sigma_at_7 FROM d WHERE det <> 0""")
def direct_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spread itself, not its square, as a quadratic of control; its value at 7."""
    own = component_marks(spark, sf_dir).withColumn("error", F.col("pcs_score") - F.col("control_score"))
    bins = sigma.pcs_bins(own, least=30).withColumn("variance", F.sqrt("variance"))  # quadratics() fits what it is given
    fits = sigma.quadratics(bins, least_bins=3)
    at = F.greatest(F.lit(0.05), F.col("a") * 49 + F.col("b") * 7 + F.col("c"))
    return fits.select("discipline_type_id", "pcs_type_id", "n_bins", rounded(at, 5).alias("sigma_at_7"))


@query(MARKS_SQL + "SELECT judge_id, count(*) AS n_marks FROM marks WHERE season_start BETWEEN 1996 AND 1998 AND CAST(season_start AS VARCHAR) <> '1997' GROUP BY judge_id")
def season_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons as text between two others, both included, one left out."""
    season = F.col("season_start").cast("string")
    return panel_marks(spark, sf_dir).where(season.between("1996", "1998") & (season != "1997")).groupBy("judge_id").agg(F.count(F.lit(1)).alias("n_marks"))


_KINDS = MARKS_SQL + """, pcs AS (SELECT *, avg(pcs_score) OVER w AS pa, (pcs_score = min(pcs_score) OVER w OR pcs_score = max(pcs_score) OVER w) AND count(*) OVER (PARTITION BY element_id, pcs_score) < 3 AS pt FROM marks WINDOW w AS (PARTITION BY element_id)),
two AS (SELECT 'element' AS score_type, 2.0 AS least, discipline_type_id, panel_size, judge_id, competition_id, competition_type_id, segment_id, skater_segment_id, deviation, thrown_out, is_rule_error FROM panel UNION ALL
SELECT 'pcs', 1.5, discipline_type_id, count(*) OVER (PARTITION BY element_id), judge_id, competition_id, competition_type_id, segment_id, skater_segment_id, pcs_score - pa, pt, is_rule_error FROM pcs)"""


def _grid_sql(keys: str) -> str:
    return _KINDS + f""", own AS (SELECT {keys}, score_type, count(*) AS n_marks, count(*) FILTER (thrown_out) AS n_thrown, count(*) FILTER (abs(deviation) >= least OR is_rule_error) AS n_anomalies, count(*) FILTER (is_rule_error) AS n_rule_errors, abs(avg(deviation)) AS size FROM two GROUP BY ALL),
fields AS (SELECT competition_id, segment_id, count(DISTINCT skater_segment_id) AS entries FROM two GROUP BY ALL), seen AS (SELECT judge_id, competition_id, segment_id, score_type, count(*) FILTER (abs(deviation) >= least OR is_rule_error) AS observed FROM two GROUP BY ALL),
over_ AS (SELECT {keys}, score_type, sum(greatest(0, observed - CASE WHEN entries <= 10 THEN 1 WHEN entries <= 20 THEN 2 ELSE 3 END)) AS n_excess FROM seen JOIN fields USING (competition_id, segment_id) GROUP BY ALL), kinds AS (SELECT * FROM own JOIN over_ USING ({keys}, score_type)),
both_ AS (SELECT {keys}, 'both' AS score_type, sum(n_marks) AS n_marks, sum(n_thrown) AS n_thrown, sum(n_anomalies) AS n_anomalies, sum(n_rule_errors) AS n_rule_errors, sum(size * n_marks) / sum(n_marks) AS size, sum(n_excess) AS n_excess FROM kinds GROUP BY {keys}),
whole AS (SELECT {keys}, score_type, n_marks, n_thrown, n_anomalies, n_rule_errors, size, n_excess FROM kinds UNION ALL SELECT * FROM both_),
long_ AS (SELECT {keys}, score_type, CAST(n_marks AS BIGINT) AS n_marks, unnest(['throwout_rate', 'anomaly_rate', 'rule_error_rate', 'rule_errors', 'excess_anomalies', 'avg_deviation']) AS metric,
unnest([round(100.0 * n_thrown / n_marks, 2), round(100.0 * n_anomalies / n_marks, 2), round(100.0 * n_rule_errors / n_marks, 2), nullif(CAST(n_rule_errors AS DOUBLE), 0), nullif(CAST(n_excess AS DOUBLE), 0), (CAST(round(size * 1000000000) AS BIGINT) + 50000) // 100000 / 10000.0]) AS value FROM whole)
SELECT * FROM long_ WHERE value IS NOT NULL"""


@query(_grid_sql("judge_id"))
def heatmap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six metrics of three score types by judge."""
    kinds = rates.by_kind(panel_marks(spark, sf_dir), component_marks(spark, sf_dir), ["judge_id"])
    return rates.heatmap_grid(kinds, ["judge_id"])


@query(_grid_sql("competition_id, judge_id"))
def competition_heatmap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by competition and judge."""
    keys = ["competition_id", "judge_id"]
    return rates.heatmap_grid(rates.by_kind(panel_marks(spark, sf_dir), component_marks(spark, sf_dir), keys), keys)


@query(_KINDS + """, b AS (SELECT CASE discipline_type_id WHEN 1 THEN 'Singles' WHEN 2 THEN 'Pairs' WHEN 3 THEN 'Dance' WHEN 5 THEN 'Synchronized' END AS discipline, panel_size, CASE score_type WHEN 'pcs' THEN 'PCS' ELSE 'Element' END AS score_type, count(*) AS total_scores,
count(*) FILTER (thrown_out) AS t, count(*) FILTER (abs(deviation) >= least OR is_rule_error) AS a FROM two WHERE panel_size BETWEEN 3 AND 12 AND competition_type_id NOT IN (11, 15, 16, 17) AND discipline_type_id IN (1, 2, 3, 5) GROUP BY ALL)
SELECT discipline, panel_size, score_type, total_scores, benchmark, hits, round(100.0 * hits / total_scores, 3) AS rate_pct FROM (SELECT * EXCLUDE (t, a), unnest(['throwout', 'anomaly']) AS benchmark, unnest([t, a]) AS hits FROM b)""")
def benchmark_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda m: m.where(predicates.scope(F.col("competition_type_id"), "qualifying"))
    return rates.benchmark_by_kind(own(panel_marks(spark, sf_dir)), own(component_marks(spark, sf_dir)), classify.discipline_bucket(F.col("discipline_type_id")))


@query("""WITH j AS (SELECT s_suppkey AS judge_id, s_nationkey % 12 AS k, s_suppkey % 3 AS identity FROM supplier), g AS (SELECT k, count(DISTINCT identity) AS n_identities, list_sort(list(DISTINCT judge_id)) AS ids FROM j GROUP BY k)
SELECT 'judge no ' || k AS key, n_identities, array_to_string(ids, ' ') AS judge_ids FROM g WHERE n_identities > 1""")
def split_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("s_nationkey") % 12).cast("string")
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Judge  No. "), k)).otherwise(F.concat(F.lit("JUDGE-no "), k))
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("judge_id"), name.alias("judge_name"), (F.col("s_suppkey") % 3).alias("identity"))
    return names.split_identities(own).withColumn("judge_ids", F.array_join(F.transform("judge_ids", lambda x: x.cast("string")), " "))


@query(_SERVICE + "SELECT official_id, " + ", ".join(f"count(DISTINCT competition_id) FILTER (season_code = {y}) AS s{y}" for y in YEARS) + " FROM service WHERE nqs GROUP BY official_id")
def nqs_only_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competitions of the national series alone, by season."""
    return activity.season_pivot(service(spark, sf_dir).where("nqs"), YEARS)
