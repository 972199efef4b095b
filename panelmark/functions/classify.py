"""Classifications of names and codes as ordered rules: the first that fits wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in a segment's name and the discipline they say, in this order.
DISCIPLINES = (
    ("women", "Singles"), ("girl", "Singles"), ("ladies", "Singles"), ("men", "Singles"), ("boy", "Singles"), ("excel", "Singles"), ("singles", "Singles"),
    ("solo", "Solo Dance"), ("shadow", "Solo Dance"), ("pair", "Pairs"), ("dance", "Ice Dance"), ("showcase", "Showcase"), ("team", "Synchronized"), ("synchronized", "Synchronized"),
    ("unified", "Synchronized"), ("elite", "Synchronized"), ("choreographic", "Theatre On Ice"), ("theatre", "Theatre On Ice"), ("spin", "Athlete Development"), ("jump", "Athlete Development"),
    ("compulsory", "Athlete Development"),
)
# Tokens of levels, in this order.
LEVELS = (
    "INTERMEDIATE NOVICE", "ADVANCED NOVICE", "BASIC NOVICE", "EXCEL PRELIMINARY PLUS", "EXCEL PRE JUVENILE PLUS", "EXCEL PRELIMINARY", "EXCEL INTERMEDIATE", "EXCEL NOVICE", "EXCEL JUVENILE",
    "EXCEL JUNIOR", "EXCEL SENIOR", "OPEN COLLEGIATE", "OPEN ADULT", "OPEN MASTERS", "OPEN JUVENILE", "MIXED AGE", "NO TEST", "COLLEGIATE", "PRE PRELIMINARY", "PRELIMINARY", "PRE JUVENILE",
    "INTERMEDIATE", "MASTERS", "ADULT", "SENIOR", "JUNIOR", "JUVENILE", "NOVICE",
)
# Component names, then words in them.
COMPONENTS = (("skating skills", "SS"), ("transitions", "TR"), ("transition", "TR"), ("performance", "PE"), ("composition", "CO"), ("composition/skating skills", "SS"), ("presentation", "PR"), ("timing", "TI"))
COMPONENT_WORDS = (("skating skill", "SS"), ("transition", "TR"), ("performance", "PE"), ("composition", "CO"), ("presentation", "PR"), ("timing", "TI"))
NOT_COUNTRIES = ("THE", "AND", "FOR")


def first_of(rules: Sequence[tuple[Column, Column | str]], otherwise: Column | str | None = None) -> Column:
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def discipline(name: Column) -> Column:
    low = F.lower(name)
    return first_of([(F.contains(low, F.lit(w)), d) for w, d in DISCIPLINES], "Uncategorized")


def discipline_bucket(kind: Column) -> Column:
    """Ids 1 singles, 2 pairs, 3 and 6 (ice and solo) dance, 5 synchronized."""
    return F.when(kind == 1, "Singles").when(kind == 2, "Pairs").when(kind.isin(3, 6), "Dance").when(kind == 5, "Synchronized")


def normal_segment(name: Column) -> Column:
    """Upper case, anything between words one underscore."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(name), "(?U)[^\\w]+", "_"), "_+", "_"), F.lit("_"))


def level(name: Column, international: Column | None = None, competition: Column | None = None) -> Column:
    """A level's token in the segment's name, else what an international competition's name says, else Unspecified."""
    normal = normal_segment(name)
    rules = [(normal.rlike(f"(^|_|[0-9]){t.replace(' ', '_')}(_|$)"), " ".join(w.capitalize() for w in t.split())) for t in LEVELS]
    if international is not None:
        comp = competition if competition is not None else F.lit("")
        rules.append((international & comp.rlike("(?i)\\bJUNIOR\\b|\\bJGP\\b"), "Junior"))
        rules.append((international & (normal != ""), "Senior"))
    return first_of(rules, "Unspecified")


def component(name: Column) -> Column:
    low = F.lower(F.trim(name))
    rules = [(low == n, c) for n, c in COMPONENTS] + [(F.contains(low, F.lit(w)), c) for w, c in COMPONENT_WORDS]
    return F.when(F.trim(name) != "", first_of(rules, F.trim(name)))


def role_label(role: Column) -> Column:
    """A panel role shortened."""
    r = F.trim(role)
    low = F.lower(r)
    return first_of([
        (F.startswith(low, F.lit("judge")), "Judge"), (F.contains(low, F.lit("referee")), "Referee"), (F.contains(low, F.lit("technical controller")), "Technical Controller"),
        (F.contains(low, F.lit("technical specialist")), "Technical Specialist"), (low.rlike("data operator|replay operator"), "Data/Replay operator"),
    ], r)


def country(name: Column) -> Column:
    """Three letters that end a name, in capitals, unless they are a common word."""
    token = F.upper(F.regexp_extract(F.trim(name), "(\\S+)$", 1))
    return F.when(token.rlike("^[A-Z]{3}$") & ~token.isin(*NOT_COUNTRIES), token)


def major_event(name: Column) -> Column:
    """The championship that a competition's name says, null for others and for synchronized ones."""
    n = F.trim(F.regexp_replace(F.lower(name), "\\s+", " "))
    youth = n.rlike("youth olympic|eyof|test event|test skating")
    rules = [
        (n.rlike("grand prix.*final|\\bgp final\\b"), F.lit("grand_prix_final")), (n.rlike("synchro"), F.lit(None).cast("string")),
        (n.rlike("olympic winter games|winter olympic") & ~youth, F.lit("olympics")), (F.contains(n, F.lit("four continents")), F.lit("four_continents")),
        (n.rlike("european") & n.rlike("championship"), F.lit("europeans")), (n.rlike("world junior|junior world"), F.lit("junior_worlds")),
        (n.rlike("world.*championship|championship.*world|\\bworlds\\b") & ~n.rlike("junior"), F.lit("worlds")),
    ]
    return first_of(rules)


def stored_url(url: Column) -> Column:
    """A results page's url as it is stored: without trailing slashes, with an index page."""
    u = F.regexp_replace(F.trim(url), "/+$", "")
    low = F.lower(u)
    legacy = low.rlike("/leaderboard/results/[0-9]{4}/[0-9]+$")
    return first_of([(u == "", u), (low.rlike("/index\\.(asp|htm|html)$"), u), (legacy, F.concat(u, F.lit("/index.asp")))], F.concat(u, F.lit("/index.htm")))


def url_key(url: Column) -> Column:
    return F.lower(stored_url(url))


def max_goe(element: Column, notes: Column, event: Column) -> Column:
    """The greatest grade that an element's marks and notes allow, -5 at least."""
    count = lambda s: F.length(element) - F.length(F.replace(element, F.lit(s), F.lit("")))
    note = lambda s: F.coalesce(F.contains(notes, F.lit(s)), F.lit(False))
    downs = (count("<<") / 2).cast("int")
    unders = count("<") - 2 * downs
    attention = count("!")
    low = note("F") | note("e") | F.contains(element, F.lit("<<")) | (unders + attention >= 2)
    best = F.when(low, 2).otherwise(5) - F.when(note("F"), 5).otherwise(0) - F.when(note("e"), 2).otherwise(0) - 3 * downs - 2 * unders - F.when(note("q"), 2 * count("q")).otherwise(0) - attention
    short = F.contains(event, F.lit("Short")) & (F.contains(element, F.lit("COMBO")) | F.contains(element, F.lit("*")))
    return F.when(short, -5).otherwise(F.greatest(F.lit(-5), best))


def range_state(score: Column, low: Column, high: Column, allowance: float = 1.0) -> Column:
    """Where a trial score lies to the panel's range."""
    return first_of([
        ((low == high) & (low == score), "In Range"), (score < low - allowance, "Low- out of range with allowance"), (score < low, "Low- out of range"), (score == low, "Low- thrown out"),
        (score > high + allowance, "High- out of range with allowance"), (score > high, "High- out of range"), (score == high, "High- thrown out"),
    ], "In Range")


def score_tokens(text: Column) -> Column:
    """Numbers of a row of tokens, a dash or other text is null."""
    return F.transform(F.split(F.trim(text), "\\s+"), lambda t: F.try_to_number(F.when(t.rlike("^-?[0-9]+(\\.[0-9]+)?$"), t), F.lit("S9999999D9999")).cast("double"))


def padded(scores: Column, size: int, missing: int | None = None) -> Column:
    """scores with a null at place `missing` (from 1) and nulls up to size."""
    own = scores if missing is None else F.array_insert(scores, missing, F.lit(None).cast("double"))
    return F.concat(own, F.array_repeat(F.lit(None).cast("double"), F.greatest(F.lit(0), F.lit(size) - F.size(own))))
