"""When and where rules on marks apply: eras, seasons, segments, levels, disciplines, judges; roles and calendar years."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelmark.functions.classify import first_of

# The first day of today's element scale, of today's components, and of caps for falls, with its season.
ELEMENTS_FROM = "2018-07-01"
COMPONENTS_FROM = "2022-07-01"
FALLS_FROM, FALLS_FROM_SEASON = "2024-07-01", "2425"
# Disciplines with caps for falls.
FALL_DISCIPLINES = (1, 2, 3, 4, 5)
# Levels by preset; None is all.
LEVEL_PRESETS = {"all": None, "novice_junior_senior": ("Novice", "Advanced Novice", "Junior", "Senior"), "junior_senior": ("Junior", "Senior")}
# Names of disciplines without element marks.
NO_ELEMENTS = ("showcase", "theatre on ice", "athlete development", "uncategorized")
# Words of segments of singles and pairs.
SINGLES_WORDS = ("WOMEN", "MEN", "BOYS", "GIRLS", "LADIES", "LADY", "GIRL", "BOY")
PAIRS_WORDS = ("PAIR", "PAIRS")
# Words that say nothing when segments are matched, and a word that is often misspelt.
SILENT_WORDS = ("SINGLE", "SKATING")
MISSPELT = {"WOMWN": "WOMEN"}
# Appointments by role.
JUDGE, REFEREE, SPECIALIST, CONTROLLER, OPERATOR = 1, 4, 9, 11, 8


def in_era(date: Column, first: str, start: str | None = None) -> Column:
    """On or after the later of an era's first day and a wanted one."""
    return date >= F.lit(max(first, start or first)).cast("date")


def flags_elements(start: Column, end: Column) -> Column:
    """Whether element rules are checked: by the start, else the end; without both they are."""
    return F.coalesce(F.coalesce(start, end) >= F.lit(ELEMENTS_FROM).cast("date"), F.lit(True))


def flags_falls(season: Column, start: Column, end: Column) -> Column:
    """Whether caps for falls are checked: by the season's code as text, else as flags_elements."""
    by_date = F.coalesce(F.coalesce(start, end) >= F.lit(FALLS_FROM).cast("date"), F.lit(True))
    return F.when(F.trim(season) != "", F.trim(season) >= FALLS_FROM_SEASON).otherwise(by_date)


def level_in(level: Column, preset: str | None) -> Column:
    levels = LEVEL_PRESETS[preset or "all"]
    return F.lit(True) if levels is None else level.isin(*levels)


def has_elements(discipline: Column) -> Column:
    """By the discipline's name; a null name has."""
    return F.coalesce(~F.lower(F.trim(discipline)).isin(*NO_ELEMENTS), F.lit(True))


def judge_names(text: str | None) -> tuple[str, ...]:
    """Names between commas, semicolons and line ends."""
    return tuple(dict.fromkeys(p.strip() for p in re.split(r"[\n,;]+", text or "") if p.strip()))


def judge_in(name: Column, text: str | None) -> Column:
    """Exactly one of the names; without names all judges are."""
    names = judge_names(text)
    return name.isin(*names) if names else F.lit(True)


def _words(segment: Column) -> Column:
    return F.split(F.replace(F.upper(F.coalesce(segment, F.lit(""))), F.lit("-"), F.lit("_")), "_+")


def _holds(segment: Column, *parts: str) -> Column:
    out = F.lit(True)
    for part in parts:
        out = out & F.contains(F.upper(F.coalesce(segment, F.lit(""))), F.lit(part))
    return out


def is_pairs(segment: Column) -> Column:
    return F.arrays_overlap(_words(segment), F.array(*map(F.lit, PAIRS_WORDS))) | _holds(segment, "PAIR", "SKATING")


def checks_elements(segment: Column) -> Column:
    """Whether element rules apply to a segment of this name: singles and pairs."""
    return F.arrays_overlap(_words(segment), F.array(*map(F.lit, SINGLES_WORDS))) | is_pairs(segment) | _holds(segment, "SINGLE", "MEN")


def checks_falls(segment: Column) -> Column:
    """Whether caps for falls apply: also to dance, solo dance and synchronized."""
    kinds = F.arrays_overlap(_words(segment), F.array(F.lit("RHYTHM"), F.lit("PATTERN"), F.lit("FREE")))
    return checks_elements(segment) | _holds(segment, "SYNCHRO") | _holds(segment, "SOLO", "DANCE") | _holds(segment, "ICE", "DANCE") | (_holds(segment, "DANCE") & kinds)


def segment_key(name: Column) -> Column:
    """Words of letters and digits in upper case, without silent ones, joined by underscores."""
    words = F.split(F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9]+", "_")), "_+")
    told = F.filter(words, lambda w: (w != "") & ~w.isin(*SILENT_WORDS))
    return F.array_join(F.transform(told, lambda w: first_of([(w == bad, F.lit(good)) for bad, good in MISSPELT.items()], w)), "_")


def appointment(role: Column) -> Column:
    """The appointment's id of a role; null for others."""
    r = F.trim(role)
    return first_of([
        (F.startswith(r, F.lit("Judge")), F.lit(JUDGE)), (F.contains(r, F.lit("Referee")), F.lit(REFEREE)), (F.contains(r, F.lit("Technical Controller")), F.lit(CONTROLLER)),
        (F.contains(r, F.lit("Technical Specialist")), F.lit(SPECIALIST)), (F.lower(r).rlike("^(data|replay) operator"), F.lit(OPERATOR)),
    ])


def calendar_year(start: Column, end: Column, season: Column, name: Column, major: Column) -> Column:
    """A competition's year: of its start, its end, of a major event's name, of its season's code (1000 to 9999), of any name."""
    titled = F.regexp_extract(name, "\\b((?:19|20)[0-9]{2})\\b", 1)
    year = F.when(titled != "", titled.cast("int"))
    stored = F.when(season.rlike("^[0-9]{4}$") & (season >= "1000"), 2000 + season.cast("int") % 100)
    return F.coalesce(F.year(start), F.year(end), F.when(major, year), stored, year)


def prompt_parts(prompt: Column) -> Column:
    """A form's column head `title | location | dates?` in its parts, with a year after 2000 from anywhere in it; parts that lack are null."""
    text = F.regexp_replace(F.trim(prompt), "[?]+$", "")
    part = F.transform(F.split(text, "[|]"), lambda p: F.trim(p))
    year = F.regexp_extract(text, "(20[0-9]{2})", 1)
    return F.struct(F.get(part, F.lit(0)).alias("title"), F.get(part, F.lit(1)).alias("location"), F.get(part, F.lit(2)).alias("dates"), F.when(year != "", year).alias("year"))


def slash_dates(line: Column) -> Column:
    """(first, last) of a line `MM/DD/YYYY` or `MM/DD/YYYY - MM/DD/YYYY`, a zone in brackets after it; dates `DD.MM.YYYY` as well; else nulls."""
    text = F.trim(F.split(F.regexp_replace(line, "\\s+", " "), "[(]")[0])
    one = "([0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4})"
    pair, alone = f"^{one} - {one}$", f"^{one}$"

    def read(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("/")), F.try_to_date(t, "M/d/yyyy")).otherwise(F.try_to_date(t, "d.M.yyyy"))

    first = F.when(text.rlike(pair), F.regexp_extract(text, pair, 1)).when(text.rlike(alone), F.regexp_extract(text, alone, 1))
    last = F.when(text.rlike(pair), F.regexp_extract(text, pair, 2)).otherwise(first)
    return F.struct(read(first).alias("first"), read(last).alias("last"))


def safe_cells(columns: Sequence[str]) -> Column:
    """The cells as JSON: dates as ISO text, missing and not-a-number values as null, others as they are."""
    return F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd"})


def run_key(parameters: Mapping) -> str:
    """24 hexadecimal digits of a run's parameters, whatever their order."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:24]


def shard_key(parts: Mapping[str, Column]) -> Column:
    """run_key() of each row's parts: text is quoted, numbers are not, nulls are null."""

    def cell(c: Column) -> Column:
        return F.coalesce(F.when(F.typeof(c) == "string", F.concat(F.lit('"'), c.cast("string"), F.lit('"'))).otherwise(c.cast("string")), F.lit("null"))

    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), cell(parts[k])) for k in sorted(parts)])
    return F.substring(F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256), 1, 24)
