"""Names of persons: keys, equality with swapped words, short forms and initials, labels of identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmark.operators.identity import nfkc


def person_key(name: Column) -> Column:
    """NFKC, lower case, signs as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(nfkc(F.coalesce(name, F.lit(""))))), "[-_/.,;:'\"`]+", " "), "\\s+", " "))


def same_given(a: Column, b: Column) -> Column:
    """Given names that are equal, an initial of the other, or its beginning."""
    initial = (F.length(a) == 1) | (F.length(b) == 1)
    return F.when((a == "") | (b == ""), a == b).when(initial, F.substring(a, 1, 1) == F.substring(b, 1, 1)).otherwise(F.startswith(a, b) | F.startswith(b, a))


def same_person(a: Column, b: Column) -> Column:
    """Of two person_key()s: equal, the same words in any order, or one family name, the last word, with same_given() names.

    An empty key equals an empty one only.
    """
    x, y = F.split(a, " "), F.split(b, " ")
    given = lambda w: F.array_join(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), " ")
    western = (F.size(x) > 1) & (F.size(y) > 1) & (F.element_at(x, -1) == F.element_at(y, -1)) & same_given(given(x), given(y))
    return F.when((a == "") | (b == ""), a == b).otherwise((F.array_sort(x) == F.array_sort(y)) | western)


def distinct_names(names: Column) -> Column:
    """Of (key, name) structs in order, one name a person: of same_person()s the longer, of equal ones the first."""

    def step(kept: Column, n: Column) -> Column:
        other = F.filter(kept, lambda k: same_person(k.key, n.key))
        longer = F.get(other, F.lit(0))
        better = F.when(F.length(n["name"]) > F.length(longer["name"]), n).otherwise(longer)
        return F.when(F.size(other) == 0, F.concat(kept, F.array(n))).otherwise(F.concat(F.filter(kept, lambda k: ~(k == longer)), F.array(better)))

    return F.aggregate(names, F.slice(names, 1, 0), step)


def identity_labels(judges: DataFrame, directory: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """judges (identity, judge_name) to (identity, label): the directory's name (identity, full_name), then other names of other persons
    in order; without a directory name the names alone and the suffix. An identity has few names; repeated ones are one."""
    keyed = judges.where("judge_name IS NOT NULL").select("identity", "judge_name", person_key(F.col("judge_name")).alias("key")).distinct()
    named = F.array_sort(F.collect_set(F.struct(F.lower("judge_name").alias("low"), "key", F.col("judge_name").alias("name"))))
    own = keyed.groupBy("identity").agg(F.transform(named, lambda n: F.struct(n.key.alias("key"), n["name"].alias("name"))).alias("names"))
    if directory is None:
        own = own.withColumn("full_name", F.lit(None).cast("string"))
    else:
        own = own.join(directory.select("identity", "full_name"), "identity", "left")
    full = person_key(F.col("full_name"))
    others = F.when(F.coalesce(F.trim("full_name"), F.lit("")) == "", F.col("names")).otherwise(F.filter("names", lambda n: ~same_person(n.key, F.col("full_key"))))
    own = own.withColumn("full_key", full).withColumn("others", others)
    shown = F.array_join(F.transform(F.array_sort(F.transform(distinct_names(F.col("others")), lambda n: F.struct(F.lower(n["name"]).alias("low"), n["name"].alias("name")))), lambda n: n["name"]), " · ")
    label = F.when(F.coalesce(F.trim("full_name"), F.lit("")) == "", F.concat(shown, F.lit(suffix))).when(shown == "", F.trim("full_name")).otherwise(F.concat_ws(" · ", F.trim("full_name"), shown))
    return own.select("identity", label.alias("label"))


def singleton_labels(judges: DataFrame) -> DataFrame:
    """judges (judge_id, judge_name, location) to (judge_id, label): `name (location)`; a label that came before has the id added."""
    base = F.when(F.coalesce("location", F.lit("")) == "", F.col("judge_name")).otherwise(F.concat("judge_name", F.lit(" ("), "location", F.lit(")")))
    own = judges.withColumn("base", base)
    again = F.row_number().over(Window.partitionBy("base").orderBy(F.lower("judge_name"), "judge_id"))
    return own.withColumn("again", again).select("judge_id", F.when(F.col("again") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" [judge id "), F.col("judge_id").cast("string"), F.lit("]"))).alias("label"))


def split_identities(judges: DataFrame) -> DataFrame:
    """judges (judge_id, judge_name, identity): names of one person under several identities, a row a key: links that could be made."""
    keyed = judges.withColumn("key", person_key(F.col("judge_name"))).where("key <> ''")
    own = keyed.groupBy("key").agg(F.countDistinct("identity").alias("n_identities"), F.array_sort(F.collect_set("judge_id")).alias("judge_ids"))  # few judges have one name
    return own.where("n_identities > 1")
