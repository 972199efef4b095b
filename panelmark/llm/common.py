"""What the corpus operators share: reading, tables in the shared folder, checked broadcasts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.storage import saved, shared_dir  # noqa: F401  saved is the operators'

#: ASCII white space, the only separators of words.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved_by(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """As saved(), in buckets by column: what groups or joins by it needs no exchange of these rows."""
    spark = df.sparkSession
    name = f"saved_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    out = spark.table(name).select(*df.columns)
    spark.sql(f"DROP TABLE {name}")  # the name only: files of a table with a path stay, and out has its files already
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files of a saved table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def checked(df: DataFrame, most_rows: int) -> DataFrame:
    """A broadcast hint if df, which must be cheap to count, has at most most_rows rows; else df, to be shuffled."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_fold(doc_id: Column, folds: int) -> Column:
    """True where crc32 of the id as text leaves 0; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def no_space(text: Column) -> Column:
    for c in " \t\n\v\f\r":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text
