"""Helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notemill.shared import checkpoint, shared_folder  # noqa: F401  operators take them from here

#: White space and case of the word rules: ASCII only.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spare(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before until no column of docs has them in any case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def columns(docs: DataFrame, *replaced: str) -> list[Column]:
    """All columns of docs but those of the given names, in any case."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c.lower() not in replaced]


def hex_number(text: Column, digits: int) -> Column:
    """The first digits (at most 15) of text's MD5 as a non-negative long."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def bucket_starts(counts: DataFrame, group: list[str], bucket: str, n: str, before: str, total: str) -> DataFrame:
    """Add to a (group, bucket, n) table the rows before each bucket and the rows of its group.

    The table holds one row for each bucket, never the rows themselves.
    """
    every = Window.partitionBy(*group)
    return counts.withColumn(total, F.sum(n).over(every)).withColumn(
        before, F.coalesce(F.sum(n).over(every.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    )


#: A key with more than this part of all rows is joined by broadcast.
HOT_KEYS = 2000


def split_join(rows: DataFrame, facts: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined with facts, one row a key, whose column `n` tells how many rows of that key there are; n is dropped.

    Keys with over 1 / HOT_KEYS of the counted rows are fewer than HOT_KEYS by arithmetic and are broadcast, the others are
    shuffled, so no task gets a hot key. Both tables are read more than once.
    """
    many = (facts.agg(F.sum(n)).first()[0] or 0) / HOT_KEYS
    hot = facts.where(F.col(n) > many).drop(n)
    new = [c for c in hot.columns if c != key]
    marked = rows.join(F.broadcast(hot.select(F.col(key).alias("_hot"), F.struct(*new).alias("_facts"))), F.col(key) == F.col("_hot"), "left")
    cold = marked.where("_hot IS NULL").drop("_hot", "_facts").join(facts.where(F.col(n) <= many).drop(n).hint("shuffle_merge"), key)
    held = marked.where("_hot IS NOT NULL").select(*rows.columns, "_facts.*")
    return held.unionByName(cold.select(*rows.columns, *new))
