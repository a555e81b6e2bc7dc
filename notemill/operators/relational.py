"""Joins, folds and rankings of the import pipeline on DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions.text import let, nfc
from notemill.operators.ranks import with_rank


def allowed(values: DataFrame, allow: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with the list's spelling as `value`, rejected rows). An empty list accepts everything as written."""
    listed = allow.dropDuplicates([key])
    if listed.isEmpty():
        return values.withColumn("value", F.col(key)), values.limit(0)
    return values.join(listed, key), values.join(listed, key, "left_anti")


#: What a number adds to a name: _02 to _99, then _100 and so on.
NUMBER = "_(0[2-9]|[1-9][0-9]+)"


def _claims(df: DataFrame, stem: str, order: str) -> DataFrame:
    """(stem, moved, skipped) of stems that meet names with a number of their own, such as x where x_02 is a stem too.

    A stem's own rows and the first rows of the stems made of it and a number are ranked together, for a count of the rows
    before each; only stems concerned take part. moved is 1 if another stem took the bare name, skipped are the numbers that
    others took in time. One task sees the distinct stems of a family, never their rows.
    """
    numbered = df.where(F.col(stem).rlike(f"(?s)^.+{NUMBER}$")).groupBy(F.col(stem).alias("child")).agg(F.min(order).alias("at"))
    shaped = numbered.select("child", "at", F.regexp_extract("child", f"(?s)^(.+){NUMBER}$", 1).alias("stem"), F.regexp_extract("child", f"(?s)^(.+){NUMBER}$", 2).cast("long").alias("k"))
    rows = df.select(F.col(stem).alias("stem"), F.col(order).alias("at"), F.lit(1).alias("own"), F.lit(None).cast("string").alias("child"), F.lit(None).cast("long").alias("k"))
    own = rows.join(shaped.select("stem").distinct(), "stem", "left_semi")
    met = own.unionByName(shaped.withColumn("own", F.lit(0))).withColumn("place", F.struct("at", (1 - F.col("own")).alias("after")))
    nth = F.row_number().over(Window.partitionBy("stem").orderBy("r"))  # a stem's numbered ones alone, each a distinct name
    found = with_rank(met, "stem", "place", "r").where("own = 0").withColumn("c", F.col("r") - nth)
    found = found.join(own.select("stem").distinct(), "stem", "left_semi")
    root = F.regexp_replace("stem", f"(?s)^(.+?)(?:{NUMBER})++$", "$1")
    children = found.select(root.alias("root"), "stem", "child", "k", "c")

    def settle(family: pd.DataFrame) -> pd.DataFrame:
        moved, skipped = {}, {}
        for parent, made in sorted(family.groupby("stem"), key=lambda x: len(x[0])):  # a parent is shorter than what it makes
            gone = skipped[parent] = []
            for k, c, child in sorted(zip(made["k"], made["c"], made["child"], strict=True)):
                if c < k - len(gone) - moved.get(parent, 0):
                    gone.append(k)
                else:
                    moved[child] = 1
        stems = sorted(set(moved) | set(skipped))
        return pd.DataFrame({"stem": stems, "moved": [moved.get(x, 0) for x in stems], "skipped": [skipped.get(x, []) for x in stems]})

    return children.groupBy("root").applyInPandas(settle, "stem string, moved int, skipped array<long>")


def unique_names(df: DataFrame, stem: str, order: str, name: str) -> DataFrame:
    """Df with column `name`: stem for the first row in order, then stem_02, stem_03 ...; no name comes twice.

    A number is passed over if a row before has it as its own stem; a stem that an earlier row got by number is numbered itself.
    Rows of equal stem and order get their numbers in any order. An empty table gives no names. Ranks come from ranges of
    (stem, order), so the rows of a frequent stem spread over many tasks.
    """
    ranked = with_rank(df, stem, order, "_n")  # written once; df is not worked out again below
    settled = _claims(ranked, stem, order).withColumnsRenamed({"stem": "_stem", "moved": "_moved", "skipped": "_skipped"})
    met = ranked.join(settled, F.col(stem) == F.col("_stem"), "left")
    n = F.aggregate(F.coalesce("_skipped", F.array().cast("array<bigint>")), F.col("_n") + F.coalesce("_moved", F.lit(0)), lambda at, k: F.when(k <= at, at + 1).otherwise(at))
    digits = let(n, lambda k: F.when(k == 1, F.lit("")).otherwise(F.concat(F.lit("_"), F.lpad(k.cast("string"), F.greatest(F.lit(2), F.length(k.cast("string"))), F.lit("0")))))
    return met.select(*[F.col(c) for c in df.columns if c != name], F.concat(F.col(stem), digits).alias(name))


def pending(sources: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Sources that no earlier run has written."""
    return sources.join(done.select(key).distinct(), key, "left_anti")


def last_wins(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """For each key the value of the last row, and how often the key came; pre-aggregated before the shuffle."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value), F.count(F.lit(1)).alias("n"))


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct by keys, the first row in order; an aggregate, so a frequent key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def new_bullets(new: DataFrame, old: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """New rows whose key the group has neither in old nor earlier among new."""
    return keep_first(new.join(old.select(group, key).distinct(), [group, key], "left_anti"), [group, key], order)


def load_drafts(inline: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """(draft_id, title) of titles given as rows (title, ord) and in JSON files (content, ord: `titles` of an object, or an array).

    Titles are trimmed and normal, blank ones go, equal ones count once at their first place: given rows before files, those by
    their ord. A file without a list is an error when it is read. draft_id is a text that sorts by place.
    """
    place = lambda *c: F.concat_ws("_", *[F.lpad(x.cast("string"), 12, "0") for x in c])
    some = inline.select(F.col("title"), place(F.lit(0), F.col("ord"), F.lit(0)).alias("draft_id"))
    if raw is not None:
        listed = F.coalesce(F.from_json(F.get_json_object("content", "$.titles"), "array<string>"), F.from_json(F.when(F.ltrim("content").startswith("["), F.col("content")), "array<string>"))
        checked = F.coalesce(listed, F.raise_error(F.lit('a file of drafts holds {"titles": [...]} or an array')).cast("array<string>"))
        some = some.unionByName(raw.select("ord", F.posexplode(checked).alias("pos", "title")).select("title", place(F.lit(1), F.col("ord"), F.col("pos")).alias("draft_id")))
    clean = some.select(F.regexp_replace(nfc(F.col("title")), r"(?U)^\s+|\s+$", "").alias("title"), "draft_id").where("title != ''")
    return clean.groupBy("title").agg(F.min("draft_id").alias("draft_id")).select("draft_id", "title")


def top(df: DataFrame, order: list, k: int) -> DataFrame:
    """The first k rows; a top-k that never sorts everything."""
    return df.orderBy(*order).limit(k)
