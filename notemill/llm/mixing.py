"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length in words, and only that histogram is planned on. A source's target is its
share of the budget; whole passes over the source come off first. What is left of the target is filled from the length counts:
proportionally, longest lengths first, up to a room of ROOM words, and the last words by a bounded-knapsack dynamic program
over the documents not taken so far, which hits the target to the word where the lengths allow it. Of each length the planned
number of documents is then chosen by seeded hash.

A source's histogram has at most about the square root of twice its words in rows, and a task holds one source's. Documents
meet the plan by (source, length) with frequent keys joined by broadcast, and are ranked by hash within buckets of about
BUCKET rows, so neither a hot source nor a great group of equal lengths meets in one task. Texts are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.llm.common import WORD, bucket_starts, checkpoint, spare, split_join, table
from notemill.operators.ranks import with_place

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, REPEATS = 1.5, 2
#: Words that the dynamic program fills at the end of a target (more where a document is longer).
ROOM = 1 << 16
#: Rows of a length that are ranked in one window, about.
BUCKET = 4096


def subset_sum(lengths: np.ndarray, counts: np.ndarray, goal: int) -> np.ndarray:
    """How many of each length to take, at most counts, so that their sum is as near to goal as can be (the lower of two).

    Bounded knapsack over the sums up to twice the goal: each count is split into powers of two, and for each sum the item that
    first reached it is kept. Ends as soon as the goal is reached.
    """
    taken = np.zeros(len(lengths), dtype=np.int64)
    if goal <= 0:
        return taken
    reach, by = np.zeros(2 * goal + 1, dtype=bool), np.full(2 * goal + 1, -1, dtype=np.int64)
    reach[0], items = True, []
    for k in np.argsort(-lengths, kind="stable"):
        left, size = min(int(counts[k]), 2 * goal // int(lengths[k])), 1
        while left and not reach[goal]:
            n = min(size, left)
            left, size, w = left - n, 2 * size, n * int(lengths[k])
            new = np.flatnonzero(reach[:-w] & ~reach[w:]) + w
            by[new], reach[new] = len(items), True
            items.append((int(k), n, w))
        if reach[goal]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - goal))])
    while at:
        k, n, w = items[by[at]]
        taken[k] += n
        at -= w
    return taken


def fill(lengths: np.ndarray, counts: np.ndarray, goal: int, room: int = ROOM) -> np.ndarray:
    """How many documents of each length to take for a sum near goal, which is at most all of them.

    A part of each length, the longest first and each making up for the rounding of those before, fills goal - room; the rest,
    less than room and one document, is fitted by subset_sum(). Over half of all words, those left out are filled alike.
    """
    taken = np.zeros(len(lengths), dtype=np.int64)
    whole = int((lengths * counts).sum())
    if 2 * goal > whole:
        return counts - fill(lengths, counts, whole - goal, room)
    first = max(goal - room, 0)
    due, filled = 0, 0
    for k in np.argsort(-lengths, kind="stable"):
        due += int(counts[k]) * int(lengths[k]) * first
        taken[k] = min(int(counts[k]), (due // whole - filled) // int(lengths[k]))
        filled += int(taken[k]) * int(lengths[k])
    return taken + subset_sum(lengths, counts - taken, goal - filled)


def _sources(histogram: DataFrame, weights: tuple[float, ...], share: float, repeats: int) -> DataFrame:
    """(s, source_size, target): shares of the budget by weight; targets over `repeats` times the source are cut, the excess dealt again.

    Each round is one aggregate over the sources that are not cut yet; it ends when none is above.
    """
    sums = histogram.groupBy("s", "no_source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = checkpoint(with_place(sums, ["no_source", "s"], "place").withColumn("w", F.get(cycle, F.pmod("place", F.lit(len(weights))).cast("int"))))
    most = F.col("source_size") * F.lit(repeats)
    rate, before = 0.0, None
    budget = share * float(placed.agg(F.sum("source_size")).first()[0] or 0)
    cut = F.lit(False)
    while rate != before:
        open_ = placed.agg(F.sum(F.when(~cut, F.col("w"))).alias("w"), F.coalesce(F.sum(F.when(cut, most)), F.lit(0)).cast("double").alias("full")).first()
        if not open_.w:
            break
        before, rate = rate, (budget - open_.full) / open_.w
        cut = F.col("w") * F.lit(rate) > most
    return placed.select("s", "source_size", F.least(F.col("w") * F.lit(rate), most.cast("double")).alias("target"))


def mix_plan(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    seed: int = 29,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """For every row of docs how often the mix takes it: doc_id, source, size, source_size, target, takes and payload.

    size is the number of words, source_size its source's sum, target what the mix wants of the source, takes a whole number of
    at most `repeats`. Sources by code point, null last, have the weights in turn and share `share` times all words; a share
    over `repeats` times its source is cut and the excess goes to the others by weight. payload is a struct of the columns
    named in carry (null if none).

    Nulls: a null text has no words, a null source is one of its own, a null id is an id like others. Rows without words are
    never taken (0). Ties in hash go by id; rows equal in id, source and length are interchangeable. An empty table gives an
    empty result. Other columns are ignored unless carried. The same rows and seed give the same takes.
    """
    no_source = F.col(source_col).isNull()
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        no_source.alias("no_source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("s"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("string")).alias("payload"),
    )
    rows = checkpoint(rows)  # the texts are read once; what is kept of them is a few bytes a row
    histogram = checkpoint(rows.groupBy("s", "no_source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = checkpoint(_sources(histogram, weights, share, repeats))

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        lengths, counts = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        whole, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        goal = min(int(target + 0.5), repeats * whole)
        passes = goal // whole
        some = fill(lengths, counts, goal - passes * whole)
        return pd.DataFrame({"key": group["key"], "n": counts, "passes": passes, "some": some, "source_size": whole, "target": target})

    key = F.concat(F.col("size").cast("string"), "s")  # sizes are digits and s is empty or starts with =
    held = histogram.where("size > 0").join(sources, "s").select(key.alias("key"), "s", "size", "n", "source_size", "target")
    planned = held.groupBy("s").applyInPandas(plan, "key string, n long, passes long, some long, source_size long, target double")
    idle = histogram.where("size = 0").join(sources, "s").select(key.alias("key"), "n", F.lit(0).cast("long").alias("passes"), F.lit(0).cast("long").alias("some"), "source_size", "target")
    facts = checkpoint(planned.unionByName(idle).withColumn("of", F.col("n")))

    met = split_join(rows.withColumn("key", key), facts.select("key", "n", "passes", "some", "source_size", "target", "of"), "key", "n")
    partly = (F.col("some") > 0) & (F.col("some") < F.col("of"))
    # only lengths of which some documents are taken and others not are ranked
    clear = met.where(~partly).withColumn("more", (F.col("some") > 0).cast("int"))
    h = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    buckets = F.least(F.ceil(F.col("of") / BUCKET), F.lit(1 << 20)).cast("long")
    torn = met.where(partly).withColumn("h", h).withColumn("b", F.pmod("h", buckets))
    counted = bucket_starts(torn.where(F.col("of") > BUCKET).groupBy("key", "b").agg(F.count(F.lit(1)).alias("n")), ["key"], "b", "n", "before", "total").select("key", "b", "before")
    nth = F.row_number().over(Window.partitionBy("key", "b").orderBy("h", "doc_id"))
    ranked = torn.join(counted, ["key", "b"], "left").withColumn("more", (nth + F.coalesce("before", F.lit(0)) <= F.col("some")).cast("int"))
    out = ["doc_id", "source", "size", "source_size", "target", "passes", "more", "payload"]
    both = clear.select(*out).unionByName(ranked.select(*out))
    takes = F.when(F.col("size") > 0, F.col("passes") + F.col("more")).otherwise(0).cast("int")
    return both.select("doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), takes.alias("takes"), "payload")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: all columns of docs, each row as often as mix_plan() takes it, and `copy`, 1 for the first of them.

    A column of docs named `copy`, in any case, is replaced.
    """
    (copy,) = spare(docs, "copy_no")
    every = tuple(c for c in docs.columns if c.lower() != "copy")
    taken = mix_plan(docs, carry=every, **settings).where("takes > 0").withColumn(copy, F.explode(F.expr("sequence(1, takes)")))
    return taken.select(*[F.col("payload")[c].alias(c) for c in every], F.col(copy).alias("copy"))


def taken_words(size: Column, takes: Column) -> Column:
    return (size * takes).cast("long")


def op11_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each; weights 5, 2, 1, 150 % of all words, at most twice."""
    plan = mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", taken_words(F.col("size"), F.col("takes")).alias("taken"))
