"""Matches of a pattern with their places in code points, by DataFrame functions alone.

regexp_extract_all gives the matches, split the gaps between them; their running length is a match's place. Texts without a
match are scanned once. The patterns must match at least one character.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from notemill.functions.text import let

#: Elements of a block of a running array.
BLOCK = 128
PART = "struct<start:int,end:int,kind:string,match:string,before:string>"
SPAN = "array<struct<start:int,end:int,match:string,before:string>>"


def matches(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def running(xs: Column, join: Callable[[Column, Column], Column], none: Column) -> Column:
    """For each element the join (associative) of it and all before it.

    Appending copies the array that it extends, so elements are taken in blocks: time grows by about BLOCK an element.
    """
    empty = F.slice(F.array(none), 1, 0)

    def appended(block: Column, head: Column) -> Column:
        step = lambda s, x: F.struct(join(s["now"], x).alias("now"), F.array_append(s["done"], join(s["now"], x)).alias("done"))
        return F.aggregate(block, F.struct(head.alias("now"), empty.alias("done")), step, lambda s: s["done"])

    def blocked(own: Column) -> Column:
        # slice() would read the whole array for each block
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int")), lambda k: F.transform(F.sequence(k * BLOCK, F.least(k * BLOCK + BLOCK, F.size(own)) - 1), lambda i: F.get(own, i)))

        def whole(all_: Column) -> Column:
            totals = F.transform(all_, lambda b: F.aggregate(b, none, lambda x, y: join(x, y)))
            heads = F.aggregate(totals, F.array(none), lambda hs, t: F.array_append(hs, join(F.element_at(hs, -1), t)))
            return let(heads, lambda hs: F.flatten(F.transform(all_, lambda b, k: appended(b, F.get(hs, k)))))

        return let(blocks, whole)

    return let(xs, lambda own: F.when(F.size(own) > 0, blocked(own)).otherwise(empty))


def found_in(text: Column, patterns: dict[str, str]) -> Column:
    """For each pattern (gaps, found): its matches and the pieces of text before each of them; without a match one scan is enough."""

    def one(pattern: str) -> Column:
        return let(matches(text, pattern), lambda found: F.struct(F.when(F.size(found) > 0, F.split(text, pattern, -1)).alias("gaps"), found.alias("found")))

    return F.array(*map(one, patterns.values()))


def located(found: Column, context: int = 0) -> Column:
    """For each pattern of found_in() an array of (start, end, match, before), `before` being the end of the gap before it.

    One expression serves all patterns, since a plan of this size is analysed for seconds.
    """

    def one(x: Column) -> Column:
        lengths = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["found"])), x["found"], lambda g, m: F.length(g) + F.length(m))
        ends = F.zip_with(x["found"], running(lengths, lambda a, b: a + b, F.lit(0)), lambda m, e: F.struct(m.alias("match"), e.alias("end")))
        whole = F.zip_with(ends, F.slice(x["gaps"], F.lit(1), F.size(x["found"])), lambda m, g: F.struct((m["end"] - F.length(m["match"])).alias("start"), m["end"].alias("end"), m["match"].alias("match"), F.right(g, F.lit(context)).alias("before")))
        return F.when(F.size(x["found"]) > 0, whole).otherwise(F.array().cast(SPAN))

    return F.transform(found, one)


def parts(spans: Column, kind: str) -> Column:
    """Spans with their kind, as beside() takes them."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["match"].alias("match"), s["before"].alias("before")))


def bare(spans: Column) -> Column:
    """Parts or located spans as (start, end, match)."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")))


def beside(spans: Column, others: Column) -> Column:
    """Parts as (span, left, right), by their start: `left` is, of the others that start no later, the one that ends last,
    `right` the first of those that start after it; null if there is none. Both sorted once and swept, so time is about linear.
    """
    none = F.lit(None).cast(f"struct<by:int,other:{PART}>")  # a literal: an expression of rows would be computed at every step
    marked = F.array_sort(
        F.concat(
            F.transform(others, lambda o: F.struct(o["start"].alias("at"), F.lit(0).alias("own"), o.alias("part"))),
            F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("own"), s.alias("part"))),
        )
    )

    def swept(rows: Column) -> Column:
        by_end = F.transform(rows, lambda r: F.when(r["own"] == 0, F.struct(r["part"]["end"].alias("by"), r["part"].alias("other"))))
        by_start = F.transform(F.reverse(rows), lambda r: F.when(r["own"] == 0, F.struct(r["at"].alias("by"), r["part"].alias("other"))))
        both = F.arrays_zip(rows.alias("row"), running(by_end, lambda a, b: F.greatest(a, b), none).alias("left"), F.reverse(running(by_start, lambda a, b: F.least(a, b), none)).alias("right"))
        met = F.transform(both, lambda m: F.struct(m["row"]["own"].alias("own"), m["row"]["part"].alias("span"), m["left"]["other"].alias("left"), m["right"]["other"].alias("right")))
        return F.filter(met, lambda m: m["own"] == 1)

    return let(marked, swept)


def ranked(spans: Column, rank: int, kind: str) -> Column:
    """Spans as (rank, start, end, kind), to be merged with those of other kinds."""
    return F.transform(spans, lambda s: F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def written(spans: Column, by_start: bool) -> Column:
    """`kind:start:end` of ranked spans, joined by commas; by start then rank, or by rank then start."""
    first, second = ("start", "rank") if by_start else ("rank", "start")
    keyed = F.transform(spans, lambda s: F.struct(s[first].alias("a"), s[second].alias("b"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    text = F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.concat_ws(",", text)
