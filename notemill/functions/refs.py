"""References in prose: book, chapter and verses, expanded to one row a verse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions.text import let

LONGEST = 50
FIELDS = ["normalized", "status", "raw", "note"]


def find(text: Column, books: list[str]) -> Column:
    """Array of (raw, book, chapter, verses): in text order the references with verses, then those of a whole chapter.

    Longer names go first and nothing anchors a name. A whole chapter has empty verses.
    """
    names = "|".join(sorted(books, key=lambda b: (-len(b), b)))
    # possessive: a list of any length is matched by a loop, where giving back would need a stack frame for each verse
    verses = r"[0-9]+(?:\s*-\s*[0-9]+)?(?:\s*,\s*[0-9]+(?:\s*-\s*[0-9]+)?)*+"
    full = rf"({names})\s*([0-9]+)\s*[:장편]\s*({verses})\s*절?"
    whole = rf"({names})\s*([0-9]+)\s*[장편](?!\s*[:장]?\s*[0-9])()"

    def all_of(pattern: str) -> Column:
        # the text is searched once; the groups come from the short matches, which match by themselves in the same way
        raws = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.transform(raws, lambda raw: F.struct(raw.alias("raw"), *[F.regexp_extract(raw, pattern, k).alias(n) for k, n in enumerate(("book", "chapter", "verses"), 1)]))

    return F.concat(all_of(full), all_of(whole))


def verses(text: Column, books: list[str], longest: int = LONGEST, aliases: dict[str, str] | None = None) -> Column:
    """Array of (normalized, status, raw, note): a verse each, or one `ambiguous` entry with the reason.

    Reasons are reversed, too_long and no_verse. Books are written by their alias if they have one. The chapter keeps its
    digits as written, verses are numbers. Of equal references (ambiguous: equal raw text and reason) the first stays. All of it
    is done within the row: equal ones meet by sorting, nothing shuffles.
    """
    return let(_keyed(text, books, longest, aliases), lambda f: F.transform(f["verses"], lambda v: F.struct(*[c.alias(n) for n, c in _fields(f, v).items()])))


def _fields(found: Column, v: Column) -> dict[str, Column]:
    return {"normalized": v["normalized"], "status": v["status"], "raw": F.get(found["raws"], v["ref"]), "note": v["note"]}


def _keyed(text: Column, books: list[str], longest: int, aliases: dict[str, str] | None) -> Column:
    """Struct of raws, the references as written, and verses: verses() with the place in raws and a field `doubt`.

    doubt is what makes ambiguous entries equal, null for verses. A long list of verses is one raw text, held once.
    """
    short = F.create_map(*[F.lit(x) for b in books for x in (b, (aliases or {}).get(b, b))])

    def made(name: Column, status: str, i: Column, note: Column, doubt: Column) -> Column:
        return F.struct(name.alias("normalized"), F.lit(status).alias("status"), i.alias("ref"), note.alias("note"), doubt.alias("doubt"))

    def of_item(ref: Column, i: Column, mark: Column, item: Column) -> Column:
        low = F.substring_index(item, "-", 1).try_cast("int")
        high = F.substring_index(item, "-", -1).try_cast("int")

        def judged(b: Column) -> Column:
            wide = ~F.coalesce(b["high"] - b["low"] <= longest, F.lit(False))
            note = F.when(ref["verses"] == "", "no_verse").when(b["high"] < b["low"], "reversed").when(wide, "too_long").otherwise("")
            return F.struct(b["low"].alias("low"), b["high"].alias("high"), note.alias("note"))

        def listed(b: Column) -> Column:
            clear = let(F.concat(F.element_at(short, ref["book"]), ref["chapter"], F.lit("_")), lambda head: F.transform(F.sequence(b["low"], b["high"]), lambda v: made(F.concat(head, v.cast("string")), "ok", i, F.lit(""), F.lit(None).cast("string"))))
            doubt = F.concat_ws("\0", mark, b["note"], F.when(b["note"] == "too_long", item))
            return F.when(b["note"] == "", clear).otherwise(F.array(made(F.lit(""), "ambiguous", i, b["note"], doubt)))

        return let(let(F.struct(low.alias("low"), high.alias("high")), judged), listed)

    def of_ref(ref: Column, i: Column) -> Column:
        items = F.array_distinct(F.split(F.regexp_replace(ref["verses"], r"\s+", ""), ","))
        # raws of up to 64 characters stand for themselves, longer ones by their length and digest
        mark = F.when(F.length(ref["raw"]) <= 64, ref["raw"]).otherwise(F.concat(F.length(ref["raw"]).cast("string"), F.lit("\0"), F.md5(ref["raw"])))
        return let(mark, lambda m: F.transform(items, lambda item: of_item(ref, i, m, item)))

    def key(v: Column) -> Column:
        return F.coalesce(F.concat(F.lit("\0"), v["doubt"]), v["normalized"])

    def distinct(all_: Column) -> Column:
        ranked = F.array_sort(F.transform(all_, lambda v, i: F.struct(key(v).alias("key"), i.alias("i"), v.alias("verse"))))
        firsts = let(ranked, lambda xs: F.filter(xs, lambda x, i: (i == 0) | (F.get(xs, i - 1)["key"] != x["key"])))
        return F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["verse"].alias("verse")))), lambda x: x["verse"])

    def kept(all_: Column) -> Column:
        repeated = (F.size(all_) > 1) & (F.size(F.array_distinct(F.transform(all_, key))) < F.size(all_))
        return F.when(repeated, distinct(all_)).otherwise(all_)

    def whole(found: Column) -> Column:
        every = F.flatten(F.flatten(F.transform(found, of_ref)))
        return F.struct(F.transform(found, lambda r: r["raw"]).alias("raws"), let(every, kept).alias("verses"))

    return let(find(text, books), whole)


def link(style: str, normalized: Column) -> Column:
    """A verse as a link in the style of the settings."""
    out = F.lit(style)
    shape = r"^(.*?)([0-9]+)_([0-9]+)$"
    for name, value in {"book": F.regexp_extract(normalized, shape, 1), "chapter": F.regexp_extract(normalized, shape, 2), "verse": F.regexp_extract(normalized, shape, 3), "normalized": normalized}.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value) if f"{{{name}}}" in style else out
    return out


def expand(df: DataFrame, text_col: str, books: list[str], keep: list[str], longest: int = LONGEST, aliases: dict[str, str] | None = None) -> DataFrame:
    """Rows (keep..., pos, normalized, status, raw, note) of verses(); rows with equal `keep` stay apart."""
    # of an exploded column Catalyst infers a filter, which would work the expression out again; of an expression it does not
    found = df.select(*keep, _keyed(F.col(text_col), books, longest, aliases).alias("_f"))
    each = found.select(*keep, "_f", F.posexplode(F.flatten(F.array(F.col("_f")["verses"]))).alias("pos", "v"))
    return each.select(*keep, "pos", *[c.alias(n) for n, c in _fields(F.col("_f"), F.col("v")).items()])


def main_passages(refs: DataFrame, keep: list[str]) -> DataFrame:
    """The first clear reference of each document as main_passage; combined before the shuffle."""
    return refs.where("status = 'ok'").groupBy(*keep).agg(F.min_by("normalized", "pos").alias("main_passage"))


def out_of_bounds(refs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Refs (book, chapter) beyond the chapters of bounds (book, chapters), a table of one row a book."""
    return refs.join(bounds, "book").where(F.col("chapter") > F.col("chapters"))
