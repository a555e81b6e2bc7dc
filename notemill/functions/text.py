"""Text, date and name expressions: Column to Column, built-in functions unless a docstring says otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: characters that names may not hold
FORBIDDEN = r'[\\/:*?"<>|#^\[\]]'
UNDATED = "undated"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def nfc(c: Column) -> Column:
    """Unicode NFC, null as empty. Spark has no built-in function for it: Arrow batches."""

    @F.pandas_udf(StringType())
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x or ""))

    # ASCII texts are normal already and never leave the JVM's side of the condition
    return normal(c)


def strip_vs(c: Column) -> Column:
    """Without the variation selector U+FE0F."""
    return F.replace(c, F.lit("️"), F.lit(""))


def strip_wikilink(c: Column) -> Column:
    """The target of a [[target|alias]] that spans the whole text."""
    inner = F.substring(c, F.lit(3), F.length(c) - 4)
    return F.when(c.startswith("[[") & c.endswith("]]") & (F.length(c) >= 4), F.trim(F.split_part(inner, F.lit("|"), F.lit(1)))).otherwise(c)


def compare_key(c: Column, normal: bool = True) -> Column:
    """T4: the key under which values are compared; normal=False skips NFC for text known to be normal."""
    return F.trim(strip_vs(nfc(strip_wikilink(c)) if normal else strip_wikilink(c)))


def collapse_separators(c: Column) -> Column:
    """T5: single underscores, without spaces round them or separators at the ends."""
    return F.btrim(F.regexp_replace(F.regexp_replace(c, " *_ *", "_"), "_{2,}", "_"), F.lit("_- "))


def sanitize_title(c: Column, fallback: str = "untitled") -> Column:
    """White space collapsed, forbidden characters as spaces, never empty."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), FORBIDDEN, " "), r"(?U)\s+", " ")
    return F.coalesce(F.nullif(F.btrim(clean, F.lit(" .")), F.lit("")), F.lit(fallback))


def normalize_date(c: Column) -> Column:
    """Yymmdd, yyyymmdd and separated dates as YYYY-MM-DD text, else empty. Only separated forms check month and day."""
    return let(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), _normal_date)


def _normal_date(c: Column) -> Column:
    six = F.concat(F.when(F.substring(c, 1, 2) < "70", F.lit("20")).otherwise(F.lit("19")), F.substring(c, 1, 2), F.lit("-"), F.substring(c, 3, 2), F.lit("-"), F.substring(c, 5, 2))
    eight = F.concat(F.substring(c, 1, 4), F.lit("-"), F.substring(c, 5, 2), F.lit("-"), F.substring(c, 7, 2))
    parts = r"^([0-9]{4})[-.]([0-9]{1,2})[-.]([0-9]{1,2})$"
    month, day = F.regexp_extract(c, parts, 2), F.regexp_extract(c, parts, 3)
    fine = month.try_cast("int").between(1, 12) & day.try_cast("int").between(1, 31) & F.regexp_extract(c, parts, 1).between("1900", "2099")
    long_ = F.concat_ws("-", F.regexp_extract(c, parts, 1), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(c.rlike("^[0-9]{6}$"), six).when(c.rlike("^[0-9]{8}$"), eight).when(c.rlike(parts) & fine, long_).otherwise(F.lit(""))


def compact_date(c: Column) -> Column:
    """Yymmdd of a YYYY-MM-DD text, else the word for undated."""
    return F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.concat(F.substring(c, 3, 2), F.substring(c, 6, 2), F.substring(c, 9, 2))).otherwise(F.lit(UNDATED))


def sermon_id(date: Column, title: Column, passage: Column, missing: str = "no본문") -> Column:
    """Date, the title's first 40 characters and the passage, joined by underscores."""
    return sanitize_title(collapse_separators(F.concat_ws("_", compact_date(date), F.substring(title, 1, 40), F.coalesce(F.nullif(passage, F.lit("")), F.lit(missing)))))


def token_set(c: Column) -> Column:
    """Distinct runs of two or more letters or digits, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("[0-9A-Za-z가-힣]{2,}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """T19, token part: shared over all tokens; 0 for two empty sets."""
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def split_sentences(c: Column) -> Column:
    """White space collapsed, then cut after a sentence's end mark."""
    return F.filter(F.split(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), "(?<=[.!?。！？]) "), lambda s: s != "")


def is_noise(c: Column, least: int = 40) -> Column:
    """Empty, a rule line, a date header, a reading cue, or shorter than `least`."""
    return stripped_noise(stripped(c), least)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def stripped_noise(t: Column, least: int = 40) -> Column:
    """is_noise() of a text without white space at its ends."""
    return (F.length(t) < least) | t.rlike(r"^[-*_\s]+$") | t.rlike(r"^[0-9]{6,8}\s+.{1,40}$") | t.rlike(r"^[가-힣A-Za-z0-9 .:_-]{1,30}\s*[을를]?\s*읽습니다\. ?$")


def pack_bullets(sentences: Column, most: int = 4, width: int = 160) -> Column:
    """Sentences packed in order into at most `most` bullets; a bullet takes another while both lengths stay under width."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, s: Column) -> Column:
        fits = (acc["now"] == "") | (F.length(acc["now"]) + F.length(s) < width)
        done = F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["now"]))
        return F.struct(done.alias("done"), F.when(fits, F.trim(F.concat_ws(" ", acc["now"], s))).otherwise(s).alias("now"))

    return F.slice(F.aggregate(sentences, start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.array_append(a["done"], a["now"]))), 1, most)


def domain_of(url: Column) -> Column:
    """The lower-case host of a URL without www."""
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.", "")


def in_domains(domain: Column, names: list[str]) -> Column:
    """Equal to, or under, one of the names."""
    return F.exists(F.array(*[F.lit(n) for n in names]), lambda n: (domain == n) | domain.endswith(F.concat(F.lit("."), n)))


def validate_tags(tags: Column) -> Column:
    """Sanitised (forbidden characters go), without spaces, distinct in order; null and empty tags go."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.replace(sanitize_title(t, ""), F.lit(" "), F.lit(""))), lambda t: t != ""))
