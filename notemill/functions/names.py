"""File names to date, marker, title and kind, and back to note names. Built-in functions only.

Names and folders are in Unicode NFC when they come here (text.nfc, once, where a listing is read).
"""

from __future__ import annotations

import re
import string
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from notemill.functions.text import collapse_separators, compare_key, let, normalize_date, sanitize_title

# fixed values: shapes of a dated name, as (pattern, group of the date, group of the rest)
DATED = [
    (r"^([0-9]{6})[_\-\s]+(.+)$", 1, 2),
    (r"^([0-9]{4}[-.]?[0-9]{2}[-.]?[0-9]{2})[_\-\s]+(.+)$", 1, 2),
    (r"^([0-9]{4}[-.][0-9]{1,2}[-.][0-9]{1,2})[_\-\s.]+(.+)$", 1, 2),
    (r"^(.+?)[_\-\s.]+([0-9]{4}[-.][0-9]{1,2}[-.][0-9]{1,2})$", 2, 1),
]
# fixed values: words that tell the kind of a gathering; the first kind with a word in the name wins
KIND_WORDS = {
    "주일대예배": ["주일대예배", "대예배", "주일예배", "주일오전", "1부예배", "장년부", "전교인", "주일설교", "주일"],
    "주일오후예배": ["주일오후", "오후예배", "저녁예배", "2부예배", "찬양예배"],
    "수요기도회": ["수요기도회", "수요예배", "수요저녁", "수요"],
    "새벽기도회": ["새벽기도회", "새벽기도", "새벽예배", "새벽"],
    "금요기도회": ["금요기도회", "금요철야", "철야", "금요"],
    "특별집회": ["부흥회", "사경회", "특별집회", "집회", "수련회"],
    "청년부": ["청년부", "대학부", "청년"],
    "청소년부": ["청소년부", "중고등부", "중등부", "고등부", "학생부", "청소년"],
    "어린이부": ["어린이부", "유년부", "유치부", "주일학교", "아동부", "어린이"],
    "심방·경조사": ["심방", "장례", "추도", "결혼", "임직", "돌잔치"],
    "성경공부": ["성경공부", "제자훈련", "교리공부", "세미나", "강의"],
}
# fixed values: kinds that one letter stands for
SHORT_KINDS = {"대": "주일대예배", "청": "청소년부", "어": "어린이부", "새": "새벽기도회", "수": "수요기도회"}
# fixed values: endings of label titles and of claims, and the lengths a title should have
LABEL_ENDS = ["필요성", "중요성", "차이", "이해", "의미", "개요", "태도", "방법", "이유", "과정", "특징", "원리", "정의", "개념", "역할"]
CLAIM_ENDS = ["다", "라", "까", "요", "자", "냐", "오", "죠", "군", "네", "?", "!", "."]
TITLE_LENGTHS = {"argument": (10, 20), "illustration": (15, 25)}
PICTURE = "💡"


def _first(options: list[Column], otherwise: Column) -> Column:
    return F.coalesce(*options, otherwise)


def _key(value: str) -> str:
    """compare_key of a setting, on the driver."""
    return unicodedata.normalize("NFC", value).replace("️", "").strip()


def _looked_up(c: Column, table: dict[str, str]) -> Column:
    """The table's value under c's key, else null; a few settings, so a literal."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c) if table else F.lit(None).cast("string")


def unquoted(stem: Column) -> Column:
    """Percent escapes decoded where they are valid; a plus sign stays one."""
    return F.when(F.contains(stem, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(stem, F.lit("+"), F.lit("%2B"))), stem)).otherwise(stem)


def dated(stem: Column) -> Column:
    """Struct (date, rest) by the first shape whose date is valid; without one, no date and the whole stem."""

    def by(pattern: str, date: int, rest: int) -> Column:
        found = let(F.regexp_extract(stem, pattern, date), normalize_date)
        return let(found, lambda day: F.when(day != "", F.struct(day.alias("date"), F.regexp_extract(stem, pattern, rest).alias("rest"))))

    return _first([by(*shape) for shape in DATED], F.struct(F.lit("").alias("date"), stem.alias("rest")))


def marked(rest: Column, markers: list[str]) -> Column:
    """Struct (target, title). Only declared markers count, longer ones first, before a separator and some title."""
    plain = F.struct(F.lit("").alias("target"), rest.alias("title"))
    if not markers:
        return plain
    names = "|".join(re.escape(m) for m in sorted(markers, key=lambda m: -len(m)))
    pattern = rf"^({names})(?=[\s_\-]|$)[\s_\-]*(.*)$"
    title = F.regexp_extract(rest, pattern, 2)
    return F.when(F.trim(title) != "", F.struct(F.regexp_extract(rest, pattern, 1).alias("target"), title.alias("title"))).otherwise(plain)


def folder_target(folders: Column, mapping: dict[str, str], strip_number: bool = True) -> Column:
    """The target of the nearest of two enclosing folders (array, nearest first) that the mapping knows, else empty."""
    table = {_key(k): v for k, v in mapping.items()}
    names = [F.get(folders, F.lit(k)) for k in range(2)]
    return _first([_looked_up(compare_key(strip_number_prefix(n) if strip_number else n, normal=False), table) for n in names], F.lit(""))


def parse_filename(stem: Column, markers: list[str], folders: Column | None = None, mapping: dict[str, str] | None = None) -> Column:
    """Struct (date, target, title) of a file's stem; the folders give the target where the name has none."""
    outer = folder_target(folders, mapping) if folders is not None and mapping else F.lit("")

    def joined(date: Column, named: Column) -> Column:
        target = F.when(named["target"] != "", named["target"]).otherwise(outer)
        return F.struct(date.alias("date"), target.alias("target"), sanitize_title(named["title"]).alias("title"))

    parts = let(let(unquoted(stem), sanitize_title), dated)
    return let(parts, lambda p: let(marked(p["rest"], markers), lambda named: joined(p["date"], named)))


def declared_kind(target: Column, folders: Column, stem: Column, kinds: list[str], markers: dict[str, str]) -> Column:
    """The declared kind named by the marker, by one of three folders, or anywhere in the stem; else empty.

    Markers stand for declared kinds only. Within the stem longer names win, markers before kinds.
    """
    own = {_key(k): k for k in kinds}
    alias = {_key(m): own[_key(k)] for m, k in markers.items() if _key(k) in own}
    if not own:
        return F.lit("")
    table = alias | own
    folder = [_looked_up(compare_key(F.regexp_replace(F.get(folders, F.lit(k)), r"^[0-9]+[.\-]?\s*", ""), normal=False), table) for k in range(3)]
    words = [w for names in (alias, own) for w in sorted(names, key=lambda w: -len(w)) if w]
    inside = [F.when(F.contains(compare_key(stem, normal=False), F.lit(w)), F.lit((alias | own if w in own else alias)[w])) for w in words]
    return _first([_looked_up(compare_key(target, normal=False), table), *folder, *inside], F.lit(""))


def first_line(text: Column) -> Column:
    """The first line without heading marks, as a title; a blank one gives the fallback title."""
    line = F.get(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]"), F.lit(0))
    return sanitize_title(F.regexp_replace(F.trim(line), r"^#+\s*", ""))


def note_name(pattern: str, values: dict[str, Column]) -> Column:
    """The pattern's fields filled in, empty ones without a trace, ending in .md. Unknown fields are an error."""
    parts = []
    for fixed, field, _, _ in string.Formatter().parse(pattern.removesuffix(".md")):
        parts.append(F.lit(fixed))
        if field is not None:
            if field not in values:
                raise ValueError(f"unknown field in a name pattern: {field}")
            parts.append(sanitize_title(values[field], ""))
    return F.concat(sanitize_title(collapse_separators(F.concat(*parts))), F.lit(".md"))


def relative_folder(folder: str) -> str:
    """A folder of the settings that stays inside its vault."""
    if folder.startswith(("/", "\\", "~")) or re.match("[A-Za-z]:", folder) or ".." in re.split(r"[/\\]", folder):
        raise ValueError(f"not a relative folder: {folder}")
    return folder


def strip_number_prefix(name: Column) -> Column:
    """Without a leading number and dot."""
    return F.regexp_replace(name, r"^[0-9]+\.\s*", "")


def has_word(c: Column, words: list[str]) -> Column:
    """Holds one of the words, in either case."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(w.lower())) for w in words], F.lit(False))


def kind_of(c: Column) -> Column:
    """The kind whose words the text holds, without regard to spaces and case, else empty."""
    squeezed = F.replace(F.lower(c), F.lit(" "), F.lit(""))
    return _first([F.when(has_word(squeezed, words), F.lit(kind)) for kind, words in KIND_WORDS.items()], F.lit(""))


def marker_kind(c: Column) -> Column:
    """As kind_of, after the single letters."""
    return F.coalesce(_looked_up(c, SHORT_KINDS), kind_of(c))


def title_issues(title: Column, kind: Column) -> Column:
    """What the style of a fragment's title lacks, as codes; titles are reported, never refused."""
    t = F.trim(title)
    picture = (kind == "illustration") | t.startswith(PICTURE)
    body = F.when(t.startswith(PICTURE), F.trim(F.substring(t, F.lit(2), F.length(t)))).otherwise(t)
    ends = {name: reduce(lambda a, b: a | b, [F.endswith(body, F.lit(w)) for w in words]) for name, words in (("label", LABEL_ENDS), ("claim", CLAIM_ENDS))}
    fits = {name: F.length(body).between(*span) for name, span in TITLE_LENGTHS.items()}
    some = t != ""
    checks = [
        (~some, "empty"),
        (some & ~F.when(picture, fits["illustration"]).otherwise(fits["argument"]), "length"),
        (some & picture & ~t.startswith(f"{PICTURE} "), "illustration_mark"),
        (some & picture & ~F.contains(body, F.lit(" - ")), "illustration_form"),
        (some & ~picture & ends["label"], "label"),
        (some & ~picture & ~ends["label"] & ~ends["claim"], "no_claim"),
        (some & ~picture & ~F.contains(body, F.lit(" ")) & (F.length(body) < 8), "one_word"),
    ]
    return F.array_compact(F.array(*[F.when(broken, F.lit(code)) for broken, code in checks]))
