"""Notes as text: frontmatter, sections, links, bullets and grades. Built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions.text import compare_key, let, pack_bullets, sanitize_title, split_sentences, strip_vs, stripped, stripped_noise

FRONTMATTER = r"(?s)\A(---\n.*?\n---\n)"
# fixed values: the marks of the five grades; the third holds a variation selector
GRADES = {"confirmed": "✅", "probable": "🟡", "disputed": "⚠️", "uncertain": "❓", "banned": "🚫"}
FIELDS = "map<string, struct<scalar: boolean, values: array<string>>>"


def lines(c: Column) -> Column:
    """The lines of a text, without an empty one after a last line break."""
    return F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r?\n\z", ""), r"\r?\n")


def unquote(c: Column) -> Column:
    return F.btrim(F.trim(c), F.lit('"'))


def needs_quote(c: Column) -> Column:
    """Whether a scalar is written in quotation marks; dates and times are not."""
    when = c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}(:[0-9]{2})?)?\z")
    return (c == "") | (~when & ((c != F.trim(c)) | c.rlike(r"\A[-?]") | c.rlike(r"""[:\[\]{}&*!|>%@#,"'\\]""")))


def scalar(c: Column) -> Column:
    """A value as it stands in frontmatter."""
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(needs_quote(c), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(c)


def frontmatter(fields: dict[str, Column], lists: set[str], optional: set[str] = frozenset()) -> Column:
    """The block of all fields in order; those in `lists` are arrays, null scalars are written as null.

    Fields in `optional` are left out where they are null or empty.
    """

    def one(name: str, value: Column) -> Column:
        if name in optional:
            some = F.coalesce(F.size(value) > 0, F.lit(False)) if name in lists else F.coalesce(value.cast("string") != "", F.lit(False))
            return F.when(some, written(name, value))
        return written(name, value)

    def written(name: str, value: Column) -> Column:
        if name not in lists:
            return F.concat(F.lit(f"{name}: "), F.coalesce(scalar(value.cast("string")), F.lit("null")))
        items = F.coalesce(value, F.array().cast("array<string>"))
        rows = F.transform(items, lambda v: F.concat(F.lit("\n  - "), scalar(v)))
        return F.concat(F.lit(f"{name}:"), F.when(F.size(items) == 0, F.lit("\n  []")).otherwise(F.array_join(rows, "")))

    return F.concat(F.lit("---\n"), F.concat_ws("\n", *[one(n, v) for n, v in fields.items()]), F.lit("\n---\n"))


def frontmatter_block(note: Column) -> Column:
    """The block at the start of a note as written, else empty."""
    return F.regexp_extract(note, FRONTMATTER, 1)


def frontmatter_keys(note: Column) -> Column:
    """Distinct top-level keys in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(frontmatter_block(note), F.lit(r"(?m)^([^\s:#-][^:\n]*):"), F.lit(1)), lambda k: F.trim(k)))


def read_frontmatter(note: Column) -> Column:
    """Map of key to (scalar, values). Indented items belong to the last key that opened a list; the last of equal keys stays."""
    entry = "array<struct<key: string, scalar: boolean, values: array<string>>>"
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast(entry).alias("done"), F.lit(False).alias("open"))

    def made(key: Column, is_scalar: Column, values: Column) -> Column:
        return F.struct(key.alias("key"), is_scalar.alias("scalar"), values.alias("values"))

    def step(acc: Column, line: Column) -> Column:
        pattern = r"^([^:\s][^:]*):\s*(.*)$"
        top, key, value = line.rlike(pattern), F.trim(F.regexp_extract(line, pattern, 1)), F.trim(F.regexp_extract(line, pattern, 2))
        item, last = r"^\s+-\s+(.*)$", F.element_at(acc["done"], -1)
        single = (value != "") & (value != "[]")
        new = made(key, single, F.when(single, F.array(unquote(value))).otherwise(none))
        longer = made(last["key"], F.lit(False), F.array_append(last["values"], unquote(F.regexp_extract(line, item, 1))))
        done = (
            F.when(top, F.array_append(acc["done"], new))
            .when(acc["open"] & line.rlike(item), F.array_append(F.slice(acc["done"], F.lit(1), F.size(acc["done"]) - 1), longer))
            .otherwise(acc["done"])
        )
        opened = F.when(top, value == "").when(line.rlike(r"^\S"), F.lit(False)).otherwise(acc["open"])
        return F.struct(done.cast(entry).alias("done"), opened.alias("open"))

    body = F.split(F.regexp_extract(note, r"(?s)\A---\n(.*?)\n---\n", 1), "\n")
    read = F.aggregate(F.filter(body, lambda x: F.trim(x) != ""), start, step, lambda acc: acc["done"])
    # the last of equal keys is the one that no later entry repeats
    last = let(read, lambda r: F.filter(r, lambda e, i: ~F.exists(F.slice(r, i + 2, F.size(r)), lambda o: o["key"] == e["key"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], F.struct(e["scalar"].alias("scalar"), e["values"].alias("values"))))).cast(FIELDS)


def bullets_of(note: Column) -> Column:
    """Struct (frontmatter as written, bullets, text after the last bullet)."""
    head = frontmatter_block(note)
    rest = lines(F.substring(note, F.length(head) + 1, F.length(note)))
    mark = r"^\s*[-*]\s+"
    places = F.filter(F.transform(rest, lambda x, i: F.when(x.rlike(mark), i + 1).otherwise(F.lit(0))), lambda i: i > 0)
    last = F.coalesce(F.array_max(places), F.lit(0))
    bullets = F.transform(F.filter(rest, lambda x: x.rlike(mark)), lambda x: F.trim(F.regexp_replace(x, mark, "")))
    return F.struct(head.alias("frontmatter"), bullets.alias("bullets"), F.array_join(F.slice(rest, last + 1, F.size(rest)), "\n").alias("trailer"))


def sections(c: Column, level: int, preamble: bool = False) -> Column:
    """Array of (title, body) by headings of one level; the text before the first counts only as `preamble`, untitled."""
    mark = "#" * level
    cut = F.split(F.coalesce(c, F.lit("")), rf"(?m)^(?={mark}\s+\S)")
    whole = rf"(?s)\A{mark}[^\S\n]+([^\n]+)(.*)\z"

    def named(part: Column) -> Column:
        return F.struct(F.trim(F.regexp_extract(part, whole, 1)).alias("title"), F.when(part.rlike(whole), F.regexp_extract(part, whole, 2)).otherwise(part).alias("body"))

    keep = F.filter(cut, lambda part: part.rlike(whole) | (F.lit(preamble) & (F.trim(part) != "")))
    return F.transform(keep, named)


def prefixed_values(c: Column, prefix: str) -> Column:
    """Distinct targets of [[links]] that start with the prefix, with or without variation selectors, in order."""
    loose = "".join(rf"\Q{ch}\E\x{{FE0F}}?" for ch in prefix.replace("️", ""))
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(rf"\[\[({loose}[^\]|]+)\]\]"), F.lit(1)), lambda v: F.trim(v)))


def links(c: Column) -> Column:
    """Targets of all [[links]], in order."""
    return F.regexp_extract_all(c, F.lit(r"\[\[([^\]|#]+)[^\]]*\]\]"), F.lit(1))


def wikilink(c: Column) -> Column:
    """As a link, unless it is one."""
    return F.when(c.startswith("[["), c).otherwise(F.concat(F.lit("[["), F.regexp_replace(c, r"\.md$", ""), F.lit("]]")))


def decorate(values: Column, wrap: bool) -> Column:
    """Values that are not blank, as links if wanted."""
    some = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    return F.transform(some, wikilink) if wrap else some


def grade_counts(body: Column) -> Column:
    """Struct of how often each grade's mark stands in the text."""
    return F.struct(*[((F.length(body) - F.length(F.replace(body, F.lit(m), F.lit("")))) / len(m)).cast("int").alias(n) for n, m in GRADES.items()])


def grade_summary(counts: Column) -> Column:
    """The marks with their counts."""
    return F.concat_ws(" ", *[F.concat(F.lit(m), counts[n].cast("string")) for n, m in GRADES.items()])


def body_without(note: Column, title: str) -> Column:
    """A note without frontmatter and without the level-2 section of that title."""
    body = F.substring(note, F.length(frontmatter_block(note)) + 1, F.length(note))
    return F.regexp_replace(body, rf"(?ms)^##[^\S\n]+\Q{title}\E[^\S\n]*$.*?(?=^##[^\S\n]|\z)", "")


def bullet_key(c: Column) -> Column:
    """The key under which bullets are equal (for NFC text)."""
    return compare_key(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), normal=False)


def _fragment(title: Column, kind: Column | str, bullets: Column) -> Column:
    return F.struct(title.alias("title"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), bullets.alias("bullets"))


def fragments(text: Column, key: Column, most: int = 20) -> Column:
    """Array of (title, kind, bullets) of a text without a prepared split.

    Sections by heading or rule; without a usable one the first eight paragraphs; without those one fragment of the whole
    text; for blank text none. All stay within one row, so a document never shuffles.
    """
    head = r"\A#{1,3}\s+"

    def made(heading: Column, body: Column) -> Column:
        def titled(said: Column) -> Column:
            return sanitize_title(F.nullif(F.coalesce(heading, F.substring(F.get(said, F.lit(0)), 1, 30)), F.lit("")))

        return let(split_sentences(body), lambda said: _fragment(titled(said), F.when(heading.isNotNull(), "section").otherwise("paragraph"), pack_bullets(said)))

    def noisy(body: Column) -> Column:
        return let(stripped(body), stripped_noise)

    # let() wherever a value is named more than once: within a lambda nothing else keeps it from being worked out again
    def section(part: Column, alone: Column) -> Column:
        def parted(rows: Column) -> Column:
            first = F.coalesce(F.get(rows, F.lit(0)), F.lit(""))
            titled = first.rlike(head)
            body = F.array_join(F.when(titled, F.slice(rows, F.lit(2), F.size(rows))).otherwise(rows), "\n")
            return F.struct(F.when(titled, F.trim(F.regexp_replace(first, head, ""))).alias("heading"), body.alias("body"))

        def judged(s: Column) -> Column:
            usable = ((F.length(s["body"]) >= 80) | alone) & ~noisy(s["body"])
            return F.when(usable, made(s["heading"], s["body"]))

        rows = F.filter(F.transform(F.split(part, "\n"), lambda x: F.trim(x)), lambda x: x != "")
        return let(let(rows, parted), judged)

    def paragraph(p: Column) -> Column:
        return F.when(~noisy(p), made(F.lit(None).cast("string"), p))

    def of(whole: Column) -> Column:
        cut = let(F.split(whole, r"\n(?=#{1,3}\s)|\n\s*---\s*\n"), lambda parts: F.array_compact(F.transform(parts, lambda part: section(part, F.size(parts) == 1))))
        blocks = F.slice(F.filter(F.transform(F.split(whole, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != ""), 1, 8)
        loose = F.array_compact(F.transform(blocks, paragraph))
        rest = F.array(_fragment(sanitize_title(F.concat(key, F.lit(" 핵심 요약"))), "fallback", pack_bullets(split_sentences(whole), most=5)))
        fallback = F.when(whole != "", rest).otherwise(F.slice(rest, 1, 0))
        unmarked = let(loose, lambda found: F.when(F.size(found) > 0, F.slice(found, 1, most)).otherwise(fallback))
        return let(cut, lambda found: F.when(F.size(found) > 0, F.slice(found, 1, most)).otherwise(unmarked))

    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n")), of)


def list_items(c: Column) -> Column:
    """The values of a list's items, links as their targets."""
    found = F.regexp_extract_all(c, F.lit(r"(?m)^\s*[-*]\s+(.+?)\s*$"), F.lit(1))
    return F.transform(found, lambda v: F.when(v.rlike(r"^\[\[[^\]|]+(\|[^\]]*)?\]\]$"), F.trim(F.regexp_extract(v, r"^\[\[([^\]|]+)", 1))).otherwise(v))


def taxonomy(df: DataFrame, text_col: str, prefixes: dict[str, str], keep: list[str]) -> DataFrame:
    """Rows (keep..., axis, heading, grp, value, ord) of taxonomy notes.

    A level-2 section belongs to the axis whose prefix it holds most often (the first of equals); of an axis the first
    section counts. Values are grouped by level-3 headings, or by the section's own where those hold none.
    """
    axes = list(prefixes)

    def counted(body: Column) -> Column:
        return F.array(*[F.size(prefixed_values(body, p)) for p in prefixes.values()])

    def placed(s: Column) -> Column:
        n = counted(s["body"])
        axis = F.when(F.array_max(n) > 0, F.get(F.array(*[F.lit(a) for a in axes]), (F.array_position(n, F.array_max(n)) - 1).cast("int")))
        return F.struct(axis.alias("axis"), s["title"].alias("title"), s["body"].alias("body"))

    placed_all = df.select(*keep, F.transform(sections(F.col(text_col), 2), placed).alias("s"))
    firsts = F.filter("s", lambda x, i: x["axis"].isNotNull() & ~F.exists(F.slice(F.col("s"), F.lit(1), i), lambda o: o["axis"] == x["axis"]))
    one = placed_all.select(*keep, F.explode(firsts).alias("x")).select(*keep, "x.axis", F.col("x.title").alias("heading"), "x.body")
    values = reduce(lambda c, a: c.when(F.col("axis") == a, F.lit(prefixes[a])), axes, F.when(F.lit(False), F.lit("")))

    def of(body: Column) -> Column:
        return reduce(lambda c, a: c.when(F.col("axis") == a, prefixed_values(body, prefixes[a])), axes, F.when(F.lit(False), F.array().cast("array<string>")))

    subs = F.filter(F.transform(sections(F.col("body"), 3), lambda s: F.struct(s["title"].alias("grp"), of(s["body"]).alias("values"))), lambda g: F.size(g["values"]) > 0)
    groups = F.when(F.size(subs) > 0, subs).otherwise(F.array(F.struct(F.col("heading").alias("grp"), of(F.col("body")).alias("values"))))
    rows = F.flatten(F.transform(groups, lambda g: F.transform(g["values"], lambda v: F.struct(g["grp"].alias("grp"), v.alias("value")))))
    return one.select(*keep, "axis", "heading", values.alias("prefix"), F.posexplode(rows).alias("ord", "r")).select(*keep, "axis", "heading", "prefix", "r.grp", "r.value", "ord")


def bare(c: Column) -> Column:
    """A value without link marks and variation selectors."""
    return strip_vs(F.regexp_replace(c, r"^\[\[([^\]|]*)(\|[^\]]*)?\]\]$", "$1"))
