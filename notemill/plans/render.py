"""Notes from fragments: main notes, fragment notes and append-only merges. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notemill.functions import markdown as md
from notemill.functions.text import let


def _bullets(b: Column) -> Column:
    return F.array_join(F.transform(b, lambda x: F.concat(F.lit("- "), x)), "\n")


def backlink(name: Column) -> Column:
    return F.concat(F.lit("원본 설교: "), md.wikilink(name))


def main_note(fields: dict[str, Column], lists: set[str], title: Column, fragments: Column, unclear: Column, original: Column, optional: set[str] = frozenset()) -> Column:
    """M4: frontmatter, a section for each fragment (basename, bullets), unclear references (raw, note), the original as it was."""
    parts = F.transform(fragments, lambda f: F.concat(F.lit("## "), md.wikilink(f["basename"]), F.lit("\n"), _bullets(f["bullets"]), F.lit("\n\n")))
    listed = F.array_join(F.transform(unclear, lambda r: F.concat(F.lit("- "), r["raw"], F.lit(" — "), r["note"])), "\n")
    doubt = F.when(F.size(unclear) > 0, F.concat(F.lit("## 확인 필요한 성경구절\n"), listed, F.lit("\n\n"))).otherwise("")
    end = F.concat(F.lit("---\n\n# 원본 설교문\n\n"), F.regexp_replace(F.coalesce(original, F.lit("")), r"(?U)\s+\z", ""), F.lit("\n"))
    return F.concat(md.frontmatter(fields, lists, optional), F.lit("\n# "), title, F.lit("\n\n"), F.array_join(parts, ""), doubt, end)


def fragment_note(fields: dict[str, Column], lists: set[str], bullets: Column, main: Column, optional: set[str] = frozenset()) -> Column:
    """M5: frontmatter, bullets and the link back to the main note."""
    return F.concat(md.frontmatter(fields, lists, optional), F.lit("\n"), _bullets(bullets), F.lit("\n\n"), backlink(main), F.lit("\n"))


def added(existing: Column, new: Column) -> Column:
    """New bullets that the note lacks, the first of equal ones, in order. Both are a note's own few bullets."""
    some = F.filter(F.transform(new, lambda b: F.struct(F.trim(b).alias("text"), md.bullet_key(b).alias("key"))), lambda b: b["key"] != "")
    keys, old = F.transform(some, lambda b: b["key"]), F.transform(existing, md.bullet_key)
    first = F.filter(some, lambda b, i: ~F.array_contains(old, b["key"]) & (F.array_position(keys, b["key"]) == i + 1))
    return F.transform(first, lambda b: b["text"])


def merge(note: Column, new: Column, main: Column) -> Column:
    """Struct (content, added, duplicates, existing). The frontmatter stays byte for byte, bullets are only appended."""

    def joined(old: Column, more: Column) -> Column:
        back = backlink(main)
        tail = F.btrim(old["trailer"], F.lit("\n"))
        closing = F.when(F.contains(note, back), tail).otherwise(F.concat_ws("\n", F.nullif(tail, F.lit("")), back))
        head = F.regexp_replace(old["frontmatter"], r"\n+\z", "\n")
        content = F.concat(head, F.lit("\n"), _bullets(F.concat(old["bullets"], more)), F.lit("\n"), F.when(closing != "", F.concat(F.lit("\n"), closing, F.lit("\n"))).otherwise(""))
        offered = F.size(F.filter(new, lambda b: md.bullet_key(b) != ""))
        return F.struct(content.alias("content"), F.size(more).alias("added"), (offered - F.size(more)).alias("duplicates"), F.size(old["bullets"]).alias("existing"))

    return let(md.bullets_of(note), lambda old: let(added(old["bullets"], new), lambda more: joined(old, more)))
