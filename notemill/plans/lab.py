"""Notes of studies, diagnoses and enrichments: one note a result; grades are counted and references found in its text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions import markdown as md
from notemill.functions import names, refs
from notemill.functions.text import sanitize_title, validate_tags
from notemill.operators.audit import DIMENSIONS
from notemill.plans import config, notes

#: Columns of a result; from_json with it reads one from JSON. Absent columns count as null.
RESULT = (
    "title string, topic string, date string, body string, main_passage string, scores map<string,int>, weaknesses array<string>, "
    "focus string, verification_status string, links map<string,string>, tags array<string>, search_count int"
)
# fixed values: types and file names of the notes, the dimensions of a diagnosis, headings, field names and reasons
MODES = {"research": ("연구노트", "연구", "topic"), "diagnose": ("진단노트", "진단", "title"), "enrich": ("보강노트", "보강", "title")}
SUMMARY = "## 검증 요약"
UNCLEAR = "## 확인 필요한 성경구절"
LINKED = ["설교노트", "관련연구"]
REASONS = {"reversed": "역방향 범위", "too_long": "범위가 너무 김", "no_verse": "절 번호 없음"}


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _frontmatter(fields: dict[str, Column], lists: set[str]) -> Column:
    """The block of all fields that are not null, every value in quotation marks as it is."""

    def one(name: str, value: Column) -> Column:
        if name not in lists:
            return F.concat(F.lit(f"{name}: "), _quoted(value))
        rows = F.transform(value, lambda v: F.concat(F.lit("\n  - "), _quoted(v)))
        return F.concat(F.lit(f"{name}:"), F.when(F.size(rows) == 0, F.lit("\n  []")).otherwise(F.array_join(rows, "")))

    return F.concat(F.lit("---\n"), F.concat_ws("\n", *[one(n, v) for n, v in fields.items()]), F.lit("\n---\n"))


def problems(mode: str) -> Column:
    """Codes of everything that keeps a result (columns of RESULT) from becoming a note; a diagnosis needs all its scores."""
    none = F.array().cast("array<string>")
    found = [
        F.when(_strip(F.col("body")) == "", "body_empty"),
        F.when(F.contains("body", F.lit(SUMMARY)), "summary_written"),
        F.when(sanitize_title(F.col("title"), "") == "", "title_empty"),
    ]
    codes = F.array_compact(F.array(*found))
    if mode != "diagnose":
        return codes
    fixed = F.array(*[F.lit(d) for d in DIMENSIONS])
    scores = F.coalesce("scores", F.create_map().cast("map<string,int>"))
    missing = F.filter(fixed, lambda d: ~F.coalesce(F.element_at(scores, d).between(1, 5), F.lit(False)))
    focus = _strip(F.col("focus"))
    more = [
        F.transform(missing, lambda d: F.concat(F.lit("score:"), d)),
        F.transform(F.array_sort(F.array_except(F.map_keys(scores), fixed)), lambda d: F.concat(F.lit("unknown_score:"), d)),
        F.transform(F.array_except(F.coalesce("weaknesses", none), fixed), lambda d: F.concat(F.lit("unknown_weakness:"), F.coalesce(d, F.lit("")))),
        F.when((focus != "") & ~focus.isin(*DIMENSIONS), F.array(F.lit("unknown_focus"))).otherwise(none),
    ]
    return F.concat(codes, *more)


def plan(results: DataFrame, mode: str, existing: DataFrame, folder: str, books: list[str], settings: dict | None = None, now: str | None = None, skill: str = "notemill") -> DataFrame:
    """M7: results (columns of RESULT, further ones stay) with path, action, problems, content, warnings, grades, bible_links, unclear.

    action is `invalid` for a result with problems (content, links and unclear references are null), `conflict` if existing (path) has the note, else `create`. All
    problems of a result are told. The date is the result's, else now's; the title stands in for a missing topic.
    """
    kind, short, named = MODES[mode]
    bible = (settings or config.DEFAULTS)["bible"]
    now = now or datetime.now().isoformat(timespec="minutes")
    given = [c for c in results.columns if c not in ("path", "action", "problems", "content", "warnings", "grades", "bible_links", "unclear")]
    typed = results.sparkSession.createDataFrame([], RESULT).schema
    full = results.select(*given, *[F.lit(None).cast(f.dataType).alias(f.name) for f in typed if f.name not in results.columns])
    title, date = sanitize_title(F.col("title"), ""), F.coalesce(F.nullif(_strip(F.col("date")), F.lit("")), F.lit(now[:10]))
    none = F.array().cast("array<string>")
    body = F.regexp_replace(F.coalesce("body", F.lit("")), r"(?U)\s+\z", "")
    read = full.withColumns({"problems": problems(mode), "_body": body, "_date": date, "_title": title})
    read = read.withColumn("_refs", F.when(F.size("problems") == 0, refs.verses(F.col("_body"), books, bible["max_range_expand"], bible["book_aliases"])))
    read = read.withColumns({
        "bible_links": F.array_distinct(F.transform(F.filter("_refs", lambda r: r["status"] == "ok"), lambda r: refs.link(bible["link_style"], r["normalized"]))),
        "unclear": F.filter("_refs", lambda r: r["status"] != "ok"),
        "grades": md.grade_counts(F.col("_body")),
        "_joined": F.filter(F.transform(F.coalesce("tags", none), lambda t: sanitize_title(t, "")), lambda t: F.contains(t, F.lit(" "))),
    })

    fields = {"created": F.lit(now), "modified": F.lit(now), "note_type": F.lit(kind), "skill": F.lit(skill), "title": F.col("_title"), "date": F.col("_date")}
    fields["main_passage"] = F.when(F.col("main_passage") != "", _strip(F.col("main_passage")))
    if mode == "diagnose":
        fields |= {f"점수_{d}": F.element_at("scores", d).cast("string") for d in DIMENSIONS}
        fields |= {"약점": F.coalesce("weaknesses", none), "집중점검": F.nullif(_strip(F.col("focus")), F.lit(""))}
    else:
        fields["검증상태"] = F.coalesce(F.nullif(_strip(F.col("verification_status")), F.lit("")), F.lit("미기재"))
    link = lambda k: F.nullif(F.element_at("links", k), F.lit(""))
    fields |= {k: F.concat(F.lit("[["), F.regexp_replace(link(k), r"\.md\z", ""), F.lit("]]")) for k in LINKED}
    tags = validate_tags(F.coalesce("tags", none))
    fields |= {"검증등급": md.grade_summary(F.col("grades")), "tags": F.when(F.size(tags) > 0, tags), bible["frontmatter_key"]: F.col("bible_links")}

    reasons = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    listed = F.array_join(F.transform("unclear", lambda r: F.concat(F.lit("- "), r["raw"], F.lit(" — "), F.element_at(reasons, r["note"]), F.lit("\n"))), "")
    doubt = F.when(F.size("unclear") > 0, F.concat(F.lit(f"\n{UNCLEAR}\n"), listed)).otherwise("")
    used = F.when(F.col("search_count").isNotNull(), F.concat(F.lit(" · 검색 "), F.col("search_count").cast("string"), F.lit("회 사용"))).otherwise("")
    end = F.lit("") if mode == "diagnose" else F.concat(F.lit(f"\n{SUMMARY}\n\n- "), md.grade_summary(F.col("grades")), used, F.lit("\n"))
    content = F.concat(_frontmatter(fields, {"약점", "tags", bible["frontmatter_key"]}), F.lit(f"\n# {kind.removesuffix('노트')}: "), "_title", F.lit("\n\n"), "_body", F.lit("\n"), doubt, end)

    subject = sanitize_title(F.coalesce("topic", "title") if named == "topic" else F.col("title"))
    name = sanitize_title(F.concat_ws("_", F.col("_date"), F.lit(short), subject))
    inside = names.relative_folder(folder)
    warnings = F.concat(F.transform("_joined", lambda t: F.concat(F.lit("tag_joined:"), t)), F.coalesce(F.transform("unclear", lambda r: F.concat(F.lit("unclear:"), r["raw"])), none))
    made = read.withColumns({"path": F.concat(F.lit(f"{inside}/" if inside else ""), name, F.lit(".md")), "warnings": warnings, "content": F.when(F.size("problems") == 0, content)})
    met = made.join(existing.select("path", F.lit(True).alias("_there")).distinct(), "path", "left")
    action = F.when(F.size("problems") > 0, "invalid").otherwise(notes.action(F.coalesce("_there", F.lit(False)), F.lit(False), F.lit(False)))
    return met.select(*given, "path", action.alias("action"), "problems", "content", "warnings", "grades", "bible_links", "unclear")


def commit(planned: DataFrame, approve: str = "") -> DataFrame:
    """K3: write the notes; an invalid result or a note that exists stops everything before the first write."""
    wrong = planned.where("action = 'invalid'").select("path", "problems").limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.path}: {', '.join(r.problems)}" for r in wrong))
    return notes.commit(planned, approve)
