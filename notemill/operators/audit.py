"""Checks of written notes and of a run's log: each check is a DataFrame of issues (path, rule, detail).

notes has (path, kind, action, content); values are compared under the key of functions.markdown.bare.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions import markdown as md
from notemill.functions.text import FORBIDDEN

# fixed values: the six dimensions of a diagnosis and the limits of a devotion's fields, as (least, most) characters
DIMENSIONS = ["본문충실", "중심명제", "구조명료", "적용구체", "예화적절", "회중공감"]
FIELD_LENGTHS = {"label": (0, 8), "title": (0, 10), "subhead": (0, 30), "scripture": (0, 50), "key1": (0, 12), "med": (80, 120), "q1": (0, 50)}


def _issue(rule: str, detail: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def _report(df: DataFrame, issues: list[Column]) -> DataFrame:
    """One row an issue; the issues of a row are arrays of (rule, detail)."""
    return df.select("path", "action", F.explode(F.concat(*issues)).alias("i")).select("path", "action", "i.rule", "i.detail")


def _if(broken: Column, rule: str, detail: Column) -> Column:
    return F.array_compact(F.array(F.when(broken, _issue(rule, detail))))


def fields(notes: DataFrame) -> DataFrame:
    """V5: notes with their frontmatter as `fields`; a note of unknown kind is a main one if it holds the original's heading."""
    kind = F.coalesce("kind", F.when(F.contains("content", F.lit("\n# 원본 설교문")), "main").otherwise("fragment"))
    return notes.withColumn("kind", kind).withColumn("fields", md.read_frontmatter(F.col("content")))


def values_of(key: str) -> Column:
    """A field's values, none where it is absent."""
    return F.coalesce(F.try_element_at("fields", F.lit(key))["values"], F.array().cast("array<string>"))


def repeated(log: DataFrame) -> DataFrame:
    """Paths that a log names more than once, one issue a repeat; counted before they shuffle."""
    n = log.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return n.select("path", F.lit("create").alias("action"), F.lit("duplicate_path").alias("rule"), F.explode(F.sequence(F.lit(2), F.col("n")).cast("array<string>")).alias("detail"))


def places(notes: DataFrame, vault: str) -> DataFrame:
    """V1: notes outside the vault, missing ones (null content) and names with forbidden characters."""
    name = F.element_at(F.split("path", "/"), -1)
    outside = ~F.startswith("path", F.lit(vault.rstrip("/") + "/")) | F.col("path").rlike(r"(^|/)\.\.(/|$)")
    return _report(
        notes,
        [_if(outside, "outside_vault", F.col("path")), _if(F.col("content").isNull(), "missing_file", F.col("path")), _if(name.rlike(FORBIDDEN), "forbidden_name", name)],
    )


def classification(read: DataFrame, allowed: dict[str, list[str]], open_axes: tuple[str, ...] = ()) -> DataFrame:
    """V2: values that their axis does not list. Empty lists and open axes allow everything.

    The lists are settings of a few hundred values, so they are literals; notes never shuffle.
    """

    def wrong(axis: str, listed: list[str]) -> Column:
        known = F.array(*[md.bare(F.lit(v)) for v in listed])
        return F.transform(F.filter(values_of(axis), lambda v: ~F.array_contains(known, F.trim(md.bare(v)))), lambda v: _issue(f"not_listed_{axis}", v))

    return _report(read, [wrong(a, v) for a, v in allowed.items() if v and a not in open_axes] or [F.array().cast("array<struct<rule:string,detail:string>>")])


def shape(read: DataFrame, prefixes: dict[str, list[str]], route_scalar: bool = True, single_world: bool = True) -> DataFrame:
    """V3: a route that is a list, a main note without exactly one world, values without their axis's prefix."""
    route, world = F.try_element_at("fields", F.lit("route")), F.try_element_at("fields", F.lit("world"))
    checks = [
        _if(F.lit(route_scalar) & route.isNotNull() & ~route["scalar"], "route_is_list", F.lit("route")),
        _if(F.lit(single_world) & (F.col("kind") == "main") & world.isNotNull() & (F.size(world["values"]) != 1), "world_count", F.size(world["values"])),
    ]

    def without(axis: str, some: list[str]) -> Column:
        def fits(v: Column) -> Column:
            return reduce(lambda a, p: a | md.bare(v).startswith(p.replace("\ufe0f", "")), some, F.lit(not some))

        return F.transform(F.filter(values_of(axis), lambda v: ~fits(v)), lambda v: _issue(f"no_prefix_{axis}", v))

    checks += [without(axis, some) for axis, some in prefixes.items()]
    return _report(read, checks)


def tags(read: DataFrame) -> DataFrame:
    """V4: tags with white space."""
    return _report(read, [F.transform(F.filter(values_of("tags"), lambda v: v.rlike(r"\s")), lambda v: _issue("tag_space", v))])


def declared(read: DataFrame, key: str, kinds: list[str], planned: Column) -> DataFrame:
    """V4: a main note's kind that is not declared, or not the planned one (empty: none was planned)."""
    known = F.array(*[F.lit(k) for k in kinds])
    main = F.when(F.col("kind") == "main", values_of(key)).otherwise(F.array().cast("array<string>"))
    odd = F.transform(F.filter(main, lambda v: F.lit(bool(kinds)) & ~F.array_contains(known, F.trim(md.bare(v)))), lambda v: _issue("kind_undeclared", v))
    other = F.transform(F.filter(main, lambda v: (planned != "") & (F.trim(md.bare(v)) != planned)), lambda v: _issue("kind_not_planned", v))
    return _report(read, [odd, other])


def unresolved(read: DataFrame, names: DataFrame) -> DataFrame:
    """Fragments that a heading of the generated part of a main note links and no note (names: name) bears."""
    made = F.split_part("content", F.lit("\n# 원본 설교문"), F.lit(1))
    found = read.where("kind = 'main'").select("path", "action", F.explode(F.array_distinct(F.regexp_extract_all(made, F.lit(r"(?m)^## \[\[([^\]]+)\]\]"), F.lit(1)))).alias("name"))
    return found.join(names.select("name").distinct(), "name", "left_anti").select("path", "action", F.lit("unresolved_link").alias("rule"), F.col("name").alias("detail"))


def unresolved_verses(read: DataFrame, key: str, names: DataFrame, sample: int = 8) -> DataFrame:
    """One row (n, sample): how many verse links have no note, and the first of them."""
    found = read.where("kind = 'main'").select(F.explode(F.transform(values_of(key), lambda v: F.trim(md.bare(v)))).alias("name")).where("name != ''").distinct()
    missing = found.join(names.select("name").distinct(), "name", "left_anti")
    first = missing.orderBy("name").limit(sample).agg(F.array_sort(F.collect_list("name")).alias("sample"))
    return missing.agg(F.count(F.lit(1)).alias("n")).join(first, F.lit(True))  # one row on either side


def graded(read: DataFrame, summary_title: str = "검증 요약") -> DataFrame:
    """V9: the declared summary of grades against the marks that the note holds outside its summary section."""
    said = F.get(values_of("검증등급"), F.lit(0))
    counted = md.grade_summary(md.grade_counts(md.body_without(F.col("content"), summary_title)))
    return _report(read, [_if((said != "") & (said != counted), "grades_differ", F.concat(said, F.lit(" / "), counted))])


def diagnosed(read: DataFrame) -> DataFrame:
    """V9: diagnoses without a score of 1 to 5 in each dimension, or with weaknesses outside them."""
    is_one = F.get(values_of("note_type"), F.lit(0)) == "진단노트"
    scores = [_if(is_one & ~F.coalesce(F.get(values_of(f"점수_{d}"), F.lit(0)), F.lit("")).rlike("^[1-5]$"), "score", F.lit(d)) for d in DIMENSIONS]
    odd = F.filter(values_of("약점"), lambda v: is_one & ~v.isin(*DIMENSIONS))
    return _report(read, [*scores, F.transform(odd, lambda v: _issue("weakness", v))])


def score_issues(scores: Column, names: list[str]) -> Column:
    """Of a map of scores, the names without a whole number of 1 to 5 and those that are unknown."""
    known = F.array(*[F.lit(n) for n in names])
    lacking = F.filter(known, lambda n: ~F.coalesce(F.try_element_at(scores, n).between(1, 5), F.lit(False)))
    return F.concat(lacking, F.array_except(F.map_keys(scores), known))


def weaknesses(scores: DataFrame, subject: str, at: str, name: str, score: str, limit: float) -> DataFrame:
    """Rows of scores (subject, at, name, score) that are weak: at or under the limit, else the lowest of a diagnosis, by name of equals.

    `nth` numbers a subject's diagnoses by time. A diagnosis has a handful of scores.
    """
    one = Window.partitionBy(subject, at)
    lowest = (F.min(score).over(one) > limit) & (F.row_number().over(one.orderBy(score, name)) == 1)
    nth = F.dense_rank().over(Window.partitionBy(subject).orderBy(at))
    return scores.select("*", ((F.col(score) <= limit) | lowest).alias("_weak"), nth.alias("nth")).where("_weak").drop("_weak")


def recurring(weak: DataFrame, subject: str, name: str, back: int = 3) -> DataFrame:
    """weaknesses() with `repeated`: whether any of the subject's last `back` diagnoses had the same one."""
    last = F.lag("nth").over(Window.partitionBy(subject, name).orderBy("nth"))
    return weak.withColumn("repeated", F.coalesce(F.col("nth") - last <= back, F.lit(False)))


def routed(issues: DataFrame) -> DataFrame:
    """V6: with a severity; what is wrong in a merged note was there before, so it is a warning."""
    return issues.withColumn("severity", F.when(F.col("action") == "merge", "warning").otherwise("issue"))


def status(issues: DataFrame) -> DataFrame:
    """V1: one row (status, issues, warnings)."""
    counts = issues.agg(F.count_if(F.col("severity") == "issue").alias("issues"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return counts.select(F.when(F.col("issues") == 0, "ok").otherwise("blocked").alias("status"), "issues", "warnings")


def length_issues(limits: dict[str, tuple[int, int]] = FIELD_LENGTHS) -> Column:
    """Q2: names of the columns whose text is shorter or longer than allowed; null counts as empty."""
    return F.array_compact(F.array(*[F.when(~F.length(F.coalesce(F.col(c), F.lit(""))).between(*span), F.lit(c)) for c, span in limits.items()]))


def bullet_issues(bullets: Column) -> Column:
    """R2: three to six bullets of 15 to 60 characters with one to three bold spans."""
    bold = F.aggregate(bullets, F.lit(0), lambda n, b: n + F.regexp_count(b, F.lit(r"\*\*[^*]+\*\*")))
    checks = [(~F.size(bullets).between(3, 6), "count"), (F.exists(bullets, lambda b: ~F.length(b).between(15, 60)), "length"), (~bold.between(1, 3), "bold")]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks]))
