"""Optional checks of prepared fragments and notes, always warnings, and small reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions.text import jaccard, token_set
from notemill.operators.gates import GRADES

# fixed values: words that mark the values which notes need
SERMON = ["설교", "말씀", "주일", "예배", "기도회", "강해", "sermon", "목양", "사역"]
FRAGMENT = ["조각", "영감", "메모", "묵상"]
OUTCOME = ["설교"]
DONE = ["완료", "완성", "마침", "종료", "done"]


def exempt(title: Column, marks: list[str]) -> Column:
    """A section whose title holds one of the marks."""
    return F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(title, m)) if marks else F.lit(False)


def by_kind(plan: DataFrame, kind: str, blank: str = "(구분 없음)") -> DataFrame:
    """Rows by kind; those without one under `blank`."""
    return plan.groupBy(F.coalesce(F.nullif(F.trim(kind), F.lit("")), F.lit(blank)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def list_issues(doctrine: Column, tags: Column, general: list[str]) -> Column:
    """One to three doctrines, three to eight tags, none of them too general. Null lists count as empty."""
    none = F.array().cast("array<string>")
    d, t = F.coalesce(doctrine, none), F.coalesce(tags, none)
    banned = F.arrays_overlap(t, F.array(*[F.lit(g) for g in general]).cast("array<string>"))
    checks = [(~F.size(d).between(1, 3), "doctrine_count"), (~F.size(t).between(3, 8), "tag_count"), (F.coalesce(banned, F.lit(False)), "general_tag")]
    return F.array_compact(F.array(*[F.when(broken, F.lit(code)) for broken, code in checks]))


def overlapping(bodies: Column, least: float = 0.5) -> Column:
    """Pairs (a, b, overlap), positions from 0, of one document's fragments that share at least half their tokens.

    A document has at most twenty fragments, so its pairs stay within the row.
    """
    tokens = F.transform(bodies, token_set)

    def against(x: Column, i: Column) -> Column:
        pairs = F.transform(tokens, lambda y, j: F.struct(i.alias("a"), j.alias("b"), jaccard(x, y).alias("overlap")))
        return F.filter(pairs, lambda p: (p["a"] < p["b"]) & (p["overlap"] >= least))

    return F.flatten(F.transform(tokens, against))


def section_issues(sections: DataFrame, quotas: DataFrame) -> DataFrame:
    """(doc, title, n, least, most) of documents whose sections (doc, title) are fewer or more than the quotas (title, least, most).

    Quotas are an outline of a few dozen rows, so every document is held against them by a literal list of titles.
    """
    wanted = [(r.title, r.least, r.most) for r in quotas.collect()]
    counts = sections.groupBy("doc").agg(*[F.count_if(F.col("title") == t).alias(f"n{k}") for k, (t, _, _) in enumerate(wanted)])
    rows = F.array(*[F.struct(F.lit(t).alias("title"), F.col(f"n{k}").alias("n"), F.lit(lo).alias("least"), F.lit(hi).alias("most")) for k, (t, lo, hi) in enumerate(wanted)])
    return counts.select("doc", F.explode(rows).alias("r")).select("doc", "r.*").where(~F.col("n").between(F.col("least"), F.col("most")))


def _holds(c: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(F.coalesce(c, F.lit(""))), w))


def subset(taxonomy: DataFrame, keep: list[str], sermon: list[str] | None = None, fragment: list[str] | None = None) -> DataFrame:
    """P10: rows (keep..., axis, value, role) that an import needs of a long taxonomy (keep..., axis, grp, value, ord).

    world: values of groups, or with names, that hold a sermon word, each once, as `sermon`; its first value with a fragment word
    is `fragment` and not `sermon`. outcome and route: their first value with a word is `recommended`. Doctrine is not narrowed.
    Each axis needs one aggregate for its first value; the words are fixed lists unless given.
    """
    words = {"world": fragment or FRAGMENT, "outcome": OUTCOME, "route": DONE}
    found = F.lit(False)
    for axis, some in words.items():
        found = F.when(F.col("axis") == axis, _holds(F.col("value"), some)).otherwise(found)
    named = taxonomy.where(F.col("axis").isin(*words)).groupBy(*keep, "axis", "value").agg(
        F.min("ord").alias("ord"), F.max(_holds(F.col("grp"), sermon or SERMON) | _holds(F.col("value"), sermon or SERMON)).alias("hit"), F.max(found).alias("found")
    )
    first = named.where("found").groupBy(*keep, "axis").agg(F.min_by("value", "ord").alias("chosen"))
    both = named.join(first, [*keep, "axis"], "left")
    chosen = F.coalesce(F.col("value") == F.col("chosen"), F.lit(False))
    role = F.when(chosen, F.when(F.col("axis") == "world", "fragment").otherwise("recommended")).when((F.col("axis") == "world") & F.col("hit"), "sermon")
    return both.select(*keep, "axis", "value", role.alias("role")).where(F.col("role").isNotNull())


def grade_by_evidence(declared: Column, agreeing: Column, institutional: Column, refuted: Column, disputed: Column, searched: Column, specific: Column) -> Column:
    """The grade that evidence allows. agreeing: independent domains that are no wikis, null as none; null flags are false.

    A refuted claim is banned, a disputed one disputed. Two agreeing domains, one institutional, confirm; with less than that,
    but something, a claim is probable. Nothing found leaves it uncertain, or banned if it names something specific. Without a
    search the declared grade stays, at most as probable.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    n = F.coalesce(agreeing, F.lit(0))
    capped = F.when(declared == GRADES[0], GRADES[1]).otherwise(declared)
    return (
        F.when(yes(refuted), GRADES[4]).when(yes(disputed), GRADES[2]).when((n >= 2) & yes(institutional), GRADES[0]).when(n > 0, GRADES[1])
        .when(yes(searched), F.when(yes(specific), GRADES[4]).otherwise(GRADES[3])).otherwise(capped)
    )
