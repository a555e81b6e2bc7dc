"""Evidence, quotation and coverage gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions import markdown as md
from notemill.functions.text import domain_of, in_domains
from notemill.operators.phrases import contains_join
from notemill.shared import checkpoint

# fixed values: what a line states as a fact, the grades and their marks, where a claim comes from, kinds that name something
FACT = r"(BC|AD|주전|주후)\s*[0-9]|[0-9]+\s*세기|[0-9]{3,4}\s*년|[0-9]+(\.[0-9]+)?\s*%|[“”]"
GRADES = ["확인됨", "개연", "논쟁중", "불확실", "사용금지"]
MARKS = ["✅", "🟡", "⚠️", "❓", "🚫"]
ORIGINS = ["script", "web", "trained", "inference"]
NAMING_KINDS = ["T1", "T2", "T4"]
# fixed values: sections whose lines need no grade, and the mark of sections that may state no outside fact
EXEMPT = ["(해석)", "검증 요약", "확인 필요한 성경구절", "주의"]
OBSERVATION = "(관찰)"
EVIDENCE = "array<struct<domain:string,url:string,agrees:boolean>>"


def needs_verification(kind: Column, load_bearing: Column) -> Column:
    """P3."""
    return kind.isin(*NAMING_KINDS) | (kind.isin("T3", "T5") & load_bearing)


def evidence_domain(e: Column) -> Column:
    """T30 for a piece of evidence: its domain, else its URL's host."""
    given = F.lower(F.trim(F.coalesce(e["domain"], F.lit(""))))
    return F.regexp_replace(F.when(given != "", given).otherwise(domain_of(e["url"])), r"^www\.", "")


def claim_issues(grade: Column, origin: Column, kind: Column, load_bearing: Column, both_sides: Column, evidence: Column, domains: dict[str, list[str]], web: bool = True) -> Column:
    """Codes of the rules that a claim breaks; `evidence` is of type EVIDENCE, null counts as none.

    domains has the lists institutional, suffixes and wiki. An unknown grade or origin is the only thing reported of a claim.
    A confirmed claim that is not from the script needs two agreeing domains that are no wikis, one of them institutional.
    Claims that need verification and have no evidence may not be graded above doubt; offline, only not as confirmed.
    """
    some = F.coalesce(evidence, F.array().cast(EVIDENCE))
    agreeing = F.filter(some, lambda e: F.coalesce(e["agrees"], F.lit(False)))
    refuted = F.exists(some, lambda e: F.coalesce(~e["agrees"], F.lit(False))) & (F.size(agreeing) == 0)
    named = F.array_distinct(F.filter(F.transform(agreeing, evidence_domain), lambda d: (d != "") & ~in_domains(d, domains["wiki"])))
    institutional = F.exists(named, lambda d: in_domains(d, domains["institutional"]) | reduce(lambda a, s: a | d.endswith(s), domains["suffixes"], F.lit(False)))
    confirmed = (grade == GRADES[0]) & (origin != "script")
    bare = needs_verification(kind, F.coalesce(load_bearing, F.lit(False))) & (F.size(some) == 0)
    ungrounded = F.when(kind.isin(*NAMING_KINDS), "no_evidence_forbid").otherwise("no_evidence_doubt")
    rules = [
        F.when(confirmed & (F.size(named) < 2), "few_domains"),
        F.when(confirmed & ~institutional, "no_institution"),
        F.when(refuted & (grade != GRADES[4]), "only_refuted"),
        F.when((grade == GRADES[2]) & (F.coalesce(both_sides, F.lit("")) == ""), "one_sided"),
        F.when(bare & grade.isin(*GRADES[:2]), ungrounded) if web else F.when(bare & confirmed, "offline_confirmed"),
    ]
    unknown = F.when(~F.coalesce(grade.isin(*GRADES), F.lit(False)), "unknown_grade").when(~F.coalesce(origin.isin(*ORIGINS), F.lit(False)), "unknown_source")
    return F.when(unknown.isNotNull(), F.array(unknown)).otherwise(F.array_compact(F.array(*rules)))


def domain_kinds(hosts: DataFrame, host: str, table: DataFrame) -> DataFrame:
    """(host, kinds) of the distinct hosts, kinds being those of the table (kind, pattern, below) that hold for it, sorted.

    A pattern holds for its own domain, unless `below` is set, and for those under it. Each host is expanded to its ends at a
    dot, and these join the table, so neither grows the plan; hosts are distinct first, however often they come.
    """
    distinct = hosts.select(F.col(host).alias("host")).where("host IS NOT NULL").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    met = distinct.select("host", F.explode(ends).alias("pattern")).join(table, "pattern").where(~F.col("below") | (F.col("pattern") != F.col("host")))
    found = met.groupBy("host").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))  # at most the kinds there are
    return distinct.join(found, "host", "left").select(F.col("host").alias(host), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))


def confirmed_by(claims: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """(key, domains, institutional) of claims with agreeing evidence (EVIDENCE): distinct domains that are no wikis, and whether one is an institution's.

    For tables of any size; claim_issues() takes short lists in the plan.
    """
    each = claims.select(key, F.explode(F.filter("evidence", lambda e: F.coalesce(e["agrees"], F.lit(False)))).alias("e"))
    named = each.select(key, evidence_domain(F.col("e")).alias("domain")).where("domain != ''").distinct()
    kinds = domain_kinds(named, "domain", table)
    known = named.join(kinds, "domain").where(~F.array_contains("kinds", "wiki"))
    return known.groupBy(key).agg(F.count(F.lit(1)).alias("domains"), F.max(F.array_contains("kinds", "institutional")).alias("institutional"))


def over_budget(runs: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """V7: rows of runs (mode, searches_used, ...) that searched more than their mode may, with the `budget`. Other modes have none."""
    budget = F.coalesce(*[F.when(F.col("mode") == m, F.lit(n)) for m, n in budgets.items()], F.lit(None).cast("int"))
    return runs.withColumn("budget", budget).where("searches_used > budget")


def repeated_ids(claims: DataFrame, key: str) -> DataFrame:
    """V7: (key, n) of ids that several claims have; counted before they shuffle."""
    return claims.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def search_plan(claims: DataFrame, budget: int | None, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(claims to verify, the load-bearing first, up to the budget; one row `skipped_over_budget`).

    claims has kind, load_bearing and evidence (EVIDENCE). Claims with evidence are not searched for again.
    """
    todo = claims.where(needs_verification(F.col("kind"), F.coalesce("load_bearing", F.lit(False))) & (F.coalesce(F.size("evidence"), F.lit(0)) <= 0))
    ordered = todo.orderBy(F.desc(F.coalesce("load_bearing", F.lit(False))), F.col(key).cast("string"))
    over = F.greatest(F.count(F.lit(1)) - F.lit(budget), F.lit(0)) if budget is not None else F.lit(0).cast("long")
    return (ordered.limit(budget) if budget is not None else ordered), todo.agg(over.alias("skipped_over_budget"))


def uncovered_lines(df: DataFrame, keep: list[str], text_col: str, marks: list[str] = MARKS) -> DataFrame:
    """Rows (keep..., section, line, rule): lines that state a fact, as `ungraded` without a grade's mark, or as
    `observation` in a section that may state none. Headings and exempt sections are left out; the text before the first has no title.
    """
    parts = df.select(*keep, F.explode(md.sections(F.col(text_col), 2, preamble=True)).alias("s")).where(~F.exists(F.array(*map(F.lit, EXEMPT)), lambda m: F.contains(F.col("s.title"), m)))
    lines = parts.select(*keep, F.col("s.title").alias("section"), F.explode(F.split("s.body", r"\r\n|[\n\r]")).alias("line"))
    # facts and marks neither start nor end with white space, so lines are judged as they are and only those shown are trimmed
    stated = lines.where(F.col("line").rlike(FACT) & ~F.col("line").rlike(r"(?U)^\s*#"))
    graded = reduce(lambda a, m: a | F.contains("line", F.lit(m)), marks, F.lit(False))
    rule = F.when(F.contains("section", F.lit(OBSERVATION)), "observation").when(~graded, "ungraded")
    return stated.withColumn("rule", rule).where("rule IS NOT NULL").withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))


def forbidden(df: DataFrame, keep: list[str], text_col: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Every match of every rule (pattern, reason)."""

    def hits(pattern: str, reason: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(reason).alias("reason"), m.alias("match")))

    found = F.flatten(F.array(*[hits(p, r) for p, r in rules]))
    return df.select(*keep, F.explode(found).alias("hit")).select(*keep, "hit.reason", "hit.match")


def squeeze(c: Column) -> Column:
    """Without white space, quotation marks and middle dots."""
    return F.regexp_replace(c, r"""(?U)[\s"'“”‘’·]+""", "")


def quote_segments(c: Column) -> Column:
    """The parts of a quotation between ellipses."""
    return F.filter(F.transform(F.split(c, r"…|\.\.\."), lambda s: squeeze(s)), lambda s: s != "")


def quote_holds(quote: Column, source: Column) -> Column:
    """Q1: every segment of the quotation is in the source."""
    return F.forall(quote_segments(quote), lambda s: F.contains(squeeze(source), s))


def find_quotes(quotes: DataFrame, sources: DataFrame, quote_id: str, source_id: str, text_col: str = "text") -> DataFrame:
    """For each row of quotes whether one source holds all its segments.

    Columns: quote_id, ok, n_sources (that hold the whole quote), source_id (of the source that lacks the fewest segments, the
    least id of several; null if none holds any) and missing_segments (those it lacks, as written). A quote without segments
    holds. Segments are sought in all whole sources by phrases.contains_join(); quotes and sources may both be many.
    """
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), r"…|\.\.\.")
    written = F.transform(F.filter(parts, lambda s: squeeze(s) != ""), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    rows = quotes.select(F.col(quote_id).alias("id"), written.alias("written"), quote_segments(F.coalesce(F.col(text_col), F.lit(""))).alias("segments"))
    asked = checkpoint(rows).withColumn("quote", F.monotonically_increasing_id())  # numbers of written rows, so equal quotes stay apart
    segments = asked.select("quote", F.posexplode("segments").alias("pos", "phrase"))
    texts = sources.select(F.col(source_id).alias("source"), squeeze(F.col(text_col)).alias("text"))
    held = contains_join(texts, segments).join(segments, "phrase").groupBy("quote", "row").agg(F.first("source").alias("source"), F.collect_set("pos").alias("has"))
    sizes = asked.select("quote", F.size("segments").alias("n"))
    lacks = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: ~F.array_contains("has", k))
    hits = held.join(sizes, "quote").select("quote", "source", lacks.alias("lacks"))
    best = hits.groupBy("quote").agg(F.min(F.struct(F.size("lacks").alias("n"), "source", "lacks")).alias("best"), F.count_if(F.size("lacks") == 0).alias("n_sources"))
    missing = F.when(F.col("best").isNull(), F.col("written")).otherwise(F.transform("best.lacks", lambda n: F.get("written", n)))
    return asked.join(best, "quote", "left").select(F.col("id").alias(quote_id), (F.size(missing) == 0).alias("ok"), F.coalesce("n_sources", F.lit(0).cast("long")).alias("n_sources"), F.col("best.source").alias(source_id), missing.alias("missing_segments"))
