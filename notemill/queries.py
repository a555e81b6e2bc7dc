"""Registry of the engine's own queries: name -> callable, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notemill.functions import markdown, names, refs, text
from notemill.operators import audit, gates, matching, relational, rules
from notemill.plans import config, importing, lab, notes, render
from notemill.sources import decode, discovery, listing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BOOKS = ["창", "출", "시", "요"]
CHAPTERS = [("창", 50), ("출", 40), ("시", 150), ("요", 21)]
DONE = ["example.com", "example.org"]
RULES = [(r"[0-9]{4,}", "long_number"), (r"[A-Z]{12,}", "shouting")]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SENTENCES = """s AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{3000}]+', ' ', 'g')), '([.!?。！？]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x != '') AS parts FROM documents)"""


@query("sentence_split", f"WITH {_SENTENCES} SELECT doc_id, (generate_subscripts(parts, 1) - 1)::INTEGER AS pos, unnest(parts) AS sentence FROM s")
def sentence_split(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.posexplode(text.split_sentences(F.col("text"))).alias("pos", "sentence"))


@query(
    "bullet_pack",
    f"""WITH RECURSIVE {_SENTENCES},
walk AS (
  SELECT doc_id, parts, 0 AS i, []::VARCHAR[] AS done, '' AS now FROM s
  UNION ALL
  SELECT doc_id, parts, i + 1,
         CASE WHEN now = '' OR length(now) + length(parts[i + 1]) < 160 THEN done ELSE list_append(done, now) END,
         CASE WHEN now = '' THEN parts[i + 1] WHEN length(now) + length(parts[i + 1]) < 160 THEN now || ' ' || parts[i + 1] ELSE parts[i + 1] END
  FROM walk WHERE i < len(parts) AND len(done) < 4
), ended AS (
  SELECT doc_id, (CASE WHEN now = '' THEN done ELSE list_append(done, now) END)[1:4] AS b FROM walk WHERE i = len(parts) OR len(done) >= 4
)
SELECT doc_id, (generate_subscripts(b, 1) - 1)::INTEGER AS pos, unnest(b) AS bullet FROM ended""",
)
def bullet_pack(spark, d):
    bullets = text.pack_bullets(text.split_sentences(F.col("text")))
    return _t(spark, d, "documents").select("doc_id", F.posexplode(bullets).alias("pos", "bullet"))


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity::INTEGER AS q, l_linenumber % 4 AS k"


def _ref_lines(spark, d):
    q, k = F.col("l_quantity").cast("int"), F.col("l_linenumber") % 4
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.concat(F.lit("요 "), "l_linenumber", F.lit(":"), q, F.lit("-"), q + k).alias("t"))


@query("ref_expand", f"WITH x AS (SELECT {_LINE} FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (v - q)::INTEGER AS pos, '요' || l_linenumber || '_' || v AS normalized, 'ok' AS status FROM (SELECT *, unnest(generate_series(q, q + k)) AS v FROM x)")
def ref_expand(spark, d):
    return refs.expand(_ref_lines(spark, d), "t", BOOKS, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).drop("raw", "note")


@query("ref_ambiguous", "SELECT l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'reversed' ELSE 'long' END AS shape, count(*) AS n FROM lineitem WHERE l_quantity >= 2 GROUP BY ALL")
def ref_ambiguous(spark, d):
    q = F.col("l_quantity").cast("int")
    last = F.when(F.col("l_linenumber") % 2 == 0, q - 1).otherwise(q + 51)
    lines = _t(spark, d, "lineitem").where("l_quantity >= 2").select(F.monotonically_increasing_id().alias("id"), "l_linenumber", F.concat(F.lit("시 3:"), q, F.lit("-"), last).alias("t"))
    found = refs.expand(lines, "t", BOOKS, ["id", "l_linenumber"]).where("status = 'ambiguous'")
    shape = F.when(F.col("l_linenumber") % 2 == 0, "reversed").otherwise("long")
    return found.groupBy("l_linenumber", shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("ref_bounds", "WITH b(book, chapters, k) AS (VALUES ('창', 50, 0), ('출', 40, 1), ('시', 150, 2), ('요', 21, 3)) SELECT book, chapters, l_partkey % 160 AS chapter, count(*) AS n FROM lineitem JOIN b ON l_suppkey % 4 = k WHERE l_partkey % 160 > chapters GROUP BY ALL")
def ref_bounds(spark, d):
    book = F.element_at(F.array(*[F.lit(b) for b in BOOKS]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    bounds = F.broadcast(spark.createDataFrame(CHAPTERS, "book string, chapters int"))  # one row a book
    found = refs.out_of_bounds(_t(spark, d, "lineitem").select(book.alias("book"), (F.col("l_partkey") % 160).alias("chapter")), bounds)
    return found.groupBy("book", "chapters", "chapter").agg(F.count(F.lit(1)).alias("n"))


@query("date_normalize", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate, '%y%m%d') AS compact FROM orders")
def date_normalize(spark, d):
    shape = F.col("o_orderkey") % 4
    written = F.when(shape == 0, F.date_format("o_orderdate", "yyMMdd")).when(shape == 1, F.date_format("o_orderdate", "yyyyMMdd")).when(shape == 2, F.date_format("o_orderdate", "yyyy-M-d")).otherwise(F.date_format("o_orderdate", "yyyy.MM.dd"))
    date = text.normalize_date(written)
    return _t(spark, d, "orders").select("o_orderkey", date.alias("date"), text.compact_date(date).alias("compact"))


@query("sermon_id", "SELECT o_orderkey, strftime(o_orderdate, '%y%m%d') || '_' || o_orderpriority || '_' || CASE WHEN o_orderkey % 3 = 0 THEN 'no본문' ELSE '요3_' || o_orderkey END AS sermon_id FROM orders")
def sermon_id(spark, d):
    passage = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("요3_"), F.col("o_orderkey")))
    key = text.sermon_id(F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.col("o_orderpriority"), F.lit("_ ")), passage)
    return _t(spark, d, "orders").select("o_orderkey", key.alias("sermon_id"))


@query("noise_flag", "SELECT doc_id, length(trim(text)) < 40 AS noise FROM documents")
def noise_flag(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.is_noise(F.col("text")).alias("noise"))


@query("title_key", "SELECT p_partkey, trim(p_name) AS k FROM part")
def title_key(spark, d):
    return _t(spark, d, "part").select("p_partkey", text.compare_key(F.concat(F.lit("[["), "p_name", F.lit("️ |x]]"))).alias("k"))


@query("token_jaccard", "WITH t AS (SELECT p_partkey, list_distinct(regexp_extract_all(p_name, '[0-9A-Za-z]{2,}')) AS a, list_distinct(regexp_extract_all(p_type, '[0-9A-Za-z]{2,}')) AS b FROM part) SELECT p_partkey, CASE WHEN len(list_distinct(a || b)) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(a || b)) ELSE 0.0 END::DOUBLE AS j FROM t")
def token_jaccard(spark, d):
    return _t(spark, d, "part").select("p_partkey", text.jaccard(text.token_set(F.col("p_name")), text.token_set(F.col("p_type"))).alias("j"))


@query("suffix_hist", "SELECT CASE WHEN regexp_matches(url, '[.]html?([?#]|$)') THEN '.html' ELSE '' END AS suffix, count(*) AS n FROM pages GROUP BY 1")
def suffix_hist(spark, d):
    suffix = F.when(F.col("url").rlike("[.]html?([?#]|$)"), ".html").otherwise("")
    return discovery.undeclared(_t(spark, d, "pages").select(suffix.alias("suffix")), [])


_ALLOW = "allow AS (SELECT DISTINCT p_brand AS value FROM part WHERE p_partkey % 50 = 0)"


def _allowed(spark, d):
    part = _t(spark, d, "part")
    brand = part.where("p_partkey % 50 = 0").select(F.upper("p_brand").alias("k"), F.col("p_brand").alias("value")).distinct()
    return relational.allowed(part.select("p_partkey", F.upper("p_brand").alias("k")), brand, "k")


@query("allowlist_join", f"WITH {_ALLOW} SELECT p_partkey, value FROM part JOIN allow ON p_brand = value")
def allowlist_join(spark, d):
    return _allowed(spark, d)[0].select("p_partkey", "value")


@query("allowlist_reject", f"WITH {_ALLOW} SELECT p_partkey FROM part WHERE p_brand NOT IN (SELECT value FROM allow)")
def allowlist_reject(spark, d):
    return _allowed(spark, d)[1].select("p_partkey")


@query("tag_validate", "SELECT p_partkey, list_sort(list_distinct([replace(p_name, ' ', ''), replace(translate(p_brand, '#', ' '), ' ', '')])) AS tags FROM part")
def tag_validate(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.array_sort(text.validate_tags(F.array("p_name", "p_brand", F.lit(" "), "p_name"))).alias("tags"))


@query("unique_names", "SELECT o_orderkey, o_custkey || '' || CASE WHEN n = 1 THEN '' ELSE '_' || lpad(n::VARCHAR, greatest(2, length(n::VARCHAR))::INTEGER, '0') END AS name FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)")
def unique_names(spark, d):
    named = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("stem"))
    return relational.unique_names(named, "stem", "o_orderkey", "name").select("o_orderkey", "name")


@query("resume_anti", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, d):
    return relational.pending(_t(spark, d, "documents").select("doc_id", "source"), _t(spark, d, "labels"), "doc_id")


@query("chunk_last_wins", "SELECT conv_id, arg_max(text, turn) AS text, count(*) AS n FROM conversations GROUP BY conv_id")
def chunk_last_wins(spark, d):
    return relational.last_wins(_t(spark, d, "conversations"), "conv_id", "turn", "text")


@query("bullet_merge", "SELECT conv_id, text, min(turn) AS turn FROM conversations c WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations o WHERE o.conv_id = c.conv_id AND o.text = c.text AND o.role != 'user') GROUP BY conv_id, text")
def bullet_merge(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return relational.new_bullets(c.where("role = 'user'").drop("role"), c.where("role != 'user'"), "conv_id", "text", "turn").select("conv_id", "text", "turn")


@query("title_match")
def title_match(spark, d):
    """The first lines of the benchmark's items against the titles of all pages."""
    drafts = _t(spark, d, "benchmark").select(F.col("item_id").alias("draft_id"), names.first_line(F.col("text")).alias("title"))
    corpus = _t(spark, d, "pages").select(F.col("page_id").alias("seq"), F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))
    return matching.match_titles(drafts, corpus)


@query("dup_paths", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n > 1")
def dup_paths(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return docs.join(first, "h").where("doc_id != first").select("doc_id")


_TITLES = ["역사 배경", "본문 (관찰)", "적용 (해석)", "주의할 점"]
_ONE_IN_FOUR = "CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_TITLES)) + " END"
_FACT_SQL = "(BC|AD|주전|주후)\\s*[0-9]|[0-9]+\\s*세기|[0-9]{3,4}\\s*년|[0-9]+([.][0-9]+)?\\s*%|[“”]"


@query(
    "coverage_gate",
    f"""WITH l AS (SELECT doc_id, {_ONE_IN_FOUR} AS section, unnest(string_split('그는 “말”했다' || chr(10) || '1885년 12.5 %' || chr(10) || 'AD 70 ✅' || chr(10) || text, chr(10))) AS raw FROM documents),
t AS (SELECT doc_id, section, regexp_replace(regexp_replace(raw, '^[\\s\\x{{00a0}}]+', ''), '[\\s\\x{{00a0}}]+$', '') AS line FROM l)
SELECT doc_id, section, line, CASE WHEN contains(section, '(관찰)') THEN 'observation' ELSE 'ungraded' END AS rule FROM t
WHERE NOT contains(section, '(해석)') AND NOT contains(section, '주의') AND regexp_matches(line, '{_FACT_SQL}') AND NOT starts_with(line, '#')
AND (contains(section, '(관찰)') OR NOT (contains(line, '✅') OR contains(line, '🟡') OR contains(line, '⚠️') OR contains(line, '❓') OR contains(line, '🚫')))""",
)
def coverage_gate(spark, d):
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("doc_id") % 4 + 1).cast("int"))
    note = F.concat(F.lit("## "), title, F.lit("\n그는 “말”했다\n1885년 12.5 %\nAD 70 ✅\n"), "text")
    return gates.uncovered_lines(_t(spark, d, "documents").select("doc_id", note.alias("note")), ["doc_id"], "note")


@query("forbidden_scan", " UNION ALL ".join(f"SELECT doc_id, '{r}' AS reason, unnest(regexp_extract_all(text, '{p}')) AS match FROM documents" for p, r in RULES))
def forbidden_scan(spark, d):
    return gates.forbidden(_t(spark, d, "documents"), ["doc_id"], "text", RULES)


_SITES = ["en.wikipedia.org", "www.jstor.org", "ox.ac.uk", "blog.example.com", "news.example.org"]
_DOMAINS = {"institutional": ["jstor.org"], "suffixes": [".ac.uk", ".edu"], "wiki": ["wikipedia.org"]}
_GRADES = [*gates.GRADES, "확실"]
_ORIGINS = [*gates.ORIGINS, "rumour"]
_CLAIM = "(kind IN ('T1', 'T2', 'T4') OR (kind IN ('T3', 'T5') AND bearing))"
_CLAIM_ROWS = f"""c AS (SELECT event_id, 'T' || (event_id % 6 + 1) AS kind, value > 50 AS bearing, [{", ".join(f"'{g}'" for g in _GRADES)}][(event_id // 2) % 6 + 1] AS grade,
  [{", ".join(f"'{o}'" for o in _ORIGINS)}][(event_id // 5) % 5 + 1] AS origin, CASE WHEN event_id % 7 = 0 THEN 'both' ELSE '' END AS both_sides, event_id % 4 AS n_evidence FROM events)"""


def _claims(spark, d):
    e = F.col("event_id")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    one = lambda k: F.struct(F.when(k % 2 == 0, pick(_SITES, e + k)).alias("domain"), F.concat(F.lit("https://"), pick(_SITES, e + k), F.lit("/x")).alias("url"), ((e + k) % 3 != 0).alias("agrees"))
    evidence = F.when(e % 4 > 0, F.transform(F.sequence(F.lit(1), (e % 4).cast("int")), one))
    columns = [F.concat(F.lit("T"), e % 6 + 1).alias("kind"), (F.col("value") > 50).alias("load_bearing"), pick(_GRADES, F.floor(e / 2)).alias("grade"), pick(_ORIGINS, F.floor(e / 5)).alias("source")]
    return _t(spark, d, "events").select("event_id", *columns, F.when(e % 7 == 0, "both").otherwise("").alias("both_sides"), evidence.alias("evidence"))


@query(
    "claims_gate",
    f"""WITH {_CLAIM_ROWS},
e AS (SELECT event_id, regexp_replace([{", ".join(f"'{x}'" for x in _SITES)}][(event_id + k) % 5 + 1], '^www[.]', '') AS site, (event_id + k) % 3 != 0 AS agrees FROM (SELECT event_id, unnest(generate_series(1, n_evidence)) AS k FROM c)),
s AS (SELECT event_id, bool_or(agrees) AS agreed, bool_or(NOT agrees) AS refuted, count(DISTINCT site) FILTER (agrees AND site NOT LIKE '%wikipedia.org') AS sites,
  count(*) FILTER (agrees AND (site = 'jstor.org' OR site LIKE '%.ac.uk')) AS inst FROM e GROUP BY event_id),
j AS (SELECT c.*, coalesce(agreed, false) AS agreed, coalesce(refuted, false) AS refuted, coalesce(sites, 0) AS sites, coalesce(inst, 0) AS inst FROM c LEFT JOIN s USING (event_id)),
i AS (SELECT kind, CASE WHEN grade = '확실' THEN ['unknown_grade'] WHEN origin = 'rumour' THEN ['unknown_source'] ELSE list_filter([
  CASE WHEN grade = '확인됨' AND origin != 'script' AND sites < 2 THEN 'few_domains' END,
  CASE WHEN grade = '확인됨' AND origin != 'script' AND inst = 0 THEN 'no_institution' END,
  CASE WHEN refuted AND NOT agreed AND grade != '사용금지' THEN 'only_refuted' END,
  CASE WHEN grade = '논쟁중' AND both_sides = '' THEN 'one_sided' END,
  CASE WHEN {_CLAIM} AND n_evidence = 0 AND grade IN ('확인됨', '개연') THEN CASE WHEN kind IN ('T1', 'T2', 'T4') THEN 'no_evidence_forbid' ELSE 'no_evidence_doubt' END END], lambda x: x IS NOT NULL) END AS issues FROM j)
SELECT issue, kind, count(*) AS n FROM (SELECT kind, unnest(issues) AS issue FROM i) GROUP BY ALL""",
)
def claims_gate(spark, d):
    c = _claims(spark, d)
    issues = gates.claim_issues(c["grade"], c["source"], c["kind"], c["load_bearing"], c["both_sides"], c["evidence"], _DOMAINS)
    return c.select("kind", F.explode(issues).alias("issue")).groupBy("issue", "kind").agg(F.count(F.lit(1)).alias("n"))


_OFFLINE = f"""WITH {_CLAIM_ROWS}, i AS (SELECT kind FROM c WHERE grade = '확인됨' AND origin NOT IN ('script', 'rumour') AND {_CLAIM} AND n_evidence = 0) SELECT kind, count(*) AS n FROM i GROUP BY kind"""


@query("claims_offline", _OFFLINE)
def claims_offline(spark, d):
    """V7 without the web: claims that may not be confirmed."""
    claims = _claims(spark, d)
    issues = gates.claim_issues(F.col("grade"), F.col("source"), F.col("kind"), F.col("load_bearing"), F.col("both_sides"), F.col("evidence"), {"institutional": [], "suffixes": [], "wiki": []}, web=False)
    return claims.where(F.array_contains(issues, "offline_confirmed")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("claims_repeated", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def claims_repeated(spark, d):
    return gates.repeated_ids(_t(spark, d, "events"), "user_id")


@query("search_budget", "SELECT conv_id, mode, searches_used, budget FROM (SELECT conv_id, ['research', 'enrich', 'diagnose', 'other'][conv_id % 4 + 1] AS mode, count(*) AS searches_used, [12, 5, 3, NULL][conv_id % 4 + 1] AS budget FROM conversations GROUP BY conv_id) WHERE searches_used > budget")
def search_budget(spark, d):
    mode = F.element_at(F.array(*map(F.lit, [*config.SEARCHES, "other"])), (F.col("conv_id") % 4 + 1).cast("int"))
    return gates.over_budget(_t(spark, d, "conversations").groupBy("conv_id", mode.alias("mode")).agg(F.count(F.lit(1)).alias("searches_used")), config.SEARCHES)


@query("claims_plan", f"WITH {_CLAIM_ROWS} SELECT event_id, kind, bearing AS load_bearing FROM c WHERE {_CLAIM} AND n_evidence = 0 ORDER BY bearing DESC, event_id::VARCHAR LIMIT 12")
def claims_plan(spark, d):
    return gates.search_plan(_claims(spark, d), config.SEARCHES["research"], "event_id")[0].select("event_id", "kind", "load_bearing")


@query("claims_skipped", f"WITH {_CLAIM_ROWS} SELECT greatest(count(*) - 12, 0)::BIGINT AS skipped_over_budget FROM c WHERE {_CLAIM} AND n_evidence = 0")
def claims_skipped(spark, d):
    return gates.search_plan(_claims(spark, d), config.SEARCHES["research"], "event_id")[1]


@query(
    "quote_verify",
    """WITH q AS (SELECT conv_id, turn, text, left(text, 12) || '…' || right(text, 9) || CASE WHEN turn % 2 = 0 THEN '...zz·' || conv_id ELSE '' END AS quote FROM conversations),
s AS (SELECT *, list_filter(list_transform(string_split_regex(quote, '…|[.]{3}'), lambda x: regexp_replace(x, '[\\s"''“”‘’·]+', '', 'g')), lambda x: x != '') AS parts, regexp_replace(text, '[\\s"''“”‘’·]+', '', 'g') AS whole FROM q)
SELECT conv_id, turn, len(list_filter(parts, lambda x: NOT contains(whole, x))) = 0 AS ok FROM s""",
)
def quote_verify(spark, d):
    """Quotations with an omission; every second one has words that its source lacks."""
    made_up = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("...zz·"), "conv_id")).otherwise("")
    quote = F.concat(F.left("text", F.lit(12)), F.lit("…"), F.right("text", F.lit(9)), made_up)
    return _t(spark, d, "conversations").select("conv_id", "turn", gates.quote_holds(quote, F.col("text")).alias("ok"))


_SQUEEZED = r"""regexp_replace(%s, '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"''“”‘’·]+', '', 'g')"""


@query("quote_sources", f"""
WITH parts AS (
  SELECT item_id, list_filter(string_split_regex(text, '…|\\.\\.\\.'), lambda s: {_SQUEEZED % "s"} != '') AS written FROM benchmark
), segments AS (SELECT item_id, pos, {_SQUEEZED % "written[pos]"} AS s FROM (SELECT *, unnest(range(1, len(written) + 1)) AS pos FROM parts)),
texts AS (SELECT doc_id, {_SQUEEZED % "text"} AS t FROM documents WHERE text IS NOT NULL),
held AS (SELECT item_id, doc_id, list(pos) AS has FROM segments JOIN texts ON contains(t, s) GROUP BY ALL),
lacks AS (SELECT item_id, doc_id, list_filter(range(1, len(written) + 1), lambda k: NOT list_contains(has, k)) AS l FROM held JOIN parts USING (item_id)),
best AS (SELECT item_id, arg_min(doc_id, (len(l), doc_id)) AS doc_id, arg_min(l, (len(l), doc_id)) AS l, count(*) FILTER (len(l) = 0) AS n FROM lacks GROUP BY item_id)
SELECT item_id, len(coalesce(l, range(1, len(written) + 1))) = 0 AS ok, coalesce(n, 0) AS n_sources, doc_id,
       array_to_string(list_transform(coalesce(l, range(1, len(written) + 1)), lambda k: trim(written[k], chr(10) || ' ')), chr(10)) AS missing
FROM parts LEFT JOIN best USING (item_id)
""")
def quote_sources(spark, d):
    found = gates.find_quotes(_t(spark, d, "benchmark").select("item_id", "text"), _t(spark, d, "documents").select("doc_id", "text"), "item_id", "doc_id")
    return found.withColumn("missing", F.array_join("missing_segments", "\n")).drop("missing_segments")


_HOST = "regexp_replace(lower(regexp_extract(url, '://([^/?#]+)', 1)), '^www[.]', '')"


@query("domain_class", f"SELECT {_HOST} AS domain, {_HOST} LIKE '%.example.com' OR {_HOST} LIKE '%.example.org' AS known, count(*) AS n FROM pages GROUP BY ALL")
def domain_class(spark, d):
    domain = text.domain_of(F.col("url"))
    return _t(spark, d, "pages").groupBy(domain.alias("domain")).agg(F.count(F.lit(1)).alias("n")).withColumn("known", text.in_domains(F.col("domain"), DONE))


@query("domain_kinds", f"SELECT DISTINCT {_HOST} AS domain, concat_ws(',', CASE WHEN {_HOST} LIKE '%_.org' OR {_HOST} = 'example.net' OR {_HOST} LIKE '%.example.net' THEN 'institutional' END, CASE WHEN {_HOST} = 'example.com' OR {_HOST} LIKE '%.example.com' THEN 'wiki' END) AS kinds FROM pages WHERE url IS NOT NULL")
def domain_kinds(spark, d):
    """Hosts of all pages against a table of domains."""
    table = spark.createDataFrame([("institutional", "org", True), ("institutional", "example.net", False), ("wiki", "example.com", False)], "kind string, pattern string, below boolean")
    found = gates.domain_kinds(_t(spark, d, "pages").where("url IS NOT NULL").select(text.domain_of(F.col("url")).alias("domain")), "domain", table)
    return found.select("domain", F.array_join("kinds", ",").alias("kinds"))


_FOLDERS = ["2. 대 예배", "새벽", "misc"]


@query("folder_kinds", "SELECT DISTINCT * FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN '대 예배' WHEN 1 THEN '새벽' END AS name, CASE o_orderkey % 3 WHEN 0 THEN '주일대예배' WHEN 1 THEN '새벽기도회' END AS kind FROM orders) WHERE kind IS NOT NULL")
def folder_kinds(spark, d):
    folder = F.element_at(F.array(*map(F.lit, _FOLDERS)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return discovery.folder_kinds(_t(spark, d, "orders").select(F.concat_ws("/", F.lit("/v"), folder, "o_orderstatus", F.concat(F.col("o_orderkey").cast("string"), F.lit(".md"))).alias("path")))


@query("plan_summary", "SELECT lang AS kind, CASE WHEN l.doc_id IS NULL THEN 'create' WHEN quality = 1 THEN 'skip' WHEN toxic = 0 THEN 'merge' ELSE 'conflict' END AS action, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL")
def plan_summary(spark, d):
    met = _t(spark, d, "documents").select("doc_id", F.col("lang").alias("kind")).join(_t(spark, d, "labels"), "doc_id", "left")
    return notes.summarize(met.withColumn("action", notes.action(F.col("quality").isNotNull(), F.col("quality") == 1, F.col("toxic") == 0)))


@query("folder_rank", "SELECT source AS folder, count(*) AS docs, (2 + least(count(*), 20) // 4)::BIGINT AS score FROM documents GROUP BY 1 HAVING count(*) >= 5 ORDER BY score DESC, docs DESC, folder LIMIT 10")
def folder_rank(spark, d):
    folders = _t(spark, d, "documents").groupBy(F.col("source").alias("folder")).agg(F.count(F.lit(1)).alias("docs")).where("docs >= 5")
    return relational.top(folders.withColumn("score", 2 + F.expr("least(docs, 20) div 4")), [F.desc("score"), F.desc("docs"), "folder"], 10)


@query("marker_decide", "SELECT role AS token, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) >= 2 OR length(role) = 1")
def marker_decide(spark, d):
    seen = _t(spark, d, "conversations").groupBy(F.col("role").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("marker"))
    return discovery.decide_markers(seen, []).select("token", "n")


@query("weakness_trend", "WITH s AS (SELECT user_id, event_type AS dim, date_trunc('day', ts) AS day, min(value) AS score FROM events GROUP BY ALL) SELECT user_id, dim, strftime(day, '%Y-%m-%d') AS day, score <= 40 AND coalesce(lag(score) OVER (PARTITION BY user_id, dim ORDER BY day) <= 40, false) AS repeated FROM s")
def weakness_trend(spark, d):
    days = _t(spark, d, "events").groupBy("user_id", F.col("event_type").alias("dim"), F.date_trunc("day", "ts").alias("day")).agg(F.min("value").alias("score"))
    before = F.lag("score").over(Window.partitionBy("user_id", "dim").orderBy("day"))
    return days.select("user_id", "dim", F.date_format("day", "yyyy-MM-dd").alias("day"), ((F.col("score") <= 40) & F.coalesce(before <= 40, F.lit(False))).alias("repeated"))


@query(
    "weakness_rules",
    """WITH s AS (SELECT user_id, event_type AS dim, date_trunc('day', ts) AS day, min(value) AS score FROM events GROUP BY ALL),
w AS (SELECT *, (score <= 40 OR (min(score) OVER d > 40 AND row_number() OVER (d ORDER BY score, dim) = 1)) AS weak, dense_rank() OVER (PARTITION BY user_id ORDER BY day) AS nth FROM s WINDOW d AS (PARTITION BY user_id, day))
SELECT user_id, dim, strftime(day, '%Y-%m-%d') AS day, EXISTS (SELECT 1 FROM w b WHERE b.user_id = w.user_id AND b.dim = w.dim AND b.weak AND b.nth BETWEEN w.nth - 3 AND w.nth - 1) AS repeated FROM w WHERE weak""",
)
def weakness_rules(spark, d):
    """The weak dimensions of each user-day, and whether any of the user's last three days had the same one."""
    scores = _t(spark, d, "events").groupBy("user_id", F.col("event_type").alias("dim"), F.date_trunc("day", "ts").alias("day")).agg(F.min("value").alias("score"))
    found = audit.recurring(audit.weaknesses(scores, "user_id", "day", "dim", "score", 40), "user_id", "dim")
    return found.select("user_id", "dim", F.date_format("day", "yyyy-MM-dd").alias("day"), "repeated")


_STEM = "strftime(o_orderdate, '%y%m%d') || CASE WHEN o_orderkey % 2 = 0 THEN '_대_' ELSE '_' END || o_orderpriority"


def _stems(spark, d):
    marker = F.when(F.col("o_orderkey") % 2 == 0, "_대_").otherwise("_")
    return _t(spark, d, "orders").select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyMMdd"), marker, "o_orderpriority").alias("stem"))


@query("filename_parse", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 2 = 0 THEN '대' ELSE '' END AS target, o_orderpriority AS title FROM orders")
def filename_parse(spark, d):
    return _stems(spark, d).select("o_orderkey", names.parse_filename(F.col("stem"), ["대", "청"]).alias("n")).select("o_orderkey", "n.date", "n.target", "n.title")


@query("naming_scan", "SELECT 'date' AS what, 'shape_0' AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'marker', '대', count(*) FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL UNION ALL SELECT 'marker', left(o_orderpriority, 1), count(*) FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL")
def naming_scan(spark, d):
    return discovery.naming(_stems(spark, d).select(F.concat("stem", F.lit(".md")).alias("name")))


@query("kind_of", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '주일대예배' WHEN 1 THEN '새벽기도회' WHEN 2 THEN '성경공부' ELSE '' END AS kind FROM orders")
def kind_of(spark, d):
    k = F.col("o_orderkey") % 4
    word = F.when(k == 0, "대 예배").when(k == 1, "새벽").when(k == 2, "세미나").otherwise("none")
    return _t(spark, d, "orders").select("o_orderkey", names.kind_of(F.concat("o_orderpriority", F.lit(" "), word)).alias("kind"))


@query("title_style", "SELECT p_partkey, concat_ws(',', CASE WHEN length(p_name) NOT BETWEEN 10 AND 20 THEN 'length' END, 'no_claim') AS issues FROM part")
def title_style(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.array_join(names.title_issues(F.col("p_name"), F.lit("argument")), ",").alias("issues"))


@query("ref_forms", "SELECT l_orderkey, l_linenumber, l_partkey, sum(1)::BIGINT AS n, CASE l_linenumber % 3 WHEN 0 THEN '요' || l_partkey || '_' || l_linenumber WHEN 1 THEN '시' || l_partkey || '_' || l_linenumber ELSE '' END AS normalized, CASE WHEN l_linenumber % 3 = 2 THEN 'no_verse' ELSE '' END AS note FROM lineitem GROUP BY ALL")
def ref_forms(spark, d):
    chapter, verse = F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")
    written = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("요한복음 "), chapter, F.lit("장 "), verse, F.lit("절"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("시 "), chapter, F.lit("편 "), verse)).otherwise(F.concat(F.lit("시편 "), chapter, F.lit("편")))
    lines = _t(spark, d, "lineitem").select(F.monotonically_increasing_id().alias("id"), "l_orderkey", "l_linenumber", "l_partkey", written.alias("t"))
    found = refs.expand(lines, "t", ["요한복음", "요", "시편", "시"], ["id", "l_orderkey", "l_linenumber", "l_partkey"], aliases={"요한복음": "요", "시편": "시"})
    return found.groupBy("l_orderkey", "l_linenumber", "l_partkey", "normalized", "note").agg(F.count(F.lit(1)).alias("n"))


_BODIES = "x AS (SELECT p_partkey, p_name, p_brand, trim(repeat(p_type || ' ', p_size % 15)) AS one, trim(repeat(p_name || ' ', (p_partkey % 8)::INTEGER)) AS two FROM part)"


def _two_sections(spark, d):
    one, two = F.expr("repeat(p_type || ' ', p_size % 15)"), F.expr("repeat(p_name || ' ', cast(p_partkey % 8 as int))")
    return _t(spark, d, "part").select("p_partkey", F.concat(F.lit("# "), "p_name", F.lit("\n"), one, F.lit("\n## "), "p_brand", F.lit("\n"), two).alias("t"))


@query("fragment_split", f"WITH {_BODIES} SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY k) - 1)::INTEGER AS pos, title, body AS bullet FROM (SELECT p_partkey, 1 AS k, p_name AS title, one AS body FROM x UNION ALL SELECT p_partkey, 2, replace(p_brand, '#', ' '), two FROM x) WHERE length(body) >= 80")
def fragment_split(spark, d):
    parts = F.filter(markdown.fragments(F.col("t"), F.lit("id")), lambda f: f["kind"] == "section")
    return _two_sections(spark, d).select("p_partkey", F.posexplode(parts).alias("pos", "f")).select("p_partkey", "pos", "f.title", F.array_join("f.bullets", " ").alias("bullet"))


@query("section_split", f"WITH {_BODIES} SELECT p_partkey, p_brand AS title, two AS body FROM x")
def section_split(spark, d):
    return _two_sections(spark, d).select("p_partkey", F.explode(markdown.sections(F.col("t"), 2)).alias("s")).select("p_partkey", "s.title", F.btrim("s.body", F.lit(" \n")).alias("body"))


@query("frontmatter_read", "SELECT c_custkey, c_name AS name, c_mktsegment || ',' || c_nationkey AS tags, 'name,tags,none,since' AS keys, true AS is_scalar FROM customer")
def frontmatter_read(spark, d):
    fields = {"name": F.col("c_name"), "tags": F.array("c_mktsegment", F.col("c_nationkey").cast("string")), "none": F.array().cast("array<string>"), "since": F.lit("2026-01-01")}
    written = _t(spark, d, "customer").select("c_custkey", markdown.frontmatter(fields, {"tags", "none"}).alias("note"))
    read = written.withColumn("f", markdown.read_frontmatter(F.col("note")))
    return read.select("c_custkey", F.expr("f['name'].values[0]").alias("name"), F.array_join(F.expr("f['tags'].values"), ",").alias("tags"), F.array_join(markdown.frontmatter_keys(F.col("note")), ",").alias("keys"), F.expr("f['name'].scalar AND NOT f['tags'].scalar AND size(f['none'].values) = 0").alias("is_scalar"))


@query("note_merge", "SELECT p_partkey, '---' || chr(10) || 'k: v' || chr(10) || '---' || chr(10) || chr(10) || '- ' || p_name || chr(10) || '- ' || p_type || chr(10) || '- ' || p_brand || chr(10) || chr(10) || '원본 설교: [[m]]' || chr(10) AS content, 1 AS added, 2 AS duplicates, 2 AS existing FROM part")
def note_merge(spark, d):
    old = F.concat(F.lit("---\nk: v\n---\n- "), "p_name", F.lit("\n* "), "p_type", F.lit("\n"))
    merged = render.merge(F.col("old"), F.array("p_type", "p_brand", "p_brand"), F.lit("m.md"))
    return _t(spark, d, "part").withColumn("old", old).select("p_partkey", merged.alias("m")).select("p_partkey", "m.*")


@query("grade_count", "SELECT doc_id, '✅' || (doc_id % 3) || ' 🟡0 ⚠️' || (doc_id % 2) || ' ❓0 🚫0' AS grades FROM documents")
def grade_count(spark, d):
    note = F.expr("'---\\na: ✅\\n---\\n' || repeat('✅ x', cast(doc_id % 3 as int)) || repeat('⚠️', cast(doc_id % 2 as int)) || '\\n## 검증 요약\\n✅\\n'")
    body = markdown.body_without(F.col("note"), "검증 요약")
    return _t(spark, d, "documents").select("doc_id", note.alias("note")).select("doc_id", markdown.grade_summary(markdown.grade_counts(body)).alias("grades"))


def _order_notes(spark, d):
    note = markdown.frontmatter({"world": F.array("o_orderpriority"), "tags": F.array("o_orderpriority", "o_orderstatus")}, {"world", "tags"})
    body = F.concat(note, F.lit("## [["), "o_custkey", F.lit("]]\n- [[other]]\n\n# 원본 설교문\n## [[kept]]\n"))
    action = F.when(F.col("o_orderkey") % 2 == 0, "merge").otherwise("create")
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.lit("main").alias("kind"), action.alias("action"), body.alias("content"))
    return audit.fields(rows)


@query("note_links", "SELECT o_orderkey::VARCHAR AS path, o_custkey::VARCHAR AS detail FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey < 12)")
def note_links(spark, d):
    known = _t(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").cast("string").alias("name"))
    return audit.unresolved(_order_notes(spark, d), known).select("path", "detail")


@query("note_audit", "SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 2 = 0 THEN 'warning' ELSE 'issue' END AS severity, unnest(list_filter([CASE WHEN o_orderpriority NOT IN ('1-URGENT', '5-LOW') THEN 'not_listed_world' END, CASE WHEN contains(o_orderpriority, ' ') THEN 'tag_space' END, CASE WHEN NOT starts_with(o_orderpriority, '1') THEN 'no_prefix_world' END], lambda x: x IS NOT NULL)) AS rule FROM orders")
def note_audit(spark, d):
    read = _order_notes(spark, d)
    found = audit.classification(read, {"world": ["1-URGENT", "5-LOW"], "route": []}).unionByName(audit.tags(read)).unionByName(audit.shape(read, {"world": ["1"]}))
    return audit.routed(found).select("path", "severity", "rule")


@query("log_repeats", "SELECT user_id::VARCHAR AS path, n::VARCHAR AS detail FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n > 1")
def log_repeats(spark, d):
    return audit.repeated(_t(spark, d, "events").select(F.col("user_id").cast("string").alias("path"))).select("path", "detail")


@query("folder_stats", "SELECT '/v/' || o_orderpriority AS folder, count(*) AS documents, count(*) FILTER (o_orderkey % 3 = 0) AS readable, strftime(max(o_orderdate), '%Y-%m-%d') AS latest FROM orders GROUP BY ALL")
def folder_stats(spark, d):
    suffix = F.when(F.col("o_orderkey") % 3 == 0, ".md").otherwise(".pdf")
    name = F.concat("o_orderkey", suffix)
    files = _t(spark, d, "orders").select(F.concat(F.lit("/v/"), "o_orderpriority", F.lit("/"), name).alias("path"), name.alias("name"), suffix.alias("suffix"), F.col("o_orderdate").alias("mtime"))
    return discovery.folders(files, [".md"]).select("folder", "documents", "readable", F.date_format("latest_modified", "yyyy-MM-dd").alias("latest"))


@query("note_plan", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'conflict' ELSE 'create' END AS action, 'main' AS kind, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL UNION ALL SELECT 'create', 'fragment', count(*) FROM documents WHERE trim(text) != '' GROUP BY ALL")
def note_plan(spark, d):
    docs = _t(spark, d, "documents")
    path = F.concat(F.lit("/x/"), "doc_id", F.lit(".md"))
    meta = importing.metadata(docs.select(path.alias("path"), "text"), config.merged({}), BOOKS)
    vault = docs.where("doc_id % 3 = 0").select(F.concat("doc_id", F.lit(".md")).alias("path"), F.lit("x").alias("content"))
    return notes.summarize(importing.plan(meta, vault, config.merged({})).where("action != 'failed'"))


_LAB = """x AS (SELECT p_partkey, p_size, p_name, '## 하나' || chr(10) || '요 ' || p_size || ':1-2, 1 그리고 시 2:9-3 ✅ ' || p_name || ' ⚠️' AS body FROM part)"""
_LAB_NOTE = """'---' || chr(10) || 'created: "2026-01-02T03:04"' || chr(10) || 'modified: "2026-01-02T03:04"' || chr(10) || 'note_type: "연구노트"' || chr(10) || 'skill: "notemill"' || chr(10)
|| 'title: "' || p_name || '"' || chr(10) || 'date: "2026-01-02"' || chr(10) || '검증상태: "미기재"' || chr(10) || '검증등급: "✅1 🟡0 ⚠️1 ❓0 🚫0"' || chr(10) || 'tags:' || chr(10) || '  - "' || replace(p_name, ' ', '') || '"' || chr(10)
|| '성경구절:' || chr(10) || '  - "[[요' || p_size || '_1]]"' || chr(10) || '  - "[[요' || p_size || '_2]]"' || chr(10) || '---' || chr(10) || chr(10) || '# 연구: ' || p_name || chr(10) || chr(10) || body || chr(10) || chr(10)
|| '## 확인 필요한 성경구절' || chr(10) || '- 시 2:9-3  — 역방향 범위' || chr(10) || chr(10) || '## 검증 요약' || chr(10) || chr(10) || '- ✅1 🟡0 ⚠️1 ❓0 🚫0 · 검색 ' || p_size || '회 사용' || chr(10)"""


@query(
    "lab_plan",
    f"""WITH {_LAB} SELECT p_partkey, '연구/2026-01-02_연구_' || p_name || ' ' || p_partkey || '.md' AS path, CASE WHEN p_size % 5 = 0 THEN 'invalid' WHEN p_partkey % 3 = 0 THEN 'conflict' ELSE 'create' END AS action,
CASE WHEN p_size % 5 = 0 THEN 'body_empty' ELSE '' END AS problems, CASE WHEN p_size % 5 = 0 THEN NULL ELSE {_LAB_NOTE} END AS content, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 2 END AS links FROM x""",
)
def lab_plan(spark, d):
    """M7, K3: parts as results of a study; every fifth size has no body, every third note exists."""
    body = F.concat(F.lit("## 하나\n요 "), "p_size", F.lit(":1-2, 1 그리고 시 2:9-3 ✅ "), "p_name", F.lit(" ⚠️ \n"))
    part = _t(spark, d, "part")
    results = part.select("p_partkey", F.col("p_name").alias("title"), F.concat_ws(" ", "p_name", "p_partkey").alias("topic"), F.when(F.col("p_size") % 5 == 0, F.lit(" ")).otherwise(body).alias("body"), F.array("p_name").alias("tags"), F.col("p_size").alias("search_count"))
    there = part.where("p_partkey % 3 = 0").select(F.concat(F.lit("연구/2026-01-02_연구_"), "p_name", F.lit(" "), "p_partkey", F.lit(".md")).alias("path"))
    planned = lab.plan(results, "research", there, "연구", BOOKS, now="2026-01-02T03:04")
    return planned.select("p_partkey", "path", "action", F.array_join("problems", ",").alias("problems"), "content", F.size("bible_links").alias("links"))


_SUBSET = "v AS (SELECT p_partkey // 20 AS note, 'world' AS axis, p_brand AS grp, p_name || ' ' || p_partkey AS value, (p_partkey % 20)::INTEGER AS ord FROM part)"


@query(
    "taxonomy_subset",
    f"""WITH {_SUBSET}, c AS (SELECT *, contains(lower(value), 'bolt') AS piece, contains(lower(grp), '#1') OR contains(lower(value), 'cold') AS hit FROM v),
f AS (SELECT note, min(ord) AS first FROM c WHERE piece GROUP BY note)
SELECT note, axis, value, CASE WHEN ord = first THEN 'fragment' ELSE 'sermon' END AS role FROM c LEFT JOIN f USING (note) WHERE ord = first OR hit""",
)
def taxonomy_subset(spark, d):
    """P10 with other words: values of a group, or with a name, that holds one; the first value for fragments."""
    values = _t(spark, d, "part").select(F.expr("p_partkey div 20").alias("note"), F.lit("world").alias("axis"), F.col("p_brand").alias("grp"), F.concat_ws(" ", "p_name", "p_partkey").alias("value"), F.expr("cast(p_partkey % 20 as int)").alias("ord"))
    return rules.subset(values, ["note"], sermon=["#1", "COLD"], fragment=["Bolt"])


@query(
    "grade_by_evidence",
    """SELECT event_id, CASE WHEN value > 90 THEN '사용금지' WHEN event_id % 10 = 0 THEN '논쟁중' WHEN event_id % 4 >= 2 AND value > 40 THEN '확인됨' WHEN event_id % 4 > 0 THEN '개연'
WHEN user_id % 2 = 0 THEN CASE WHEN event_type = 'click' THEN '사용금지' ELSE '불확실' END ELSE CASE WHEN event_id % 8 = 0 THEN '개연' ELSE '불확실' END END AS grade FROM events""",
)
def grade_by_evidence(spark, d):
    """Events as claims; the id gives the agreeing domains, even users' claims are searched."""
    declared = F.when(F.col("event_id") % 8 == 0, "확인됨").otherwise("불확실")
    agreeing = F.col("event_id") % 4
    return _t(spark, d, "events").select("event_id", rules.grade_by_evidence(declared, agreeing, F.col("value") > 40, F.col("value") > 90, F.col("event_id") % 10 == 0, (F.col("user_id") % 2 == 0) | (agreeing > 0), F.col("event_type") == "click").alias("grade"))


def _files(spark, d):
    """Files made of orders: three folders deep, with names of every sort."""
    k = F.col("o_orderkey")
    name = F.concat(F.element_at(F.array(*map(F.lit, ["~$", "._", ".", "a", "b", "c"])), (k % 6 + 1).cast("int")), k.cast("string"))
    suffix = F.element_at(F.array(*map(F.lit, [".md", ".pdf", ".gdoc", ".xyz"])), (k % 4 + 1).cast("int"))
    path = F.concat_ws("/", F.lit("/v"), "o_orderpriority", F.element_at(F.array(*map(F.lit, ["docs", ".git", "~tmp", "venv", "notes"])), (k % 5 + 1).cast("int")), F.concat(name, suffix))
    return _t(spark, d, "orders").select("o_orderkey", path.alias("path"), F.concat(name, suffix).alias("name"), suffix.alias("suffix"), F.when(k % 11 > 0, k % 10).alias("size"), F.col("o_orderdate").cast("timestamp").alias("mtime"))


_NAMED = "['~$', '._', '.', 'a', 'b', 'c'][o_orderkey % 6 + 1] || o_orderkey || ['.md', '.pdf', '.gdoc', '.xyz'][o_orderkey % 4 + 1]"
_FILES = f"""files AS (SELECT *, '/v/' || o_orderpriority || '/' || leaf || '/' || name AS path FROM (SELECT o_orderkey, o_orderpriority, o_orderdate AS mtime, {_NAMED} AS name, ['.md', '.pdf', '.gdoc', '.xyz'][o_orderkey % 4 + 1] AS suffix,
  ['docs', '.git', '~tmp', 'venv', 'notes'][o_orderkey % 5 + 1] AS leaf, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 10 END AS size FROM orders))"""
_REASON = """CASE WHEN name LIKE '~$%' THEN 'lock_file' WHEN name LIKE '.\\_%' ESCAPE '\\' THEN 'mac_metadata' WHEN name LIKE '.%' THEN 'hidden' WHEN suffix = '.gdoc' THEN 'google_stub'
  WHEN size = 0 THEN 'empty_or_cloud_placeholder' WHEN size IS NULL THEN 'unreadable' END"""


@query("skip_reasons", f"WITH {_FILES} SELECT o_orderkey, coalesce({_REASON}, CASE WHEN suffix NOT IN ('.md', '.pdf') THEN 'unsupported' END) AS reason FROM files")
def skip_reasons(spark, d):
    """S2, S4, S5."""
    return listing.scan(_files(spark, d), [".md", ".pdf"]).select("o_orderkey", "reason")


@query("first_files", f"WITH {_FILES} SELECT path FROM files WHERE suffix = '.md' AND {_REASON} IS NULL ORDER BY path LIMIT 50")
def first_files(spark, d):
    """S1, S6."""
    return discovery.sample(_files(spark, d), [".md"], 50).select("path")


@query("undeclared_types", f"WITH {_FILES} SELECT suffix, count(*) AS n FROM files WHERE suffix != '.md' GROUP BY suffix")
def undeclared_types(spark, d):
    """S3, A2."""
    return discovery.undeclared(_files(spark, d), discovery.suffixes(["MD"]))


@query("visible_files", f"WITH {_FILES} SELECT o_orderkey FROM files WHERE leaf IN ('docs', 'notes')")
def visible_files(spark, d):
    """S8."""
    return _files(spark, d).where(discovery.visible(F.col("path"), ["venv"])).select("o_orderkey")


@query(
    "folder_candidates",
    f"""WITH {_FILES}, f AS (SELECT folder, count(*) FILTER (suffix = '.md') AS notes FROM (SELECT suffix, unnest([o_orderpriority || '/' || leaf]) AS folder FROM files WHERE leaf NOT IN ('.git', '~tmp')) GROUP BY folder),
s AS (SELECT *, split_part(folder, '/', 2) AS leaf, 3 * (contains(lower(folder), 'urgent')::INTEGER + contains(lower(folder), 'notes')::INTEGER) AS s1 FROM f)
SELECT folder, notes, (s1 + 2 * contains(leaf, 'notes')::INTEGER - 4 * contains(leaf, 'venv')::INTEGER)::INTEGER AS score FROM s WHERE s1 + 2 * contains(leaf, 'notes')::INTEGER > 0 ORDER BY score DESC, notes DESC, folder LIMIT 6""",
)
def folder_candidates(spark, d):
    """S15, S16, S17."""
    return discovery.candidates(discovery.note_folders(_files(spark, d), "/v", []), ["urgent", "notes"], 6, ["venv"])


@query("capped_notes", f"WITH {_FILES} SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY o_orderpriority, leaf ORDER BY path) AS n FROM files) WHERE n <= 20")
def capped_notes(spark, d):
    """S20."""
    return discovery.capped(_files(spark, d), 20).select("path")


@query("note_titles", f"WITH {_FILES} SELECT regexp_replace(name, '[.][^.]*$', '') AS title, path, (SELECT count(*) FROM files) > 200 AS truncated FROM files ORDER BY name, path LIMIT 200")
def note_titles(spark, d):
    """S24, W7."""
    return discovery.titles(_files(spark, d), 200)


@query("by_priority", "SELECT path, min(p)::INTEGER AS priority FROM (SELECT doc_id AS path, 0 AS p FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 1 FROM labels UNION ALL SELECT doc_id, 2 FROM documents) GROUP BY path")
def by_priority(spark, d):
    """S23."""
    labels = _t(spark, d, "labels").select(F.col("doc_id").alias("path"), "quality")
    return discovery.by_priority(labels.where("quality = 0"), labels, _t(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit(None).cast("int").alias("quality"))).select("path", "priority")


@query("chunk_titles", "SELECT DISTINCT role || ' ' || turn % 5 AS title FROM conversations")
def chunk_titles(spark, d):
    """S25."""
    title = F.concat(F.lit(" "), "role", F.lit(" "), (F.col("turn") % 5).cast("string"))
    fragment = F.struct(title.alias("title"), F.array(F.col("text")).alias("bullets"))
    return discovery.chunk_titles(_t(spark, d, "conversations").select(F.to_json(F.create_map(F.col("conv_id").cast("string"), F.array(fragment))).alias("content")))


@query("draft_list", "SELECT '000000000000_' || lpad(min(p_partkey)::VARCHAR, 12, '0') || '_000000000000' AS draft_id, p_name AS title FROM part GROUP BY p_name")
def draft_list(spark, d):
    """S26."""
    return relational.load_drafts(_t(spark, d, "part").select(F.concat(F.lit(" "), "p_name", F.lit("\n")).alias("title"), F.col("p_partkey").alias("ord")))


@query("done_before", "SELECT DISTINCT o_custkey::VARCHAR AS path FROM orders WHERE o_orderkey % 3 != 0")
def done_before(spark, d):
    """S28, J3."""
    action = F.when(F.col("o_orderkey") % 3 == 0, "skip_conflict").otherwise("create")
    return importing.done_before(_t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("source"), F.lit("").alias("sermon_id"), action.alias("action")))[0]


@query("axis_links", "SELECT conv_id, turn, (conv_id % 3)::INTEGER AS a, (turn % 2)::INTEGER AS b FROM conversations WHERE conv_id % 3 > 0 AND turn % 2 > 0")
def axis_links(spark, d):
    """A10, S21."""
    note = F.concat(F.coalesce("text", F.lit("")), F.repeat(F.lit(" [[🏷 a x]]"), (F.col("conv_id") % 3).cast("int")), F.repeat(F.lit("\n- [[b: y|z]]"), (F.col("turn") % 2).cast("int")))
    notes_ = _t(spark, d, "conversations").select("conv_id", "turn", note.alias("content"), F.lit(1).alias("size"))
    return discovery.taxonomy_notes(notes_, {"a": "🏷️ a", "b": "b:"}).select("conv_id", "turn", "axes.a", "axes.b")


@query("folder_targets", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'x' WHEN o_orderpriority = '5-LOW' THEN 'y' ELSE '' END AS target FROM orders")
def folder_targets(spark, d):
    """T10, T34."""
    folders = F.array(F.concat(F.lit("3. "), "o_orderstatus"), "o_orderpriority", F.lit("F"))
    return _t(spark, d, "orders").select("o_orderkey", names.folder_target(folders, {"F": "x", "5-LOW": "y"}).alias("target"))


@query("declared_kinds", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '대예배' WHEN o_orderstatus = 'F' THEN '새벽' WHEN o_orderpriority = '5-LOW' THEN '대예배' ELSE '' END AS kind FROM orders")
def declared_kinds(spark, d):
    """By marker, by folder, within the stem."""
    target = F.when(F.col("o_orderkey") % 5 == 0, "대").otherwise("")
    folders = F.array(F.lit("x"), F.when(F.col("o_orderstatus") == "F", "12. 새벽").otherwise("y"))
    stem = F.concat(F.lit("a "), F.when(F.col("o_orderpriority") == "5-LOW", "대예배").otherwise("b"))
    return _t(spark, d, "orders").select("o_orderkey", names.declared_kind(target, folders, stem, ["새벽", "대예배"], {"대": "대예배"}).alias("kind"))


@query("first_lines", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'untitled' ELSE p_name END AS title FROM part")
def first_lines(spark, d):
    """T12."""
    text_ = F.when(F.col("p_partkey") % 4 == 0, "\nnot this").otherwise(F.concat(F.lit("##  "), "p_name", F.lit(" .\r\nmore")))
    return _t(spark, d, "part").select("p_partkey", names.first_line(text_).alias("title"))


@query("link_values", "SELECT p_partkey, 'a ' || p_name || ';a z' AS of_axis, '[[' || p_name || ']]' AS wrapped, p_name || ';t' AS items FROM part")
def link_values(spark, d):
    """T28, T33, X6."""
    note = F.concat(F.lit("[[a "), "p_name", F.lit("]] [[b q]] [[a z|shown]] [[a "), "p_name", F.lit("]]"))
    listed = F.concat(F.lit("- "), "p_name", F.lit(" \n  * [[t|u]]\n1. no"))
    return _t(spark, d, "part").select("p_partkey", F.array_join(F.concat(md_prefixed(note), F.array(F.lit("a z"))), ";").alias("of_axis"), F.element_at(markdown.decorate(F.array("p_name", F.lit(" ")), True), 1).alias("wrapped"), F.array_join(markdown.list_items(listed), ";").alias("items"))


def md_prefixed(note):
    return markdown.prefixed_values(note, "a ")


@query(
    "injection_lookup",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 6 != 0 THEN 'by path' WHEN doc_id % 2 = 0 THEN 'by name' END AS found FROM documents",
)
def injection_lookup(spark, d):
    """By path, an empty list counting as none, then by name."""
    docs = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("/x/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    by_path = docs.where("doc_id % 3 = 0").select(F.col("path").alias("source"), F.when(F.col("doc_id") % 6 != 0, F.array(F.lit("by path"))).otherwise(F.array().cast("array<string>")).alias("value"))
    by_name = docs.where("doc_id % 2 = 0").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("source"), F.array(F.lit("by name")).alias("value"))
    return importing.looked_up(docs, by_path.unionByName(by_name), "value").select("doc_id", F.get("value", F.lit(0)).alias("found"))


@query("axis_values", "SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'de' END AS kept, concat_ws(';', CASE WHEN lang NOT IN ('en', 'de') THEN lang END, source) AS rejected FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def axis_values(spark, d):
    """P7, J1 on arrays, with a value for those that have none."""
    kept, rejected = importing.axis_values(F.array(F.concat(F.lit("[["), "lang", F.lit("]]")), "source", F.lit(" ")), ["en", "de"], F.lit("de"))
    return _t(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select("doc_id", F.array_join(kept, ";").alias("kept"), F.array_join(rejected, ";").alias("rejected"))


@query("kind_folders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'all' END AS folder FROM orders")
def kind_folders(spark, d):
    """P9, T16."""
    return _t(spark, d, "orders").select("o_orderkey", importing.folder_for(F.col("o_orderstatus"), {"F": "done", "P": ""}, "all").alias("folder"))


@query("plan_by_kind", "SELECT coalesce(nullif(CASE WHEN doc_id % 4 > 0 THEN lang ELSE ' ' END, ' '), '(구분 없음)') AS kind, count(*) AS n FROM documents GROUP BY 1")
def plan_by_kind(spark, d):
    """A7."""
    return rules.by_kind(_t(spark, d, "documents").select(F.when(F.col("doc_id") % 4 > 0, F.col("lang")).otherwise(" ").alias("kind")), "kind")


@query("list_issues", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 5 NOT BETWEEN 1 AND 3 THEN 'doctrine_count' END, CASE WHEN o_orderkey % 10 NOT BETWEEN 3 AND 8 THEN 'tag_count' END, CASE WHEN o_orderkey % 10 > 6 THEN 'general_tag' END) AS issues FROM orders")
def list_issues(spark, d):
    """R3."""
    upto = lambda n: F.transform(F.slice(F.sequence(F.lit(1), F.lit(10)), 1, (F.col("o_orderkey") % n).cast("int")), lambda k: F.concat(F.lit("t"), k.cast("string")))
    return _t(spark, d, "orders").select("o_orderkey", F.array_join(rules.list_issues(upto(5), upto(10), ["t7"]), ",").alias("issues"))


@query("section_quotas", "SELECT o_custkey AS doc, t.title, count(*) FILTER (o_orderstatus = t.title) AS n FROM orders, (VALUES ('F', 2, 6), ('P', 0, 1)) t(title, least, most) GROUP BY o_custkey, t.title, least, most HAVING count(*) FILTER (o_orderstatus = t.title) NOT BETWEEN least AND most")
def section_quotas(spark, d):
    """R7."""
    quotas = spark.createDataFrame([("F", 2, 6), ("P", 0, 1)], "title string, least int, most int")
    return rules.section_issues(_t(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderstatus").alias("title")), quotas).select("doc", "title", "n")


@query("field_lengths", "SELECT p_partkey, concat_ws(',', CASE WHEN length(p_name) NOT BETWEEN 9 AND 10 THEN 'p_name' END, CASE WHEN length(p_type) NOT BETWEEN 6 AND 7 THEN 'p_type' END) AS issues FROM part")
def field_lengths(spark, d):
    """Q2, R8."""
    return _t(spark, d, "part").select("p_partkey", F.array_join(audit.length_issues({"p_name": (9, 10), "p_type": (6, 7)}), ",").alias("issues"))


@query("bullet_issues", "SELECT p_partkey, concat_ws(',', CASE WHEN n NOT BETWEEN 3 AND 6 THEN 'count' END, CASE WHEN n > 0 AND length(p_name) + 4 < 15 THEN 'length' END, CASE WHEN n NOT BETWEEN 1 AND 3 THEN 'bold' END) AS issues FROM (SELECT *, p_partkey % 8 AS n FROM part)")
def bullet_issues(spark, d):
    """R2."""
    bullets = F.slice(F.array_repeat(F.concat(F.lit("**"), "p_name", F.lit("**")), 8), 1, (F.col("p_partkey") % 8).cast("int"))
    return _t(spark, d, "part").select("p_partkey", F.array_join(audit.bullet_issues(bullets), ",").alias("issues"))


@query("score_issues", "SELECT event_id, concat_ws(',', CASE WHEN value NOT BETWEEN 1 AND 5 THEN 'a' END, 'b', CASE WHEN event_type != 'a' THEN event_type END) AS issues FROM (SELECT event_id, event_type, floor(value) AS value FROM events)")
def score_issues(spark, d):
    """A13."""
    scores = F.create_map(F.lit("a"), F.floor("value").cast("int"), F.col("event_type"), F.lit(3))
    return _t(spark, d, "events").select("event_id", F.array_join(audit.score_issues(scores, ["a", "b"]), ",").alias("issues"))


@query("pdf_pages", "SELECT p_partkey, (p_partkey % 4 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END)::INTEGER AS pages FROM part")
def pdf_pages(spark, d):
    """F3."""
    text_ = F.concat(F.repeat(F.concat("p_name", F.lit("\f")), (F.col("p_partkey") % 4).cast("int")), F.when(F.col("p_partkey") % 3 == 0, "tail").otherwise(" \n"))
    return _t(spark, d, "part").select("p_partkey", decode.pdf_pages(text_).alias("pages"))


@query("json_sources", "SELECT p_partkey, p_name AS text, CASE WHEN p_partkey % 3 = 1 THEN '' ELSE p_name END AS quotes FROM part")
def json_sources(spark, d):
    """an object with text and quotations, plain text, an array."""
    k = F.col("p_partkey") % 3
    both = F.to_json(F.struct(F.col("p_name").alias("text"), F.array("p_name", F.lit(" ")).alias("quotes")))
    quotes = F.when(k == 2, F.to_json(F.array("p_name", F.lit("")))).otherwise(F.when(k == 0, both).otherwise(F.col("p_name")))
    return _t(spark, d, "part").select("p_partkey", decode.text_or_json(F.when(k == 0, both).otherwise(F.col("p_name"))).alias("text"), F.array_join(decode.quotes_of(quotes), ";").alias("quotes"))


@query("main_passage", f"WITH x AS (SELECT {_LINE} FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, '요' || l_linenumber || '_' || q AS main_passage FROM x")
def main_passage(spark, d):
    """W1."""
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return refs.main_passages(refs.expand(_ref_lines(spark, d), "t", BOOKS, keep), keep)


@query(
    "best_folders",
    """SELECT folder, documents, (CASE WHEN contains(folder, 'src1') THEN 6 ELSE 0 END + 2 * (CASE WHEN last LIKE '%7%' THEN 1 ELSE 0 END) + least(documents, 20) // 4)::BIGINT AS score
FROM (SELECT '/x/' || source AS folder, count(*) AS documents, max(doc_id)::VARCHAR AS last FROM documents WHERE source IS NOT NULL GROUP BY source) WHERE documents >= 5 ORDER BY score DESC, documents DESC, folder LIMIT 10""",
)
def best_folders(spark, d):
    """S11, S12."""
    found = _t(spark, d, "documents").where("source IS NOT NULL").groupBy(F.concat(F.lit("/x/"), "source").alias("folder")).agg(F.count(F.lit(1)).alias("documents"), F.array(F.max("doc_id").cast("string")).alias("samples"))
    hit = F.transform("samples", lambda s: F.when(F.contains(s, F.lit("7")), "src1").otherwise("none"))
    return discovery.best_folders(found.withColumn("samples", hit), ["src1"], 10)[0].select("folder", "documents", F.col("score").cast("long").alias("score"))
