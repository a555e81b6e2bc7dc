"""Secret scans: base patterns, and weak candidates that are linked to complementary parts near them.

Three kinds are reported wherever they stand: assignments, access identifiers and long hexadecimal strings. Three more are
weak, since each alone is mostly harmless: account names in assignments (`ident`), service addresses (`endpoint`) and long
mixed strings (`key`). A weak candidate is reported only if complementary parts co-occur in its scope: an identifier with
a secret, a key with an identifier or an address, an address with a secret. A part's scope is its interval and SCOPE code
points on either side; two parts are linked if the gap between their intervals is at most SCOPE, wherever in the text they
stand. The join on intervals sorts the parts of a text once and sweeps them, for the nearest complement on either side.

DataFrame functions only; no row leaves its task and there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.llm.common import columns, spare, table
from notemill.llm.native_spans import PART, bare, beside, found_in, located, parts, ranked, written

SCOPE = 256
# fixed values: the base patterns; a match of `assign` needs a group 2 of 6 or more characters
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak patterns; a `key` needs capitals, small letters and digits.
IDENT = r"""(?i:client_id|access_key_id|account|username|user)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
ENDPOINT = r"(?:https?|ftp|s3|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/@-]+"
KEY = r"[A-Za-z0-9+/_-]{32,}"
KINDS = ["assign", "access", "hex", "ident", "endpoint", "key"]
PATTERNS = dict(zip(KINDS, [ASSIGN, ACCESS, HEX, IDENT, ENDPOINT, KEY], strict=True))


def _linked(weak: Column, complements: Column) -> Column:
    """(part, before, after) of the weak parts that have a complement at most SCOPE away: the nearest on either side."""

    def near(b: Column) -> Column:
        s = b["span"]
        before = F.when(b["left"]["end"] + SCOPE >= s["start"], b["left"])
        after = F.when(s["end"] + SCOPE >= b["right"]["start"], b["right"])
        return F.struct(s.alias("part"), before.alias("before"), after.alias("after"))

    return F.filter(F.transform(beside(weak, complements), near), lambda x: x["before"].isNotNull() | x["after"].isNotNull())


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with a struct `secrets`: for each of KINDS an array of (start, end, match), and `links`.

    links has a row (part, before, after), each (start, end, kind, match), for each reported weak part: the nearest complement
    on either side, null if it is over SCOPE away. A weak part that lies within an assignment is no part of its own. Places are code points, end exclusive.

    A null text counts as empty and has no spans; long texts are scanned whole, in time about linear in their matches. Repeated
    rows, null ids, empty tables and other columns pass through, whatever their names; a column named `secrets` is replaced.
    """
    found, at, free, links = spare(docs, "found", "at", "free", "links")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = columns(docs, "secrets")
    step = docs.select("*", found_in(text, PATTERNS).alias(found))
    step = step.withColumn(at, located(F.col(found)))
    mixed = lambda s: s["match"].rlike("[A-Z]") & s["match"].rlike("[a-z]") & s["match"].rlike("[0-9]")
    spans = {k: F.get(at, F.lit(i)) for i, k in enumerate(KINDS)}
    spans["assign"] = F.filter(spans["assign"], lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 6)
    spans["key"] = F.filter(spans["key"], mixed)
    step = step.withColumn(at, F.struct(*[spans[k].alias(k) for k in KINDS]))
    spans = {k: F.col(at)[k] for k in KINDS}
    weak = F.size(spans["ident"]) + F.size(spans["endpoint"]) + F.size(spans["key"]) > 0
    every = F.concat(*[parts(spans[k], k) for k in KINDS[3:]])
    outside = F.filter(beside(every, parts(spans["assign"], "assign")), lambda b: F.coalesce(b["left"]["end"] < b["span"]["end"], F.lit(True)))
    step = step.withColumn(free, F.when(weak, F.transform(outside, lambda b: b["span"])))
    named = F.filter(free, lambda s: s["kind"] != "key")
    keys = F.filter(free, lambda s: s["kind"] == "key")
    secrets = F.concat(parts(spans["assign"], "assign"), parts(spans["hex"], "hex"), keys)
    pairs = F.array(*[F.struct(w.alias("weak"), c.alias("complements")) for w, c in ((named, secrets), (keys, F.concat(parts(spans["access"], "access"), named)))])
    both = F.flatten(F.transform(pairs, lambda p: _linked(p["weak"], p["complements"])))
    step = step.withColumn(links, F.when(F.size(free) > 0, both).otherwise(F.array().cast(f"array<struct<part:{PART},before:{PART},after:{PART}>>")))

    def reported(kind: str) -> Column:
        return bare(F.transform(F.filter(links, lambda x: x["part"]["kind"] == kind), lambda x: x["part"]))

    plain = lambda p: F.struct(*[p[c].alias(c) for c in ("start", "end", "kind", "match")])
    shown = F.transform(links, lambda x: F.struct(*[F.when(x[c].isNotNull(), plain(x[c])).alias(c) for c in ("part", "before", "after")]))
    kinds = [*[bare(spans[k]).alias(k) for k in KINDS[:3]], *[reported(k).alias(k) for k in KINDS[3:]]]
    return step.select(*keep, F.struct(*kinds, shown.alias("links")).alias("secrets"))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The spans of all documents, and how many weak ones were reported; see scan()."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    s = F.col("secrets")
    base = F.concat(*[ranked(s[k], i, k) for i, k in enumerate(KINDS[:3])])
    every = F.concat(*[ranked(s[k], i, k) for i, k in enumerate(KINDS)])
    counts = [F.size(s[k]).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(written(base, True).cast("binary"), 256).alias("base_sha256"), written(every, True).alias("spans"), F.size(s["links"]).cast("long").alias("n_linked"))


def _sql_located(kind: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, {KINDS.index(kind)} AS rank, m,
         sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS s, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e
  FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{quoted}')) AS m, unnest(string_split_regex(t, '{quoted}')[:-2]) AS g,
               generate_subscripts(regexp_extract_all(t, '{quoted}'), 1) AS i FROM docs WHERE regexp_matches(t, '{quoted}'))"""


OP5_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
located AS ({" UNION ALL ".join(_sql_located(k, p) for k, p in PATTERNS.items())}),
valid AS (
  SELECT * FROM located l
  WHERE (kind != 'assign' OR length(regexp_extract(m, '{ASSIGN.replace("'", "''")}', 2)) >= 6)
    AND (kind != 'key' OR (regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')))
), parts AS (
  SELECT * FROM valid v WHERE rank < 3 OR NOT EXISTS (SELECT 1 FROM valid x WHERE x.doc_id = v.doc_id AND x.kind = 'assign' AND x.s <= v.s AND v.e <= x.e)
), reported AS (
  SELECT * FROM parts v WHERE rank < 3 OR EXISTS (
    SELECT 1 FROM parts x WHERE x.doc_id = v.doc_id AND greatest(x.s - v.e, v.s - x.e) <= {SCOPE}
    AND ((v.kind = 'key' AND x.kind IN ('access', 'ident', 'endpoint')) OR (v.kind != 'key' AND x.kind IN ('assign', 'hex', 'key'))))
)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind IS NOT NULL), '') AS spans,
       count(*) FILTER (rank >= 3) AS n_linked
FROM docs LEFT JOIN reported USING (doc_id) GROUP BY doc_id
"""
