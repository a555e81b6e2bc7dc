"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled by a seeded hash within each source and ranked there; a row's fractional rank is its rank over the
size of its source. All rows are then sorted by fractional rank and cut into shards whose row counts differ by one at
most, so that each shard holds every source in the proportion it has in the corpus.

No source, however large, meets in one task: ranks are taken within hash buckets (4096 a source) and completed with the
rows of the buckets before, which come from a table of counts. The global order works alike on 4096 slices of the
fractional rank. A source's ranks are shifted by a phase of its own in [0, 1), so that a great many small sources spread
over the whole range rather than meet at one fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.llm.common import bucket_starts, hex_number

#: Buckets of a source's shuffled rows, and slices of the fractional rank.
BUCKETS = 4096


def _text_id(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def interleave(
    docs: DataFrame,
    n_shards: int = 24,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Deal every row of docs into shards 0 to n_shards - 1.

    Returns doc_id, source, size (UTF-8 bytes and 8), text_crc32, shard, slot (place in the shard, gapless from 0) and
    payload, a struct of the columns named in carry (null if none). The law is `rows`: counts differ by one at most.

    Nulls: a null text has size 8 and the CRC of no bytes; rows with a null source form a stratum of their own; a null id
    is an id like others. Repeated rows are all dealt; ties in hash go by id, CRC and size, and rows equal in all of these
    are interchangeable. An empty table gives an empty result. Other columns are ignored unless carried.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("s"),
        hex_number(F.concat(F.lit(f"{seed}:"), _text_id(F.col(id_col))), 15).alias("h"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("string")).alias("payload"),
    ).withColumn("b", F.shiftright("h", 48).cast("int"))
    starts = bucket_starts(rows.groupBy("s", "b").agg(F.count(F.lit(1)).alias("n")), ["s"], "b", "n", "before", "total").drop("n")
    ranked = (
        rows.join(starts, ["s", "b"])
        .withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("s", "b").orderBy("h", "doc_id", "text_crc32", "size")))
        .withColumn("f", (F.col("rank") - hex_number(F.concat(F.lit(f"{seed}:"), "s"), 8) / F.lit(4294967296.0)) / F.col("total"))
        .withColumn("slice", F.least(F.floor(F.col("f") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
        .drop("b", "h", "before", "total")
    )
    # at most BUCKETS rows, whatever the input: they may meet in one task and be broadcast
    slices = bucket_starts(ranked.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1)), ["one"], "slice", "n", "start", "all").drop("n", "one")
    place = F.col("start") + F.row_number().over(Window.partitionBy("slice").orderBy("f", "s", "rank")) - 1
    return (
        ranked.join(F.broadcast(slices), "slice")
        .withColumn("place", place)
        .withColumn("shard", F.floor(F.expr(f"place * {n_shards} div `all`")).cast("int"))
        .withColumn("slot", F.col("place") - F.expr(f"(cast(shard as bigint) * `all` + {n_shards - 1}) div {n_shards}"))
        .select("doc_id", "source", "size", "text_crc32", "shard", "slot", "payload")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, seed: int = 17) -> None:
    """Write all columns of docs as Parquet under path, one folder for each shard, rows in slot order within a file."""
    dealt = interleave(docs, n_shards, seed, carry=tuple(docs.columns))
    dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select("shard", "slot", "payload").write.partitionBy("shard").parquet(path)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards; see interleave(). grown_shard is null: the law is `rows`."""
    from notemill.llm.common import table

    return interleave(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


OP1_SQL = """
WITH RECURSIVE step(byte, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT byte, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM step WHERE k < 8
), crc AS (SELECT list(v ORDER BY byte) AS tab FROM step WHERE k = 8),
rows_ AS (
  SELECT doc_id, '=' || source AS s0, coalesce('=' || source, '') AS s, coalesce(text, '') AS t,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), summed AS (
  SELECT doc_id, s, h, (octet_length(encode(t)) + 8)::BIGINT AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT)),
                         lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM rows_, crc
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, doc_id, text_crc32, size) AS rank, count(*) OVER (PARTITION BY s) AS total,
         ('0x' || substr(md5('17:' || s), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS phase
  FROM summed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (rank - phase) / total, s, rank) - 1 AS place, count(*) OVER () AS n FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * 24 // n)::INTEGER AS shard,
       place - ((place * 24 // n) * n + 23) // 24 AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""
