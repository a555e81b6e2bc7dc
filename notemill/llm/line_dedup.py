"""Line dedup across documents: a line that several documents hold stays only in the one with the smallest id.

Two Bloom filters are built in one pass: bits that some document's line has set once, and bits set twice. A line is
suspected if all its bits were set twice; all truly repeated lines are, and few others. Only suspected lines are shuffled,
to be confirmed by their 128-bit BLAKE2 digest and to find the smallest document id of each; documents then meet the
digests that they lose.

The filters have 16 bits a line, up to MAX_BITS each. Beyond that size more lines are suspected and shuffled, and the
result stays the same. Tasks send their filters in compressed chunks, merged chunk by chunk; what reaches the driver, and
from there every task, is the twice-seen filter: MAX_BITS / 8 bytes at most.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm.common import checkpoint, columns, split_join, table

MIN_BITS, MAX_BITS = 1 << 20, 1 << 30
#: Bits of a chunk.
CHUNK = 1 << 20
BITS_A_LINE = 16
MIN_CHARS = 10


def line_key(line: bytes, least: int = MIN_CHARS) -> bytes | None:
    """The line without white space at its ends, A-Z lower-cased; None if shorter than `least` code points."""
    key = line.strip().lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode()) < least):
        return None
    return key


def keys_of(text: str | None, least: int) -> set[bytes]:
    return {k for k in map(lambda x: line_key(x, least), (text or "").encode().split(b"\n")) if k is not None}


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two bits for each hash, shape (2, n)."""
    mask = np.uint64(bits - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(32)) & mask]).astype(np.int64)


def _hashes(texts, least: int) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(k) for t in texts for k in keys_of(t, least)], dtype=np.uint64)


def _set(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def _has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _task_filters(bits: int, least: int):
    def build(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = positions(_hashes(batch.column(0).to_pylist(), least), bits).ravel()
            unique, count = np.unique(at, return_counts=True)
            _set(twice, unique[(count > 1) | _has(once, unique)])
            _set(once, unique)
        for k in range(bits // CHUNK):
            part = slice(k * CHUNK // 8, (k + 1) * CHUNK // 8)
            if once[part].any():
                pack = lambda x: zlib.compress(x[part].tobytes(), 1)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "once": pa.array([pack(once)], pa.binary()), "twice": pa.array([pack(twice)], pa.binary())})

    return build


def _merge_chunks(batches):
    """Rows come sorted by chunk; one chunk's two bitmaps are held at a time."""
    at, once, twice = None, None, None
    unpack = lambda x: np.frombuffer(zlib.decompress(x), np.uint8)
    done = lambda: pa.RecordBatch.from_pydict({"chunk": pa.array([at], pa.int32()), "twice": pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())})
    for batch in batches:
        for k, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            a, b = unpack(a), unpack(b)
            if k != at:
                if at is not None:
                    yield done()
                at, once, twice = k, a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    if at is not None:
        yield done()


def twice_seen(docs: DataFrame, text_col: str, bits: int, least: int) -> np.ndarray:
    """The bitmap of bits that lines of two or more rows have set."""
    chunks = (
        docs.select(F.col(text_col).alias("text"))
        .mapInArrow(_task_filters(bits, least), "chunk int, once binary, twice binary")
        .repartition("chunk")
        .sortWithinPartitions("chunk")
        .mapInArrow(_merge_chunks, "chunk int, twice binary")
    )
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in chunks.collect():  # bits / CHUNK rows
        bitmap[row.chunk * CHUNK // 8 : (row.chunk + 1) * CHUNK // 8] = np.frombuffer(zlib.decompress(row.twice), np.uint8)
    return bitmap


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def drop_repeated_lines(docs: DataFrame, least: int = MIN_CHARS, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, with texts without their repeated lines, and a struct `line_dedup` (n_lines, n_dropped).

    Lines whose key has `least` code points or more and is in at least two documents (ids) go from all of them but that
    with the smallest id, where all stay. Rows of one id count as one document, each loses the same lines. Rows with a null id
    are no documents: they lose nothing and count for nothing. A null text stays null and counts as one empty line. Other
    columns pass through; one named `line_dedup`, in any case, is replaced.
    """
    spark = docs.sparkSession
    lines = docs.agg(F.sum(F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = min(max_bits, max(MIN_BITS, 1 << int(lines * BITS_A_LINE).bit_length()))
    known = docs.where(F.col(f"`{id_col}`").isNotNull())
    seen = spark.sparkContext.broadcast(twice_seen(known, text_col, bits, least))

    def suspects(batches):
        for batch in batches:
            ids, keys = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = list(keys_of(t, least))
                if own:
                    at = positions(np.array([xxhash.xxh3_64_intdigest(k) for k in own], dtype=np.uint64), bits)
                    for k in np.flatnonzero(_has(seen.value, at[0]) & _has(seen.value, at[1])):
                        ids.append(i)
                        keys.append(_digest(own[k]))
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, batch.schema.field(0).type), "key": pa.array(keys, pa.binary())})

    id_type = docs.schema[id_col].dataType.simpleString()
    found = checkpoint(known.select(F.col(f"`{id_col}`").alias("id"), F.col(text_col).alias("text")).mapInArrow(suspects, f"id {id_type}, key binary"))
    first = checkpoint(found.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").drop("last"))
    held = split_join(found, first, "key", "n")
    lost = held.where("id != first").groupBy("id").agg(F.collect_set("key").alias("lost"))  # at most a document's own lines

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def cut(text: pd.Series, lost: pd.Series) -> pd.DataFrame:
        out = []
        for t, gone in zip(text, lost, strict=True):
            if gone is None or t is None:
                out.append((t, 1 if t is None else t.count("\n") + 1, 0))
                continue
            gone = {bytes(x) for x in gone}
            every = t.encode().split(b"\n")
            kept = [x for x in every if (key := line_key(x, least)) is None or _digest(key) not in gone]
            out.append((b"\n".join(kept).decode(), len(every), len(every) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    row = F.col("row")
    own = F.struct(*columns(docs)).alias("row")
    met = docs.select(own).join(lost, row.getField(id_col) == F.col("id"), "left").withColumn("cut", cut(row.getField(text_col), "lost"))
    kept = [(F.col("cut.text") if c == text_col else row.getField(c)).alias(c) for c in docs.columns if c.lower() != "line_dedup"]
    return met.select(*kept, F.struct("cut.n_lines", "cut.n_dropped").alias("line_dedup"))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents with their lines, the lines dropped, and the digest of what is kept."""
    docs = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), firsts AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first IS NOT NULL AND doc_id != first) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (first IS NULL OR doc_id = first), '')) AS kept_sha256
FROM lines LEFT JOIN firsts USING (key) GROUP BY doc_id
"""
