"""Which texts contain which phrases, for any number of both, by anchors.

Each phrase is found by one of its character runs (of 32, 16, ... 1 characters, the longest that fits), the one that the
fewest other phrases hold. Texts are read once: the rolling hashes of all their runs are looked up in a bit table of the
anchors, and only the anchors found are shuffled, to meet their phrases by an equi-join. A candidate is then confirmed by the
whole phrase. So the work on a text does not grow with the number of phrases, and neither they nor the texts are collected.

The bit table has BITS_A_PHRASE bits a phrase, up to MAX_BITS (32 MB, which each task gets). Beyond about 16 million phrases it
lets more runs through, and the result stays the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.shared import checkpoint

RUNS = (32, 16, 8, 4, 2, 1)
BITS_A_PHRASE, MIN_BITS, MAX_BITS = 16, 1 << 16, 1 << 28
#: Characters of a text that are hashed at once.
WINDOW = 1 << 20
_FACTOR = 0x9E3779B97F4A7C15


def run_hashes(text: str) -> dict[int, np.ndarray]:
    """Hashes of all runs of each length of RUNS, by length; a run's hash is mixed, and tells its length."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out, h, size, factor = {}, (codes + np.uint64(1)) * np.uint64(_FACTOR), 1, _FACTOR
    while len(h):
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[size] = mixed ^ (mixed >> np.uint64(32)) ^ np.uint64(size << 8)
        if size == RUNS[0]:
            break
        h = h[: max(len(h) - size, 0)] * np.uint64(factor) + h[size:]  # halves of a run of twice the size
        size, factor = 2 * size, factor * factor % (1 << 64)
    return out


def _runs(batches):
    """(phrase, hash) of the distinct runs of the longest length that fits the phrase."""
    for batch in batches:
        numbers, hashes = [], []
        for k, phrase in enumerate(batch.column("phrase").to_pylist()):
            found = run_hashes(phrase)
            own = np.unique(found[max(found)])
            numbers.append(np.full(len(own), k))
            hashes.append(own)
        at = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)
        every = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("phrase").take(pa.array(at)), pa.array(every.view(np.int64))], names=["phrase", "hash"])


def anchors(phrases: DataFrame) -> DataFrame:
    """(phrase, hash): each distinct, not empty phrase with the run that is rarest among all phrases."""
    distinct = phrases.where("phrase != ''").select("phrase").distinct()
    runs = checkpoint(distinct.mapInArrow(_runs, "phrase string, hash long"))
    often = runs.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    return runs.join(often, "hash").groupBy("phrase").agg(F.min_by("hash", F.struct("n", "hash")).alias("hash"))


def bit_table(hashes: DataFrame, count: int) -> np.ndarray:
    """Words of 64 bits, with a bit set for each hash."""
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (count * BITS_A_PHRASE).bit_length()))
    bit = F.expr("shiftleft(1L, cast(hash & 63 AS int))")
    words = hashes.select(F.shiftright(F.col("hash").bitwiseAND(F.lit(bits - 1)), 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out, found = np.zeros(bits // 64, dtype=np.int64), words.toArrow()  # at most bits / 64 rows
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def found_anchors(text: str, table: np.ndarray) -> np.ndarray:
    """The distinct run hashes of the text that are in the table."""
    mask, some = np.uint64(64 * len(table) - 1), []
    for start in range(0, max(len(text), 1), WINDOW):
        for h in run_hashes(text[start : start + WINDOW + RUNS[0] - 1]).values():
            at = h & mask
            some.append(np.unique(h[(table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]))
    return np.unique(np.concatenate(some)) if some else np.zeros(0, dtype=np.uint64)


def contains_join(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(row, all columns of texts but `text`, phrase) for each text and distinct phrase (column `phrase`) that it contains.

    row numbers the rows of texts that hold an anchor, so that equal rows stay apart. Null and empty phrases are in no text;
    null texts hold none. texts has no column named row, phrase or hash.
    """
    session = texts.sparkSession
    known = checkpoint(anchors(phrases))
    table = session.sparkContext.broadcast(bit_table(known, known.count()))

    def seek(batches):
        for batch in batches:
            hits = [found_anchors(t, table.value).view(np.int64) for t in batch.column("text").to_pylist()]
            some = np.flatnonzero([len(h) > 0 for h in hits])
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(some)) for c in batch.columns], pa.array([hits[k] for k in some], pa.list_(pa.int64()))], names=[*batch.schema.names, "hash"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    near = checkpoint(texts.where("text IS NOT NULL").mapInArrow(seek, f"{kinds}, hash array<bigint>")).withColumn("row", F.monotonically_increasing_id())
    met = near.select("row", F.explode("hash").alias("hash")).join(known, "hash")
    asked = met.groupBy("row").agg(F.collect_set("phrase").alias("phrases"))  # those that share an anchor with this one text
    held = near.drop("hash").join(asked, "row").withColumn("phrase", F.explode(F.expr("filter(phrases, p -> contains(text, p))")))
    return held.drop("phrases", "text")
