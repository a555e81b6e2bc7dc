"""Packing into sequences of fixed length by cutting-stock column generation.

Documents are tokenised and cut: whole sequences first, then one remainder. Sizes are lengths rounded up to UNIT tokens,
and only the histogram of sizes (at most CAPACITY / UNIT rows) reaches the driver. There a linear program over patterns
(multisets of sizes that fit a sequence) covers the histogram; its columns are priced by a knapsack dynamic program over
the dual values. Multiplicities are rounded down, and what is left is filled greedily. Pieces of one size are then ranked,
in hash buckets, and each rank falls into a pattern's copy and slot by a broadcast table of patterns (bounded by the
number of sizes, not by the corpus). Within a sequence pieces close up, so rounding costs padding at the end alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notemill.llm.common import bucket_starts, checkpoint, table

CAPACITY = 1024
#: Tokens of a unit of size.
UNIT = 16
BUCKETS = 4096
#: Texts of these characters alone go by the quicker encoder of the same vocabulary.
_PLAIN = r"[^\x00-ɏ‐-‧]"
_ENCODERS: dict[str, object] = {}


class Encoder:
    """Token ids of texts by a public byte-level BPE file, as `tokenizers` gives them with add_special_tokens=False.

    None is added, but the string of a special token in a text becomes that token. Where the same vocabulary lies beside the
    file as ranks, texts without such strings whose characters are all Latin or common punctuation are encoded from that, about
    four times as fast, to the same ids.
    """

    def __init__(self, path: str):
        import os
        import re

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.slow = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.slow.get_added_tokens_decoder().values()]
        self.exotic = re.compile("|".join([_PLAIN, *special])).search
        self.quick = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.quick is None or self.exotic(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.quick.encode_ordinary(text), dtype="<u4")


def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once in a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, the ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        enc = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(enc.ids(text or ""), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            out = {
                "doc_id": pa.array(columns[0], batch.schema.field(0).type),
                "start": pa.array(columns[1], pa.int64()),
                "length": pa.array(columns[2], pa.int64()),
                "ids_crc32": pa.array(columns[3], pa.int64()),
                "doc_tokens": pa.array(columns[4], pa.int64()),
            }
            if with_ids:
                out["ids"] = pa.array([x.astype(np.int32) for x in columns[5]], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def price(duals: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of highest total dual value (unbounded knapsack): its value and its count of each length."""
    worth = duals > 1e-12
    size, value = lengths[worth], duals[worth]
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = np.searchsorted(size, c, side="right")
        best[c] = best[c - 1]
        if fits:
            totals = best[c - size[:fits]] + value[:fits]
            k = int(totals.argmax())
            if totals[k] > best[c] + 1e-15:
                best[c], take[c] = totals[k], k
    counts = np.zeros(len(lengths), np.int64)
    where, c = np.flatnonzero(worth), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[where[take[c]]] += 1
            c -= size[take[c]]
    return float(best[capacity]), counts


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows: count of each length) and their fractional use in a near-optimal linear program.

    A revised simplex: the basis starts with one pattern for each length, the dual values price a new pattern, and the
    ratio test says which leaves. It ends when no pattern prices above 1 + gap (which bounds the distance from the
    optimum), or after `rounds`.
    """
    m = len(lengths)
    patterns = np.diag(capacity // lengths).astype(np.int64)
    inverse = np.diag(1.0 / np.diag(patterns))  # of the matrix with patterns as columns
    use = inverse @ demand
    for _ in range(rounds):
        value, pattern = price(inverse.sum(0), lengths, capacity)
        if value <= 1 + gap:
            break
        direction = inverse @ pattern
        up = direction > 1e-9
        ratio = np.full(m, np.inf)
        ratio[up] = use[up] / direction[up]
        out = int(ratio.argmin())
        step = ratio[out]
        if not np.isfinite(step):
            break
        use = np.maximum(use - step * direction, 0)
        use[out] = step
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        patterns[out] = pattern
    return patterns, use


def plan(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: count}, multiplicity) that hold exactly demand[i] pieces of lengths[i].

    Linear program, rounded down (and never beyond demand); the rest is filled largest first, and each such pattern is
    repeated as often as its lengths last, so there are few patterns whatever the demand.
    """
    left = demand.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []

    def put(counts: np.ndarray, times: int) -> None:
        if times > 0:
            out.append(({int(lengths[k]): int(counts[k]) for k in np.flatnonzero(counts)}, int(times)))
            left[:] -= counts * times

    if len(lengths) > 1:
        patterns, use = column_generation(lengths, demand.astype(float), capacity)
        for k in np.argsort(-use, kind="stable"):
            has = patterns[k] > 0
            put(patterns[k], min(int(use[k] + 1e-9), int((left[has] // patterns[k][has]).min()) if has.any() else 0))
    while left.any():
        counts, room = np.zeros(len(lengths), np.int64), capacity
        for k in np.flatnonzero(left)[::-1]:
            n = min(left[k], room // lengths[k])
            counts[k] = n
            room -= n * lengths[k]
        has = counts > 0
        put(counts, int((left[has] // counts[has]).min()))
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """For each size and range of ranks [low, high): the first sequence, its copies, the first place."""
    rows, taken, sequence = [], {}, 0
    for counts, times in patterns:
        offset = 0
        for size in sorted(counts, reverse=True):
            low = taken.get(size, 0)
            taken[size] = low + counts[size] * times
            rows.append((size, low, taken[size], sequence, times, offset))
            offset += size * counts[size]
        sequence += times
    return pd.DataFrame(rows, columns=["size", "low", "high", "sequence_id", "times", "at"]).astype("int64")


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    unit: int = UNIT,
    path: str | None = None,
    end_id: int = 0,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Cut and pack all documents; one row for each piece, with sequence_id and offset (gapless from 0 in a sequence).

    A null text counts as empty and holds the end id alone. Null ids and repeated rows are documents like others; pieces
    equal in id, start, length and CRC are interchangeable. An empty table gives an empty result. With with_ids the
    pieces' ids are a column. Other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = checkpoint(
        cut_pieces(docs, path or tokenizer_path(), capacity, end_id, with_ids, id_col, text_col)
        .withColumn("size", F.ceil(F.col("length") / unit))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(BUCKETS)).cast("int"))
    )
    counted = checkpoint(pieces.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n")))
    histogram = counted.groupBy("size").agg(F.sum("n").alias("n")).orderBy("size").toPandas()  # capacity / unit rows at most
    table_ = slots(plan(histogram["size"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), -(-capacity // unit)))
    where = spark.createDataFrame(table_, "size long, low long, high long, sequence_id long, times long, at long")
    starts = bucket_starts(counted, ["size"], "bucket", "n", "before", "all").drop("n", "all")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = pieces.join(starts, ["size", "bucket"]).withColumn("rank", rank)
    order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # at most `capacity` pieces
    return (
        ranked.join(F.broadcast(where), "size")  # a few patterns for each size
        .where("rank >= low and rank < high")
        .withColumn("sequence_id", F.col("sequence_id") + F.expr("(rank - low) % times"))
        .withColumn("slot", F.col("at") + F.expr("(rank - low) div times") * F.col("size"))
        .withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0).cast("long")))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))
    )


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """All documents cut into pieces, packed into sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
