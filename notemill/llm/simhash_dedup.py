"""SimHash near-duplicates by pivot distance tables.

Every text gets a 64-bit fingerprint; two fingerprints link if they differ in three bits or fewer. Links are found
between distinct fingerprints, by their Hamming distances to reference fingerprints (pivots):

- Fingerprints meet under the values of pairs of bit blocks: of five blocks two linked fingerprints agree in two at least, so
  the ten pairs of blocks (25 or 26 bits each) are the keys. They only deal the work to tasks, the pivots do the search.
- Within a key, distances to 16 random pivots are tabulated. If two fingerprints link, no coordinate differs by more than
  three. Members are sorted by the first coordinate, only those within three of each other are paired, other coordinates
  discard more pairs, and the survivors are verified by counting differing bits. No link is lost.
- A key with over GROUP members is dealt in chunks; each pair of chunks is a task's work of its own. What leaves a task is
  a spanning star of each cluster it found, never its pairs.

Clusters of all keys are joined to components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from notemill.llm.common import checkpoint, split_join, table
from notemill.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Blocks of bits (first bit, width); any two of them make a key.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Members of a chunk of a key.
GROUP = 16384
PIVOTS = np.random.default_rng(7).integers(0, 2**64, 16, dtype=np.uint64)
#: Pairs that are looked at together.
STEP = 1 << 21


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash as a signed number: A-Z lower-cased, words split at ASCII white space, all shingles with repeats.

    Fewer words than a shingle make one shingle; no words give 0. A bit is 1 if set in over half of the XXH64 hashes.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[shingle - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last)], dtype="<u8")  # noqa: B905  there are more starts than ends
    count = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprint_udf(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in text], dtype="int64")


def stars(x: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Of fingerprints x (uint64) in buckets: for each cluster within a bucket, edges from its members to one of them."""
    table_ = np.bitwise_count(x[:, None] ^ PIVOTS[None, :]).astype(np.int16)
    order = np.lexsort((table_[:, 0], bucket))
    x, bucket, table_ = x[order], bucket[order], table_[order]
    place = np.unique(bucket, return_inverse=True)[1].astype(np.int64) * 256 + table_[:, 0]
    more = np.searchsorted(place, place + radius, side="right") - np.arange(len(x)) - 1
    ends = np.cumsum(more)
    parent = np.arange(len(x))
    begin = 0
    while begin < len(x):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + STEP, side="right")))
        n = more[begin:stop]
        i = np.repeat(np.arange(begin, stop), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        for k in range(1, table_.shape[1]):
            near = np.abs(table_[i, k] - table_[j, k]) <= radius
            i, j = i[near], j[near]
        near = np.bitwise_count(x[i] ^ x[j]) <= radius
        i, j = i[near], j[near]
        while len(i):
            a, b = parent[i], parent[j]
            open_ = a != b
            i, j = i[open_], j[open_]
            np.minimum.at(parent, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
            while not np.array_equal(up := parent[parent], parent):
                parent = up
        begin = stop
    own = parent != np.arange(len(x))
    return x[own], x[parent[own]]


def _link_groups(batches):
    for batch in batches:
        members = batch.column(0)
        if not len(members):
            continue
        x = members.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        bucket = np.repeat(np.arange(len(members)), np.diff(members.offsets.to_numpy()))
        a, b = stars(x, bucket)
        yield pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})


def links(prints: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` that connect the same clusters as all links within RADIUS."""
    keys = []
    for n, (i, j) in enumerate((i, j) for i in range(5) for j in range(i + 1, 5)):
        bits = lambda k: F.shiftrightunsigned("fp", BLOCKS[k][0]).bitwiseAND(F.lit((1 << BLOCKS[k][1]) - 1))
        keys.append(F.lit(n << 26) + F.shiftleft(bits(i), 13) + bits(j))
    keyed = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    many = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / group).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = (
        keyed.join(many, "key")
        .withColumn("c", chunk)
        .withColumn("d", F.explode(F.expr("sequence(0, chunks - 1)")))
        .groupBy("key", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"))
        .agg(F.collect_list("fp").alias("members"))  # about two chunks at most
    )
    return dealt.select("members").mapInArrow(_link_groups, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All rows of docs, their columns (or those of `keep`), `fingerprint` (long) and `component_id`, the smallest id reachable.

    Null and wordless texts have fingerprint 0 and link like others. Rows with equal ids or texts are rows like others. A
    null id is never the smallest; a component of null ids alone has a null component_id. Extra columns pass through, whatever
    their names; `fingerprint` and `component_id` are replaced. Texts are hashed once: the kept columns are written with their
    fingerprint to the checkpoint folder, so leave the text out of `keep` where it is not needed.
    """
    carried = [c for c in keep or docs.columns if c.lower() not in ("fingerprint", "component_id")]
    row = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.struct(F.lit(None).alias("none"))
    rows = checkpoint(docs.select(row.alias("row"), F.col(id_col).alias("id"), fingerprint_udf(F.col(text_col)).alias("fp")))
    prints = checkpoint(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(prints))
    placed = checkpoint(prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    least = checkpoint(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes")))
    # neither a giant component's classes nor a hot class's rows meet in one task
    classes = checkpoint(split_join(placed, least, "root", "classes").select("fp", "component_id", "n"))
    found = split_join(rows.drop("id"), classes, "fp", "n")
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in carried], F.col("fp").alias("fingerprint"), "component_id")


def op3_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents; see near_duplicates()."""
    found = near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
