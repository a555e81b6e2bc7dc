"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and their components.

- Texts with equal shingle sets are one class (a 128-bit digest); what follows works on classes.
- A class gets a 64-bit SimHash of its distinct shingles and KEYS keys, each made of the least values of two seeded hashes over
  its shingles. At similarity 0.8 a pair shares one key at least with probability 1 - 0.36^8 (99.97 %), above it more. At this
  similarity fingerprints differ in about 10 bits of 64, so blocks of their bits would need hundreds of keys.
- Classes that share a key are tabulated by Hamming distance to reference fingerprints of their own group. A pair whose
  coordinates differ by more than RADIUS anywhere is discarded, survivors are verified by Hamming distance, by size and then
  by the exact similarity of their shingle sets (32 bits a shingle). Pairs that are joined already are not looked at again,
  and a task emits one edge a join, never all pairs.
- A key with more members than a chunk holds is dealt in chunks by hash, differently for every key. After the components of
  all keys are known, members outside a key's largest component meet all its other chunks, so no pair that shares a key is lost
  to the chunks. What can be lost is a pair that shares no key, or whose fingerprints differ in over RADIUS bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notemill.llm.common import checkpoint, columns, split_join
from notemill.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
#: 10 bits are expected at SIMILARITY, with a deviation of 3.
RADIUS = 24
KEYS = 8
REFERENCES = 16
#: A chunk holds about this many classes and shingles.
GROUP, WEIGHT = 256, 1 << 20
_SEEDS = np.random.default_rng(11).integers(0, 2**64, (2 * KEYS, 2), dtype=np.uint64) | np.uint64(1)
SKETCH = "digest binary, fp long, size long, keys array<long>"


def shingle_hashes(text: str | None) -> np.ndarray:
    """Distinct XXH64 of all five-word shingles, sorted; fewer words make one shingle, no words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[SHINGLE - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, last)], dtype=np.uint64))  # noqa: B905  there are more starts than ends


def sketch(text: str | None) -> tuple:
    """(digest, fingerprint, number of shingles, keys) of a text."""
    h = shingle_hashes(text)
    if not len(h):
        return hashlib.blake2b(b"", digest_size=16).digest(), 0, 0, []
    count = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        count += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    fp = int(np.packbits(2 * count > len(h), bitorder="little").view("<i8")[0])
    low = np.array([((h ^ s) * m).min() for s, m in _SEEDS], dtype=np.uint64).reshape(KEYS, 2)
    keys = [xxhash.xxh64_intdigest(low[k].tobytes(), k) - (1 << 63) for k in range(KEYS)]
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest(), fp, len(h), keys


def _sketches(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            made = zip(*map(sketch, part.column("text").to_pylist()), strict=True)
            made = [pa.array(v, t) for v, t in zip(made, (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_key"), *made], names=["id", "text_key", "digest", "fp", "size", "keys"])


def _sets(batches):
    """Adds the shingles of the text, 32 sorted bits each."""
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            sets = [np.unique((shingle_hashes(t) >> np.uint64(32)).astype("<u4")).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("digest", "fp", "size")), pa.array(sets, pa.binary())], names=["digest", "fp", "size", "shingles"])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct values."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def forest(fp: np.ndarray, size: np.ndarray, sets: list, part: np.ndarray, first: int) -> list[tuple[int, int]]:
    """Joins (i, j) that connect all similar pairs with i < j and j >= first; members with equal `part` are joined already."""
    refs = fp[np.linspace(0, len(fp) - 1, min(REFERENCES, len(fp))).astype(int)]
    place = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int16)
    part, joins = part.copy(), []
    for j in range(max(first, 1), len(fp)):
        near = np.flatnonzero(part[:j] != part[j])
        near = near[np.minimum(size[near], size[j]) >= SIMILARITY * np.maximum(size[near], size[j])]
        near = near[(np.abs(place[near] - place[j]) <= RADIUS).all(1)]
        near = near[np.bitwise_count(fp[near] ^ fp[j]) <= RADIUS]
        for i in near:
            if part[i] != part[j] and similarity(sets[i], sets[j]) >= SIMILARITY:
                part[part == part[i]] = part[j]
                joins.append((int(i), j))
    return joins


def _edges(batches):
    """Rows hold a list of members (visitor, root, digest, fp, size, shingles); visitors come last and meet all before them."""
    for batch in batches:
        a, b = [], []
        for row in batch.column(0):  # one group at a time as Python objects
            members = row.as_py()
            members.sort(key=lambda m: (m["visitor"], m["digest"]))
            seen, own = set(), []
            for m in members:  # a visitor can be at home in this chunk too
                if m["digest"] not in seen:
                    seen.add(m["digest"])
                    own.append(m)
            visitors = sum(m["visitor"] for m in own)
            first = len(own) - visitors if visitors else 0
            sets = [np.frombuffer(m["shingles"], "<u4") for m in own]
            part = np.unique([m["root"] for m in own], return_inverse=True)[1]
            fp = np.array([m["fp"] for m in own], dtype=np.int64).view(np.uint64)
            for i, j in forest(fp, np.array([m["size"] for m in own]), sets, part, first):
                a.append(own[i]["digest"])
                b.append(own[j]["digest"])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _joined(members: DataFrame, *by: str) -> DataFrame:
    own = F.struct("visitor", "root", "digest", "fp", "size", "shingles")
    return members.groupBy("key", *by).agg(F.collect_list(own).alias("members")).select("members").mapInArrow(_edges, "a binary, b binary").select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))


def links(classes: DataFrame, rows: DataFrame, group: int = GROUP, weight: int = WEIGHT) -> DataFrame:
    """Edges (a, b) between classes (64-bit hashes of digests) that connect the same components as all similar pairs; see the module's text.

    `rows` (id, text_key, text) hold the texts; shingles are made only for classes that share a key, from their `least` row.
    """
    node = F.xxhash64("digest")
    keyed = classes.select("digest", "size", F.explode("keys").alias("key"))
    chunks = F.greatest(F.ceil(F.col("n") / group), F.ceil(F.col("w") / weight)).cast("int")
    many = checkpoint(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w")).where("n > 1").select("key", "n", chunks.alias("chunks")))
    met = split_join(keyed.select("key", "digest"), many, "key", "n")
    members = checkpoint(met.select("key", "digest", "chunks", F.pmod(F.xxhash64("digest", "key"), F.col("chunks")).cast("int").alias("c")))
    needed = members.select("digest").distinct().join(classes, "digest").select("digest", "fp", "size", "least.*")
    texts = rows.join(needed, (rows.text_key == needed.text_key) & rows.id.eqNullSafe(needed.id)).select("digest", "fp", "size", "text")
    shingled = texts.mapInArrow(_sets, "digest binary, fp long, size long, shingles binary")
    sets = checkpoint(shingled.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("fp", "size", "shingles")]))  # repeated rows go
    edges = checkpoint(_joined(members.join(sets, "digest").withColumn("visitor", F.lit(False)).withColumn("root", node), "c"))
    big = members.where("chunks > 1")
    if big.isEmpty():
        return edges
    placed = checkpoint(big.join(components(edges), node == F.col("node"), "left").select("key", "digest", "chunks", "c", F.coalesce("root", node).alias("root")))
    sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    major = sizes.groupBy("key").agg(F.max(F.struct("m", "root")).alias("top"), F.sum("m").alias("n"))
    open_ = major.where("n > top.m").select("key", "n", F.col("top.root").alias("top"), F.ceil((F.col("n") - F.col("top.m")) / group).cast("int").alias("visits"))
    left = checkpoint(split_join(placed, checkpoint(open_), "key", "n"))
    home = left.withColumn("v", F.explode(F.expr("sequence(0, visits - 1)"))).withColumn("visitor", F.lit(False))
    visit = left.where("root != top").withColumn("v", F.pmod(F.xxhash64("digest", "key"), F.col("visits")).cast("int"))
    visit = visit.withColumn("c", F.explode(F.expr("sequence(0, chunks - 1)"))).withColumn("visitor", F.lit(True))
    columns = ["key", "digest", "root", "c", "v", "visitor"]
    return edges.unionByName(checkpoint(_joined(home.select(*columns).unionByName(visit.select(*columns)).join(sets, "digest"), "c", "v")))


def _text_key(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def _components(docs: DataFrame, id_col: str, text_col: str, group: int) -> tuple[DataFrame, DataFrame]:
    """(id, text_key) of every row, and (text_key, component_id, root, n) of every text; root tells components of equal ids apart."""
    rows = docs.select(F.col(id_col).alias("id"), _text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    sketches = checkpoint(rows.mapInArrow(_sketches, f"id {id_type}, text_key binary, {SKETCH}"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")).alias("least")
    classes = checkpoint(sketches.groupBy("digest").agg(first, *[F.first(c).alias(c) for c in ("fp", "size", "keys")]))
    joined = classes.select("digest", F.col("least.id").alias("least")).join(components(links(classes, rows, group)), F.xxhash64("digest") == F.col("node"), "left")
    joined = joined.select("digest", "least", F.coalesce("root", F.xxhash64("digest")).alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = joined.join(least, "root").select("digest", "component_id", "root")
    texts = sketches.groupBy("text_key").agg(F.first("digest").alias("digest"), F.count(F.lit(1)).alias("n")).join(placed, "digest").drop("digest")
    return sketches.select("id", "text_key"), checkpoint(texts)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """All rows and columns of docs with `component_id`, the smallest id reachable over similar texts.

    Texts of equal shingles are similar, wordless and null ones too. A null id is never the smallest; a component of null ids
    alone has a null component_id. Rows with equal ids are rows like others. Extra columns pass through; one named
    `component_id`, in any case, is replaced.
    """
    _, texts = _components(docs, id_col, text_col, group)
    own = F.struct(*columns(docs)).alias("row")
    found = split_join(docs.select(own, _text_key(text_col).alias("text_key")), texts, "text_key", "n")
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != "component_id"], "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """The rows of docs that stay when each component keeps one document, that with its smallest id; same columns.

    Of several rows of that id in one component, one stays: of the least text key, then of the lowest hash of its columns.
    Rows with a null id stay. Texts are shuffled once, by id and text key.
    """
    ids, texts = _components(docs, id_col, text_col, group)
    kept = split_join(ids, texts, "text_key", "n").where(F.col("id") == F.col("component_id")).groupBy("id", "root").agg(F.min("text_key").alias("text_key")).drop("root")
    own = F.struct(*columns(docs)).alias("row")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), _text_key(text_col).alias("text_key"), own)
    met = rows.join(kept, ["id", "text_key"])  # a text is in one component, so these are distinct
    nth = F.row_number().over(Window.partitionBy("id", "text_key").orderBy(F.xxhash64("row")))
    return met.withColumn("nth", nth).where("nth = 1").select("row.*").unionByName(docs.where(F.col(id_col).isNull()))
