"""The prefix trie of conversations by preorder-interval encoding.

A conversation is one row, its key the 128-bit digests of its turns one after the other; texts are never shuffled. Equal
conversations are counted first, so a conversation that very many ids hold is one row. The distinct keys are dealt by ranges
and sorted. As a prefix sorts before what extends it, the nodes in the order in which the keys first reach them are in preorder: a
conversation adds a node for each turn beyond those it shares with the one before, and its place among all nodes is the sum of the
nodes before, from a table with one row a partition. Every node's subtree is an interval: its own place to the greatest last
place among the conversations below it, which an aggregate with partial results finds.

Leaves and savings are then differences of distributed prefix sums over the places: running sums within ranges of places,
completed with the totals of the ranges before, looked up at both ends of the interval.

Digests of the ids that end at a node come from ids dealt by ranges of (node, id), joined into pieces of text there; the
pieces of a node then pass through one running digest in order, so no task holds a node's ids. The ranges put a node of
very many ids into many partitions.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notemill.llm.common import WORD, checkpoint, split_join, table
from notemill.operators.ranks import before_parts, ordered

#: Bytes of a turn's digest.
SIZE = 16
#: Conversations of so many ids share the head of the first of them, and up to HEAD - 1 of its turns.
FAMILY, HEAD = 20, 4
#: Characters of a piece of joined ids, about.
PIECE = 1 << 16
NO_IDS = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame, family: int = FAMILY, head: int = HEAD, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, key, words) of every conversation after its head was replaced; see trie() for how, words are counts by turn.

    Families meet in one window; a family is at most `family` conversations.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    c = F.col(f"`{id_col}`")
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    narrow = turns.where(c.isNotNull()).select(
        (c - c % family).alias("base"),
        c.alias("conv_id"),
        F.struct(F.col(f"`{turn_col}`").alias("turn"), digest.alias("digest"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("int").alias("words")).alias("t"),
    )
    dealt = narrow.repartition("base")  # serves the grouping and the window
    own = dealt.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, head - 1))).over(Window.partitionBy("base"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(head)).cast("int")
    with_h = own.withColumn("first", first).withColumn("h", h)
    all_ = F.concat(F.slice(F.coalesce("first", F.slice("own", 1, 0)), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1))))
    joined = with_h.select("conv_id", all_.alias("turns"))
    return joined.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))


def shared_turns(a: bytes, b: bytes) -> int:
    """Leading turns that two keys have in common."""
    low, high = 0, min(len(a), len(b)) // SIZE
    while low < high:  # equal prefixes are compared as whole slices
        mid = (low + high + 1) // 2
        if a[: mid * SIZE] == b[: mid * SIZE]:
            low = mid
        else:
            high = mid - 1
    return low


def _new_nodes(last: dict[int, bytes]):
    """Of each sorted partition, the number of nodes that it adds; last holds the keys that the partitions before end with."""

    def count(batches):
        part, before, n = None, None, 0
        for batch in batches:
            keys = batch.column("key").to_pylist()
            if part is None and len(keys):
                part = batch.column("part")[0].as_py()
                before = last.get(part)
            for key in keys:
                n += len(key) // SIZE + 1 if before is None else len(key) // SIZE - shared_turns(before, key)
                before = key
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([n], pa.int64())})

    return count


MEMBERS = "node binary, up binary, depth long, place long, end long, conv_id long, n long, children long, words long"


def _members(last: dict[int, bytes], start: dict[int, int]):
    """A row for each conversation and node on its path, narrow ones; the root's parent is null.

    place is the node's place where the conversation is the first to reach it, else null; end is the last place that the conversation
    reaches; children counts the node that it adds below. Digests of prefixes are made by running one digest along the key.
    """

    def explode(batches):
        part, before, at = None, None, 0
        for batch in batches:
            out = [[] for _ in range(9)]
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "words", "conv_id", "n")), strict=True)
            if part is None and batch.num_rows:
                part = batch.column("part")[0].as_py()
                before, at = last.get(part), start[part]
            for key, words, conv, n in rows:
                depth = len(key) // SIZE
                known = -1 if before is None else shared_turns(before, key)
                end = at + depth - known - 1
                running, up = hashlib.md5(), None
                for d in range(depth + 1):
                    if d:
                        running.update(key[(d - 1) * SIZE : d * SIZE])
                    node = running.copy().digest()
                    place = at + d - known - 1 if d > known else None
                    below = 1 if known <= d < depth else 0
                    for column, value in zip(out, (node, up, d, place, end, conv, n, below, words[d - 1] if d else 0), strict=True):
                        column.append(value)
                    up = node
                at, before = end + 1, key
                if len(out[0]) > 20000:
                    yield _batch(out)
                    out = [[] for _ in range(9)]
            yield _batch(out)

    return explode


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in MEMBERS.split(", ")])


def _pieces(batches):
    """Runs of sorted (node, conv_id) as (node, first, ids), ids joined by commas."""
    at, first, ids, size = None, None, [], 0
    for batch in batches:
        out = ([], [], [])
        for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node != at or size > PIECE:
                if at is not None:
                    for column, value in zip(out, (at, first, ",".join(ids)), strict=True):
                        column.append(value)
                at, first, ids, size = node, conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["node", "first", "ids"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], names=["node", "first", "ids"])


def _digests(batches):
    """The SHA-256 of each node's pieces, which come in order; one digest runs at a time."""
    at, running = None, None
    for batch in batches:
        nodes, digests = [], []
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node != at:
                if at is not None:
                    nodes.append(at)
                    digests.append(running.hexdigest())
                at, running = node, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([running.hexdigest()])], names=["node", "ends"])


def _running(columns: list[str]):
    """Running sums of the columns within a partition, in its order."""

    def add(batches):
        sums = dict.fromkeys(columns, 0)
        for batch in batches:
            made = [batch.column("place")]
            for c in columns:
                run = sums[c] + np.cumsum(batch.column(c).to_numpy())
                sums[c] = int(run[-1]) if len(run) else sums[c]
                made.append(pa.array(run, pa.int64()))
            yield pa.RecordBatch.from_arrays(made, names=["place", *columns])

    return add


def trie(turns: DataFrame, family: int = FAMILY, head: int = HEAD, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each node of the prefix trie of the rebuilt conversations.

    A conversation is its rows in order of turn (null first; rows of equal turn by the digest of role and text). Conversation c
    is rebuilt as the first h turns of conversation c - c % family, and its own after its first h, with h = crc32(c) % head.
    Columns: conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens
    (over the subtree: members but one, times the words of a node's last text), ends_sha256 (of the ids of the conversations that
    end at the node), and place and end, the node's preorder interval.

    Null roles and texts are empty. Rows with a null id belong to no conversation and are left out. Repeated rows are turns
    like others. An empty table has no nodes. Other columns are ignored. Turns are told apart by 128-bit digests.
    """
    convs = checkpoint(rebuilt(turns, family, head, id_col, turn_col, role_col, text_col).withColumn("conv_id", F.col("conv_id").cast("long")))
    distinct = convs.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.first("words").alias("words"))
    rows = ordered(distinct, ["key"], "part", "row")
    ends = rows.groupBy("part").agg(F.max("key").alias("key")).orderBy("part").collect()  # a key for each partition
    last = {b.part: bytes(a.key) for a, b in zip(ends, ends[1:], strict=False)}
    added = rows.select("part", "key").mapInArrow(_new_nodes(last), "part int, n long").collect()
    start, total = {}, 0
    for r in sorted(added):
        start[r.part], total = total, total + r.n
    members = rows.select("part", "key", "words", "conv_id", "n").mapInArrow(_members(last, start), MEMBERS)
    sums = [F.max("up").alias("up"), F.max("depth").alias("depth"), F.min("place").alias("place"), F.max("end").alias("end"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("children").alias("n_children"), F.max("words").alias("words")]
    nodes = checkpoint(members.groupBy("node").agg(*sums))

    own = nodes.select("place", (F.col("end") == F.col("place")).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    placed = ordered(own, ["place"], "part", "row")
    running = placed.select("place", "leaves", "saved").mapInArrow(_running(["leaves", "saved"]), "place long, leaves long, saved long")
    ranges = placed.groupBy("part").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    before = ranges.join(before_parts(placed, "part", F.sum("leaves"), "leaves_before"), "part").join(before_parts(placed, "part", F.sum("saved"), "saved_before"), "part").drop("part")
    bounds = F.broadcast(checkpoint(before))  # a row for each partition
    prefix = checkpoint(running.join(bounds, F.col("place").between(F.col("low"), F.col("high"))).select("place", (F.col("leaves") + F.col("leaves_before")).alias("leaves"), (F.col("saved") + F.col("saved_before")).alias("saved")))

    # a difference of prefix sums: at the interval's end, less before its start
    at_start = prefix.select("place", F.col("leaves").alias("leaves_here"), F.col("saved").alias("saved_here"))
    at_end = prefix.select(F.col("place").alias("end"), F.col("leaves").alias("leaves_end"), F.col("saved").alias("saved_end"))
    single = (F.col("end") == F.col("place")).cast("long")
    spans = nodes.join(at_end, "end").join(at_start, "place").withColumn("n_leaves", F.col("leaves_end") - F.col("leaves_here") + single)
    spans = spans.withColumn("saved_tokens", F.col("saved_end") - F.col("saved_here") + (F.col("n_convs") - 1) * F.col("words"))

    by_node = convs.select(F.unhex(F.md5("key")).alias("node"), "conv_id")
    dealt = by_node.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = dealt.mapInArrow(_pieces, "node binary, first long, ids string")
    digests = pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(_digests, "node binary, ends string")
    full = checkpoint(spans.join(digests, "node", "left"))
    parents = nodes.where("n_children > 0").select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    out = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    out += [F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"), "place", "end"]
    below = split_join(full.where("depth > 0"), parents, "up", "n").select(*out)
    return below.unionByName(full.where("depth = 0").withColumn("parent_conv_id", F.lit(None)).select(*out))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations, families of 20 and heads of up to three turns."""
    return trie(table(spark, sf_dir, "conversations")).drop("place", "end")


OP13_SQL = r"""
WITH RECURSIVE step(byte, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT byte, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM step WHERE k < 8
), crc AS (SELECT list(v ORDER BY byte) AS tab FROM step WHERE k = 8),
own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
  SELECT own.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 4 AS h
  FROM own, crc
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
  FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20
), steps AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt),
members AS (SELECT conv_id, depth, turns[1:depth] AS path, turns[1:depth - 1] AS up, depth = len(turns) AS ends FROM steps),
nodes AS (
  SELECT path, depth, min(CASE WHEN depth > 0 THEN up END) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
         CASE WHEN depth > 0 THEN len(regexp_extract_all(path[-1].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
  FROM members GROUP BY path, depth
), children AS (SELECT up, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up),
full_ AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n, 0) AS n_children
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.up LEFT JOIN children c ON c.up = n.path
), below AS (SELECT path[1:d] AS top, n_children, n_convs, words FROM (SELECT *, unnest(range(depth + 1)) AS d FROM full_)),
sums AS (SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM below GROUP BY top)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM full_ JOIN sums ON top = path
"""
