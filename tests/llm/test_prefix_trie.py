"""The prefix trie against a dictionary of prefixes, on whole tables and on awkward rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from notemill.llm import prefix_trie
from notemill.llm.common import table

SF = "/root/testdata/sf0.001"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows) -> set:
    """rows of (conv_id, turn, role, text)"""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, own_ in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(own_) - 1) * words
    out = set()
    for path, own_ in members.items():
        ends = ",".join(str(c) for c in own_ if built[c] == path)
        parent = members[path[:-1]][0] if path else None
        out.add((own_[0], len(path), parent, len(own_), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got(nodes) -> set:
    rows = nodes.collect()
    assert len({r.place for r in rows}) == len(rows) and {r.place for r in rows} == set(range(len(rows)))
    return {tuple(r[f] for f in FIELDS) for r in rows}


def test_whole_table(spark):
    turns = table(spark, SF, "conversations")
    assert got(prefix_trie.trie(turns)) == brute([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])


SCHEMA = "conv_id long, turn long, role string, text string, place long, `a.b` string, key string"


@pytest.mark.parametrize("parts", [1, 7])
def test_deep_hot_and_awkward(spark, parts):
    rows = [(c, t, "user" if t % 2 else None, ["hello there", None, "", "a b c"][(c // 7 + t) % 4]) for c in range(150) for t in range(c % 6)]
    rows += [(c, None if t == 1 else t, "x", f"turn {t}") for c in range(1000, 1400) for t in range(4)]  # equal ones
    rows += [(5000, t, "x", "again") for t in range(300)] + [(5001, t, "x", "again") for t in range(299)]
    rows += [(7, 1, "user", "tied"), (7, 1, "user", "tied"), (None, 1, "x", "lost"), (9, 2**40, "", "é" * 50000)]
    frame = spark.createDataFrame([(*r, 1, "z", "k") for r in rows], SCHEMA).repartition(parts)
    assert got(prefix_trie.trie(frame)) == brute(rows)


def test_small_ones(spark, monkeypatch):
    frame = spark.createDataFrame([(3, 1, "a", "b", 0, "", "")], SCHEMA)
    assert got(prefix_trie.trie(frame)) == brute([(3, 1, "a", "b")])
    assert prefix_trie.trie(frame.limit(0)).count() == 0
    rows = [(20 * k, 0, "u", "same") for k in range(500)]
    monkeypatch.setattr(prefix_trie, "PIECE", 40)
    assert got(prefix_trie.trie(spark.createDataFrame([(*r, 0, "", "") for r in rows], SCHEMA))) == brute(rows)
