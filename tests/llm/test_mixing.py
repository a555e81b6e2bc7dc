"""Mixing against brute force: targets by repeated dealing, sums by all subsets, whole tables and awkward rows."""

import itertools
import re
from collections import defaultdict

import numpy as np
import pytest

from notemill.llm import mixing
from notemill.llm.common import table

SF = "/root/testdata/sf0.001"


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, repeats=2) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        rate = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * rate > repeats * sizes[s]}
        if not over:
            return out | {s: w[s] * rate for s in open_}
        out |= {s: float(repeats * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("seed", range(30))
def test_subset_sum_is_the_nearest(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 40, 5))
    counts = rng.integers(0, 3, len(lengths))
    goal = int(rng.integers(0, int((lengths * counts).sum()) + 1))
    sums = {sum(a * b for a, b in zip(take, lengths, strict=True)) for take in itertools.product(*[range(c + 1) for c in counts])}
    best = min(abs(s - goal) for s in sums)
    for room in (0, 10, 1 << 16):
        taken = mixing.fill(lengths, counts, goal, room)
        assert ((taken >= 0) & (taken <= counts)).all()
        got = int((taken * lengths).sum())
        assert abs(got - goal) == best if room > goal else abs(got - goal) <= lengths.max()


def test_fill_meets_great_targets_to_the_word():
    rng = np.random.default_rng(3)
    lengths, counts = np.arange(1, 3000), rng.integers(0, 500, 2999)
    whole = int((lengths * counts).sum())
    for goal in (whole // 3, whole - 1, whole, 70000):
        taken = mixing.fill(lengths, counts, goal)
        assert int((taken * lengths).sum()) == goal and (taken <= counts).all()
    third = mixing.fill(lengths, counts, whole // 3)
    assert abs(third[2000:].sum() / counts[2000:].sum() - 1 / 3) < 0.01  # lengths keep their proportion


def check(docs, plan):
    sizes, took, ids = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in docs:
        sizes[r.source] += words(r.text)
        ids[r.doc_id, r.source].append(words(r.text))
    want = targets(dict(sizes))
    for r in plan:
        assert r["size"] in ids[r.doc_id, r.source] and r.source_size == sizes[r.source] and 0 <= r.takes <= 2
        assert r.target == pytest.approx(want[r.source], rel=1e-12)
        took[r.source] += r["size"] * r.takes
    assert len(plan) == len(docs)
    return {s: took[s] - want[s] for s in want}


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    plan = mixing.mix_plan(docs).collect()
    off = check(docs.collect(), plan)
    assert max(map(abs, off.values())) < 10  # ten documents a source: not every sum can be reached
    again = mixing.mix_plan(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id, r.takes)
    assert sorted(map(key, plan)) == sorted(map(key, again))


def test_hot_lengths_are_ranked_in_buckets(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id doc_id", "if(id % 3 = 0, 'one two', 'one two three') text", "if(id % 10 < 7, 'a', 'b') source")
    whole = mixing.mix_plan(docs, share=0.3).collect()
    monkeypatch.setattr(mixing, "BUCKET", 50)
    parts = mixing.mix_plan(docs, share=0.3).collect()
    for plan in (whole, parts):
        took = defaultdict(int)
        for r in plan:
            took[r.source] += r["size"] * r.takes
        assert all(abs(took[r.source] - r.target) <= 1 for r in plan)
        assert 0 < sum(r.takes for r in plan if r["size"] == 2) < 1000


def test_awkward_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (None, "one two", None), (4, "one", "a"), (4, "one", "a"), (5, "word " * 30000, "é"), (6, "\t x \x0b y z", "Z"), (7, "a b c", "")]
    docs = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, source string, size int, `a.b` string, Copy int").repartition(3)
    check(docs.collect(), mixing.mix_plan(docs).collect())
    mix = mixing.mixed(docs)
    assert mix.columns == ["doc_id", "text", "source", "size", "a.b", "copy"]
    plan = {(r.doc_id, r.source): r.takes for r in mixing.mix_plan(docs).collect()}
    assert mix.count() == sum(r.takes for r in mixing.mix_plan(docs).collect()) and plan[1, None] == 0
    assert mixing.mix_plan(docs.limit(0)).count() == 0
    assert mixing.mix_plan(docs.where("doc_id = 1")).first().takes == 0
