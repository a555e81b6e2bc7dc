"""Every stage of the pipeline against brute force on its own input, and the pairs that its approximate stages find."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from notemill.llm import decontaminate, near_copies, packing, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before the first stage and after each."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.collect())
    return out


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def walked(forest, x):
    """Log-odds of one row, node by node."""
    total = forest.base
    for node in forest.roots:
        while forest.left[node] != node:
            node = forest.left[node] if x[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
        total += forest.value[node]
    return total


def test_quality_stage(spark, stages):
    forest, threshold = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    keep = {}
    for i, t in texts(stages[0]).items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        repeated = len({k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)})
        score = 1 / (1 + math.exp(-walked(forest, quality.statistics(t)[1])))
        if len(words) >= 10 and 100 * repeated <= 20 * len(words) and score >= threshold:
            keep[i] = t
    assert texts(stages[1]) == keep and len(keep) < len(stages[0])


def test_quality_on_held_out_documents(spark):
    """Trees of one half of the labelled documents, judged on the other: good ones stay, bad ones mostly go."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    forest, threshold = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = docs.join(labels.where("doc_id % 2 = 1 AND quality IS NOT NULL"), "doc_id").collect()
    kept = {1: [], 0: []}
    for r in rows:
        kept[r.quality].append(1 / (1 + math.exp(-walked(forest, quality.statistics(r.text)[1]))) >= threshold)
    assert np.mean(kept[1]) > 0.95
    print("kept of good and bad:", np.mean(kept[1]), np.mean(kept[0]), len(kept[1]), len(kept[0]))


def test_line_stage(stages):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    before, holders = texts(stages[1]), {}
    for i, t in before.items():
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    lost = lambda line, i: len(key(line)) >= 10 and len(holders[key(line)]) > 1 and min(holders[key(line)]) != i
    assert texts(stages[2]) == {i: "\n".join(x for x in (t or "").split("\n") if not lost(x, i)) for i, t in before.items()}
    assert all(r.n_chars == len(r.text) for r in stages[2])


def shingle_sets(rows):
    out = {}
    for i, t in texts(rows).items():
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = {" ".join(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()
    return out


def similar_pairs(sets):
    """All pairs of similarity 0.8 or more, found over a common shingle."""
    by, shared = {}, Counter()
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    for ids in by.values():
        shared.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    empty = [i for i, s in sets.items() if not s]
    return [p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)] + [(empty[0], i) for i in empty[1:]]


def test_near_copy_stage(stages):
    sets = shingle_sets(stages[2])
    root = {i: i for i in sets}
    for a, b in similar_pairs(sets):
        low, high = sorted((root[a], root[b]))
        root = {i: low if r == high else r for i, r in root.items()}
    assert {r.doc_id for r in stages[3]} == set(root.values()) and len(set(root.values())) < len(root)


def test_near_copy_recall(spark):
    """Unequal pairs of 0.8 or more among all documents of sf0.01: at least 99 % end in one component, and no others meet."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = shingle_sets(docs.collect())
    pairs = [(a, b) for a, b in similar_pairs(sets) if sets[a] != sets[b]]
    root = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    joined = sum(root[a] == root[b] for a, b in pairs)
    print("near pairs joined:", joined, "of", len(pairs))
    assert len(pairs) > 10 and joined >= 0.99 * len(pairs)


def brute_leaks(docs, items):
    """(doc, item) with a window of the item's length at weighted Jaccard 0.8 or more, by sliding counts over all windows."""
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    found = set()
    targets = []
    for item, t in items.items():
        w = words(t)
        size = min(len(w), 5)
        if w:
            targets.append((item, len(w) - size + 1, size, Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1))))
    for doc, t in docs.items():
        w = words(t)
        by_size = {size: [tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 0))] for size in {x[2] for x in targets}}
        known = {size: set(s) for size, s in by_size.items()}
        for item, n, size, want in targets:
            s = by_size[size]
            if not s or known[size].isdisjoint(want):
                continue
            now, common = Counter(), 0
            for k, x in enumerate(s):
                common += now[x] < want[x]
                now[x] += 1
                if k >= n:
                    now[s[k - n]] -= 1
                    common -= now[s[k - n]] < want[s[k - n]]
                if k >= n - 1 or k == len(s) - 1:
                    if common >= 0.8 * (n + min(k + 1, n) - common):
                        found.add((doc, item))
                        break
    return found


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_decontamination_recall(spark, sf):
    """All windows of all documents: what is found is right, and at least 99 % of what is there is found."""
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute_leaks(texts(docs.collect()), {r.item_id: r.text for r in items.collect()})
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    print("leaks found:", len(got & want), "of", len(want))
    assert got <= want and len(got) >= 0.99 * len(want) and want


def test_decontamination_stage(spark, stages):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    leaks = {doc for doc, _ in brute_leaks(texts(stages[3]), items)}
    assert {r.doc_id for r in stages[4]} == {r.doc_id for r in stages[3]} - leaks


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    pieces, used = {}, Counter()
    for r in stages[5]:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
        used[r.sequence_id] += r.length
    for i, t in texts(stages[4]).items():
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces.pop(i))
        assert [a for a, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))] and sum(n for _, n, _ in own) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == crc for a, n, crc in own)
    assert not pieces and max(used.values()) <= packing.CAPACITY and sum(used.values()) > 0.9 * packing.CAPACITY * len(used)


def test_run_leaves_one_folder(spark):
    """run() gives the last stage's rows and keeps no earlier stage."""
    import glob

    folder = spark.conf.get("spark.checkpoint.dir")
    rows = corpus_pipeline.run(spark, SF)
    kept = glob.glob(f"{folder}/corpus-pipeline-*/*")
    assert rows.count() > 0 and [k.rsplit("/", 1)[1] for k in kept] == ["4-packing"]
