"""Similarity join of titles: token Jaccard by a prefix index, sequence ratio in bounded blocks with exact bounds.

Two titles match if the Jaccard similarity of their token sets or the Ratcliff-Obershelp ratio of their texts reaches the threshold.

Tokens: a pair at the threshold shares one of the rarest tokens of either side, so only these prefixes are joined, by shuffle.

Ratio: a high ratio forces no shared token and at most few rare characters, so there is no selective key. Drafts sorted by
length are cut into blocks, a title is dealt only to blocks whose lengths can reach the threshold, and each cell of a block and
a slice of the corpus is one bounded group. Within it three bounds that never lose a pair come before the ratio itself:
length, the shared bag of characters, and the longest common subsequence (bit-parallel). The ratio is then taken for thousands of
pairs at once and left as soon as what is still open cannot reach the threshold.
"""

from __future__ import annotations

import difflib
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions.text import compare_key, jaccard, token_set
from notemill.operators.ranks import with_place
from notemill.shared import checkpoint

#: Drafts and titles of a cell.
BLOCK, SLICE = 2048, 8192
#: Pairs whose ratio is taken at once.
CHUNK = 4096
#: The longer text's length from which the sequence matcher leaves out popular characters; such pairs are taken one by one.
POPULAR = 200
#: Classes of characters in the bag bound.
BAG = 64


def ratio_bounds(x: pd.Series, y: pd.Series) -> np.ndarray:
    """At least the sequence ratio of each pair: matching blocks are a common subsequence, so the longest one bounds them.

    Bit-parallel over all pairs, for a shorter text of up to 64 and a longer one of up to 512 characters; others, and those with
    a NUL, have the bound 1.
    """
    out = np.ones(len(x))
    a, b = x.to_numpy(object), y.to_numpy(object)
    size_a, size_b = (np.fromiter(map(len, v), np.int64, len(v)) for v in (a, b))
    x, y = pd.Series(np.where(size_a <= size_b, a, b)), pd.Series(np.where(size_a <= size_b, b, a))
    short, long = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    fits = np.flatnonzero((short <= 64) & (long <= 512) & np.fromiter(("\0" not in p and "\0" not in q for p, q in zip(a, b, strict=True)), bool, len(a)))
    if not len(fits):
        return out
    (i, p), (j, q) = pd.factorize(x.iloc[fits]), pd.factorize(y.iloc[fits])
    p, q = (np.array(list(u), dtype=f"U{max(1, max(map(len, u)))}") for u in (p, q))
    n, m = np.char.str_len(p), np.char.str_len(q)
    p, q = p.view(np.uint32).reshape(len(p), -1), q.view(np.uint32).reshape(len(q), -1)
    known = np.unique(p)
    masks = np.zeros((len(p), len(known) + 1), dtype=np.uint64)
    for k in range(p.shape[1]):  # a bit for each place of a character; padding has none
        masks[np.arange(len(p)), np.searchsorted(known, p[:, k])] |= np.where(p[:, k] > 0, np.uint64(1 << k), np.uint64(0))
    at = np.searchsorted(known, q)
    at[known[np.minimum(at, len(known) - 1)] != q] = len(known)
    rows, columns = masks.reshape(-1), np.ascontiguousarray(at.T)
    s = np.full(len(fits), ~np.uint64(0))
    for column in columns:
        t = s & rows[i * masks.shape[1] + column[j]]
        s = (s + t) | (s - t)
    out[fits] = 2.0 * np.bitwise_count(~s) / np.maximum(n[i] + m[j], 1)
    out[fits[n[i] + m[j] == 0]] = 1
    return out


def _codes(texts: list[str], pad: int, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """A row of small numbers for each text, filled up with pad, and the lengths."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.full((len(texts), max(1, int(lengths.max(initial=0)))), pad, dtype=np.uint16)
    for row, t in zip(out, texts, strict=True):
        row[: len(t)] = [known.setdefault(c, len(known)) for c in t]
    return out, lengths


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in a, start in b and length of each row's longest common run; of several the first in a, then in b."""
    size, at_a, at_b = (np.zeros(len(a), dtype=np.int64) for _ in range(3))
    run = np.zeros((len(b), b.shape[1] + 1), dtype=np.uint8)
    for i in range(a.shape[1]):
        run[:, 1:] = (run[:, :-1] + 1) * (b == a[:, i : i + 1])
        top = run.max(1)
        better = np.flatnonzero(top > size)
        if len(better):
            end = run[better].argmax(1)
            size[better] = top[better]
            at_a[better], at_b[better] = i + 1 - size[better], end - size[better]
    return at_a, at_b, size


def _parts(codes: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, pad: int) -> np.ndarray:
    """The pieces low:high of the given rows, filled up with pad."""
    at = low[:, None] + np.arange(int((high - low).max()))
    return np.where(at < high[:, None], codes[rows[:, None], np.minimum(at, codes.shape[1] - 1)], np.uint16(pad))


def ratios(x: list[str], y: list[str], least: float = 0.0) -> np.ndarray:
    """The Ratcliff-Obershelp ratio of each pair, as difflib gives it; 0 where it is under `least`.

    All pairs go through the recursion together, a level at a time: the longest common run of each open piece, then the pieces
    to its left and right. A pair is left when its runs and the shorter sides of its open pieces cannot reach `least`.
    """
    out = np.zeros(len(x))
    n = np.array([len(a) + len(b) for a, b in zip(x, y, strict=True)], dtype=np.int64)
    single = np.array([len(b) >= POPULAR for b in y], dtype=bool)
    for k in np.flatnonzero(single):
        out[k] = difflib.SequenceMatcher(None, x[k], y[k]).ratio()
    known: dict[str, int] = {}
    many = np.flatnonzero(~single)
    pad_a, pad_b = 65534, 65535
    for start in range(0, len(many), CHUNK):
        own = many[start : start + CHUNK]
        a, na = _codes([x[k] for k in own], pad_a, known)
        b, nb = _codes([y[k] for k in own], pad_b, known)
        total = np.zeros(len(own), dtype=np.int64)
        piece = (np.arange(len(own)), np.zeros_like(na), na, np.zeros_like(nb), nb)
        piece = tuple(v[(na > 0) & (nb > 0)] for v in piece)
        dead = np.zeros(len(own), dtype=bool)
        while len(piece[0]):
            order = np.argsort((piece[2] - piece[1]) * 256 + (piece[4] - piece[3]), kind="stable")
            piece, made = tuple(v[order] for v in piece), []
            for k in range(0, len(order), 1024):  # of about one length, so little of it is filling
                p, a0, a1, b0, b1 = (v[k : k + 1024] for v in piece)
                i, j, size = _longest(_parts(a, p, a0, a1, pad_a), _parts(b, p, b0, b1, pad_b))
                np.add.at(total, p, size)
                some = size > 0
                i, j = i + a0, j + b0
                for c in ((p, a0, i, b0, j), (p, i + size, a1, j + size, b1)):
                    ok = some & (c[1] < c[2]) & (c[3] < c[4])
                    made.append(tuple(v[ok] for v in c))
            piece = tuple(np.concatenate(v) for v in zip(*made, strict=True))
            open_ = np.bincount(piece[0], np.minimum(piece[2] - piece[1], piece[4] - piece[3]), len(own))
            dead = 2.0 * (total + open_) / np.maximum(n[own], 1) < least
            dead &= n[own] > 0
            piece = tuple(v[~dead[piece[0]]] for v in piece)
        done = np.where(n[own] > 0, 2.0 * total / np.maximum(n[own], 1), 1.0)
        out[own] = np.where(dead, 0.0, done)
    return np.where(out >= least, out, 0.0)


def ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """T19, sequence part, as an Arrow function (there is no built-in one); 0 if under least."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x))
        near = np.flatnonzero(ratio_bounds(x, y) >= least)
        out[near] = ratios(x.iloc[near].tolist(), y.iloc[near].tolist(), least)
        return pd.Series(out)

    return of(a, b)


def _bags(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), BAG), dtype=np.uint16)
    for row, t in zip(out, texts, strict=True):
        np.add.at(row, np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") % BAG, 1)
    return out


def near_pairs(drafts: list[str], titles: list[str], least: float, pairs: int = 1 << 16):
    """Yields (draft numbers, title numbers, ratios) of all pairs whose ratio is `least` or more."""
    lengths = np.array([len(t) for t in titles], dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    lengths, bags = lengths[order], _bags([titles[k] for k in order])
    held, some = [], 0

    def settle():
        i, j = (np.concatenate(v) for v in zip(*held, strict=True))
        x, y = pd.Series([drafts[k] for k in i], dtype=object), pd.Series([titles[k] for k in j], dtype=object)
        near = np.flatnonzero(ratio_bounds(x, y) >= least)
        r = ratios(x.iloc[near].tolist(), y.iloc[near].tolist(), least)
        ok = r >= least
        return i[near][ok], j[near][ok], r[ok]

    for k, (draft, bag) in enumerate(zip(drafts, _bags(drafts), strict=True)):
        n = np.maximum(len(draft) + lengths, 1)
        fits = np.flatnonzero((2.0 * np.minimum(len(draft), lengths) / n >= least) | (len(draft) + lengths == 0))
        if len(fits):  # those of fitting length lie together
            low, high = fits[0], fits[-1] + 1
            shared = np.minimum(bags[low:high], bag).sum(1)
            near = low + np.flatnonzero((2.0 * shared / n[low:high] >= least) | (len(draft) + lengths[low:high] == 0))
            if len(near):
                held.append((np.full(len(near), k), order[near]))
                some += len(near)
        if some >= pairs:
            yield settle()
            held, some = [], 0
    if held:
        yield settle()


def _cell(least: float, top: int, draft_kind, seq_kind):
    def match(drafts: pd.DataFrame, titles: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"d": i, "t": j, "score": r}) for i, j, r in near_pairs(drafts["draft"].tolist(), titles["key"].tolist(), least)]
        best = pd.concat(found) if found else pd.DataFrame({"d": [], "t": [], "score": []}).astype({"d": int, "t": int})
        best = best.assign(seq=titles["seq"].to_numpy()[best["t"]]).sort_values(["d", "score", "seq"], ascending=[True, False, True]).groupby("d").head(top)
        return pd.DataFrame({"draft_id": drafts["draft_id"].to_numpy()[best["d"]], "seq": best["seq"], "title": titles["title"].to_numpy()[best["t"]], "score": best["score"]})

    return match


def by_ratio(drafts: DataFrame, corpus: DataFrame, least: float, top: int) -> DataFrame:
    """(draft_id, seq, title, score): of each cell, a draft's `top` titles with a ratio of `least` or more."""
    blocks = checkpoint(with_place(drafts.select("draft_id", "draft", F.length("draft").alias("n")), ["n", "draft_id", "draft"], "place").withColumn("block", F.expr(f"cast(place div {BLOCK} as int)")))
    ends = blocks.groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high")).orderBy("block").collect()  # a row for BLOCK drafts
    lows, highs = [e.low for e in ends], [e.high for e in ends]
    lengths = [r[0] for r in corpus.select(F.length("key")).distinct().collect()]  # not more than the longest title has characters
    count = corpus.count()
    reach = (2 - least) / least + 1e-9
    spans = [(n, bisect_left(highs, n / reach), bisect_right(lows, n * reach)) for n in lengths]
    spans = [s for s in spans if s[1] < s[2]]
    session = corpus.sparkSession
    of = session.createDataFrame(spans, "n int, low int, high int")
    slices = max(-(-count // SLICE), -(-2 * session.sparkContext.defaultParallelism // max(len(ends), 1)))
    cell = F.pmod(F.xxhash64("title"), F.lit(slices)).cast("int")
    dealt = corpus.join(F.broadcast(of), F.length("key") == F.col("n")).select("seq", "title", "key", cell.alias("slice"), F.explode(F.expr("sequence(low, high - 1)")).alias("block"))
    spread = blocks.select("draft_id", "draft", "block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    kinds = drafts.schema["draft_id"].dataType.simpleString(), corpus.schema["seq"].dataType.simpleString()
    cells = spread.groupBy("block", "slice").cogroup(dealt.groupBy("block", "slice"))
    return cells.applyInPandas(_cell(least, top, *kinds), f"draft_id {kinds[0]}, seq {kinds[1]}, title string, score double")


def by_tokens(drafts: DataFrame, corpus: DataFrame, least: float) -> DataFrame:
    """(draft_id, seq, title, score): all pairs whose token sets have a Jaccard similarity of `least` or more.

    Sets that similar share at least ceil(least * size) tokens of each, so they meet in the size - that + 1 rarest of either.
    """
    words = lambda df, tokens: df.select("*", F.explode(tokens).alias("token"))
    a, b = words(drafts, "t"), words(corpus, "u")
    often = a.select("token").unionByName(b.select("token")).groupBy("token").agg(F.count(F.lit(1)).alias("often"))

    def rarest(rows: DataFrame, tokens: str, *own: str) -> DataFrame:
        keep = F.size(tokens) - F.ceil(F.size(tokens) * F.lit(least) - 1e-9) + 1
        nth = F.row_number().over(Window.partitionBy(*own).orderBy("often", "token"))
        return rows.join(often, "token").withColumn("nth", nth).where(F.col("nth") <= keep).drop("nth", "often")

    left, right = rarest(a, "t", "draft_id", "draft"), rarest(b, "u", "seq", "title")
    size = lambda x, y: F.size(x) >= F.size(y) * F.lit(least) - 1e-9
    met = left.join(right, "token").where(size("t", "u") & size("u", "t"))
    pairs = met.select("draft_id", "seq", "title", jaccard(F.col("t"), F.col("u")).alias("score")).where(F.col("score") >= least)
    return pairs.groupBy("draft_id", "seq", "title").agg(F.max("score").alias("score"))  # a pair meets once a shared token


def match_titles(drafts: DataFrame, corpus: DataFrame, threshold: float = 0.55, top: int = 5, extra: DataFrame | None = None) -> DataFrame:
    """For each draft (draft_id, title) the `top` distinct titles of corpus and extra (title, seq) at or over the threshold.

    Columns: draft_id, title, similarity, rank and exact. A title counts once, at its least seq; ranks go by similarity, then
    seq, then title. Similarity is the higher of token Jaccard and sequence ratio of the compared keys, rounded only when shown.
    exact tells that the compared keys are equal. Blank drafts and null titles are left out; both sides may be large.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is over 0 and at most 1")
    every = corpus.select("title", "seq") if extra is None else corpus.select("title", "seq").unionByName(extra.select("title", "seq"))
    key = F.regexp_replace(compare_key(F.col("title")), r"(?U)^\s+|\s+$", "")
    a = checkpoint(drafts.where(r"title RLIKE '\\S'").select("draft_id", key.alias("draft")).withColumn("t", token_set(F.col("draft"))))
    b = checkpoint(every.where("title IS NOT NULL").groupBy("title").agg(F.min("seq").alias("seq")).withColumn("key", key).withColumn("u", token_set(F.col("key"))))
    both = by_ratio(a, b.drop("u"), threshold, top).unionByName(by_tokens(a, b.drop("key"), threshold))
    scored = both.groupBy("draft_id", "seq", "title").agg(F.max("score").alias("score"))
    best = Window.partitionBy("draft_id").orderBy(F.desc("score"), "seq", "title")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    drafted = a.groupBy("draft_id").agg(F.min("draft").alias("draft"))
    shown = ranked.join(drafted, "draft_id").withColumn("exact", key == F.col("draft"))
    return shown.select("draft_id", "title", F.bround("score", 3).alias("similarity"), "rank", "exact")
