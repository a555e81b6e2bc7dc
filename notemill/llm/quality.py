"""Quality rules: boosted trees over document statistics, flattened into numpy node arrays, beside two fixed base rules.

The trees are fitted on all labelled documents, with a score that may only fall as symbols, exclamation marks, repeated
lines or repeated passages grow; only statistics and ids shuffle for that. Statistics and verdicts cover every document,
whole texts, in one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm import gbt
from notemill.llm.common import checkpoint, columns, table

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbol_share": -1,
    "exclaim_share": -1,
    "upper_share": 0,
    "digit_share": 0,
    "bar_share": 0,
    "dup_line_share": -1,
    "repeat_share": -1,
    "distinct_share": 0,
    "mean_line": 0,
    "stop_share": 0,
}
WINDOW = 5
#: The most words for which a five-word window's ids fit one 64-bit number.
PACKED = 6208


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """(words in 5-word windows found twice or more, distinct words). Exact: windows are compared by word ids."""
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    n = len(words) - WINDOW + 1
    if n < 2 or len(ids) == len(words):
        return 0, len(ids)
    if len(ids) <= PACKED:
        key = code[:n].copy()
        for k in range(1, WINDOW):
            key = key * len(ids) + code[k : k + n]
    else:
        pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)[1]
        four = np.unique(pair[:-2] * len(words) + pair[2:], return_inverse=True)[1]
        key = four[:n] * len(ids) + code[WINDOW - 1 :]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0, len(ids)
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(WINDOW):
        covered[k : k + n] |= again
    return int(covered.sum()), len(ids)


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts of BASE and the FEATURES of one whole text; null counts as empty."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    chars = len(text) - without(b" \t\n\v\f\r")
    symbols = without(b"#*$%&|<>")
    lines = raw.split(b"\n")
    full = [x for x in lines if x and not x.isspace()]
    dups = len(full) - len(set(full))
    repeats, distinct = repeated_words(words)
    per = max(chars, 1)
    return [n, chars, symbols, dups, repeats], [
        float(np.log1p(n)),
        chars / max(n, 1),
        symbols / per,
        without(b"!") / per,
        without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / per,
        without(b"0123456789") / per,
        without(b"|") / per,
        dups / max(len(full), 1),
        repeats / max(n, 1),
        distinct / max(n, 1),
        n / max(len(full), 1),
        without(b".,;:?") / per,
    ]


def _frame(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    both = [statistics(t) for t in batch["text"]]
    return np.array([b for b, _ in both], dtype=np.int64).reshape(-1, len(BASE)), np.array([f for _, f in both]).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[gbt.Forest, float]:
    """Trees and threshold from all labelled documents.

    The threshold keeps 99.5 % of the good documents, and is 0.5 at most. A document with several labels counts as good if
    one of them is; unlabelled and null ids are left out. Of rows with one id those features count that are least in order,
    so the same rows give the same trees. Without labels everything is kept.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.max("quality") >= 1).cast("int").alias("y"))

    @F.pandas_udf("array<double>")
    def measure(text: pd.Series) -> pd.Series:
        return pd.Series(list(_frame(pd.DataFrame({"text": text}))[1]), dtype=object)

    features = docs.where(F.col("doc_id").isNotNull()).select("doc_id", measure("text").alias("x"))
    rows = checkpoint(features.groupBy("doc_id").agg(F.min("x").alias("x")).join(marks, "doc_id").select("x", "y"))
    forest = gbt.train_rows(rows, len(FEATURES), monotone=list(FEATURES.values()))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(forest.probability(np.array(x.tolist()).reshape(-1, len(FEATURES))))

    good = rows.where("y = 1")
    n = good.count()
    if not n:
        return forest, 0.0
    scores = good.select(F.lit(0).alias("j"), score("x").alias("v"))
    return forest, min(0.5, float(gbt.quantiles(scores, n, 1, np.array([0.005]))[0, 0]))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows and columns of docs with a struct column `quality`: the base counts, base_failed, score and kept.

    Base rule: fewer than 10 words, or over 20 % of the words in repeated 5-word windows. Null texts count as empty (and
    fail). Any number of repeated rows, null ids, empty tables and other columns pass through as they are; a column of docs
    named `quality`, in any case, is replaced.
    """
    forest, threshold = fit(docs, labels)

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")
    def verdict(text: pd.Series) -> pd.DataFrame:
        base, features = _frame(pd.DataFrame({"text": text}))
        out = pd.DataFrame(base, columns=BASE)
        out["base_failed"] = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
        out["score"] = forest.probability(features) if len(features) else np.zeros(0)
        out["kept"] = ~out["base_failed"] & (out["score"] >= threshold)
        return out

    return docs.select(*columns(docs, "quality"), verdict("text").alias("quality"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents with their base counts, whether the base rule fails, and the verdict of the trees."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *[f"quality.{c}" for c in BASE], "quality.base_failed", "quality.kept", "quality.score")
