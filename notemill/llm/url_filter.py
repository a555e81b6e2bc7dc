"""URL filters: boosted trees on lexical features, under fixed host and path rules.

The trees are trained here on labelled URLs that a seeded generator writes. What tells unwanted ones apart is mostly shape:
keyword chains of many hyphens and digits, machine-made and numeric hosts, deep chains of subdomains, registries of ill
repute, long queries and escapes. Ordinary URLs have some of each too. Words alone decide little: the generator's words come
in halves, and held-out accuracy is measured on URLs of the half that training has not seen.

Features are lexical: lengths, depth, digit share, entropy, parameters, runs of consonants, and statistics of host suffixes and
of three-letter pieces of hosts, estimated from the training URLs.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm import gbt
from notemill.llm.common import columns, table

# fixed values: (verdict, host, path start)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words of hosts that the generator writes; a half of each list goes into a training set.
TRADES = "casino jackpot poker roulette wager viagra pharmacy pills replica payday refinance escort webcam torrent keygen serial cracked coupon discount giveaway miracle slimming astrology hookup cheats unlocker prize forex".split()
TOPICS = "news garden library museum travel health history weather forum music recipes photo archive physics poetry cycling theatre zoology village mountain radio press journal review atlas kitchen medicine linguistics bridge harbor orchard chess".split()
#: Suffixes that ordinary sites have, and registries in which abuse is common.
COMMON, ABUSED = "com org net de fr es info io edu example.com example.net example.org".split(), "top xyz click loan bid icu cyou buzz gq tk work".split()
FEATURES = ["length", "host_length", "depth", "digit_share", "entropy", "parameters", "hyphens", "host_labels", "longest_label", "suffix_rate", "pieces_mean", "pieces_worst", "escapes", "is_ip", "path_digits", "consonants", "longest_value"]


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) by the fixed law: the host after the first '://', A-Z lower-cased, up to / ? # or the end."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = rest[:cut].translate(_LOWER)
    path = rest[cut:]
    end = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return host, path[:end]


_LOWER = {c: c + 32 for c in range(65, 91)}


def rule_of(host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def pieces_of(host: str) -> list[list[str]]:
    """The three-letter pieces of each word of a host without its last label."""
    return [[x[k : k + 3] for k in range(len(x) - 2)] for x in re.split(r"[^a-z]+", host.rpartition(".")[0]) if len(x) > 2]


def entropy(text: str) -> float:
    if not text:
        return 0.0
    n = np.array(list({c: text.count(c) for c in set(text)}.values()), dtype=float) / len(text)
    return float(-(n * np.log2(n)).sum())


class Model:
    """Statistics of host pieces and suffixes, and trees on top of the lexical features.

    The statistics of a training URL leave the URL itself out, and for every second one no piece counts as known, so that the
    trees learn to judge hosts of unseen words by their shape.
    """

    def __init__(self, urls: list[str], bad: np.ndarray):
        self.pieces: dict[str, list[float]] = {}
        self.suffixes: dict[str, list[float]] = {}
        for url, y in zip(urls, bad, strict=True):
            for table_, x in self._counted(url):
                n = table_.setdefault(x, [0.0, 0.0])
                n[0] += y
                n[1] += 1
        self.trees = gbt.train(np.array([self.features(u, y, k % 2 == 0) for k, (u, y) in enumerate(zip(urls, bad, strict=True))]), bad, n_trees=40)

    def _counted(self, url: str) -> list[tuple[dict, str]]:
        host = split_url(url)[0]
        return [(self.suffixes, host.rpartition(".")[2]), *[(self.pieces, x) for x in {p for w in pieces_of(host) for p in w}]]

    def _rate(self, table_: dict, x: str, own: float | None) -> float:
        bad, n = table_.get(x, (0.0, 0.0))
        if own is not None:
            bad, n = bad - own, n - 1
        return float(np.log((bad + 2) / (n - bad + 2)))  # few sightings say little

    def features(self, url: str | None, own: float | None = None, known: bool = True) -> list[float]:
        """The FEATURES of a URL; `own` is its label if it is one of the training URLs, `known` whether to look up pieces."""
        url = url or ""
        host, path = split_url(url)
        words = [np.mean([self._rate(self.pieces, x, own) for x in w]) for w in pieces_of(host)] if known else []
        labels = host.split(".")
        query = url.partition("?")[2].partition("#")[0]
        values = [x for x in query.split("&") if x]
        return [
            len(url),
            len(host),
            path.count("/"),
            sum(c.isdigit() for c in host) / max(len(host), 1),
            entropy(host),
            len(values),
            host.count("-"),
            len(labels),
            max(map(len, labels)),
            self._rate(self.suffixes, labels[-1], own),
            sum(words) / max(len(words), 1),
            max(words, default=0.0),
            url.count("%"),
            float(bool(re.fullmatch(r"[0-9.]+(:[0-9]+)?", host)) and bool(host)),
            sum(c.isdigit() for c in path) / max(len(path), 1),
            max(map(len, re.findall(r"[bcdfghjklmnpqrstvwxz]+", host)), default=0),
            max(map(len, values), default=0),
        ]


def training_urls(n: int = 6000, seed: int = 11, half: int = 0) -> tuple[list[str], np.ndarray]:
    """n labelled URLs (1: unwanted) from a seeded generator, with the words and letters of one half (0 or 1)."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    some = lambda a, b: int(rng.integers(a, b))
    of = lambda chars, a, b: "".join(pick(chars) for _ in range(some(a, b)))
    trades, topics = TRADES[half::2], TOPICS[half::2]
    syllables = [c + v + e for k, c in enumerate(["b", "c", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "z", "st", "tr", "pl", "ch", "th", "br", ""]) for m, v in enumerate("aeiou") for n, e in enumerate(["", "n", "r", "s", "l", "nd", "st", "th"]) if (k + m + n) % 2 == half]
    word = lambda: "".join(pick(syllables) for _ in range(some(1, 4)))
    hexa = lambda a, b: of("0123456789abcdef", a, b)
    urls, bad = [], np.zeros(n)
    for k in range(n):
        bad[k] = unwanted = rng.random() < 0.3
        suffix, query = pick(COMMON), pick(["", "", "", "#top", "?utm_source=feed", f"?page={some(1, 40)}&ref={word()}", f"?id={some(1, 1 << 30)}"])
        path = pick(["/", "/en/", "/de/", "/fr/", f"/{pick(topics)}/", f"/{some(1990, 2027)}/{some(1, 13)}/"]) + pick([word(), f"{word()}-{word()}-{pick(topics)}", str(some(0, 9999)), f"{some(0, 9999)}.html", ""])
        path = path if rng.random() < 0.9 else ""
        prefix = pick(["", "", "www.", "blog.", "m.", "en."])
        name = pick([word(), word() + word(), pick(topics), f"{word()}-{word()}", f"{pick(topics)}-{word()}", f"{word()}{some(1, 99)}", f"{word()}.{word()}", f"{pick(topics)}{pick(topics)}"])
        if not unwanted and rng.random() < 0.05:
            suffix = pick(ABUSED)
        if unwanted:
            suffix = pick(ABUSED) if rng.random() < 0.5 else suffix
            shape = some(0, 6)
            if shape == 0:  # a chain of keywords
                name = "-".join([pick(trades), *[pick([pick(trades), word(), str(some(1, 999))]) for _ in range(some(1, 4))]])
            elif shape == 1:  # a plain host of the trade
                name = pick([pick(trades), pick(trades) + word(), pick(trades) + str(some(1, 999))])
            elif shape == 2:  # made by a machine
                name = of("0123456789bcdfghjkmnpqrstvwxz", 12, 28)
            elif shape == 3:  # an address
                prefix, suffix, name = "", str(some(1, 255)), f"{some(11, 223)}.{some(0, 255)}.{some(0, 255)}"
                path = pick(["", "/", f"/{hexa(6, 20)}"])
            elif shape == 4:  # a chain of subdomains
                name = ".".join([*[pick([word(), "login", "secure", "account", "verify", hexa(4, 9)]) for _ in range(some(3, 6))], word()])
            else:  # a redirect
                query = f"?{word()}={hexa(24, 90)}&" + "&".join(f"{word()}={pick([hexa(8, 40), '%2F%2F' + word() + '%3D' + hexa(4, 12)])}" for _ in range(some(2, 7)))
        urls.append(pick(["http://", "https://"]) + prefix + name + "." + suffix + path + query)
    return urls, bad


#: Share of ordinary URLs of unseen words that the threshold leaves alone.
LEFT_ALONE = 0.99


def calibrated(trained: Model, half: int, seed: int = 12) -> float:
    """The threshold, 0.5 at least, that leaves LEFT_ALONE of the ordinary URLs of a half alone."""
    urls, bad = training_urls(3000, seed, half)
    ordinary = trained.trees.probability(np.array([trained.features(u) for u, y in zip(urls, bad, strict=True) if not y]))
    return max(0.5, float(np.quantile(ordinary, LEFT_ALONE)))


@lru_cache(1)
def model() -> tuple[Model, float]:
    """Trees of both halves' URLs; the threshold is the higher one of trees of one half, calibrated on the other half's words."""
    halves = [training_urls(half=k) for k in (0, 1)]
    least = max(calibrated(Model(*halves[k]), 1 - k) for k in (0, 1))
    return Model([u for urls, _ in halves for u in urls], np.concatenate([bad for _, bad in halves])), least


def judge(pages: DataFrame, trained: Model | None = None, threshold: float | None = None, url_col: str = "url") -> DataFrame:
    """All rows and columns of pages with a struct `url_filter`: host, path, rule, verdict, score (probability unwanted).

    A fixed rule decides where one fits, else the trees: `block` at a score over `threshold` (none: that of model()). A null URL, or one without
    '://', has an empty host and path, fits no rule and is allowed. Repeated rows, null ids, empty tables and extra columns
    pass through, whatever their names; a column named `url_filter` is replaced.
    """
    own, least = (trained, 0.5) if trained else model()
    least = least if threshold is None else threshold

    @F.pandas_udf("host string, path string, rule string, verdict string, score double")
    def verdicts(urls: pd.Series) -> pd.DataFrame:
        urls = [u if isinstance(u, str) else "" for u in urls]
        scores = own.trees.probability(np.array([own.features(u) for u in urls]).reshape(-1, len(FEATURES)))
        rows = []
        for u, score in zip(urls, scores, strict=True):
            host, path = split_url(u)
            rule, verdict = rule_of(host, path) or (None, "block" if host and score > least else "allow")
            rows.append((host, path, rule, verdict, float(score)))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "score"])

    return pages.select(*columns(pages, "url_filter"), verdicts(F.col(url_col)).alias("url_filter"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdicts on all pages; see judge()."""
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "url_filter.host", "url_filter.path", "url_filter.rule", "url_filter.verdict", "url_filter.score")
