"""Personal data: fixed patterns, and further spans that boosted trees select among high-recall candidates.

Four base kinds are always reported. Beside them three generators propose spans that may overlap each other and the base
ones: spelled-out mail addresses (`at_mail`), digit groups (`number`: telephone numbers without +, identity numbers) and
account numbers (`account`). Trees score each candidate by its format and by the words before it, and spans over the
threshold of their kind are redacted; thresholds are calibrated on held-out examples for a precision of PRECISION.

The trees are trained here, on labelled examples from a seeded generator (of bounded size) and calibrated on examples with other
words, and enter the plan as plain expressions: DataFrame functions only, whole texts, no shuffle.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.llm import gbt
from notemill.llm.common import columns, spare, table
from notemill.llm.native_spans import PART, bare, beside, found_in, located, parts, ranked, written

PRECISION = 0.99
#: Code points of context before a candidate, back to the one before it of its kind.
CONTEXT = 24
# The base patterns match as the fixed ones do; \G, look-behinds and possessive marks only keep long runs from being tried at each place.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART_OF_IP = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
MORE = {
    "at_mail": r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}){1,5}",
    "number": r"(?<![0-9A-Za-z+.])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){10,30}(?![0-9A-Za-z])",
}
KINDS = [*BASE, *MORE]
#: Format and context features: (name, pattern, on the context rather than the match).
TESTS = [
    ("spelled", r"(?:\[at\]|\(at\)|[\x20\[(]dot[\x20\])])", False),
    ("date_shape", r"^(?:19|20)[0-9]{2}[-./\x20][0-9]{1,2}[-./\x20][0-9]{1,2}$|^[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{2,4}$", False),
    ("national_phone", r"^\(?[2-9][0-9]{2}\)?[\x20.-]{0,2}[2-9][0-9]{2}[\x20.-][0-9]{4}$|^\(?0[0-9]{2,4}\)?[\x20/-][0-9]{3,4}[\x20-]?[0-9]{2,5}$", False),
    ("identity_number", r"^(?!000|666|9)[0-9]{3}[\x20-](?!00)[0-9]{2}[\x20-](?!0000)[0-9]{4}$", False),
    ("plain_run", r"^[0-9]+$", False),
    ("book_number", r"^97[89][\x20-]?[0-9]", False),
    ("account_shape", r"^[A-Z]{2}[0-9]{2}\x20?(?:[A-Z0-9]{4}\x20?){2,7}[A-Z0-9]{1,4}$", False),
    ("personal_word", r"(?i)(?:phone|tel|call|mobile|fax|cell|contact|mail|write to|reach)[^0-9A-Za-z]*(?:me|us|at|on|no|number)?[^0-9A-Za-z]*$", True),
    ("identity_word", r"(?i)(?:ssn|social security|passport|identity|id no|iban|account|bank)[^0-9A-Za-z]*(?:is|no|number)?[^0-9A-Za-z]*$", True),
    ("other_word", r"(?i)(?:isbn|order|version|part|page|article|ticket|invoice|item|code|ref|serial|model|meet|look|sit)[^0-9A-Za-z]*(?:no|number|is)?[^0-9A-Za-z]*$", True),
]
FEATURES = ["kind", "length", "digits", "separators", "checks", *[name for name, _, _ in TESTS]]


def account_checks(match: str) -> bool:
    """Whether the check digits of an international account number are right: 1 modulo 97."""
    own = match.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


def _account_checks(match: Column) -> Column:
    own = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(own, 5, 64), F.substring(own, 1, 4)), "")
    step = lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.try_cast("int")) % 97).when(c.rlike("[A-Z]"), (r * 100 + F.ascii(c) - 55) % 97).otherwise(r)
    return F.aggregate(turned, F.lit(0), step) == 1


def example_features(kind: str, match: str, context: str) -> list[float]:
    """The features in Python, for training; features_of() has the same as expressions."""
    digits = len(re.sub("[^0-9]", "", match))
    checks = float(kind == "account" and account_checks(match))
    return [KINDS.index(kind), len(match), digits, len(re.sub("[0-9A-Za-z]", "", match)), checks, *[float(bool(re.search(p, context if on else match))) for _, p, on in TESTS]]


def features_of(rank: Column, match: Column, context: Column) -> list[Column]:
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    tests = [(context if on else match).rlike(p).cast("int") for _, p, on in TESTS]
    checks = F.when(rank == KINDS.index("account"), _account_checks(match)).otherwise(False).cast("int")
    return [rank, F.length(match), digits, F.length(F.regexp_replace(match, "[0-9A-Za-z]", "")), checks, *tests]


# Words before a candidate. Fit and calibration take turns in these lists, so that calibration meets words that the trees were
# not fitted on; of either side's words some are not among those of TESTS.
PERSONAL = "phone;tel.;dial;ring;call me at;mobile no;line;text;contact;fax;sms;voice;cell;reach us on;handset;hotline;mail;write to;send to;inbox".split(";")
IDENTITY = "SSN;social security number;taxpayer no;insured person;passport no;identity no;document held by;holder;IBAN;account no;pay to;transfer to;bank;id no".split(";")
OTHER = "isbn;order no;catalogue;parcel;version;ticket;build;case;invoice;part;receipt;sku;page;article;folio;chapter;ref;serial;batch;lot;model;code;score;gate;meet;look;stand;arrive;sit;item".split(";")


#: Parts of the ordinary numbers and references that look personal by chance: telephone or identity shape, right check digits.
LOOKALIKE = 0.005


def examples(side: int, n: int = 4000, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of n generated candidates, personal and not; side 0 is for fitting, 1 for calibration, 2 for tests.

    Sides 1 and 2 have words that side 0 lacks, side 2 also shapes that the others lack: telephone numbers, identity numbers
    and addresses written otherwise, accounts of other countries and with letters. A sixth of the candidates stands after a plain
    word, whatever it is; LOOKALIKE of the ordinary ones have a personal shape.
    """
    rng = np.random.default_rng(seed + side)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(pick("0123456789") for _ in range(k))
    letters = "abcdefghilmnoprstu" if side else "aeioubcdghjklmnprstvwz"
    word = lambda: "".join(pick(letters) for _ in range(int(rng.integers(2, 8))))
    cue = lambda words: (word() if rng.random() < 1 / 6 else pick(words[min(side, 1) :: 2])) + pick([" ", ": ", ", "])

    def phone() -> str:
        area, office, own = pick("23456789") + num(2), pick("23456789") + num(2), num(4)
        seen = [f"({area}) {office}-{own}", f"{area}-{office}-{own}", f"{area}.{office}.{own}", f"0{num(3)} {num(6)}"]
        return pick([f"({area}){office}-{own}", f"{area} {office} {own}", f"({area}) {office} {own}", f"0{num(4)}/{num(5)}"] if side == 2 else seen)

    def identity() -> str:
        own = [f"{rng.integers(1, 666):03d}", f"{rng.integers(1, 100):02d}", f"{rng.integers(1, 10000):04d}"]
        return (" " if side == 2 else "-").join(own)

    def account(right: bool) -> str:
        country, rest = pick(["NL", "IT", "CH", "AT"] if side == 2 else ["DE", "FR", "GB", "ES"]), pick([num(18), "".join(pick("ABCDEFGHKLMNPRSTUVW") for _ in range(4)) + num(14)] if side else [num(18)])
        check = 98 - int("".join(str(int(c, 36)) for c in rest + country) + "00") % 97
        own = f"{country}{check if right else rng.integers(2, 99):02d}{rest}"
        return pick([own, " ".join(own[k : k + 4] for k in range(0, len(own), 4))])

    def ordinary() -> str:
        if rng.random() < LOOKALIKE:
            return pick([phone(), identity()])
        plain = [num(int(rng.integers(7, 19))), f"{pick(['19', '20'])}{num(2)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(4)} {num(4)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(3)} {num(2)} {num(3)}", f"{num(1)} {num(1)} {num(2)} {num(3)} {num(2)}"]
        return pick([*plain, f"{num(5)}-{num(3)}", f"{num(2)}-{num(6)}"] if side == 2 else plain)

    x, y = [], np.zeros(n)
    for k in range(n):
        y[k] = good = rng.random() < 0.5
        kind = pick(["at_mail", "number", "number", "account"])
        if kind == "at_mail":
            name, host = pick([word(), f"{word()}.{word()}", word() + num(2)]), word()
            at, dot = ([" [at] ", "(at)", "[at]"], [" [dot] ", "(dot)", " dot ", "."]) if side < 2 else ([" (at) ", "(at) ", " [at]"], ["[dot]", " (dot) ", " dot ", "."])
            match = name + pick(at) + host + pick(dot) + pick(["com", "org", "de"]) if good else f"{word()} at {word()}.{word()}"
            context = cue(PERSONAL if good else OTHER)
        elif kind == "account":
            match = account(True) if good or rng.random() < LOOKALIKE else pick([account(False), pick(["DE", "FR", "GB", "ES"]) + num(2) + "".join(pick("ABCDEFGHKLMNPRSTUVW0123456789") for _ in range(int(rng.integers(10, 26))))])
            context = cue(IDENTITY if good else OTHER)
        elif good and rng.random() < 0.6:
            match, context = phone(), cue(PERSONAL)
        elif good:
            match, context = identity(), cue(IDENTITY)
        else:
            match, context = ordinary(), cue(OTHER)
        x.append(example_features(kind, match, context))
    return np.array(x), y


@lru_cache(1)
def model() -> tuple[gbt.Forest, dict[str, float]]:
    """Trees, and for each further kind the lowest log-odds (0 at least) at which the calibration examples reach PRECISION."""
    forest = gbt.train(*examples(0), n_trees=24)
    x, y = examples(1)
    margin = forest.margin(x)
    thresholds = {}
    for kind in MORE:
        own = np.flatnonzero(x[:, 0] == KINDS.index(kind))
        own = own[np.argsort(-margin[own], kind="stable")]
        precision = np.cumsum(y[own]) / np.arange(1, len(own) + 1)
        # equal scores stand or fall together
        ends = np.flatnonzero(np.append(margin[own][1:] < margin[own][:-1], True) & (precision >= PRECISION))
        thresholds[kind] = float(max(0.0, margin[own][ends[-1]])) if len(ends) else np.inf
    return forest, thresholds


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with a struct `pii`: for each of KINDS an array of (start, end, match).

    Places are code points, end exclusive. Candidates that overlap a base span are dropped, as it is reported already. A null
    text counts as empty and has no spans; texts are read whole, in time about linear in their matches. Repeated rows, null
    ids, empty tables and other columns pass through, whatever their names; a column named `pii` is replaced.
    """
    forest, thresholds = model()
    found, at, base, chosen = spare(docs, "found", "at", "base", "chosen")
    text = F.coalesce(F.col(text_col), F.lit(""))
    patterns = BASE | MORE
    keep = columns(docs, "pii")
    step = docs.select("*", found_in(text, patterns).alias(found))
    step = step.withColumn(at, located(F.col(found), CONTEXT))
    spans = {k: F.get(at, F.lit(i)) for i, k in enumerate(patterns)}
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    valid = {
        "email": spans["email"],
        "ip": F.filter(spans["ip"], lambda s: s["match"].rlike(rf"^{PART_OF_IP}(?:\.{PART_OF_IP}){{3}}$")),
        "card": F.filter(spans["card"], lambda s: F.when(F.length(digits(s["match"])).between(13, 19), F.call_function("luhn_check", digits(s["match"]))).otherwise(False)),
        "phone": F.filter(spans["phone"], lambda s: F.length(digits(s["match"])).between(9, 15)),
    }
    step = step.withColumn(base, F.struct(*[c.alias(k) for k, c in valid.items()]))
    candidates = F.concat(*[parts(spans[k], k) for k in MORE])
    free = F.filter(
        beside(candidates, F.concat(*[parts(F.col(base)[k], k) for k in BASE])),
        lambda b: ~(F.coalesce(b["left"]["end"] > b["span"]["start"], F.lit(False)) | F.coalesce(b["right"]["start"] < b["span"]["end"], F.lit(False))),
    )

    def scored(b: Column) -> Column:
        s = b["span"]
        rank = reduce(lambda c, k: c.when(s["kind"] == k, KINDS.index(k)), MORE, F.when(F.lit(False), 0))
        return F.struct(s.alias("s"), *[c.alias(n) for n, c in zip(FEATURES, features_of(rank, s["match"], s["before"]), strict=True)])

    def over(x: Column) -> Column:
        least = reduce(lambda c, k: c.when(x["s"]["kind"] == k, thresholds[k]), MORE, F.when(F.lit(False), 0.0))
        return forest.margin_column([x[n] for n in FEATURES]) >= least

    picked = F.transform(F.filter(F.transform(free, scored), over), lambda x: x["s"])
    some = sum(F.size(spans[k]) for k in MORE) > 0
    step = step.withColumn(chosen, F.when(some, picked).otherwise(F.array().cast(f"array<{PART}>")))

    def of(kind: str) -> Column:
        return bare(F.filter(chosen, lambda s: s["kind"] == kind)).alias(kind)

    return step.select(*keep, F.struct(*[bare(F.col(base)[k]).alias(k) for k in BASE], *map(of, MORE)).alias("pii"))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, given as (kind, start, end), replaced by its kind; of overlapping ones the first counts."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
    return "".join([*out, text[at:]])


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """The spans of all documents, and how many there are of all kinds; see detect()."""
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    p = F.col("pii")
    base = F.concat(*[ranked(p[k], i, k) for i, k in enumerate(BASE)])
    every = F.concat(*[ranked(p[k], i, k) for i, k in enumerate(KINDS)])
    counts = [F.size(p[k]).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(written(base, False).cast("binary"), 256).alias("base_sha256"), written(every, False).alias("spans"), F.size(every).cast("long").alias("n_spans"))
