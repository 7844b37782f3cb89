"""Language identification in two levels of one-versus-one linear support vector machines.

The first level tells language families apart, the second the closely related languages within the
predicted family. Features are hashed letter pairs and triples of the whole text; the machines are
trained by subgradient steps on at most ``MAX_PER_LANG`` labelled documents of each language, chosen
by hashed id.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything if
no labelled row exists; a single known language is predicted for every other text; rows without a
language teach nothing; repeated rows are judged each by itself; further columns are ignored. Texts of any length count
whole.
"""

import re
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNKNOWN = "und"
MAX_PER_LANG = 500
BUCKETS = 1 << 12
EPOCHS, RATE, DECAY = 150, 0.5, 1e-4
# Families of language codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "es fr it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu", "baltic": "lt lv", "turkic": "tr az kk uz",
    "indic": "hi ur bn mr ne pa gu", "semitic": "ar he fa", "sinitic": "zh yue wuu",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_FOLD = np.array([c if c >= 128 else c | 32 if chr(c).isalpha() else 32 for c in range(256)],
                 dtype=np.uint32)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def family(lang: str) -> str:
    return _FAMILY.get(re.split(r"[-_]", lang.lower())[0], lang)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(_ASCII_LETTER.search(text)) or any(
        c.isalpha() for c in text.decode("utf-8", "replace"))


def vector(text: bytes) -> np.ndarray:
    """Square roots of hashed pair and triple counts, of length one."""
    b = _FOLD[np.frombuffer(b" " + text + b" ", dtype=np.uint8)]
    pairs = b[:-1] * np.uint32(256) + b[1:]
    triples = pairs[:-1] * np.uint32(256) + b[2:]
    codes = np.concatenate([pairs + np.uint32(1 << 24), triples]) * np.uint32(2654435761)
    counts = np.sqrt(np.bincount(codes >> np.uint32(20), minlength=BUCKETS)).astype(np.float32)
    return counts / max(np.linalg.norm(counts), 1e-9)


class Machines:
    """One-versus-one linear machines over a set of classes."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.classes = sorted(set(y))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        self.w = np.zeros((BUCKETS + 1, len(self.pairs)), dtype=np.float32)
        for k, (a, b) in enumerate(self.pairs):
            first, second = y == self.classes[a], y == self.classes[b]
            self.w[:, k] = _svm(np.vstack([x[first], x[second]]), int(first.sum()))

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class index, confidence) by votes, ties by summed margins."""
        votes = np.zeros((len(x), len(self.classes)))
        margins = np.zeros_like(votes)
        values = x @ self.w[:-1] + self.w[-1]
        for k, (a, b) in enumerate(self.pairs):
            won = values[:, k] >= 0
            votes[:, a] += won
            votes[:, b] += ~won
            margins[:, a] += np.clip(values[:, k], -3, 3)
            margins[:, b] -= np.clip(values[:, k], -3, 3)
        best = (votes + 0.05 * margins / max(1, len(self.classes))).argmax(axis=1)
        lead = margins[np.arange(len(x)), best] / max(1, len(self.classes) - 1)
        sure = 1 / (1 + np.exp(-3 * lead)) if self.pairs else np.ones(len(x))
        return best, sure


def _svm(x: np.ndarray, positives: int) -> np.ndarray:
    """Weights and bias of a linear machine: hinge loss, both classes weighing the same."""
    y = np.where(np.arange(len(x)) < positives, 1.0, -1.0).astype(np.float32)
    cost = np.where(y > 0, 0.5 / positives, 0.5 / (len(x) - positives)).astype(np.float32)
    w, seen = np.zeros(BUCKETS + 1, dtype=np.float32), np.full(BUCKETS + 1, 1e-8, dtype=np.float32)
    for _ in range(EPOCHS):
        wrong = np.where(y * (x @ w[:-1] + w[-1]) < 1, y * cost, 0)
        slope = np.append(wrong @ x - DECAY * w[:-1], 0.1 * wrong.sum()).astype(np.float32)
        seen += slope ** 2
        w += RATE * slope / np.sqrt(seen)
    return w


class Model:
    """Family machines and, for each family, machines of its languages."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.top = None
        if texts:
            x, y = np.stack([vector(t) for t in texts]), np.array(langs, dtype=object)
            families = np.array([family(lang) for lang in langs], dtype=object)
            self.top = Machines(x, families)
            self.within = [Machines(x[families == f], y[families == f]) for f in self.top.classes]

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        real = [i for i, t in enumerate(texts) if has_letter(t)] if self.top else []
        if not real:
            return langs, scores
        x = np.stack([vector(texts[i]) for i in real])
        families, sure = self.top.decide(x)
        for f, machines in enumerate(self.within):
            rows = np.flatnonzero(families == f)
            if len(rows):
                best, inner = machines.decide(x[rows])
                for r, b, s in zip(rows, best, inner):
                    langs[real[r]] = machines.classes[b]
                    scores[real[r]] = float(s * sure[r])
        return langs, scores


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_per_lang: int = MAX_PER_LANG) -> Model:
    """The model of a table of labelled rows; only a bounded hashed sample reaches the driver."""
    rows = train.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"),
                        F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0)
    for lang, n in counts.items():
        cut = min(1 << 30, -(-max_per_lang * (1 << 30) // n))
        share = F.when(F.col("lang") == lang, cut).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).withColumn(
        "at", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id"), "text")))
    held = [r for r in sample.where(F.col("at") <= max_per_lang).select("text", "lang").collect()
            if has_letter(r["text"])]
    return Model([bytes(r["text"]) for r in held], [r["lang"] for r in held])


def predict(docs: DataFrame, model: Model, text: Column) -> Column:
    """Struct (lang_pred, score) for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.DataFrame:
        langs, scores = [], []
        for at in range(0, len(texts), 256):
            some = shared.value.predict(list(texts[at:at + 256]))
            langs += some[0]
            scores += some[1]
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "lang_pred string, score double").asNondeterministic()(
        text.cast("binary"))
