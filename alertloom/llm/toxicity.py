"""Toxicity scores: a lexicon learned from labelled rows, misspellings caught by Levenshtein automata.

The lexicon holds whole words and stems that toxic documents contain far more often than clean ones,
by likelihood ratio over all training rows, near copies counted once. Every token of a text is turned
into a Levenshtein automaton and intersected with the lexicon's trie; words that the labels show to be
clean are left out. Around each hit a window of tokens separates quotation (quotation marks, words of
reporting) from abuse (second person). The hits on each entry, and
the summed evidence of misspelt and quoted hits, go through a logistic model around a prior, fitted on at
most ``FIT_ROWS`` training rows, chosen by hashed text. The lexicon keeps at most ``MAX_ENTRIES`` entries,
those that tell the classes apart best.

An entry must occur in ``LEAST_SHARE`` of the toxic training documents, which bounds the lexicon by the
number of words in a document, whatever the size of the corpus; the same holds for the clean words.
Labels are broadcast up to ``MAX_BROADCAST_LABELS`` rows and joined by shuffle beyond.

Defined results: a null or empty text has no hits and gets the score of a text without hits; without
labelled rows the lexicon is empty and every score is that of the prior. A document whose label rows
disagree is toxic; rows without id or label teach nothing. Repeated rows are judged each by itself; an
empty table gives an empty result; further columns are ignored. Texts of any length are read whole, one
at a time.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.automaton import Lexicon
from alertloom.llm.common import stored

FIT_ROWS = 20_000
MAX_BROADCAST_LABELS = 1_000_000
LEAST_DOCS, LEAST_SHARE, LEAST_WEIGHT, MAX_ENTRIES = 3, 0.002, 2.0, 500
STEM_SIZES = range(4, 9)
EDIT_FACTOR = 0.6
WINDOW = 6
CACHE = 300_000
# Prior of the logistic model: bias, misspelt and quoted evidence; an entry's is its log-odds. Strength.
PRIOR, STRENGTH = (-4.0, 3.0, 0.3), 1.0
# Words that report speech, words that address someone.
REPORTING = frozenset(
    "said says wrote writes called calls quote quoted quotes word words term phrase "
    "sagte sagt schrieb nannte wort wörter begriff zitat zitiert "
    "écrit appelé citation cité terme dijo escribió llamó palabra palabras cita citó".split())
ADDRESSING = frozenset(
    "you your you're youre yourself ur du dich dir dein deine toi vous votre tienes eres usted".split())
_TOKEN = re.compile(r"\w(?:[\w*@$!]*\w)?")
_QUOTED = re.compile("\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]")


def words_of(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def _sketch(texts: pd.Series) -> pd.Series:
    """Least hash of neighbouring word pairs: near copies share it, unrelated texts hardly ever."""
    out = []
    for text in texts:
        words = pd.Series(words_of(text), dtype=object)
        hashed = pd.util.hash_array(words.to_numpy()) if len(words) else np.zeros(1, np.uint64)
        pairs = (hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ hashed[1:]) if len(hashed) > 1 else hashed
        out.append(int((pairs * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(1)).min()))
    return pd.Series(out, dtype="int64")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, toxic, clean documents) of each batch; stems end in *, the empty key counts documents."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = set(words_of(text))
            stems = {w[:n] + "*" for w in words for n in STEM_SIZES if len(w) > n}
            counts[not toxic].update(words | stems | {""})
        keys = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in counts]],
            names=["key", "pos", "neg"])


def weight(pos: float, neg: float, toxic: float, clean: float) -> float:
    """Smoothed log-odds of a key in toxic against clean documents."""
    return math.log((pos + 0.5) / (toxic + 1)) - math.log((neg + 0.5) / (clean + 1))


def likelihood_ratio(pos: float, neg: float, toxic: float, clean: float) -> float:
    """G squared of presence against class."""
    total, cells = toxic + clean, ((pos, toxic, pos + neg), (neg, clean, pos + neg),
                                   (toxic - pos, toxic, toxic + clean - pos - neg),
                                   (clean - neg, clean, toxic + clean - pos - neg))
    return 2 * sum(n * math.log(n * total / (row * column)) for n, row, column in cells if n > 0)


def choose(counts: dict[str, tuple[int, int]], toxic: int, clean: int, keys: int
           ) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems of the lexicon among candidate keys.

    A stem that all its documents continue alike stands for that one word and gives way to it; of
    nested entries the shortest stays.
    """
    least = 2 * math.log(max(2, keys))
    good = {k: weight(*n, toxic, clean) for k, n in counts.items()
            if likelihood_ratio(*n, toxic, clean) >= least and weight(*n, toxic, clean) >= LEAST_WEIGHT}
    longer = {k for k in good if k.endswith("*") for n in (k[:-1],) if any(
        counts[c] == counts[k] for c in counts if c != k and c.rstrip("*").startswith(n)
        and len(c.rstrip("*")) == len(n) + 1)}
    words, stems = {}, {}
    best = sorted(good, key=lambda k: (-likelihood_ratio(*counts[k], toxic, clean), k))[:4 * MAX_ENTRIES]
    for key in sorted(best, key=lambda k: (len(k.rstrip("*")), k)):
        bare = key.rstrip("*")
        if key in longer or any(bare[:n] in stems for n in range(1, len(bare) + 1)):
            continue
        (stems if key.endswith("*") else words)[bare] = good[key]
    kept = {k for k in best if k.rstrip("*") in (stems if k.endswith("*") else words)}
    kept = set([k for k in best if k in kept][:MAX_ENTRIES])
    return ({w: v for w, v in words.items() if w in kept}, {w: v for w, v in stems.items() if w + "*" in kept})


class Model:
    """Lexicon, known clean words and the weights of the evidence."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], clean: frozenset[str] = frozenset(),
                 theta: np.ndarray | None = None):
        self.words, self.stems, self.clean = words, stems, clean
        self.prior = np.array([*PRIOR, *words.values(), *stems.values()])
        self.theta = self.prior if theta is None else theta
        self._place = {e: k for k, e in enumerate([*words, *stems], len(PRIOR))}
        self._lexicon, self._seen = Lexicon(words, stems), {}

    def __reduce__(self):
        return Model, (self.words, self.stems, self.clean, self.theta)

    def match(self, token: str) -> tuple[float, bool, int] | None:
        """(weight, misspelt, place of the entry) of the lexicon entry that the token spells best."""
        if token not in self._seen:
            if len(self._seen) >= CACHE:
                self._seen.clear()
            skip = not self._lexicon.possible(token) or token in self.clean
            found = [] if skip else self._lexicon.near(token)
            self._seen[token] = max(
                ((w * EDIT_FACTOR ** e, e > 0, self._place[entry]) for entry, w, e in found), default=None)
        return self._seen[token]

    def evidence(self, text: str | None) -> dict[int, float]:
        """Logarithmic sums by place: 0 the bias, 1 misspelt, 2 quoted hits, then the entries."""
        low = text.lower() if text else ""
        if not any([self.match(w) for w in set(_TOKEN.findall(low))]):
            return {0: 1.0}
        out: dict[int, float] = {}
        spans = [m.span() for m in _QUOTED.finditer(low)]
        tokens = [(m.group(), m.start()) for m in _TOKEN.finditer(low)]
        at = 0
        for i, (token, start) in enumerate(tokens):
            hit = self.match(token)
            if hit:
                while at < len(spans) and spans[at][1] <= start:
                    at += 1
                inside = at < len(spans) and spans[at][0] < start
                near = [t for t, _ in tokens[max(0, i - WINDOW):i + WINDOW + 1]]
                place, amount = (2, hit[0]) if quoted(inside, near) else (1, hit[0]) if hit[1] else (hit[2], 1)
                out[place] = out.get(place, 0) + amount
        return {0: 1.0} | {k: math.log1p(v) for k, v in out.items()}

    def score(self, text: str | None) -> float:
        z = sum(self.theta[k] * v for k, v in self.evidence(text).items())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def quoted(inside: bool, near: list[str]) -> bool:
    """Whether a hit reports someone's words: marks and words of reporting against direct address."""
    reports = sum(t in REPORTING for t in near)
    return 2 * inside + min(2, reports) - (sum(t in ADDRESSING for t in near) > 0) >= 2


def posterior(x: np.ndarray, y: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Weights of the logistic model around its prior, by Newton steps with halving."""
    def loss(t):
        z = x @ t
        return np.logaddexp(0, z).sum() - y @ z + STRENGTH / 2 * ((t - prior) ** 2).sum()

    theta = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (p - y) + STRENGTH * (theta - prior)
        move = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + STRENGTH * np.eye(len(theta)), slope)
        size = 1.0
        while size > 1e-6 and loss(theta - size * move) > loss(theta):
            size /= 2
        theta = theta - size * move
        if np.abs(size * move).max() < 1e-8:
            break
    return theta


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic") -> DataFrame:
    """(text, toxic) of the labelled documents; of near copies one stays."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(
        F.col(id_col).alias("id")).agg(F.max(F.col(label_col) == 1).alias("toxic"))
    few = marks.limit(MAX_BROADCAST_LABELS + 1).count() <= MAX_BROADCAST_LABELS
    sketch = F.pandas_udf(_sketch, "long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(marks) if few else marks, "id").select("toxic", "text")
    kept = rows.groupBy(sketch("text").alias("s"), "toxic").agg(
        F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return kept.select("t.text", "toxic", "t.h")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model:
    """The model of the documents that have a label."""
    rows = stored(labelled(docs, labels, id_col, text_col, label_col), "toxicity-rows")
    table = stored(
        rows.mapInArrow(_keys, "key string, pos long, neg long")
        .groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxicity-words")
    total = table.where("key = ''").first()
    if total is None or not total["pos"]:
        return Model({}, {})
    toxic, clean = total["pos"], total["neg"]
    odds = F.log((F.col("pos") + 0.5) / (toxic + 1)) - F.log((F.col("neg") + 0.5) / (clean + 1))
    often = max(LEAST_DOCS, LEAST_SHARE * toxic)
    asked = table.where((F.col("key") != "") & (F.col("pos") >= often) & (odds >= LEAST_WEIGHT)).collect()
    words, stems = choose({r["key"]: (r["pos"], r["neg"]) for r in asked}, toxic, clean, table.count())
    first = docs.sparkSession.sparkContext.broadcast(Model(words, stems))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([
                bool(first.value.match(k)) and k not in first.value.words
                for k in batch.column("key").to_pylist()], pa.bool_()))

    seen = table.where((F.col("neg") >= max(LEAST_DOCS, LEAST_SHARE * clean)) & (odds < 0)
                       & ~F.endswith("key", F.lit("*"))).select("key").mapInArrow(near, "key string").collect()
    model = Model(words, stems, frozenset(r["key"] for r in seen))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.evidence(t) for t in texts])

    evidence.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    seen_rows = rows.select("h", "toxic", F.pandas_udf(evidence, "map<int,double>")("text").alias("x"))
    sample = seen_rows.orderBy("h", "toxic").limit(FIT_ROWS).collect()
    x = np.zeros((len(sample), len(model.prior)))
    for row, r in zip(x, sample):
        row[list(r["x"])] = list(r["x"].values())
    return Model(words, stems, model.clean, posterior(x, np.array([float(r["toxic"]) for r in sample]), model.prior))


def score(docs: DataFrame, model: Model, text: Column) -> Column:
    """Probability, from 0 to 1, that each whole text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double").asNondeterministic()(text)
