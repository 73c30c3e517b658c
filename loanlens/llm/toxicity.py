"""Severity of toxicity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w . x - theta_k) with one weight vector for all
ordered thresholds theta_0 < theta_1 < ...; the expected severity is the sum
of these probabilities.

Features are sparse: presence of selected byte n-grams of the lower-cased
text (hashed; everything but letters is a space, so word edges count), and
the log density of the selected n-grams that go with toxic rows. N-grams and
not words, since languages that compound write one insult in many words.
They are selected on the labelled sample by the z score of their toxic
share. The labels are 0/1, so the ordinal grades are made from them: 0 for
rows that are not toxic, and 1 to 3 for the thirds of the toxic rows by that
density.

The model is fitted on about ``SAMPLE_ROWS`` labelled rows (chosen by a hash
of the id; exact copies vote once), scoring covers every document.

Defined results: a null or empty text has no features and gets the base
rate; a document with several labels takes the highest; repeated rows are
judged alike; an empty table gives an empty result; without toxic labels
every severity is 0. Other columns are passed through; columns named like a
result are replaced. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import free_name, staged, table
from loanlens.llm.registry import register

SAMPLE_ROWS = 20_000
SIZES = (5, 6)
DIMS = 1 << 18
MIN_DOCS = 5
MIN_Z = 6.0
MAX_GRAMS = 384
GRADES = 4
L2 = 1e-3
REJECT = 0.3

#: Bytes that are not letters count as a space.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str | None) -> np.ndarray:
    """Hashed n-grams of a text, one for each position and size, repeats included."""
    b = np.frombuffer(b" " + (text or "").lower().encode("utf-8", "replace").translate(_LETTERS) + b" ", np.uint8)
    b = b[np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]].astype(np.uint64)
    out = []
    for n in SIZES:
        m = len(b) - n + 1
        if m > 0:
            key = np.full(m, n, np.uint64)
            for i in range(n):
                key = key << np.uint64(8) | b[i:i + m]
            out.append((key * _MUL >> np.uint64(64 - (DIMS - 1).bit_length())).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class Model:
    slots: np.ndarray         # by hashed n-gram: its feature, or -1
    toxic: np.ndarray         # whether each feature goes with toxic rows
    weights: np.ndarray       # one for each feature, then the density's
    thetas: np.ndarray        # ascending thresholds

    def features(self, text: str | None) -> tuple[np.ndarray, float]:
        """(features present, log density of toxic n-grams)."""
        found = self.slots[grams(text)]
        hits = found[found >= 0]
        n = np.count_nonzero(self.toxic[hits])
        return np.unique(hits), float(np.log1p(100 * n / len(found))) if n else 0.0

    def tail(self, score):
        """P(grade > k) for every threshold."""
        return 1 / (1 + np.exp(np.clip(self.thetas - np.asarray(score)[..., None], -500, 500)))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of the sampled labelled documents, exact copies once."""
    labels = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    n = labels.count()
    if n > sample_rows:
        labels = labels.filter(F.pmod(F.xxhash64(F.lit("tox"), F.col("doc_id")), F.lit(1 << 30)) < int(sample_rows / n * (1 << 30)))
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # at most about sample_rows rows: a bound by parameter
    joined = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(labels), "doc_id")
    return joined.groupBy("text").agg(F.max("toxic").alias("toxic"))


def select_grams(sample: DataFrame, min_docs: int = MIN_DOCS, min_z: float = MIN_Z,
                 max_grams: int = MAX_GRAMS) -> list[tuple[int, bool]]:
    """(hashed n-gram, goes with toxic rows), strongest first."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, t = np.zeros(DIMS, np.int64), np.zeros(DIMS, np.int64)
        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                at = np.unique(grams(text))
                n[at] += 1
                t[at] += int(toxic > 0)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"gram": at, "n": n[at], "t": t[at]})

    total = sample.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("toxic") > 0).cast("int")).alias("t")).first()
    if not total["n"] or not total["t"] or total["t"] == total["n"]:
        return []
    p = total["t"] / total["n"]
    z = (F.col("t") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    rows = (sample.mapInPandas(count, "gram int, n long, t long").groupBy("gram")
            .agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
            .filter(F.col("n") >= min_docs).withColumn("z", z).filter(F.abs("z") >= min_z)
            .orderBy(F.abs("z").desc(), "gram").limit(max_grams).collect())
    return [(r["gram"], r["z"] > 0) for r in rows]


def _sample_features(sample: DataFrame, model: Model) -> list:
    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [model.features(t) for t in pdf["text"]]
            yield pd.DataFrame({"slots": [g[0].astype(np.int32) for g in got], "density": [g[1] for g in got], "toxic": pdf["toxic"] > 0})
    return sample.mapInPandas(extract, "slots array<int>, density double, toxic boolean").collect()


def fit(rows: list, model: Model, grades: int = GRADES, steps: int = 400, l2: float = L2) -> Model:
    """Fill in weights and thresholds by full-batch Adam on the cumulative-link likelihood."""
    rows = sorted(rows, key=lambda r: (r["toxic"], r["density"], r["slots"]))
    dense = np.array([r["density"] for r in rows])
    toxic = np.array([r["toxic"] for r in rows])
    edges = np.quantile(dense[toxic], [k / (grades - 1) for k in range(1, grades - 1)])
    y = np.where(toxic, 1 + np.searchsorted(edges, dense, side="left"), 0)
    at = np.repeat(np.arange(len(rows)), [len(r["slots"]) for r in rows])
    slot = np.array([s for r in rows for s in r["slots"]], np.int64)
    m, n = len(model.toxic), len(rows)
    # parameters: feature weights, density weight, first threshold, log gaps
    x = np.zeros(m + 1 + grades - 1)
    x[m + 1] = 2.0
    mom, vel = np.zeros_like(x), np.zeros_like(x)
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -500, 500)))
    for step in range(1, steps + 1):
        gaps = np.exp(x[m + 2:])
        theta = x[m + 1] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(at, x[slot], minlength=n) + x[m] * dense
        bounds = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = sig(bounds[y + 1] - score), sig(bounds[y] - score)   # P(grade <= y), P(grade < y)
        prob = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / prob, lo * (1 - lo) / prob
        g_score = (d_hi - d_lo) / n                                   # of the mean negative log likelihood
        g_theta = np.array([(d_lo[y == k + 1].sum() - d_hi[y == k].sum()) / n for k in range(grades - 1)])
        grad = np.concatenate([np.bincount(slot, g_score[at], minlength=m), [g_score @ dense], [g_theta.sum()],
                               [gaps[k] * g_theta[k + 1:].sum() for k in range(grades - 2)]])
        grad[:m] += l2 * x[:m]
        mom, vel = 0.9 * mom + 0.1 * grad, 0.99 * vel + 0.01 * grad**2
        x = x - 0.1 * (mom / (1 - 0.9**step)) / (np.sqrt(vel / (1 - 0.99**step)) + 1e-9)
    model.weights = x[:m + 1]
    model.thetas = x[m + 1] + np.concatenate([[0.0], np.cumsum(np.exp(x[m + 2:]))])
    return model


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Model from (doc_id, text) and (doc_id, toxic), or None without both kinds of labels."""
    sample = staged(labelled_sample(docs, labels, sample_rows), "tox-sample")
    chosen = select_grams(sample)
    counts = sample.agg(F.max("toxic").alias("hi")).first()
    if counts["hi"] is None or counts["hi"] <= 0:
        return None
    slots = np.full(DIMS, -1, np.int16)
    slots[[g for g, _ in chosen]] = np.arange(len(chosen))
    model = Model(slots, np.array([t for _, t in chosen], bool), np.zeros(0), np.zeros(0))
    return fit(_sample_features(sample, model), model)


def severity(model: Model | None):
    """Pandas UDF: text -> (expected severity, most likely grade)."""
    @F.pandas_udf("expected_severity double, grade int")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            if model is None:
                yield pd.DataFrame({"expected_severity": np.zeros(len(texts)), "grade": np.zeros(len(texts), np.int32)})
                continue
            w = model.weights
            s = np.zeros(len(texts))
            for i, t in enumerate(texts):
                present, density = model.features(t)
                s[i] = w[present].sum() + w[-1] * density
            tail = model.tail(s)
            edge = np.concatenate([np.ones((len(s), 1)), tail, np.zeros((len(s), 1))], axis=1)
            yield pd.DataFrame({"expected_severity": tail.sum(axis=1),
                                "grade": np.argmax(edge[:, :-1] - edge[:, 1:], axis=1).astype(np.int32)})
    return score


def score_documents(docs: DataFrame, model: Model | None, reject: float = REJECT) -> DataFrame:
    """``docs`` with expected_severity, grade and toxic (severity of ``reject`` or more)."""
    s = free_name(docs, "_s")
    out = docs.withColumn(s, severity(model)(F.col("text")))
    out = out.withColumn("expected_severity", F.col(s)["expected_severity"]).withColumn("grade", F.col(s)["grade"])
    return out.withColumn("toxic", F.col("expected_severity") >= reject).drop(s)


@register("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, grade and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")
