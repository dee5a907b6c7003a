"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (P) and unlabelled ones (U) train a linear classifier g on the
presence of words and of letter runs inside words. The risk of negatives is estimated as
the risk over U less the class prior times the risk over P; where that difference turns
negative it is not followed further but stepped back from, so the classifier can't gain
by overfitting P. The prior is the share of toxic rows among the training labels.

Fitting uses at most ``max_positive`` and ``max_unlabelled`` documents picked by hash, whole
and of any length, until ``labelled.SAMPLE_BYTES`` are reached; scoring takes every whole text. Defined cases: null and empty texts score the classifier's
bias; without any toxic training label every text scores 0; equal texts score alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfree.llm.common import documents, id_crc, lower_words
from stepfree.llm.labelled import hashed_first, labelled_ids, sample_texts

EDGES = b".,!?;:\"()*$%&#|'"
RUN = (4, 5, 6)
#: Distinct words whose features a scoring task remembers.
CACHED_WORDS = 300_000


def word_features(word: bytes) -> set[bytes]:
    """The word without marks at its edges, and its runs of RUN letters (bytes)."""
    word = word.strip(EDGES)
    out = {b"=" + word} if word else set()
    for n in RUN:
        out.update(word[i : i + n] for i in range(len(word) - n + 1))
    return out


def text_features(text: str | None) -> set[bytes]:
    out: set[bytes] = set()
    for w in set(lower_words(text)):
        out |= word_features(w)
    return out


@dataclass
class LinearModel:
    """score = sigmoid(scale * (bias + sum of the weights of the features present))."""

    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -30.0
    cache: dict[bytes, frozenset] = field(default_factory=dict)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        known, weights, out = self.cache, self.weights, np.empty(len(texts))
        for i, text in enumerate(texts):
            present: set[bytes] = set()
            for w in set(lower_words(text)):
                hit = known.get(w)
                if hit is None:
                    hit = known[w] = frozenset(x for x in word_features(w) if x in weights)
                if hit:
                    present |= hit
            out[i] = self.bias + sum(map(weights.__getitem__, sorted(present)))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def choose_features(positive: list[str], unlabelled: list[str], most: int) -> list[bytes]:
    """Features that are commoner in P than in U, by how many standard errors; of those in the same texts of P the longest.

    Texts are gone through twice, so that only counts and a shortlist are held at a time.
    """
    p, u = Counter(), Counter()
    for t in positive:
        p.update(text_features(t))
    p = Counter({x: c for x, c in p.items() if c >= max(3, 0.004 * len(positive))})
    for t in unlabelled:
        u.update(text_features(t) & p.keys())
    n, m = max(1, len(positive)), max(1, len(unlabelled))
    lift = {}
    for x, c in p.items():
        q = (u[x] + 1) / (m + 2)
        lift[x] = (c / n - q) / np.sqrt(q * (1 - q) / n)
    wide = [x for x in sorted(lift, key=lambda x: (-lift[x], -len(x), x)) if lift[x] > 4][: 20 * most]
    held: dict[bytes, list[int]] = {x: [] for x in wide}
    for i, t in enumerate(positive):
        for x in text_features(t) & held.keys():
            held[x].append(i)
    first: dict[tuple, bytes] = {}
    for x in wide:
        first.setdefault(tuple(held[x]), x)
    return list(first.values())[:most]


def risk_gradient(p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """The direction to step against, and the risk of negatives, R_u- - prior * R_p-; where that is below 0 it alone is raised."""
    sp, su = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) for x in (p, u))
    # loss of label y is sigmoid(-y g); both losses have the slope s (1 - s)
    dp = p.T @ (sp * (1 - sp)) / len(p)
    du = u.T @ (su * (1 - su)) / len(u)
    negative = su.mean() - prior * sp.mean()
    return (-prior * dp + (du - prior * dp) if negative >= 0 else -(du - prior * dp)), float(negative)


def train_nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 1000, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise prior * R_p+ + max(0, R_u- - prior * R_p-) with the sigmoid loss, by Adam."""
    d = p.shape[1]
    w = np.zeros(d + 1)
    p1, u1 = np.c_[p, np.ones(len(p))], np.c_[u, np.ones(len(u))]
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, steps + 1):
        grad = risk_gradient(p1, u1, w, prior)[0] + decay * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(positive: list[str], unlabelled: list[str], prior: float, most: int = 400) -> LinearModel:
    if not positive or not unlabelled or prior <= 0:
        return LinearModel()
    chosen = choose_features(positive, unlabelled, most)
    place = {x: i for i, x in enumerate(chosen)}

    def matrix(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(chosen)), np.float32)
        for i, t in enumerate(texts):
            out[i, [place[x] for x in text_features(t) & place.keys()]] = 1
        return out

    w, bias = train_nnpu(matrix(positive), matrix(unlabelled), prior)
    return LinearModel(dict(zip(chosen, w.tolist(), strict=True)), bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, max_positive: int = 2000, max_unlabelled: int = 3000) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (score >= 0.5).

    Rows whose crc32(doc_id) mod 5 is 0 are held out: neither their labels nor their texts are learned from.
    """
    train = id_crc(F.col("doc_id")) % 5 != 0
    counts = labels.where(train & F.col("toxic").isNotNull()).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    positive = [t for _, _, t in sample_texts(docs, labelled_ids(labels, "toxic", 1, train, max_positive))]
    some = hashed_first(docs.where(train & F.col("doc_id").isNotNull()).select("doc_id"), max_unlabelled, 11).select("doc_id", F.lit(-1).alias("label"), "place")
    unlabelled = [t for _, _, t in sample_texts(docs, some)]
    model = docs.sparkSession.sparkContext.broadcast(fit(positive, unlabelled, float(counts or 0)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "held_out")], pa.array(model.value.score(batch.column("text").to_pylist()))], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", (~train).alias("held_out"), "text").mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
