"""Quality classifier by compression.

Two zstandard dictionaries are built from labelled text, one from good and one from bad
documents. A text is cut into blocks, every block is compressed with each dictionary, and
(bytes with the bad one - bytes with the good one) / (their sum) tells which side it
resembles. A logistic curve fitted on labelled documents that built no dictionary turns
this into a score.

Fitting uses at most ``per_class`` documents of each label picked by hash, whole and of any
length, until ``labelled.SAMPLE_BYTES`` are reached; scoring takes every whole text. Defined cases: null and empty texts have difference 0; where a label is
missing from the training rows, every score is the share of good rows there; equal texts
score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfree.llm.common import documents, id_crc
from stepfree.llm.labelled import labelled_ids, sample_texts

BLOCK = 4096
DICTIONARY = 112_640
LEVEL = 3


def build_dictionary(texts: list[str]) -> bytes:
    """Dictionary bytes from blocks of the texts; too little text for the trainer is taken as it is."""
    blocks = [b for t in texts for b in blocks_of(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY:]


def blocks_of(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


class TwoSided:
    """The two dictionaries ready for use."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.sides = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self.sides.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def difference(self, text: str | None) -> float:
        """-1 to 1; above 0 when the good dictionary makes the text smaller."""
        blocks = blocks_of(text)
        good, bad = (sum(len(side.compress(b)) for b in blocks) for side in self.sides)
        return (bad - good) / (bad + good) if blocks else 0.0


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a little shrinkage, on standardised x."""
    mean, scale = x.mean(), x.std() or 1.0
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-6]) + 1e-9 * np.eye(2)
        w -= np.clip(np.linalg.solve(hess, a.T @ (p - y) + np.array([1e-2, 0]) * w), -4, 4)
    return w[0] / scale, w[1] - w[0] * mean / scale


_READY: dict[int, TwoSided] = {}


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> DataFrame:
    """One row per input row: doc_id, held_out, difference, score, predicted (score >= 0.7).

    Rows whose crc32(doc_id) mod 4 is 2 are held out: their labels are not learned from.
    """
    train = id_crc(F.col("doc_id")) % 4 != 2
    share = labels.where(train & F.col("quality").isNotNull()).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    sample = {q: [t for _, _, t in sample_texts(docs, labelled_ids(labels, "quality", q, train, per_class))] for q in (0, 1)}
    share = 0.5 if share is None else float(share)
    if min(map(len, sample.values())) < 2:
        good = bad = b""
        slope, intercept = 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    else:
        good, bad = (build_dictionary(sample[q][::2]) for q in (1, 0))
        sides = TwoSided(good, bad)
        rest = [(sides.difference(t), q) for q in (0, 1) for t in sample[q][1::2]]
        x, y = np.array([r[0] for r in rest]), np.array([r[1] for r in rest], float)
        slope, intercept = fit_logistic(x, y)
        # classes were drawn apart: bring the odds back to those of the training labels
        drawn = y.mean()
        intercept += float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)) - np.log(drawn / (1 - drawn)))
    held = docs.sparkSession.sparkContext.broadcast((good, bad, slope, intercept))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad, slope, intercept = held.value
        key = hash((good, bad))
        if key not in _READY:
            _READY.clear()
            _READY[key] = TwoSided(good, bad)
        sides = _READY[key]
        for batch in batches:
            diff = np.array([sides.difference(t) for t in batch.column("text").to_pylist()], float)
            score = 1 / (1 + np.exp(-np.clip(slope * diff + intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(diff), pa.array(score)], ["doc_id", "held_out", "difference", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", (~train).alias("held_out"), "text").mapInArrow(scored, f"doc_id {kind}, held_out boolean, difference double, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op9_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "held_out", "score", "predicted", "difference")
