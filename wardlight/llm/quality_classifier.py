"""Quality scores from zstandard dictionaries of good and of bad text.

Two dictionaries are trained on pieces of labelled texts. Every text is cut into
pieces, each piece is compressed with either dictionary, and the sizes are added
up over the whole text. The normalised difference (good - bad) / (good + bad) is
low for text that resembles the good dictionary. A logistic curve fitted on
other labelled texts turns the difference, damped for short texts and beside the
packed density, into a score from 0 to 1.

Training looks at bounded samples (`PIECES` pieces per dictionary, from
`CALIBRATION_TEXTS` texts, and as many to calibrate), chosen by a hash of the document id. Every row is scored, whole.

Null and empty texts, and every text while one class has no labelled text, get the
share of good texts in the calibration sample, or 0.5 where that is empty. A very long text is
compressed piece by piece. Rows that repeat are scored one by one and alike; an empty table of
documents gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import stored

#: Characters of a piece.
PIECE_CHARS = 512
#: Pieces from which each dictionary is trained, at most.
PIECES = 6000
DICTIONARY_BYTES = 112_640
#: Labelled texts for each dictionary, and for the calibration, at most about.
CALIBRATION_TEXTS = 6000
LEVEL = 3
#: Steps of the shares that are drawn.
_DRAWS = 1 << 20


def _features(measured: np.ndarray) -> np.ndarray:
    """What the logistic curve sees of (difference, packed bytes per byte, bytes) rows.

    The damped columns let texts of a few bytes stay near the prior, and the
    density tells repetition, which both dictionaries pack equally well.
    """
    difference, density, size = measured.T
    damp = np.minimum(size, 400.0) / 400.0
    return np.column_stack(
        [np.ones_like(damp), damp, difference, difference * damp, density * damp, density**2 * damp]
    )


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: np.ndarray
    prior: float
    _packers: list = field(default_factory=list)

    def __getstate__(self):
        return {**self.__dict__, "_packers": []}

    def measure(self, text: str) -> tuple[float, float, int]:
        """Normalised difference, packed bytes per byte and UTF-8 length of a text."""
        if not self._packers:
            self._packers = [
                zstandard.ZstdCompressor(
                    dict_data=zstandard.ZstdCompressionDict(own),
                    level=LEVEL,
                    write_content_size=False,
                    write_dict_id=False,
                )
                for own in (self.good, self.bad)
            ]
        by_good = by_bad = size = 0
        good, bad = self._packers
        for start in range(0, len(text), PIECE_CHARS):
            piece = text[start : start + PIECE_CHARS].encode("utf-8", "replace")
            by_good += len(good.compress(piece))
            by_bad += len(bad.compress(piece))
            size += len(piece)
        both = by_good + by_bad
        return (by_good - by_bad) / max(both, 1), both / max(2 * size, 1), size

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.good:
            return np.full(len(texts), self.prior)
        measured = np.array([self.measure(text) for text in texts], float).reshape(-1, 3)
        logit = np.clip(_features(measured) @ self.weights, -30, 30)
        return np.where(measured[:, 2] > 0, 1 / (1 + np.exp(-logit)), self.prior)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Newton's iteration for a few weights; the ridge keeps separable data finite."""
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (y - p) - ridge * weights
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(weights))
        step = np.linalg.solve(hessian, gradient)
        weights = weights + np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit(
    docs: DataFrame, labels: DataFrame, pieces: int = PIECES, sample_texts: int = CALIBRATION_TEXTS
) -> QualityModel:
    """A model from docs (doc_id, text) and labels (doc_id, quality 0 or 1); other labels teach nothing.

    Half of the labelled documents, by a hash of their id, build the dictionaries, the
    other half calibrates. The documents are drawn from the labels alone, at most about
    `sample_texts` for each dictionary and for the calibration, so that the ids that
    meet the documents are few whatever the corpus, and no text is shuffled.
    """
    known = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("draw"))
        .where("quality IN (0, 1) AND doc_id IS NOT NULL")
        .withColumn("part", F.pmod("draw", F.lit(2)))
    )
    counts = {(r["part"], r["quality"]): r["count"] for r in known.groupBy("part", "quality").count().collect()}
    calibrating = sum(n for (part, _), n in counts.items() if part == 1)
    limit = F.lit(0)
    for (part, quality), n in counts.items():
        share = min(1.0, sample_texts / (n if part == 0 else calibrating))
        limit = F.when(
            (F.col("part") == part) & (F.col("quality") == quality), F.lit(int(share * _DRAWS))
        ).otherwise(limit)
    chosen = known.where(F.pmod(F.xxhash64("draw"), F.lit(_DRAWS)) < limit)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text <> ''")
    rows = stored(
        texts.join(F.broadcast(chosen), "doc_id").select("text", "quality", "draw", "part"), "quality-training"
    )
    cut = F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / PIECE_CHARS).cast("int"))
    samples = {}
    for label in (0, 1):
        cuts = rows.where(f"part = 0 AND quality = {label}").select("text", "draw", F.explode(cut).alias("at"))
        share = min(1.0, pieces / max(cuts.count(), 1))
        part = cuts.where(F.pmod(F.xxhash64("draw", "at"), F.lit(_DRAWS)) < int(share * _DRAWS)).select(
            F.substring("text", F.col("at") * PIECE_CHARS + 1, F.lit(PIECE_CHARS)).alias("piece")
        )
        samples[label] = sorted(row["piece"].encode() for row in part.collect())
    calibration = rows.where("part = 1").select("text", "quality")
    share = calibration.agg(F.avg("quality")).first()[0]
    model = QualityModel(b"", b"", np.zeros(0), 0.5 if share is None else float(share))
    if len(samples[0]) < 8 or len(samples[1]) < 8 or share in (None, 0.0, 1.0):
        return model
    size = min(DICTIONARY_BYTES, min(sum(map(len, own)) for own in samples.values()) // 2)
    model.good, model.bad = (_dictionary(samples[label], size) for label in (1, 0))
    measured = calibration.select("text", "quality").mapInArrow(
        _measurer(model), "difference double, density double, size double, quality int"
    ).toPandas().to_numpy(float)
    model.weights = _logistic(_features(measured[:, :3]), measured[:, 3])
    return model


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(max(size, 1024), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-max(size, 1024) :]


def _measurer(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([model.measure(t) for t in batch.column("text").to_pylist()], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(found[:, i]) for i in range(3)), batch.column("quality")],
                names=["difference", "density", "size", "quality"],
            )

    return run


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores([text or "" for text in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double"
    )
