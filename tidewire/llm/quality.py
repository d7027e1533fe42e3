"""Quality by compression: which of two zstandard dictionaries, of good and of bad text, packs a text tighter."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import calibrate
from tidewire.llm.common import id_text, labelled_sample
from tidewire.session import ship_package

MAX_ROWS = 6_000
DICT_BYTES = 64 << 10
TRAIN_BYTES = 4 << 20
BLOCK = 2048
LEVEL = 3
THRESHOLD = 0.5
NEUTRAL = np.zeros(4)


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


class _Packer:
    """Both compressors. They are made once for each task, as they cannot be sent."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.good, self.bad = self._compressor(good), self._compressor(bad)
        self.plain = zstandard.ZstdCompressor(level=LEVEL)

    @staticmethod
    def _compressor(data: bytes):
        if not data:
            return zstandard.ZstdCompressor(level=LEVEL)
        packed = zstandard.ZstdCompressionDict(data)
        packed.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=packed, write_content_size=False, write_dict_id=False)

    def features(self, text: str) -> tuple[float, float, float]:
        """(normalised size difference, its lowest value in a block, packed share of the raw size); zeros if empty.

        Every block of the whole text is compressed by itself, so that the dictionaries count all along.
        """
        data = text.encode()
        good = bad = own = 0
        low = 1.0
        for start in range(0, len(data), BLOCK):
            block = data[start:start + BLOCK]
            g, b = len(self.good.compress(block)), len(self.bad.compress(block))
            good, bad = good + g, bad + b
            own += len(self.plain.compress(block))
            if len(block) >= BLOCK // 8 or start == 0:
                low = min(low, (b - g) / (b + g))
        if not data:
            return 0.0, 0.0, 0.0
        return (bad - good) / (bad + good), low, own / len(data)


def _dictionary(texts: list[str]) -> bytes:
    pieces, total = [], 0
    for t in texts:
        data = t.encode()
        for start in range(0, len(data), BLOCK):
            if total >= TRAIN_BYTES:
                break
            pieces.append(data[start:start + BLOCK])
            total += len(pieces[-1])
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, total // 4)), pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(pieces)[-DICT_BYTES:]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> QualityModel:
    """Fit on at most ``max_rows`` labelled rows that are not held out, and ``TRAIN_BYTES`` of text for each class.

    Half of the rows, by turns, make the dictionaries, the other half the calibration. With one class only, or
    none, every score is one half.
    """
    rows = sorted((r.id, r.text, r.y) for r in labelled_sample(docs, labels, "quality", max_rows).collect())
    if len({y for _, _, y in rows}) < 2:
        return QualityModel(b"", b"", tuple(NEUTRAL))
    sides = [[r for r in rows if r[2] == y] for y in (1, 0)]
    good, bad = (_dictionary([t for _, t, _ in side[::2] or side]) for side in sides)
    packer = _Packer(good, bad)
    rest = [r for side in sides for r in (side[1::2] or side)]
    x = np.array([packer.features(t) for _, t, _ in rest])
    return QualityModel(good, bad, tuple(calibrate.fit(x, np.array([y for *_, y in rest], dtype=float), NEUTRAL)))


def _score(batches: Iterator[pa.RecordBatch], model: QualityModel) -> Iterator[pa.RecordBatch]:
    packer, weights = _Packer(model.good, model.bad), np.array(model.weights)
    for batch in batches:
        x = np.array([packer.features(t.as_py()) for t in batch.column("text")]).reshape(-1, 3)
        yield pa.record_batch({"id": batch.column("id"), "score": calibrate.predict(weights, x), "difference": x[:, 0].copy()})


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, difference, predicted) for each row; ``score`` is the chance of good quality.

    An empty or null text has difference 0 and the score that the model gives to that. Only the text is looked at.
    """
    scored = id_text(docs, id_col, text_col).mapInArrow(lambda b: _score(b, model), "id bigint, score double, difference double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_rows(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns; a null text counts as empty."""
    ship_package()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, weights = _Packer(model.good, model.bad), np.array(model.weights)
        for batch in batches:
            x = np.array([packer.features(t.as_py() or "") for t in batch.column(text_col)]).reshape(-1, 3)
            yield batch.filter(pa.array(calibrate.predict(weights, x) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
