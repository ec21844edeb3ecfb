"""Quality by compression: one zstandard dictionary of good and one of bad text.

A text is cut into blocks, and each is compressed with either dictionary; text that looks like the good sample shrinks
more with the good dictionary. The difference of the two sizes over their sum, and how far the text shrinks at all, go
through a logistic calibration that was fitted on labelled texts of which neither dictionary has seen anything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from memoglyph.llm.common import arrow_columns, fitting, is_held_out, labelled_sample, logistic, sigmoid, string_buffers, table

#: Labelled documents of each class that a model is fitted on, at most.
PER_CLASS = 1500
DICTIONARY_BYTES, BLOCK_BYTES, LEVEL = 1 << 16, 1024, 3


def _blocks(text: bytes, most: int):
    return [text[i : i + most] for i in range(0, len(text), most)]


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; of a few texts, which can't be trained on, their bytes."""
    samples = [b for t in texts for b in _blocks(t, 2 * BLOCK_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class CompressionModel:
    """good, bad: dictionaries; weights: of the difference, of the shrinkage, and the bias."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray | None = None):
        self.good, self.bad, self.weights = good, bad, weights

    def opened(self):
        def one(raw: bytes):
            kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            found = zstandard.ZstdCompressionDict(raw, dict_type=kind)
            found.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=found, write_content_size=False, write_checksum=False)

        plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        return one(self.good) if self.good else plain, one(self.bad) if self.bad else plain

    @staticmethod
    def features(compressors, text: bytes) -> tuple[float, float]:
        """(difference of the sizes over their sum, log of the mean size over the text's); of the whole text."""
        good, bad = compressors
        blocks = _blocks(text, BLOCK_BYTES) or [b""]
        a = sum([len(good.compress(b)) for b in blocks])
        b = sum([len(bad.compress(b)) for b in blocks])
        return (a - b) / (a + b), float(np.log((a + b) / 2 / (len(text) + 8)))


@fitting
def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> CompressionModel:
    """A model of labels.quality, from at most per_class documents of each class outside the held-out quarter.

    Two thirds of the sample make the dictionaries, the rest the calibration. One class alone, or none, gives a constant.
    """
    texts, y, weight = labelled_sample(docs, labels, "quality", per_class)
    raw = [t.encode() for t in texts]
    for_dictionary = np.arange(len(y)) % 3 != 0
    good, bad = (_dictionary([raw[i] for i in np.flatnonzero(for_dictionary & (y == k))]) for k in (1, 0))
    model = CompressionModel(good, bad)
    compressors = model.opened()
    rest = np.flatnonzero(~for_dictionary)
    features = np.array([model.features(compressors, raw[i]) for i in rest]).reshape(len(rest), 2)
    model.weights = logistic(features, y[rest], weight[rest], l2=1e-6)
    return model


def score(docs: DataFrame, model: CompressionModel, keep: list[str] | None = None, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score of 0 to 1 for each whole text, higher if good is likelier; null and empty texts are scored as empty.

    One pass without a shuffle; the model (two dictionaries of 64 KB) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.good, model.bad, model.weights))

    def make():
        own = CompressionModel(*shared.value)
        compressors = own.opened()

        def step(texts: pa.Array):
            raw, offsets = string_buffers(texts)
            whole = raw.tobytes()
            x = np.array([own.features(compressors, whole[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]).reshape(len(texts), 2)
            return [pa.array(sigmoid(x @ own.weights[:-1] + own.weights[-1]))]

        return step

    return arrow_columns(docs, [text], [T.StructField(out, T.DoubleType())], make, keep)


#: A text of this score or more counts as good.
GOOD_FROM = 0.7


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text of documents: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    scored = score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", is_held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))
