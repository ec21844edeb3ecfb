"""Language ID: averaged hashed subword embeddings and a linear softmax, trained by stochastic gradient descent in numpy.

The subwords of a text are its byte n-grams of 2, 3 and 4; each hashes to one row of an embedding table, the text's vector
is the mean of its rows, and a linear layer gives the languages. As both are linear, a trained model is one table of
bucket -> logits, and a whole text is scored by gathering and summing its rows. A temperature fitted on documents that the
gradient hasn't seen calibrates the probabilities, and the same documents give the score below which a prediction is
rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from memoglyph.llm.common import arrow_columns, checkpointed, is_held_out, joined_small, string_buffers, table

#: Documents of each language that a model is trained on, and segments of them in an epoch, at most.
PER_LANGUAGE = 300
GRAMS = (2, 3, 4)
BUCKETS, DIMENSIONS = 1 << 15, 16
SEGMENT_BYTES, SEGMENTS, BATCH, EPOCHS, RATE = 240, 1500, 64, 3, 20.0
#: Predictions are accepted from the score that keeps this share of them right on unseen documents.
PRECISION = 0.99
#: Bytes handled at once.
BLOCK = 1 << 20
_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def _folded(raw: np.ndarray) -> np.ndarray:
    """Lower case A-Z; every other ASCII byte is a space."""
    fold = np.arange(256, dtype=np.uint8)
    fold[:128] = 32
    fold[97:123] = np.arange(97, 123)
    fold[65:91] = np.arange(97, 123)
    return fold[raw]


def _buckets(folded: np.ndarray, gram: int) -> np.ndarray:
    """The bucket of the n-gram at each position but the last gram - 1."""
    n = max(0, len(folded) - gram + 1)
    value = np.zeros(n, np.uint32)
    for k in range(gram):
        value = (value << np.uint32(8)) | folded[k : k + n]
    value = (value + np.uint32(gram * 0x51ED270B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x85EBCA77)
    return (value >> np.uint32(17)).astype(np.int32)


def logits_of(raw: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The mean table row of each whole text's n-grams (zero without any), one text never touching another."""
    n, width = len(offsets) - 1, rows.shape[1]
    sums, counts = np.zeros((n, width)), np.zeros(n)
    none = np.vstack([rows, np.zeros((1, width), rows.dtype)])
    folded = _folded(raw)
    lengths = np.diff(offsets)
    for g in GRAMS:
        counts += np.maximum(0, lengths - g + 1)
    for start in range(0, len(raw), BLOCK):
        stop = min(len(raw), start + BLOCK)
        first = int(np.searchsorted(offsets, start, "right")) - 1
        last = int(np.searchsorted(offsets, stop, "left"))
        edges = np.clip(offsets[first : last + 1], start, stop) - start
        some = np.flatnonzero(np.diff(edges))
        for g in GRAMS:
            at = _buckets(folded[start : min(len(raw), stop + g - 1)], g)[: stop - start]
            if len(at) < stop - start:
                at = np.append(at, np.full(stop - start - len(at), BUCKETS, np.int32))
            ends = offsets[first + 1 : last + 1]
            for k in range(1, g):  # n-grams that would run over a text's end
                over = ends - k - start
                at[over[(over >= 0) & (over < stop - start)]] = BUCKETS
            sums[first + some] += np.add.reduceat(none[at], edges[some], axis=0)
    return sums / np.maximum(counts, 1)[:, None]


class Model:
    """languages; rows: bucket -> logits; bias; temperature; accept: the least accepted score."""

    def __init__(self, languages, rows, bias, temperature=1.0, accept=0.0):
        self.languages, self.rows, self.bias, self.temperature, self.accept = languages, rows, bias, temperature, accept

    def probabilities(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = (logits_of(raw, offsets, self.rows) + self.bias) * self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def sample(docs: DataFrame, per_language: int) -> list[tuple[str, str]]:
    """(lang, whole text) of at most per_language documents of each language that may be learnt from, by hash order.

    Counts of the languages first give each one a hash below which about twice as many lie, so that few rows are ranked and
    no task gets a language whole. Of rows of one id the smallest by language and text counts; other columns aren't read.
    """
    own = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out("doc_id", 3, 1))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    counts = own.groupBy("lang").count()
    below = checkpointed(counts.select("lang", F.ceil(F.lit(float(1 << 40)) * F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.col("count"))).alias("below")))
    ids = joined_small(own.select("doc_id", "lang", draw.alias("draw")), below, ["lang"], "inner").where(F.col("draw") < F.col("below")).groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("draw").alias("draw"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("draw", "doc_id"))
    chosen = checkpointed(ids.withColumn("rank", rank).where(F.col("rank") <= per_language).select("doc_id"))
    rows = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x")).select("doc_id", "x.lang", "x.text").toArrow()
    return [(x[1], x[2]) for x in sorted(zip(*(rows[c].to_pylist() for c in ("doc_id", "lang", "text")), strict=True))]


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of the non-null languages of docs, from a bounded sample; None if there are none."""
    rows = sample(docs, per_language)
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    code = {lang: k for k, lang in enumerate(languages)}
    train = [r for i, r in enumerate(rows) if i % 5 or len(rows) < 10]
    unseen = [r for i, r in enumerate(rows) if i % 5 == 0] or rows
    pieces, y = [], []
    for lang, text in train:
        raw = text.encode()
        for i in range(0, len(raw), SEGMENT_BYTES):
            pieces.append(raw[i : i + SEGMENT_BYTES])
            y.append(code[lang])
    y = np.array(y)
    rng = np.random.default_rng(7)
    table_, out, bias = (rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32), np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32))
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    per = [np.flatnonzero(y == k) for k in range(len(languages))]
    for epoch in range(EPOCHS):
        order = rng.permutation(np.concatenate([rng.permutation(p)[:SEGMENTS] for p in per]))
        rate = RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(order), BATCH):
            batch = order[i : i + BATCH]
            x = np.zeros((len(batch), BUCKETS), np.float32)
            for r, j in enumerate(batch):
                if j not in found:
                    found[j] = _counts(pieces[j])
                at, share_ = found[j]
                x[r, at] = share_
            used = np.unique(np.concatenate([found[j][0] for j in batch]))
            x = x[:, used]
            hidden = x @ table_[used]
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p /= len(batch)
            slope = x.T @ (p @ out.T)
            out -= rate * (hidden.T @ p)
            bias -= 0.1 * p.sum(axis=0)
            table_[used] -= rate * slope
    model = Model(languages, (table_ @ out).astype(np.float32), bias)
    raw, offsets = string_buffers(pa.array([t for _, t in unseen], pa.string()))
    z, want = logits_of(raw, offsets, model.rows) + bias, np.array([code[lang] for lang, _ in unseen])

    # smoothed targets, so that a sample without errors doesn't ask for certainty
    goal = np.full(z.shape, 1 / (len(want) + 2) / max(1, len(languages) - 1))
    goal[np.arange(len(want)), want] = 1 - 1 / (len(want) + 2)

    def loss(t):
        s = z * t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - (goal * s).sum(axis=1)))

    model.temperature = min((float(t) for t in np.geomspace(0.05, 20, 80)), key=loss)
    p = model.probabilities(raw, offsets)
    best, right = p.max(axis=1), p.argmax(axis=1) == want
    order = np.argsort(-best, kind="stable")
    kept = np.flatnonzero(np.cumsum(right[order]) >= PRECISION * np.arange(1, len(order) + 1))
    model.accept = float(best[order[kept[-1]]]) if len(kept) else 1.0
    return model


def _counts(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    folded = _folded(np.frombuffer(piece, np.uint8))
    at, n = np.unique(np.concatenate([_buckets(folded, g) for g in GRAMS]), return_counts=True)
    return at, (n / max(1, n.sum())).astype(np.float32)


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and accepted, of each whole text, in one pass without a shuffle.

    A null text, or one without a letter (or any text, where no language could be learnt), is `und` with score 0 and not
    accepted. accepted says whether the score reaches the calibrated one. The model (a few MB) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def step(texts: pa.Array):
            raw, offsets = string_buffers(texts)
            ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128)
            upto = np.concatenate([[0], np.cumsum(ascii_letter)])
            letters = upto[offsets[1:]] > upto[offsets[:-1]]
            for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
                letters[i] = bool(_LETTER.search(raw[offsets[i] : offsets[i + 1]].tobytes().decode()))
            if own is None:
                letters[:] = False
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            else:
                p = own.probabilities(raw, offsets)
                best, score = p.argmax(axis=1), p.max(axis=1)
            score = np.where(letters, score, 0.0)
            names = [own.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
            accepted = letters & (score >= (own.accept if own else 2))
            return [pa.array(names, pa.string()), pa.array(score), pa.array(accepted)]

        return step

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    return arrow_columns(docs, [text], fields, make, keep)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents: doc_id, held_out, lang_pred, score, accepted."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    found = predict(docs, fit(docs), keep=["doc_id"])
    return found.select("doc_id", is_held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "accepted")
