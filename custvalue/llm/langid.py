"""Language identification: averaged hashed subword embeddings under a linear softmax.

``fit`` trains on a bounded, documented sample of labelled documents with stochastic gradient
descent in NumPy: each subword has an embedding, a document is their mean, and a linear softmax
names the language. A fourth of the sample is kept out of the descent and calibrates: one
temperature makes the scores probabilities, and the lowest score at which the accepted documents
reach the asked precision becomes the rejection limit. ``predict`` reads every whole text.

Defined results: a null text, an empty text and one without a letter get ``und``, score 0, and
are not accepted. Equal texts get equal results; of tied languages the first by name wins.
Documents without a language teach nothing. With one language known all texts with letters get
it; with none (or an empty table to learn from) every text gets ``und``, score 0. An empty table
gives an empty result. Other columns, whatever their names, are no input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.llm import subwords as S
from custvalue.llm.shared import named, small_batches

UNKNOWN = "und"
SAMPLE = 2000  # labelled documents to learn from, spread evenly over the languages
MAX_LANGUAGES = 1000  # the width of the softmax


@dataclass(frozen=True)
class LanguageModel:
    """``table`` holds, per bucket, its embedding times the linear layer: the mean over a
    document's subwords commutes with the layer, so this is the same model, applied once."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    limit: float

    def probabilities(self, texts) -> tuple[np.ndarray, np.ndarray]:
        mean, count = S.means(texts, self.table)
        return _softmax((mean + self.bias) / self.temperature), count


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _vectors(bits: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                bucket, share = S.bucket_counts(text.as_py(), bits)
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([lang], pa.string()),
                        "bucket": pa.array([bucket.astype("<u4").tobytes()], pa.binary()),
                        "share": pa.array([share.astype("<f4").tobytes()], pa.binary()),
                    }
                )

    return hashed


def _sample(labelled: DataFrame, id_column: str, text: str, lang: str, size: int, bits: int):
    rows = labelled.select(
        F.xxhash64(named(id_column), named(lang), F.lit(7)).alias("h"),
        named(lang).cast("string").alias("lang"),
        named(text).alias("text"),
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if not counts:
        return []
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; raise MAX_LANGUAGES to allow it")
    each = max(size // len(counts), 20)
    share = F.create_map(
        *[F.lit(x) for row in counts for x in (row["lang"], min(1.0, each / row["count"]))]
    )
    place = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(place < share[F.col("lang")]).select("lang", "text")
    # The shares make the sample about its size; the limit holds even where ids repeat.
    found = chosen.mapInArrow(
        _vectors(bits), "lang string, bucket binary, share binary"
    ).limit(2 * max(size, 20 * len(counts)))
    return sorted(tuple(row) for row in found.toLocalIterator())


def fit(
    labelled: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    sample: int = SAMPLE,
    bits: int = 14,
    width: int = 16,
    epochs: int = 12,
    rate: float = 60.0,
    precision: float = 0.99,
    seed: int = 7,
) -> LanguageModel:
    """Learn from at most about ``sample`` documents, chosen by a hash of their ids."""
    rows = _sample(labelled, id_column, text_column, lang_column, sample, bits)
    names = tuple(sorted({row[0] for row in rows}))
    if not names:
        return LanguageModel((), np.zeros((1 << bits, 1), np.float32), np.zeros(1), 1.0, 1.0)
    random = np.random.default_rng(seed)
    order = random.permutation(len(rows))
    known = [
        (names.index(rows[i][0]), np.frombuffer(rows[i][1], "<u4"), np.frombuffer(rows[i][2], "<f4"))
        for i in order
    ]
    known = [row for row in known if len(row[1])]
    kept_out = known[::4] if len(known) >= 8 * len(names) else known
    training = [row for i, row in enumerate(known) if i % 4] if kept_out is not known else known
    embedding = random.normal(0, 1 / width, (1 << bits, width))
    layer = np.zeros((width, len(names)))
    layer += random.normal(0, 1 / width, layer.shape)
    bias = np.zeros(len(names))
    steps, step = epochs * max(len(training), 1), 0
    for _ in range(epochs):
        for i in random.permutation(len(training)):
            label, bucket, share = training[i]
            now = 1 - step / steps
            mean = share @ embedding[bucket]
            slope = _softmax(mean @ layer + bias)
            slope[label] -= 1
            back = layer @ slope
            layer -= 0.3 * now * np.outer(mean, slope)
            bias -= 0.01 * now * slope
            embedding[bucket] -= (rate * now * share)[:, None] * back[None, :]
            step += 1
    table = (embedding @ layer).astype(np.float32)
    scores = np.array([share @ table[bucket] + bias for _, bucket, share in kept_out])
    truth = np.array([label for label, _, _ in kept_out])
    return LanguageModel(names, table, bias, *_calibrated(scores, truth, precision))


def _calibrated(scores: np.ndarray, truth: np.ndarray, precision: float) -> tuple[float, float]:
    """The temperature of least log loss, and the lowest limit that reaches the precision."""
    if not len(truth):
        return 1.0, 0.0

    def loss(t: float) -> float:
        return -np.log(_softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean()

    temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    p = _softmax(scores / temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-best, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= precision)
    return temperature, float(best[order[good[-1]]]) if len(good) else 1.0


def predict(
    docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per document: its id, ``lang_pred``, ``score`` (calibrated probability) and ``accepted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def named_languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.slice(low, 512)
                p, count = known.probabilities([t.as_py() for t in part.column(1)])
                best, score = p.argmax(axis=1), np.round(p.max(axis=1), 6)
                some = (count > 0) & bool(known.languages)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([known.languages[i] if s else UNKNOWN for i, s in zip(best, some)]),
                        pa.array(np.where(some, score, 0.0)),
                        pa.array(some & (score >= known.limit)),
                    ],
                    names=["doc_id", "lang_pred", "score", "accepted"],
                )

    rows = docs.select(named(id_column), named(text_column))
    kind = rows.schema[0].dataType.simpleString()
    return small_batches(rows).mapInArrow(
        named_languages, f"doc_id {kind}, lang_pred string, score double, accepted boolean"
    )
