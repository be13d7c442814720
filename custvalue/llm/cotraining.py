"""Quality classifier by co-training on two views of a document.

One classifier sees only the text's content (hashed subwords and the rule ledger's measures), the
other only the metadata (source, language, length in characters). Both start from the labelled
sample; over rounds each scores all documents without a label and labels those that it is surest
of, and these teach the *other* one. On a part of the labelled sample that was kept out, each view
is calibrated and the two are combined to one probability. All documents are then scored, whole.

The labelled sample has about ``SAMPLE`` documents, half of them good and half bad as far as there
are so many, chosen by a hash of their ids; the calibration weighs each class as in all labels.
The limit of acceptance is the probability at which, over all kept-out labelled documents, the
share of bad ones rejected less ``LOSS`` times the share of good ones rejected is greatest: losing
1 % of the good documents counts as much as keeping 5 % of the bad ones. The pool of
pseudo-labels is every document that no label names; its features are stored once and scored in
each round. Bounded is only how many pseudo-labels teach (``teach``). Documents of equal features
teach once, so a large group of copies does not use them up.

Defined results: a null text counts as empty, a null metadata value as a value of its own. Scores
are per row, so ties and repeated rows agree; a document with several labels counts as bad if any
is. With fewer than five labelled documents of a kind nothing is known: every score is the share
of good labels (1 if there are none) and every document is accepted. An empty table gives an empty table. Input
columns are kept; the result's own columns replace any of the same name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, StructField, StructType

from custvalue.llm import rules
from custvalue.llm import subwords as S
from custvalue.llm.shared import Scratch, give_back, named, small_batches, text_parts
from custvalue.llm.wordhash import per_text

SAMPLE = 3000
LOSS = 5.0
BITS = 10
_META = 8  # bits of the hashed metadata values
METADATA = ("source", "lang", "n_chars")


_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_RATIOS = 8


def content_ratios(column: pa.Array) -> np.ndarray:
    """Ratios of what the rule ledger measures, for each text."""
    parts = []
    for _, _, data, offsets in text_parts(column):
        measures = list(rules.measure(data, offsets).values())
        upper = per_text(_UPPER[data], offsets)
        marks = per_text(data == ord("!"), offsets)
        parts.append(np.stack([*measures, upper, marks], axis=1))
    m = dict(zip((*rules.MEASURES, "upper", "marks"), np.concatenate(parts).T.astype(float)))
    words, chars = m["n_words"] + 1.0, m["word_chars"] + 1.0
    ratios = [
        np.minimum(m["n_symbols"] / words, 1),
        np.minimum(m["n_repeat_words"] / words, 1),
        m["n_dup_lines"] / (m["n_lines"] + 1),
        1 - np.minimum(m["n_letters"] / chars, 1),
        np.minimum(m["word_chars"] / words / 10, 2),
        m["upper"] / (m["n_letters"] + 1),
        np.minimum(m["marks"] / words, 1),
        np.log2(words) / 16,
    ]
    return np.stack(ratios, axis=1)


def metadata_buckets(columns: list[list]) -> np.ndarray:
    """Hashed buckets of the metadata values of each row: source, language, length by its log."""
    source, lang, length = columns
    scale = [None if n is None else int(2 * np.log2(max(n, 0) + 1)) for n in length]
    values = [source, lang, scale, list(zip(lang, scale))]
    out = np.empty((len(source), len(values)), np.int64)
    for i, column in enumerate(values):
        number = {v: zlib.crc32(f"{i}|{v!r}".encode()) for v in set(column)}
        out[:, i] = [number[v] % (1 << _META) for v in column]
    return out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fitted(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float = 1e-4, steps: int = 150):
    """Weighted logistic regression by Nesterov's gradient steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weights = momentum = np.zeros(x.shape[1])
    w = w / w.sum()
    rate = 4.0 / max(float(w @ np.einsum("ij,ij->i", x, x)), 1e-9)
    for step in range(1, steps + 1):
        miss = (w * (_logistic(x @ momentum.astype(x.dtype)) - y)).astype(x.dtype)
        slope = x.T @ miss + l2 * momentum
        new = momentum - rate * slope
        momentum = new + (step - 1) / (step + 2) * (new - weights)
        weights = new
    return weights


def _scaled(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Platt's scaling: a logistic of the raw scores (columns of z), fitted on kept-out rows.

    It is fitted with equal classes, and the bias then moved to the shares that ``w`` gives them.
    """
    spread = np.maximum(z.std(axis=0), 1e-6)
    held = np.array([w[y == 0].sum(), w[y == 1].sum()])
    equal = w / held[y.astype(int)]
    weights = _fitted(z / spread, y, equal, l2=1e-3, steps=400)
    return np.append(weights[:-1] / spread, weights[-1] + np.log(held[1] / held[0]))


def best_limit(p: np.ndarray, good: np.ndarray, loss: float = LOSS) -> float:
    """The limit below which the share of bad rows less ``loss`` times that of good ones is
    greatest; of equal ones the one nearest to an even chance."""
    values = np.unique(p)
    limits = np.concatenate([[0.0], (values[1:] + values[:-1]) / 2, [(values[-1] + 1) / 2]])
    bad, fine = np.sort(p[good == 0]), np.sort(p[good == 1])
    gain = np.searchsorted(bad, limits) / len(bad) - loss * np.searchsorted(fine, limits) / len(fine)
    top = limits[gain >= gain.max() - 1e-12]
    # Any limit between two neighbouring scores does the same; an even chance, if among them.
    low, high = np.append(0.0, values), np.append(values, 1.0)
    even = int(np.searchsorted(values, 0.5))
    if gain[even] >= gain.max() - 1e-12 and low[even] < 0.5 <= high[even]:
        return 0.5
    return float(top[np.argmin(np.abs(top - 0.5))])


@dataclass(frozen=True)
class QualityModel:
    """Weights of both views, how their scores combine, and the limit of acceptance."""

    text: np.ndarray
    metadata: np.ndarray
    text_scale: np.ndarray
    metadata_scale: np.ndarray
    combined: np.ndarray
    limit: float

    def scores(self, texts: pa.Array, metadata: list[list]) -> tuple[np.ndarray, ...]:
        """Probability that a document is good: by its text, its metadata, and both."""
        buckets = 1 << BITS
        table = (self.text[:buckets, None] * _SHARE).astype(np.float32)
        mean, _ = S.means([t.as_py() for t in texts], table)
        z_text = mean[:, 0] + content_ratios(texts) * _RATIO @ self.text[buckets:-1]
        z_text += self.text[-1]
        z_meta = self.metadata[metadata_buckets(metadata)].sum(axis=1) + self.metadata[-1]
        return self.of(z_text, z_meta)

    def of(self, z_text: np.ndarray, z_meta: np.ndarray) -> tuple[np.ndarray, ...]:
        z_text = z_text * self.text_scale[0] + self.text_scale[1]
        z_meta = z_meta * self.metadata_scale[0] + self.metadata_scale[1]
        both = z_text * self.combined[0] + z_meta * self.combined[1] + self.combined[2]
        return _logistic(z_text), _logistic(z_meta), _logistic(both)


_SHARE, _RATIO = 8.0, 4.0


def _with_features(rows: DataFrame) -> DataFrame:
    """``rows`` with ``content`` and ``meta`` in place of the text and the metadata."""
    carried = [c for c in rows.columns if c != "text" and c not in METADATA]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                texts = part.column("text")
                share = S.shares([t.as_py() for t in texts], BITS).astype(np.float32)
                ratio = content_ratios(texts).astype(np.float32)
                meta = metadata_buckets([part.column(c).to_pylist() for c in METADATA])
                content = [np.concatenate(r).tobytes() for r in zip(share, ratio)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in carried],
                        pa.array(content, pa.binary()),
                        pa.array([r.astype("<i4").tobytes() for r in meta], pa.binary()),
                    ],
                    names=[*carried, "content", "meta"],
                )

    fields = [rows.schema[c] for c in carried]
    fields += [StructField(c, BinaryType()) for c in ("content", "meta")]
    return small_batches(rows).mapInArrow(features, StructType(fields))


def _matrices(content: list[bytes], meta: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Content features as the models weigh them, and the buckets of the metadata."""
    x = np.frombuffer(b"".join(content), "<f4").reshape(len(content), -1).copy()
    x[:, : 1 << BITS] *= _SHARE
    x[:, 1 << BITS :] *= _RATIO
    return x, np.frombuffer(b"".join(meta), "<i4").reshape(len(meta), -1)


def _views(content: list[bytes], meta: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    if not content:
        width = (1 << BITS) + _RATIOS
        return np.zeros((0, width), np.float32), np.zeros((0, 1 << _META), np.float32)
    x, buckets = _matrices(content, meta)
    held = np.zeros((len(meta), 1 << _META), np.float32)
    held[np.arange(len(meta))[:, None], buckets] = 1
    return x, held


def _place(column: str, salt: int):
    return F.pmod(F.xxhash64(named(column), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def _rows(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    return docs.select(
        named(columns["id"]).alias("__doc"),
        named(columns["text"]).alias("text"),
        *[named(columns[c]).alias(c) for c in METADATA],
    )


def _known(labels: DataFrame, id_column: str, bad: str) -> DataFrame:
    known = labels.select(named(id_column).alias("__id"), named(bad).cast("int").alias("bad"))
    return known.where("__id IS NOT NULL AND bad IS NOT NULL")


def _sample(rows: DataFrame, known: DataFrame, size: int) -> tuple[list[tuple], dict[int, int]]:
    """(hash, bad, content, meta) of labelled sample documents, in order of the hash, and how many
    labelled documents of each class there are in all."""
    here = rows.select("__doc").where("__doc IS NOT NULL").distinct()
    known = known.groupBy("__id").agg((F.max("bad") > 0).cast("int").alias("bad"))
    known = known.join(here, F.col("__doc") == F.col("__id"), "left_semi")
    total = {r.bad: r["count"] for r in known.groupBy("bad").count().collect()}
    share = F.lit(0.0)
    for bad, n in total.items():
        # Half of the sample, and what the other class leaves of its half.
        most = max(size / 2, size - total.get(1 - bad, 0))
        share = F.when(F.col("bad") == bad, F.lit(min(1.0, most / n))).otherwise(share)
    taken = known.where(_place("__id", 21) < share).limit(2 * size)
    # At most twice the sample's ids, so they may go to every task.
    mine = rows.join(F.broadcast(taken), F.col("__doc") == F.col("__id"))
    hashed = F.xxhash64("__doc", F.lit(22)).alias("h")
    # The shares make the sample about its size; the limit holds even where ids repeat.
    found = _with_features(mine.select(hashed, "bad", "text", *METADATA)).limit(2 * size)
    return sorted(tuple(r) for r in found.toLocalIterator()), total


def _pool(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(__doc, key, content, meta) of every document, stored; equal features have equal keys."""
    found = _with_features(rows)
    key = F.xxhash64("content", "meta").alias("key")
    return scratch.saved(found.select("__doc", key, "content", "meta"))


def _unlabelled(rows: DataFrame, known: DataFrame) -> DataFrame:
    return rows.join(known, F.col("__doc") == F.col("__id"), "left_anti")


def _surest(
    pool: DataFrame,
    known: DataFrame,
    views: list,
    told: list[np.ndarray],
    most: dict,
    confidence: float,
) -> list[tuple[int, int, int]]:
    """(view, label, key) of the documents without a label that each view is surest of, of all
    the pool but those already ``told``; ``most`` of each label."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            keys = np.asarray(batch.column("key"))
            x, buckets = _matrices(*(batch.column(c).to_pylist() for c in ("content", "meta")))
            for v, (weights, scale) in enumerate(views):
                z = x @ weights[:-1] if v == 0 else weights[buckets].sum(axis=1)
                # Rounded: equal rows agree, wherever in a batch they stand.
                z = np.round((z + weights[-1]) * scale[0] + scale[1], 6)
                new = ~np.isin(keys, told[v])
                for label in most:
                    sure = z if label else -z
                    mine = np.flatnonzero(new & (_logistic(sure) >= confidence))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("__doc").take(pa.array(mine)),
                            pa.array(np.full(len(mine), 2 * v + label, np.int32)),
                            pa.array(keys[mine]),
                            pa.array(sure[mine]),
                        ],
                        names=["__doc", "which", "key", "sure"],
                    )

    kind = pool.schema["__doc"].dataType.simpleString()
    found = pool.mapInArrow(look, f"__doc {kind}, which int, key long, sure double")
    # Ids and scores go into the join, not features: where there are many labels, it is a shuffle.
    found = _unlabelled(found, known).groupBy("which", "key").agg(F.max("sure").alias("sure"))
    order = Window.partitionBy("which").orderBy(F.desc("sure"), "key")
    top = found.withColumn("place", F.row_number().over(order))
    top = top.where(F.col("place") <= max(most.values())).select("which", "place", "key").collect()
    return sorted((r.which // 2, r.which % 2, r.key) for r in top if r.place <= most[r.which % 2])


def _looked_up(pool: DataFrame, keys: list[int]) -> list[tuple]:
    """(key, content, meta) of the documents of these keys, one of each."""
    wanted = np.array(sorted(keys), np.int64)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = wanted
        for batch in batches:
            here, first = np.unique(np.asarray(batch.column("key")), return_index=True)
            mine = np.isin(here, left)
            left = np.setdiff1d(left, here[mine])
            yield batch.take(pa.array(first[mine]))

    pool = pool.select("key", "content", "meta")
    found = pool.mapInArrow(look, pool.schema).dropDuplicates(["key"])
    return sorted(tuple(r) for r in found.toLocalIterator())


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    bad_column: str = "bad",
    sample: int = SAMPLE,
    rounds: int = 4,
    confidence: float = 0.97,
    seed: int = 7,
    teach: float = 0.25,
) -> QualityModel:
    """Learn from ``labels`` (id and ``bad_column``: 1 for a document to reject, else 0).

    In each of the rounds a view gives the other one as many new pseudo-labels as ``teach`` times
    the labelled documents that teach, at most, in the proportion of the labels.
    """
    columns = {"id": id_column, "text": text_column} | {c: c for c in METADATA}
    docs, known = _rows(docs, columns), _known(labels, id_column, bad_column)
    rows, total = _sample(docs, known, sample)
    buckets = (1 << BITS) + _RATIOS
    views = _views([r[2] for r in rows], [r[3] for r in rows])
    good = np.array([1 - bad for _, bad, _, _ in rows], int)
    labelled = np.arange(len(rows))
    if len(np.unique(good)) < 2 or min(np.bincount(good)) < 5:
        share = total.get(0, 0) / sum(total.values()) if total else 1.0
        z = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        nothing = np.zeros(1 << _META), np.array([0.0, z])
        return QualityModel(
            np.zeros(buckets + 1), np.append(nothing[0], 0.0), nothing[1], nothing[1],
            np.array([0.0, 0.0, z]), 0.0,
        )
    out = np.sort(np.concatenate([np.flatnonzero(good == label)[::3] for label in (0, 1)]))
    core = np.setdiff1d(labelled, out)
    y = good[out].astype(float)
    # Kept-out rows stand for all labelled documents of their class.
    stands = np.array([total[1 - label] / (good[out] == label).sum() for label in (0, 1)])[good[out]]
    share = {label: max(float((good[core] == label).mean()), 0.02) for label in (0, 1)}
    most = {label: max(1, int(len(core) * share[label] * teach)) for label in share}
    scratch = Scratch()
    pool = _pool(docs, scratch)
    taught: list[dict[int, int]] = [{}, {}]
    features: dict[int, tuple] = {}
    weights = [np.zeros(0), np.zeros(0)]
    for turn in range(rounds + 1):
        scales = []
        more = _views(*([features[k][i] for k in sorted(features)] for i in (0, 1)))
        at = {k: i for i, k in enumerate(sorted(features))}
        for v, x in enumerate(views):
            mine = sorted(taught[v])
            label = np.append(good[core], [taught[v][k] for k in mine]).astype(float)
            weight = np.append(np.ones(len(core)), np.full(len(mine), 0.5))
            from_pool = more[v][np.array([at[k] for k in mine], int)]
            weights[v] = _fitted(np.concatenate([x[core], from_pool]), label, weight)
            z = x @ weights[v][:-1] + weights[v][-1]
            scales.append((z, _scaled(z[out, None], y, stands)))
        if turn == rounds:
            break
        # The surest of each kind in all of the pool teach the other view.
        told = [np.array(sorted(taught[1 - v]), np.int64) for v in (0, 1)]
        seen = [(weights[v], scales[v][1]) for v in (0, 1)]
        sure = _surest(pool, known, seen, told, most, confidence)
        for v, label, key in sure:
            taught[1 - v].setdefault(key, label)
        new = {key for _, _, key in sure} - features.keys()
        if new:
            features |= {key: (c, m) for key, c, m in _looked_up(pool, list(new))}
    scratch.clear()
    (z_text, s_text), (z_meta, s_meta) = scales
    both = np.stack([z_text[out] * s_text[0] + s_text[1], z_meta[out] * s_meta[0] + s_meta[1]], 1)
    combined = _scaled(both, y, stands)
    model = QualityModel(weights[0], weights[1], s_text, s_meta, combined, 0.5)
    p = model.of(z_text[out], z_meta[out])[2]
    limit = best_limit(p, good[out])
    del views, more, features, rows
    give_back()
    return QualityModel(weights[0], weights[1], s_text, s_meta, combined, limit)


def scored(
    docs: DataFrame, model: QualityModel, text_column: str = "text"
) -> DataFrame:
    """The input rows with ``p_text``, ``p_metadata``, ``score`` (probabilities that the document
    is good) and ``accepted``."""
    own = ["p_text", "p_metadata", "score", "accepted"]
    columns = [c for c in docs.columns if c not in own or c == text_column or c in METADATA]
    at = {c: columns.index(c) for c in (text_column, *METADATA)}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.slice(low, 512)
                meta = [part.column(at[c]).to_pylist() for c in METADATA]
                p = [np.round(x, 6) for x in known.scores(part.column(at[text_column]), meta)]
                extra = [*map(pa.array, p), pa.array(p[2] >= known.limit)]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*columns, *own])

    rows = docs.select(*map(named, columns))
    kinds = [DoubleType()] * 3 + [BooleanType()]
    fields = [StructField(c, k) for c, k in zip(own, kinds)]
    return small_batches(rows).mapInArrow(score, StructType(rows.schema.fields + fields))
