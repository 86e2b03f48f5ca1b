"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import RangeHash, flat, fresh, once_each, slices, staged, with_package, words

BITS = 18  # features are hashed to 2**BITS places
PREFIXES = (4, 5, 6, 8)  # beginnings of words, in bytes, that count as features beside the whole word
CHOSEN = 1024
THRESHOLD = 0.7
MOST_TOXIC, MOST_UNLABELLED = 2000, 6000  # documents that the classifier is fitted on, at most
SLICE = 1 << 20  # bytes of text at a time: there are five features for a word


@dataclass
class Model:
    """A linear classifier over the chosen features: each counts by its presence and by its density."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def _raw(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of a text column: its first row, number of rows, row and feature of each occurrence, words per row."""
    data, offsets = flat(pc.utf8_lower(column.cast(pa.large_string())))
    for low, high in slices(offsets, SLICE):
        starts, ends, first = words(data, offsets, low, high, bare=True)
        count = np.diff(first)
        if not len(starts):
            yield low, high - low, np.zeros(0, np.int64), np.zeros(0, np.int64), count
            continue
        base = int(starts[0])
        hashes = RangeHash(data[base : int(ends[-1])])
        row = np.repeat(np.arange(high - low), count)
        rows, found = [row], [hashes(starts - base, ends - base)]
        for n in PREFIXES:
            long = np.flatnonzero(ends - starts > n)
            rows.append(row[long])
            found.append(hashes(starts[long] - base, starts[long] - base + n))
        yield low, high - low, np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), count


def _counted(row: np.ndarray, feature: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, features and numbers of their occurrences."""
    both, n = np.unique(row * places + feature, return_counts=True)
    return both // places, both % places, n


def _density(n: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.minimum(1.0, np.log1p(1000.0 * n / (words + 20)) / 4)


def _bags(sample: DataFrame) -> DataFrame:
    """``toxic, features, counts, words`` for every row of ``toxic, text``."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, counts, sizes = [], [], []
            for _, n, row, feature, size in _raw(batch.column(1)):
                row, feature, count = _counted(row, feature, 1 << BITS)
                cuts = np.searchsorted(row, np.arange(n + 1))
                features += [feature[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                counts += [count[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                sizes.append(size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(features, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64())), pa.array(np.concatenate([*sizes, np.zeros(0, np.int64)]))],
                names=["toxic", "features", "counts", "words"],
            )

    return sample.mapInArrow(of_batches, "toxic boolean, features array<long>, counts array<long>, words long")


def _choose(bags: DataFrame, prior: float, toxic: int, pool: int) -> np.ndarray:
    """The features that a toxic text is likely behind: by Bayes' rule with the class prior, a deviation on the safe side."""
    seen = bags.select("toxic", F.explode("features").alias("feature")).groupBy("feature")
    seen = seen.agg(F.sum(F.col("toxic").cast("long")).alias("p"), F.sum((~F.col("toxic")).cast("long")).alias("u"))
    least = prior * (F.col("p") - F.sqrt("p")) / toxic
    most = (F.col("u") + F.sqrt("u") + 1) / pool
    rated = seen.where("p >= 4").withColumn("behind", least / most).where("behind > 0.3")
    best = rated.orderBy(F.desc(F.col("behind") * F.sqrt("p")), "feature").limit(CHOSEN)
    return np.sort(np.array([r.feature for r in best.select("feature").collect()], np.int64))


class SampleRows:
    """Rows of the bounded sample in the chosen features: presence, then density. Only the rows asked for are made dense.

    ``packed`` has a row each: the bits of the features that it has, then their densities. In the order of these
    bytes the rows are in the order of their dense bytes too.
    """

    def __init__(self, packed: list[bytes], features: int):
        self.shape = (len(packed), 2 * features)
        wide = (features + 7) // 8
        bits = np.frombuffer(b"".join([x[:wide] for x in packed]), np.uint8).reshape(len(packed), wide)
        row, self.place = np.nonzero(np.unpackbits(bits, axis=1, count=features))
        self.density = np.frombuffer(b"".join([x[wide:] for x in packed]), np.float32)
        self.first = np.searchsorted(row, np.arange(len(packed) + 1))

    def __len__(self) -> int:
        return self.shape[0]

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        count = self.first[rows + 1] - self.first[rows]
        row = np.repeat(np.arange(len(rows)), count)
        at = np.arange(len(row)) + np.repeat(self.first[rows] - np.cumsum(count) + count, count)
        out = np.zeros((len(rows), self.shape[1]), np.float32)
        out[row, self.place[at]] = 1
        out[row, self.shape[1] // 2 + self.place[at]] = self.density[at]
        return out

    def values(self, w: np.ndarray, b: float) -> np.ndarray:
        parts = [np.arange(k, min(k + 512, len(self))) for k in range(0, len(self), 512)]
        return np.concatenate([*(self[part] @ w + b for part in parts), np.zeros(0)])


def _matrix(bags: DataFrame, chosen: np.ndarray) -> tuple[SampleRows, SampleRows]:
    """The bounded sample in the chosen features, toxic rows and unlabelled rows."""
    m = len(chosen)

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for features, counts, n in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                features = np.array(features, np.int64)
                at = np.minimum(np.searchsorted(chosen, features), m - 1)
                has = chosen[at] == features
                bits = np.zeros(m, np.uint8)
                bits[at[has]] = 1
                density = _density(np.array(counts, np.int64)[has], n).astype(np.float32)  # features ascend in a row
                out.append(np.packbits(bits).tobytes() + density.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["toxic", "row"])

    found = bags.mapInArrow(of_batches, "toxic boolean, row binary").toArrow()  # a row for each document of the sample
    sides = []
    for toxic in (True, False):
        rows = sorted(found.filter(pc.equal(found.column(0), toxic)).column(1).to_pylist())  # the same order in each run
        sides.append(SampleRows(rows, m))
    return sides[0], sides[1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def nn_pu(toxic: np.ndarray, pool: np.ndarray, prior: float, epochs: int = 80, rate: float = 0.1, decay: float = 1e-4, parts: int = 10):
    """Weights and bias that minimise the non-negative risk (Kiryo et al. 2017) with the logistic loss.

    The risk of the clean class is that of the unlabelled texts less the prior's share of the toxic ones;
    where a part's estimate falls below zero, the step goes back up it instead.
    """
    draw = np.random.default_rng(0)
    w, b = np.zeros(toxic.shape[1]), -2.0
    sum_w, sum_b = np.full_like(w, 1e-6), 1e-6
    for _ in range(epochs):
        for i, j in zip(np.array_split(draw.permutation(len(toxic)), parts), np.array_split(draw.permutation(len(pool)), parts), strict=True):
            if not len(i) or not len(j):
                continue
            p, u = toxic[i], pool[j]
            at_p, at_u = p @ w + b, u @ w + b
            clean = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()
            as_clean, as_toxic, unlabelled = _sigmoid(at_p) / len(i), (_sigmoid(at_p) - 1) / len(i), _sigmoid(at_u) / len(j)
            of_p, of_u = (prior * (as_toxic - as_clean), unlabelled) if clean >= 0 else (prior * as_clean, -unlabelled)
            g, g_b = p.T @ of_p + u.T @ of_u + decay * w, of_p.sum() + of_u.sum()
            sum_w += g * g
            sum_b += g_b * g_b
            w -= rate * g / np.sqrt(sum_w)
            b -= rate * g_b / np.sqrt(sum_b)
    return w, b


def _cut(toxic: np.ndarray, pool: np.ndarray, prior: float) -> float:
    """The value from which a text counts as toxic: most toxic texts found, less twice the clean ones by the prior's estimate."""
    values = np.unique(np.concatenate([toxic, pool]))
    found = 1 - np.searchsorted(np.sort(toxic), values) / len(toxic)
    rejected = 1 - np.searchsorted(np.sort(pool), values) / len(pool)
    best = int((prior * found - 2 * np.maximum(0, rejected - prior * found)).argmax())
    return float(values[best] + values[max(0, best - 1)]) / 2


def fit(documents: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_unlabelled: int = MOST_UNLABELLED) -> Model | None:
    """A classifier from confirmed toxic texts and texts without marks; None where none is confirmed.

    Labels are read only where crc32 of the doc_id as text, modulo 3, is not 1. The prior is the toxic share
    of all those labels; the texts are those of at most ``most_toxic`` confirmed documents and
    ``most_unlabelled`` others, the first by a hash of the id, each id once: of rows with one id the text with
    the smallest hash. That sample is all the fit sees, so it takes the same time at any size.
    """
    with_package(documents.sparkSession)
    marks = labels.where(learnable("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null and doc_id is not null")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    confirmed = marks.where("toxic = 1").select("doc_id").orderBy(*order).limit(most_toxic).withColumn("toxic", F.lit(True))
    others = documents.where(learnable("doc_id")).select("doc_id").where("doc_id is not null").distinct().orderBy(*order).limit(most_unlabelled)
    ids = confirmed.union(others.withColumn("toxic", F.lit(False)))  # bounded by the two limits
    texts = documents.select("doc_id", F.col("text").cast("string"), F.xxhash64("text").alias("row_hash"))
    first = texts.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("row_hash").alias("row_hash"))
    first = staged(ids.join(first, "doc_id"), "sample")  # as many rows as ids
    sample = once_each(texts.join(F.broadcast(first), ["doc_id", "row_hash"]), "doc_id", "toxic").select("toxic", "text")
    bags = staged(_bags(sample), "bags")
    prior = marks.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    sizes = {r.toxic: r.n for r in bags.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not prior or len(sizes) < 2:
        return None
    chosen = _choose(bags, prior, sizes[True], sizes[False])
    if not len(chosen):
        return None
    toxic, pool = _matrix(bags, chosen)
    w, b = nn_pu(toxic, pool, prior)
    shift = _cut(toxic.values(w, b), pool.values(w, b), prior) - np.log(THRESHOLD / (1 - THRESHOLD))
    return Model(chosen, w, float(b - shift))


def learnable(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 != 1, F.lit(True))


def rate(texts: pa.Array, model: Model | None) -> np.ndarray:
    """Scores from 0 to 1 of a column of texts."""
    if model is None:
        return np.zeros(len(texts))
    m, out = len(model.features), []
    place = np.full(1 << BITS, -1, np.int64)
    place[model.features] = np.arange(m)
    for _, n, row, feature, words_of in _raw(texts):
        at = place[feature]
        row, at, count = _counted(row[at >= 0], at[at >= 0], m)
        value = model.weights[at] + model.weights[m + at] * _density(count, words_of[row])
        out.append(model.bias + np.bincount(row, value, n))
    return _sigmoid(np.concatenate([*out, np.zeros(0)]))


def with_score(documents: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """All columns of the documents and the score of their text. Null and empty texts get the score of no evidence."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = rate(batch.column(names.index("text")).cast(pa.string()), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*names, name])

    names = documents.columns
    with_package(documents.sparkSession)
    return documents.mapInArrow(of_batches, documents.withColumn(name, F.lit(0.0)).schema)


def scored(documents: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; see ``fit``.

    Only the text goes into a score. Repeated rows come back repeated, rows without an id are scored too and
    are not held out; labels of unknown documents and null labels teach nothing; without labels all scores
    are 0; empty tables give an empty result; other columns are ignored.
    """
    model = fit(documents, labels, **bounds)
    rows = with_score(documents.select("doc_id", "text"), model)
    return rows.select("doc_id", (~learnable("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_documents(documents: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The documents that are not rejected as toxic, with all their columns."""
    model = fit(documents, labels, **bounds)
    (score,) = fresh(documents, "toxic_score")
    return with_score(documents, model, score).where(F.col(score) < THRESHOLD).select(*documents.columns)
