"""Ranked lexical search with hashed max-sketches: bounds for all documents, exact scores for the promising ones."""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import flat, slices, staged, text_or_empty, with_package, word_hashes, words

TOP = 10
LENGTH_SHARE = 90  # percent of a document's norm that its length makes
SATURATION = 8
LEAST_WIDTH, PLACES_PER_TERM = 1 << 16, 16
BLOCK_ITEMS, BLOCK_TERMS = 1024, 1 << 16  # items and different terms of a block of queries
FIRST_ROUND = 20_000  # documents whose scores give the first thresholds
CELLS = 1 << 22  # of a working matrix
MERGE = 64  # salts of the first merge

# Counts up to 128 have levels of their own; the higher ones grow evenly in the exponent up to 2**32.
_LEVELS = np.concatenate([np.arange(129), np.ceil(128 * 2 ** (25 * np.arange(1, 128) / 127))]).astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """The smallest level that is not below a count, as one byte."""
    return np.minimum(np.searchsorted(_LEVELS, counts), len(_LEVELS) - 1).astype(np.uint8)


def terms_of(data: np.ndarray, offsets: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the different terms of texts ``low`` to ``high``, ascending, and how often each occurs.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z count as a-z.
    """
    first, last = int(offsets[low]), int(offsets[high])
    part = data[first:last]
    part = np.where((part >= 65) & (part <= 90), part + np.uint8(32), part).astype(np.uint8)
    starts, ends, of_text = words(part, offsets[low : high + 1] - first, 0, high - low, bare=True)
    hashes = word_hashes(part, starts, ends)
    for k in range(high - low):
        yield np.unique(hashes[of_text[k] : of_text[k + 1]], return_counts=True)


def sketch(hashes: np.ndarray, counts: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Coordinatewise maxima: each term falls to a place by its hash, a place keeps the highest level.

    The impact of a term rises with its count in the document, so the level of the largest count is the
    level of the largest impact, whatever the statistics of the corpus are. Returns the width, the places
    that are not empty in ascending order, and their levels. The width is LEAST_WIDTH, or so many times
    sixteen as long texts need for PLACES_PER_TERM places to each different term.
    """
    width = LEAST_WIDTH
    while width < PLACES_PER_TERM * len(hashes):
        width *= 16
    places = (hashes & np.uint64(width - 1)).astype(np.uint32)
    order = np.argsort(places, kind="stable")
    places, made = places[order], levels(counts)[order]
    first = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1]))) if len(places) else np.zeros(0, np.int64)
    return width, places[first], np.maximum.reduceat(made, first) if len(first) else made


def _place_kind(width: int) -> str:
    return "<u2" if width <= 1 << 16 else "<u4"


NAMES = ["doc_id", "n", "width", "places", "levels", "terms", "counts"]


def index(documents: DataFrame) -> DataFrame:
    """``doc_id, n, width, places, levels, terms, counts`` of every document: a table that serves any number of searches.

    ``n`` is the number of terms with repeats; ``width``, ``places`` and ``levels`` are the sketch, 3 bytes for a
    term as a rule; ``terms`` has the 64-bit hashes of the different terms in ascending order, ``counts`` how
    often each occurs. Nothing in it depends on other documents.
    """

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for low, high in slices(offsets):
                rows = []
                for hashes, counts in terms_of(data, offsets, low, high):
                    width, places, made = sketch(hashes, counts)
                    rows.append((int(counts.sum()), width, places.astype(_place_kind(width)).tobytes(), made.tobytes(), hashes.astype("<u8").tobytes(), counts.astype("<u4").tobytes()))
                kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *columns], names=NAMES)

    with_package(documents.sparkSession)
    rows = documents.select("doc_id", text_or_empty().alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(of_batches, f"doc_id {kind}, n long, width long, places binary, levels binary, terms binary, counts binary")


def norms(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """The norm m of documents with ``n`` terms each: whole percents of the mean length, and a fixed part."""
    if LENGTH_SHARE * docs * int(n.max(initial=0)) < 1 << 63:
        return 100 - LENGTH_SHARE + (LENGTH_SHARE * docs * n) // max(1, total)
    exact = [100 - LENGTH_SHARE + (LENGTH_SHARE * docs * int(x)) // max(1, total) for x in n]
    return np.array(exact, np.int64)


def shares(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Impact of a term before its weight; it rises with the count."""
    return (1_000_000_000 * counts) // (1000 * counts + SATURATION * m)


@dataclass(frozen=True)
class Block:
    """Some items: their terms (ascending hashes), the places of each item's terms, the terms' weights."""

    numbers: list[int]  # of the items
    terms: np.ndarray
    places: list[np.ndarray]
    weights: np.ndarray | None = None
    docs: int = 0
    total: int = 0


def blocks(items: Iterable[tuple[int, str | None]], most_items: int = BLOCK_ITEMS, most_terms: int = BLOCK_TERMS) -> Iterator[Block]:
    """Items in blocks of a bounded number of items and terms; an item with more terms stands alone."""

    def closed() -> Block:
        terms = np.unique(np.concatenate(hashes))
        return Block(list(numbers), terms, [np.searchsorted(terms, h) for h in hashes])

    numbers, hashes, size = [], [], 0
    for number, text in items:
        data, offsets = flat(pa.array([text or ""]))
        found, _ = next(terms_of(data, offsets, 0, 1))
        if numbers and (len(numbers) >= most_items or size + len(found) > most_terms):
            yield closed()
            numbers, hashes, size = [], [], 0
        numbers.append(number)
        hashes.append(found)
        size += len(found)
    if numbers:
        yield closed()


def _weighted(block: Block, indexed: DataFrame, docs: int, total: int) -> Block:
    """The block with the weight of each term, from its count over all documents."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(block.terms), np.int64)
        for batch in batches:
            data, _ = flat(batch.column(0))
            hashes = data.view("<u8")
            place = np.minimum(np.searchsorted(block.terms, hashes), len(found) - 1)
            found += np.bincount(place[block.terms[place] == hashes], minlength=len(found))
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(found[used])], names=["term", "df"])

    df = np.zeros(len(block.terms), np.int64)
    if len(df):
        counted = indexed.select("terms").mapInArrow(of_batches, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        for r in counted.collect():  # at most a row for each term of the block
            df[r.term] = r.df
    weights = [math.floor(1000 * math.log((2 * docs + 2) / (2 * int(x) + 1))) if x else 0 for x in df]
    return Block(block.numbers, block.terms, block.places, np.array(weights, np.int64), docs, total)


class _Best:
    """The best documents of one item so far, and the score that a further one must reach."""

    def __init__(self, top: int, floor: int):
        self.top, self.floor, self.rows = top, max(1, floor), []

    def add(self, score: int, known: bool, doc_id) -> None:
        insort(self.rows, (-score, not known, doc_id if known else 0))
        del self.rows[self.top :]
        if len(self.rows) == self.top:
            self.floor = max(self.floor, -self.rows[-1][0])


class _Postings:
    """For sketches of one width: which items look at a place, with the weights of their terms there."""

    def __init__(self, block: Block, width: int):
        at = (block.terms & np.uint64(width - 1)).astype(np.int64)
        used, column = np.unique(at, return_inverse=True)
        pairs = [(column[places], np.full(len(places), item), block.weights[places]) for item, places in enumerate(block.places)]
        columns, items, weights = (np.concatenate([p[k] for p in pairs]) for k in range(3))
        order = np.argsort(columns, kind="stable")
        self.items, self.weights = items[order], weights[order].astype(np.float64)
        self.begin = np.searchsorted(columns[order], np.arange(len(used) + 1))
        self.column = np.full(width, -1, np.int32)
        self.column[used] = np.arange(len(used))

    def bounds(self, sizes: np.ndarray, places: np.ndarray, made: np.ndarray, m: np.ndarray, n_items: int) -> np.ndarray:
        """Upper bounds of the scores of documents (rows) for items (columns); ``sizes`` are those of the sketches."""
        column = self.column[places]
        here = np.flatnonzero(column >= 0)
        row, column = np.repeat(np.arange(len(sizes)), sizes)[here], column[here]
        impact = shares(_LEVELS[made[here]], m[row])
        each = self.begin[column + 1] - self.begin[column]
        entry = np.arange(each.sum()) + np.repeat(self.begin[column] - np.cumsum(each) + each, each)
        cell = np.repeat(row, each) * n_items + self.items[entry]
        total = np.bincount(cell, np.repeat(impact, each) * self.weights[entry], len(sizes) * n_items)
        return total.reshape(len(sizes), n_items)


def _search(block: Block, top: int, floors: list[int]):
    """The best documents of a task for each item of the block.

    The levels at the places of an item's terms, turned into impacts and weighted, are an upper bound of a
    document's score; those of many documents for all items are looked up together. Each item takes the
    documents by descending bound and computes exact scores, until the bound is below the score of its
    ``top``-th best. Bounds and scores are whole numbers below 2**53, so both are exact as doubles.
    """
    weights, n_items = block.weights, len(block.places)

    def exact(item: int, terms: np.ndarray, counts: np.ndarray, m: int) -> int:
        places = block.places[item]
        mine = block.terms[places]
        at = np.minimum(np.searchsorted(terms, mine), len(terms) - 1)
        hit = terms[at] == mine
        return int((weights[places[hit]] * shares(counts[at[hit]].astype(np.int64), np.int64(m))).sum())

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(top, f) for f in floors]
        postings: dict[int, _Postings] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            ids, n, widths = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            (places, place_at), (made, made_at), (terms, term_at), (counts, count_at) = (flat(batch.column(k)) for k in (3, 4, 5, 6))
            for width in np.unique(widths[n > 0]).tolist():
                if width not in postings:
                    postings[width] = _Postings(block, width)
                here = np.flatnonzero((widths == width) & (n > 0))
                step = max(1, CELLS // n_items)
                for part in (here[k : k + step] for k in range(0, len(here), step)):
                    m = norms(n[part], block.docs, block.total)
                    at = np.concatenate([places[place_at[r] : place_at[r + 1]] for r in part]).view(_place_kind(width))
                    level = np.concatenate([made[made_at[r] : made_at[r + 1]] for r in part])
                    bounds = postings[width].bounds(made_at[part + 1] - made_at[part], at, level, m, n_items)
                    open_ = (bounds >= np.array([b.floor for b in best])).any(0)
                    for item in np.flatnonzero(open_).tolist():
                        found = best[item]
                        for k in _descending(bounds[:, item], found):
                            row = int(part[k])
                            mine, times = terms[term_at[row] : term_at[row + 1]].view("<u8"), counts[count_at[row] : count_at[row + 1]].view("<u4")
                            score = exact(item, mine, times, int(m[k]))
                            if score >= found.floor:
                                found.add(score, ids[row] is not None, ids[row])
        if kind is None:
            return
        rows = [(block.numbers[k], -s, None if missing else i) for k, b in enumerate(best) for s, missing, i in b.rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64())],
            names=["item", "doc_id", "score"],
        )

    return of_batches


def _descending(bounds: np.ndarray, found: _Best) -> Iterator[int]:
    """Places of bounds from the highest down, as long as they reach the floor, which may rise meanwhile."""
    open_ = np.flatnonzero(bounds >= found.floor)
    for k in open_[np.argsort(-bounds[open_], kind="stable")].tolist():
        if bounds[k] < found.floor:
            return
        yield k


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The best rows of each item with their rank. Rows are merged in two steps, so that an item's rows of very many
    tasks do not meet in one task."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    first = Window.partitionBy("item", "salt").orderBy(*order)
    found = found.withColumn("salt", F.spark_partition_id() % MERGE)
    found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return ranked.where(F.col("rank") <= top)


def search(documents: DataFrame, items: DataFrame, top: int = TOP, first_round: int = FIRST_ROUND) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents with the highest scores above 0 for each item.

    The score is a sum over the item's different terms of whole-number weights (rare terms weigh more) times
    an impact that rises with the term's count and falls with the document's length. All documents are
    indexed (see ``index``); the sketch of a document bounds its score for any item from above, because a
    place holds the largest impact of all terms that fall to it. Documents below an item's threshold are
    never scored. Thresholds start from the exact scores of about ``first_round`` documents and rise with
    what a task finds, so the result is that of scoring all documents for all items.

    Items are read in blocks of at most BLOCK_ITEMS items and BLOCK_TERMS terms; a block's terms and weights
    are all that tasks get, and each block is one pass over the index. Equal scores go by ascending doc_id,
    rows without an id last. Null and empty texts have no terms: such documents are never found and such items
    have no rows. Repeated documents are found each, repeated items are answered each. Empty tables give an
    empty result; other columns are ignored. Terms are told apart by 64-bit hashes.
    """
    spark = with_package(documents.sparkSession)
    indexed = staged(index(documents), "lexical")
    rows, docs, total = indexed.agg(F.count("*"), F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = staged(items.select("item_id", text_or_empty().alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")
    id_type, item_type = indexed.schema["doc_id"].dataType, asked.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    parts = []
    for block in blocks((r.item, r.text) for r in asked.select("item", "text").toLocalIterator()):
        block = _weighted(block, indexed, docs, total)
        floors = [1] * len(block.numbers)
        if rows > first_round:
            some = indexed.sample(first_round / rows, 1).mapInArrow(_search(block, top, floors), schema)
            lowest = _ranked(some, top).where(F.col("rank") == top).select("item", "score").collect()  # at most a row for each item of the block
            seats = {number: k for k, number in enumerate(block.numbers)}
            for r in lowest:
                floors[seats[r.item]] = r.score
        parts.append(staged(_ranked(indexed.mapInArrow(_search(block, top, floors), schema), top), "ranked"))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()), *schema.fields[1:]]))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
