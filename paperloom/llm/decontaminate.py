"""Benchmark decontamination: the rarer gapped word triples of items as seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import bitmap, flat, fresh, in_bitmap, mix, signed, slices, staged, with_package, word_hashes, words

SHAPES = ((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))  # of a seed: where its second and third word stand after the first
SEGMENT = 64  # words of a test item that are aligned at once; longer items are cut into such parts
PASSAGE, STRIDE = 256, 128  # words of a training passage, and from one passage to the next: any 128 words lie in one
FILTER_BITS = 24  # of the bitmap that goes to all tasks, 2 MB; a seed sets two
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5
LEAST_WORDS = 8


def _tokens(column: pa.Array):
    """For each slice of a text column: its first row, the hashes of its words, and where each text's words begin."""
    data, offsets = flat(pc.utf8_lower(column.cast(pa.large_string())))
    for low, high in slices(offsets):
        starts, ends, first = words(data, offsets, low, high, bare=True)
        yield low, word_hashes(data, starts, ends), first


def _parts(benchmark: DataFrame, least_words: int) -> DataFrame:
    """``item_id, tokens``: test items as word hashes, cut into parts of at most SEGMENT words."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tokens = [], []
            for low, hashes, first in _tokens(batch.column(1)):
                for k in range(len(first) - 1):
                    own = hashes[first[k] : first[k + 1]].astype("<u4")
                    if len(own) < least_words:
                        continue
                    cuts = [*range(0, len(own) - SEGMENT, SEGMENT), max(0, len(own) - SEGMENT)]
                    for c in cuts:
                        rows.append(low + k)
                        tokens.append(own[c : c + SEGMENT].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(tokens, pa.binary())], names=["item_id", "tokens"])

    items = benchmark.select("item_id", F.col("text").cast("string"))
    return items.mapInArrow(of_batches, f"item_id {dict(items.dtypes)['item_id']}, tokens binary").distinct()


def _least_places(words, least_score: float):
    """At how many words of a document a seed of an item (a number or a column of its words) begins at least, before rounding.

    Let an alignment have m matches and e edits, 2 m - e >= 2 L n for n words and a least score L. Between
    consecutive matches lie m - 1 gaps with e edits in all. Two gaps in a row with at most two edits are a seed,
    whatever its shapes here and there. Other neighbours hold three edits or more, so they are at most 2 e / 3
    of the m - 2, which leaves m - 2 - (4 m - 4 L n) / 3 seeds or more; m is at most n.
    """
    return (words * (4 * least_score - 1) - 6) / 3


def _triples(hashes: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Hashes of the triples of one shape that begin at each word of a sequence."""
    second, third = shape
    n = max(0, len(hashes) - third)
    with np.errstate(over="ignore"):
        two = mix(hashes[:n] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[second : second + n])
        return mix(two * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[third : third + n])


def _seeds(parts: DataFrame) -> DataFrame:
    """``part, place, seed``: all triples of the parts, of all shapes, and the words at which they begin."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, seeds = [], [], []
            for key, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for found in (_triples(np.frombuffer(tokens, "<u4").astype(np.uint64), shape) for shape in SHAPES):
                    keys.append(np.full(len(found), key, np.int64))
                    places.append(np.arange(len(found), dtype=np.int32))
                    seeds.append(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), pa.array(np.concatenate([*places, np.zeros(0, np.int32)])),
                    pa.array(signed(np.concatenate([*seeds, np.zeros(0, np.uint64)]))),
                ],
                names=["part", "place", "seed"],
            )

    return parts.select("part", "tokens").mapInArrow(of_batches, "part long, place int, seed long").distinct()


def _rare(seeds: DataFrame, items: DataFrame, passages: DataFrame) -> DataFrame:
    """``part, place, seed``: the seeds that are looked up. ``items`` has ``part, least``.

    An alignment that counts begins seeds at ``least`` words of the item or more. If half of these are asked for
    (``asked``), as many of the item's words as the other half may be passed over, and those where the seeds are
    most common in the corpus are. What is left is hit ``asked`` times all the same.
    """
    counts = passages.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count("*").alias("n"))
    known = seeds.join(counts, "seed")
    common = known.groupBy("part", "place").agg(F.sum("n").alias("n")).join(items.select("part", "least", "asked"), "part")
    order = Window.partitionBy("part").orderBy(F.desc("n"), "place")  # a row for each word of a part, SEGMENT at most
    looked_up = common.withColumn("turn", F.row_number().over(order)).where(F.col("turn") > F.ceil("least") - F.col("asked"))
    return known.join(looked_up.select("part", "place"), ["part", "place"]).select("part", "place", "seed")


def _hits(hashes: np.ndarray, first: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words at which a seed may begin, the seeds, and the texts they lie in."""
    hashes, places, found, texts = hashes & np.uint64(0xFFFFFFFF), [], [], []
    for shape in SHAPES:
        triples = _triples(hashes, shape)
        maybe = np.flatnonzero(in_bitmap(bits, triples))
        maybe = maybe[in_bitmap(bits, triples[maybe] >> np.uint64(32))]
        text = np.searchsorted(first, maybe, "right") - 1
        inside = maybe + shape[1] < first[text + 1] if len(maybe) else np.zeros(0, bool)
        places.append(maybe[inside])
        found.append(triples[maybe[inside]])
        texts.append(text[inside])
    return np.concatenate(places), np.concatenate(found), np.concatenate(texts)


def _passages(documents: DataFrame, seeds: DataFrame, least: float) -> DataFrame:
    """``doc_id, word, tokens, seeds``: the passages of documents in which seeds begin at ``least`` words or more."""
    sent = bitmap(seeds.select("seed").union(seeds.select(F.shiftrightunsigned("seed", 32))), "seed", FILTER_BITS)

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            rows, at, tokens, found = [], [], [], []
            for low, hashes, first in _tokens(batch.column(1)):
                places, grams, text = _hits(hashes, first, bits)
                if not len(places):
                    continue
                passage = (places - first[text]) // STRIDE
                # A word lies in the passage that begins before it and, but at the text's beginning, in the one before.
                twice = np.concatenate([np.arange(len(places)), np.flatnonzero(passage > 0)])
                passage = np.concatenate([passage, passage[passage > 0] - 1])
                order = np.lexsort((places[twice], passage, text[twice]))
                places, grams, text, passage = places[twice][order], grams[twice][order], text[twice][order], passage[order]
                cuts = np.flatnonzero(np.concatenate(([True], (np.diff(text) != 0) | (np.diff(passage) != 0))))
                fresh_place = np.concatenate(([True], np.diff(places) != 0))
                fresh_place[cuts] = True
                enough = np.add.reduceat(fresh_place.astype(np.int64), cuts) >= least
                for a, b in zip(cuts[enough], np.append(cuts[1:], len(places))[enough], strict=True):
                    word = int(passage[a]) * STRIDE
                    begin = int(first[text[a]]) + word
                    end = min(begin + PASSAGE, int(first[text[a] + 1]))
                    rows.append(low + int(text[a]))
                    at.append(word)
                    tokens.append(hashes[begin:end].astype("<u4").tobytes())
                    found.append(signed(np.unique(grams[a:b])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.int64()), pa.array(tokens, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "word", "tokens", "seeds"],
            )

    rows = documents.select("doc_id", F.col("text").cast("string"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(of_batches, f"doc_id {kind}, word long, tokens binary, seeds array<long>")


def places_met(item: bytes, passage: bytes) -> int:
    """At how many words of a passage a seed of an item begins."""
    a, b = np.frombuffer(item, "<u4").astype(np.uint64), np.frombuffer(passage, "<u4").astype(np.uint64)
    wanted = np.unique(np.concatenate([_triples(a, shape) for shape in SHAPES]))
    met = np.zeros(len(b), bool)
    for shape in SHAPES:
        triples = _triples(b, shape)
        at = np.minimum(np.searchsorted(wanted, triples), len(wanted) - 1)
        met[: len(triples)] |= wanted[at] == triples
    return int(met.sum())


def align(items: list[bytes], passages: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of pairs of word sequences (32-bit hashes), and the word of the passage at which
    the best alignment ends. A score of 1 means that the whole item stands in the passage unchanged."""
    sizes = np.array([len(x) // 4 for x in items], np.int64)
    a = np.full((len(items), sizes.max(initial=0)), -1, np.int64)
    b = np.full((len(items), max([0, *(len(x) // 4 for x in passages)])), -2, np.int64)
    for k, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[k, : sizes[k]] = np.frombuffer(x, "<u4")
        b[k, : len(y) // 4] = np.frombuffer(y, "<u4")
    slope = np.arange(b.shape[1] + 1, dtype=np.int16) * GAP
    row = np.zeros((len(items), b.shape[1] + 1), np.int16)
    best, end = np.zeros(len(items), np.int16), np.zeros(len(items), np.int64)
    for i in range(a.shape[1]):
        step = np.where(b == a[:, i : i + 1], np.int16(MATCH), np.int16(MISMATCH))
        new = np.zeros_like(row)
        np.maximum(row[:, :-1] + step, row[:, 1:] + np.int16(GAP), out=new[:, 1:])
        np.maximum(new, 0, out=new)
        # Gaps along the passage: a running maximum of the scores without the slope.
        new = np.maximum(np.maximum.accumulate(new - slope, axis=1) + slope, 0)
        new[i >= sizes] = 0
        at = new.argmax(1)
        top = new[np.arange(len(items)), at]
        end = np.where(top > best, at, end)
        best = np.maximum(best, top)
        row = new
    return best / np.maximum(1, MATCH * sizes), end


def leaks(documents: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, item_id, score, word``: which documents hold which test items, wholly or edited.

    Words are compared in lower case without ASCII punctuation. Every three words of an item that stand within
    two edits of each other are a seed, and a document that reaches a score of 0.5 has some of them, however it
    was edited and however common its words are; see ``_least_places``. Documents are read in overlapping
    passages. Of an item only the rarer seeds are looked up, which still find each such passage (see ``_rare``), so
    a phrase that many items and documents share brings no pairs; passages with enough seeds of an item are
    aligned with it. From a ``least_score`` of 0.5 and 7 words
    on, the result is that of an alignment of all documents with all items. ``score`` is the alignment's score
    over that of an exact copy (items of more than SEGMENT words: the best of their parts), at least
    ``least_score``; ``word`` is where in the document it ends.

    Items with fewer than ``least_words`` words are no evidence of a leak and are left out. Null and empty
    texts hold nothing. Rows with the same doc_id, or the same item_id, count as one document or item; nulls
    are an id of their own. Empty tables give no rows; other columns are ignored. Only a bitmap of fixed size
    and one number go to all tasks.
    """
    with_package(documents.sparkSession)
    parts = staged(_parts(benchmark, least_words).withColumn("part", F.xxhash64("item_id", "tokens")), "parts")
    seeds = staged(_seeds(parts), "seeds")
    items = parts.withColumn("least", _least_places(F.octet_length("tokens") / 4, least_score) - 1e-9)
    items = items.withColumn("asked", F.greatest(F.lit(1), F.ceil(F.ceil("least") / 2)))
    shortest = items.agg(F.min("least")).first()[0] or 0.0
    passages = staged(_passages(documents, seeds, shortest).withColumn("passage", F.monotonically_increasing_id()), "passages")
    met = passages.select("passage", F.explode("seeds").alias("seed")).join(_rare(seeds, items, passages), "seed")
    met = met.groupBy("passage", "part").agg(F.count_distinct("place").alias("places"))
    pairs = met.join(items.select("part", "item_id", F.col("tokens").alias("item"), "least", "asked"), "part").where("places >= asked")
    pairs = pairs.select("passage", "item_id", "item", "least").join(passages.select("passage", "doc_id", "word", "tokens"), "passage")

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                enough = [places_met(i, p) >= n for i, p, n in zip(*(some.column(c).to_pylist() for c in (2, 3, 5)), strict=True)]
                some = some.filter(pa.array(enough, pa.bool_()))
                if not some.num_rows:
                    continue
                score, end = align(some.column(2).to_pylist(), some.column(3).to_pylist())
                near = pa.array(np.flatnonzero(score >= least_score))
                out = [some.column(0).take(near), some.column(1).take(near), pa.array(score).take(near)]
                out.append(pc.add(some.column(4).take(near), pa.array(end).take(near)))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "item_id", "score", "word"])

    kinds = dict(pairs.dtypes)
    found = pairs.select("doc_id", "item_id", "item", "tokens", "word", "least").mapInArrow(
        scored, f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, score double, word long"
    )
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "word")).alias("best"))
    return best.select("doc_id", "item_id", "best.score", "best.word")


def decontaminated(documents: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents that hold no test item, with all their columns; rows with one doc_id stay or go together."""
    (key,) = fresh(documents, "leaked_id")
    ids = leaks(documents, benchmark, least_score).select(F.col("doc_id").alias(key)).distinct()
    return documents.join(ids, F.col("doc_id").eqNullSafe(F.col(key)), "left_anti").select(*documents.columns)
