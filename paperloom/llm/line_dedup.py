"""Line dedup by a deletion-neighbourhood join."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import RangeHash, bitmap, flat, in_bitmap, known_id, mix, signed, slices, staged, with_package
from paperloom.llm.ordered import packed

LEAST_CHARS = 10  # shorter lines must be equal to be copies
FILTER_BITS = 26
_SALT = np.uint64(0x5851F42D4C957F2D)


def _lines(column: pa.Array) -> Iterator[tuple]:
    """For each slice of a text column: its lines that are not blank, as row, number, start and end among its
    characters, the characters, and their range hash."""
    data, offsets = flat(column)
    for low, high in slices(offsets, 1 << 20):
        part = data[offsets[low] : offsets[high]]
        text = part.tobytes().decode("utf-8", "replace")
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))[offsets[low : high + 1] - offsets[low]]
        breaks = np.flatnonzero(codes == 10)
        # Each line ends at a line feed or where its text does.
        row = np.concatenate([np.searchsorted(chars, breaks, "right") - 1, np.arange(high - low)])
        edges = np.concatenate([breaks, chars[1:]])
        order = np.lexsort((edges, row))
        row, edges = row[order], edges[order]
        first = np.concatenate(([True], row[1:] != row[:-1]))
        starts = np.concatenate(([0], edges[:-1] + 1))
        starts[first] = chars[row[first]]
        number = np.arange(len(edges)) - np.maximum.accumulate(np.where(first, np.arange(len(edges)), 0))
        yield low, row, number, starts, edges, codes


def _solid(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which lines have a character that is not white space."""
    ink = np.concatenate(([0], np.cumsum(~np.isin(codes, (9, 11, 12, 13, 32)))))
    return ink[ends] > ink[starts]


def _names(hashes: RangeHash, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes, 128 bits together, that stand for a line."""
    one = hashes(starts, ends)
    with np.errstate(over="ignore"):
        return one, mix(hashes.raw(starts, ends) ^ _SALT)


def _halves(hashes: RangeHash, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys (key, line) of which two lines at distance 1 share one.

    Let n be the shorter length. The edit leaves the first n // 2 characters or the other n - n // 2 as they
    are, at the line's beginning or end. Each line is the shorter one of a pair, or the longer.
    """
    out = []
    for k in (0, 1):
        n = ends - starts - k
        for salt, a, b in ((0, starts, starts + n // 2), (1, ends - (n - n // 2), ends)):
            with np.errstate(over="ignore"):
                out.append(mix(hashes(a, b) + n.astype(np.uint64) * _SALT + np.uint64(salt)))
    return np.stack(out)


def _occurrences(documents: DataFrame) -> DataFrame:
    """``doc_id, row_hash, line, h1, h2`` for every line that is not blank."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, row, number, starts, ends, codes in _lines(batch.column(2)):
                solid = _solid(codes, starts, ends)
                one, two = _names(RangeHash(codes), starts[solid], ends[solid])
                at = pa.array(row[solid] + low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(number[solid].astype(np.int32)), pa.array(signed(one)), pa.array(signed(two))],
                    names=["doc_id", "row_hash", "line", "h1", "h2"],
                )

    return _texts(documents).mapInArrow(of_batches, f"doc_id {dict(documents.dtypes)['doc_id']}, row_hash long, line int, h1 long, h2 long")


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.xxhash64("text").alias("row_hash"), F.col("text").cast("string"))


def _shared_halves(documents: DataFrame, least_chars: int) -> DataFrame:
    """``key``: the halves that different lines have in common."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, starts, ends, codes in _lines(batch.column(2)):
                long = (ends - starts >= least_chars) & _solid(codes, starts, ends)
                hashes = RangeHash(codes)
                names, first = np.unique(hashes(starts[long], ends[long]), return_index=True)  # copies once
                keys = _halves(hashes, starts[long][first], ends[long][first])
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys.ravel())), pa.array(signed(np.tile(names, 4)))], names=["key", "h1"])

    keyed = _texts(documents).mapInArrow(of_batches, "key long, h1 long")
    return keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low != high").select("key")


def _candidates(documents: DataFrame, shared: DataFrame, least_chars: int) -> DataFrame:
    """``h1, h2, text``: the lines that share a half with another one."""
    sent = bitmap(shared, "key", FILTER_BITS)

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            for _, _, _, starts, ends, codes in _lines(batch.column(2)):
                long = np.flatnonzero((ends - starts >= least_chars) & _solid(codes, starts, ends))
                hashes = RangeHash(codes)
                long = long[in_bitmap(bits, _halves(hashes, starts[long], ends[long])).any(0)]
                one, two = _names(hashes, starts[long], ends[long])
                _, first = np.unique(one, return_index=True)
                texts = [codes[starts[k] : ends[k]].tobytes().decode("utf-32-le", "surrogatepass") for k in long[first]]
                yield pa.RecordBatch.from_arrays([pa.array(signed(one[first])), pa.array(signed(two[first])), pa.array(texts, pa.string())], names=["h1", "h2", "text"])

    found = _texts(documents).mapInArrow(of_batches, "h1 long, h2 long, text string")
    return found.groupBy("h1", "h2").agg(F.first("text").alias("text"))


def neighbourhood(codes: np.ndarray) -> np.ndarray:
    """Keys of a line's variants: the line itself, then without each one of its characters in turn."""
    n, hashes = len(codes), RangeHash(codes)
    with np.errstate(over="ignore"):
        without = hashes.total[:n] + hashes.inverse[1] * (hashes.total[n] - hashes.total[1 : n + 1])
        shorter = mix(without + np.uint64(n - 1) * np.uint64(0xD6E8FEB86659FD93))
    return np.concatenate([hashes(np.zeros(1, np.int64), np.full(1, n)), shorter])


def within_one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + 1 :] == b[p + 1 :] or a[p:] == b[p + 1 :] or a[p + 1 :] == b[p:]


def _variants(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, place, rank``: all variants of the lines; the place of the missing character, -1 where none is."""
    for batch in batches:
        texts, ranks = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        low = 0
        while low < len(texts):  # about half a million keys at a time
            high, size = low, 0
            while high < len(texts) and (high == low or size < 1 << 19):
                size += len(texts[high])
                high += 1
            found = [neighbourhood(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)) for t in texts[low:high]]
            sizes = np.array([len(k) for k in found])
            places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate(found))), pa.array(places.astype(np.int32)), pa.array(np.repeat(ranks[low:high], sizes))], names=["key", "place", "rank"]
            )
            low = high


def _witnesses(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``rank, witness``: for lines an earlier one at distance 1; rows come sorted by key, place and rank.

    A line is at distance 1 from each that lacks one of its characters, and from each that lacks a character
    at the same place. The first of these is enough, so a group gives fewer rows than twice its own.
    """
    none = np.int64(-1)
    key, place, head, whole = None, None, none, none  # of the row before: its run's first line, the key's own line
    for batch in batches:
        keys, places, ranks = (batch.column(k).to_numpy() for k in range(3))
        n = len(keys)
        if not n:
            continue
        new_key = np.concatenate(([key is None or keys[0] != key], keys[1:] != keys[:-1]))
        new_run = new_key | np.concatenate(([place is None or places[0] != place], places[1:] != places[:-1]))
        at = np.arange(n)
        run_at = np.maximum.accumulate(np.where(new_run, at, -1))
        heads = np.where(run_at >= 0, ranks[np.maximum(run_at, 0)], head)
        key_at = np.maximum.accumulate(np.where(new_key, at, -1))
        firsts = np.maximum(key_at, 0)
        wholes = np.where(key_at >= 0, np.where(places[firsts] == -1, ranks[firsts], none), whole)
        # The line itself may come as several rows only if two lines are one; a key's own line is unique.
        lacking = places >= 0
        out = [(ranks, heads, lacking & (heads < ranks)), (ranks, wholes, lacking & (wholes >= 0) & (wholes < ranks))]
        out.append((wholes, ranks, lacking & (heads == ranks) & (wholes > ranks)))
        late, early = (np.concatenate([x[c][x[2]] for x in out]) for c in (0, 1))
        yield pa.Table.from_pydict({"rank": late, "witness": early}).group_by(["rank", "witness"]).aggregate([]).combine_chunks().to_batches()[0] if len(late) else pa.RecordBatch.from_pydict({"rank": pa.array([], pa.int64()), "witness": pa.array([], pa.int64())})
        key, place, head, whole = keys[-1], places[-1], heads[-1], wholes[-1]


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = [within_one_edit(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))


def dropped_lines(documents: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id, row_hash, lines``: for every document that loses lines, their numbers from 0, ascending.

    Lines stand in the order of doc_id (null last), the hash of the text and their place in it. A line goes if
    an equal line stands before it, or, from ``least_chars`` characters, one at an edit distance of 1: one
    character put in, taken out or changed. Lines are compared by 128-bit hashes; every near pair is verified
    on its characters. Only lines that share a half with another emit their deletion neighbourhood, all
    variants without one character; lines at distance 1 always share a half, so nothing is lost.

    Blank lines never go. Null and empty texts have no lines to lose. Rows that are wholly equal, doc_id
    included, count as one. Very frequent lines and halves are reduced before each shuffle.
    """
    with_package(documents.sparkSession)
    rows = staged(_occurrences(documents), "lines")
    seat = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_hash", "line")
    firsts = rows.groupBy("h1", "h2").agg(F.min(seat).alias("seat"))
    candidates = _candidates(documents, staged(_shared_halves(documents, least_chars), "halves"), least_chars)
    # Sorted by seat over all partitions, so the ranks of rows ascend with their seats.
    ranked = candidates.join(firsts, ["h1", "h2"]).orderBy("seat").select("h1", "h2", "text", F.monotonically_increasing_id().alias("rank"))
    ranked = staged(ranked, "candidates")
    variants = ranked.select("text", "rank").mapInArrow(_variants, "key long, place int, rank long")
    pairs = variants.repartition("key").sortWithinPartitions("key", "place", "rank").mapInArrow(_witnesses, "rank long, witness long").distinct()
    pairs = pairs.join(ranked.select("rank", "h1", "h2", F.col("text").alias("a")), "rank")
    pairs = pairs.join(ranked.select(F.col("rank").alias("witness"), F.col("text").alias("b")), "witness")
    near = pairs.select("h1", "h2", "a", "b").mapInArrow(_verified, "h1 long, h2 long").distinct().withColumn("near", F.lit(True))
    # One step between grouping and join, so that Spark can split the join for a very frequent line.
    marks = firsts.withColumnRenamed("seat", "kept").join(near, ["h1", "h2"], "left").hint("rebalance")
    judged = rows.join(marks, ["h1", "h2"])
    gone = judged.where(F.col("near") | (F.col("kept") != seat))
    lost = gone.groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_set("line")).alias("lines"))  # of one document
    return lost


def deduplicated(documents: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` for every document: its text without the lines that an earlier line
    makes superfluous; see ``dropped_lines``. Null texts come back empty."""

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            texts, sizes, losses = [], [], []
            for blob, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = open_.decompress(blob).decode("utf-8", "surrogatepass").split("\n")
                lost = set(gone or ())
                texts.append("\n".join(x for k, x in enumerate(lines) if k not in lost))
                sizes.append(len(lines))
                losses.append(len(lost))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(losses, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"]
            )

    def pressed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed(batch.column(2).to_pylist()), pa.binary())], names=["doc_id", "row_hash", "packed"])

    lost = dropped_lines(documents, least_chars).select(known_id("doc_id").alias("id_text"), F.col("row_hash"), "lines")
    kind = dict(documents.dtypes)["doc_id"]
    texts = _texts(documents).mapInArrow(pressed, f"doc_id {kind}, row_hash long, packed binary").withColumn("id_text", known_id("doc_id"))
    rows = texts.join(lost, ["id_text", "row_hash"], "left").select("doc_id", "packed", "lines")
    return rows.mapInArrow(joined, f"doc_id {kind}, text string, n_lines long, n_dropped long")
