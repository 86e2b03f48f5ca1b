"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import fresh, known_id, mix, staged, with_package
from paperloom.llm.components import connected

RADIUS = 4
SHINGLE = 4
SEED = 42
SMALL = 64  # members of a variant whose pairs are compared directly; larger groups take the full balls


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a text in UTF-8; A-Z count as a-z, words are cut at ASCII white space."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:n].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist(), strict=True)
    hashes = np.fromiter((digest(line[s:e], seed) for s, e in pairs), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``row_hash`` (of the text) and ``print`` (a long) for every row; null texts are empty."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t or b"", shingle, seed) for t in (x.as_py() for x in batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "row_hash", "print"]
            )

    with_package(documents.sparkSession)
    rows = documents.select("doc_id", F.xxhash64("text").alias("row_hash"), F.encode("text", "UTF-8").alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, row_hash long, print long"
    return rows.mapInArrow(of_batches, schema)


def thirds() -> list[np.uint64]:
    """Masks of the three pairs of thirds of the 64 bits."""
    cuts = [(0, 21), (21, 42), (42, 64)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in cuts]
    return [np.uint64(x | y) for x, y in combinations(blocks, 2)]


def ball(mask: int, radius: int) -> np.ndarray:
    """What to flip to reach all variants within the radius, in the bits of the mask."""
    bits = [1 << i for i in range(64) if mask >> i & 1]
    flips = [sum(c) for r in range(radius + 1) for c in combinations(bits, r)]
    return np.array(flips, np.uint64)


def _variants(prints: np.ndarray, masks: list[np.uint64], radius: int) -> np.ndarray:
    """Keys of all variants, one row for each print; each mask has keys of its own."""
    out = []
    for k, mask in enumerate(masks):
        out.append(mix(((prints & mask)[:, None] ^ ball(int(mask), radius)[None, :]) + np.uint64(k)))
    return np.concatenate(out, axis=1)


def _emit(column: str, masks: list[np.uint64], radius: int, chunk: int):
    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k in range(0, len(prints), chunk):
                part = prints[k : k + chunk]
                keys = _variants(part, masks, radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, keys.shape[1]).view(np.int64))], names=["key", "print"]
                )

    return of_batches


def _meeting_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The one key at which a pair is compared, of all those at which it meets: the least variant between
    both, in the first pair of thirds where they differ in at most two bits."""
    keys, open_ = np.zeros(len(x), np.uint64), np.ones(len(x), bool)
    for k, mask in enumerate(thirds()):
        d = (x ^ y) & mask
        low = d & (~d + np.uint64(1))
        between = np.minimum((x & mask) ^ low, (x & mask) ^ d ^ low)
        here = open_ & (np.bitwise_count(d) <= 2)
        keys[here] = mix(between + np.uint64(k))[here]
        open_ &= ~here
    return keys


def _compare(radius: int, small: int):
    """Links between prints of one key; rows come sorted by key. A key of more than ``small`` prints gives
    rows (print, null) instead, for the full balls. Every link comes once."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints, hot_key = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

        def found(keys: np.ndarray, prints: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = [], []
            k, p = keys[~hot], prints[~hot]
            for lag in range(1, small):
                same = np.flatnonzero(k[lag:] == k[:-lag]) if len(k) > lag else np.zeros(0, np.int64)
                if not len(same):
                    break
                x, y = p[same], p[same + lag]
                near = (np.bitwise_count(x ^ y) <= radius) & (_meeting_key(x, y).view(np.int64) == k[same])
                a.append(x[near])
                b.append(y[near])
            one, two = (np.concatenate([*v, np.zeros(0, np.uint64)]) for v in (a, b))
            wide = np.unique(prints[hot])
            left = np.concatenate([one, wide]).view(np.int64)
            right = np.concatenate([two, np.zeros(len(wide), np.uint64)]).view(np.int64)
            if len(left):
                yield pa.RecordBatch.from_pydict({"a": pa.array(left), "b": pa.array(right, mask=np.arange(len(left)) >= len(one))})

        def closed(keys: np.ndarray, prints: np.ndarray, last: bool):
            """Splits off the rows of the last key, which may go on; marks keys that are too large."""
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.append(starts, len(keys)))
            hot = np.repeat((sizes > small) | (keys[starts] == hot_key if hot_key is not None else False), sizes)
            cut = len(keys) if last or sizes[-1] > small else starts[-1]
            return hot, cut

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            prints = np.concatenate([prints, batch.column(1).to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            hot, cut = closed(keys, prints, False)
            if cut:
                yield from found(keys[:cut], prints[:cut], hot[:cut])
                hot_key = keys[cut - 1] if cut == len(keys) and hot[-1] else None
            keys, prints = keys[cut:], prints[cut:]
        if len(keys):
            hot, cut = closed(keys, prints, True)
            yield from found(keys, prints, hot)

    return of_batches


def _stars(radius: int):
    """Links every print of a variant with the first; rows come sorted by key."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head = None, np.uint64(0)
        for batch in batches:
            keys, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            new = np.concatenate(([key is None or keys[0] != key], keys[1:] != keys[:-1]))
            heads = np.where(new, np.arange(len(keys)), -1)
            heads = np.maximum.accumulate(heads)
            first = np.where(heads >= 0, prints[np.maximum(heads, 0)], head)
            near = (first != prints) & (np.bitwise_count(first ^ prints) <= radius)
            pairs = pa.RecordBatch.from_pydict({"a": pa.array(first[near].view(np.int64)), "b": pa.array(prints[near].view(np.int64))})
            yield from pa.Table.from_batches([pairs]).group_by(["a", "b"]).aggregate([]).combine_chunks().to_batches()
            key, head = keys[-1], first[-1]

    return of_batches


def links(prints: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """``a``, ``b``: links that join all prints at ``radius`` (4 or 2) or fewer differing bits.

    ``prints`` has a long column ``print``; nulls are ignored. Two prints at 4 bits differ in at most 2 bits
    in one pair of thirds of the word, because every bit counts in two of the three pairs. So a print emits,
    for each pair of thirds, the variants within half of that, one bit: 131 keys in all. Prints that share a
    variant meet, and their whole distance is verified. A variant that more than ``small`` prints share is
    not paired up: its prints emit the full ball, all 2,081 variants within two bits of the word. What meets
    there is within four bits by the triangle inequality, so one star for each variant loses nothing, and
    the work is linear in the group. Links inside such a group may be replaced by paths of other links.
    """
    if radius not in (2, 4):
        raise ValueError("the radius is 2 or 4 bits")
    with_package(prints.sparkSession)
    distinct = prints.select("print").where("print is not null").distinct()
    keyed = distinct.mapInArrow(_emit("print", thirds(), 1, 4096), "key long, print long")
    met = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(radius, small), "a long, b long")
    met = staged(met.distinct(), "met")
    wide = met.where("b is null").select(F.col("a").alias("print"))
    whole = wide.mapInArrow(_emit("print", [np.uint64(0xFFFFFFFFFFFFFFFF)], radius // 2, 512), "key long, print long")
    stars = whole.repartition("key").sortWithinPartitions("key", "print").mapInArrow(_stars(radius), "a long, b long")
    return met.where("b is not null").union(stars).distinct()


def near_duplicates(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, small: int = SMALL) -> DataFrame:
    """``doc_id``, ``row_hash``, ``print`` and ``component_id``, the smallest doc_id reachable, for every row.

    Documents are linked if their prints differ in at most ``radius`` bits. Each distinct print stands once
    in the search, however many copies it has. Null and empty texts and texts of white space have the print
    zero, which is linked like any other. Repeated rows come back repeated; rows without an id belong to a
    component but do not name it (its id is null if none has one); an empty table gives an empty result;
    other columns are ignored.
    """
    prints = staged(fingerprints(documents, shingle), "prints")
    first = prints.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    groups = connected(links(first, radius, small)).withColumnRenamed("node", "print")
    placed = first.join(groups, "print", "left").withColumn("component", F.coalesce("component", "print"))
    named = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    names = placed.join(named, "component").select("print", "component_id", "component")
    return prints.join(names, "print").select("doc_id", "row_hash", "print", "component_id", "component")


def keep_one(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The documents without near-duplicates: one row of each component stays, with all its columns.

    It is the row with the smallest doc_id; among rows with that id the one with the smallest hash of its
    text; of equal rows one. Rows without an id stay only where no row of the component has one.
    """
    found = near_duplicates(documents, radius, shingle)
    keepers = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row_hash")).alias("keeper"))
    id_text, row_hash, seat = fresh(documents, "id_text", "row_hash", "seat")
    keepers = keepers.select(known_id("keeper.doc_id").alias(id_text), F.col("keeper.row_hash").alias(row_hash))
    rows = documents.withColumn(id_text, known_id("doc_id")).withColumn(row_hash, F.xxhash64("text"))
    kept = rows.join(keepers, [id_text, row_hash])
    # Equal rows of one document: the join's partitions serve this window too.
    once = kept.withColumn(seat, F.row_number().over(Window.partitionBy(id_text, row_hash).orderBy(F.lit(0))))
    return once.where(F.col(seat) == 1).select(*documents.columns)
