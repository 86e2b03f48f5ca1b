"""Documents dealt to tasks by ranges of their id, texts compressed on the way."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import with_package

PER_SPLIT = 2  # ranges for each split of the input


def range_starts(documents: DataFrame, ranges: int | None = None) -> np.ndarray:
    """Ids at which ranges of about as many rows begin; the first is the smallest id.

    There are ``ranges`` of them, or PER_SPLIT for each split of the input, so their number follows the
    input and their size does not. They are the only thing that reaches the driver. Ids are whole numbers.
    """
    ranges = ranges or PER_SPLIT * documents.rdd.getNumPartitions()
    shares = [k / ranges for k in range(ranges)]
    found = documents.agg(F.min("doc_id"), F.percentile_approx("doc_id", shares, max(10_000, 10 * ranges))).first()
    return np.unique(np.array([found[0], *(found[1] or [])], np.int64)) if found[0] is not None else np.zeros(0, np.int64)


def packed(texts: Iterable[str | bytes | None]) -> list[bytes]:
    """Texts compressed one by one; null is empty."""
    press = zstandard.ZstdCompressor(level=3, write_content_size=True)
    return [press.compress(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t or b"") for t in texts]


def unpacked(blobs: list[bytes]) -> list[str]:
    open_ = zstandard.ZstdDecompressor()
    return [open_.decompress(b).decode("utf-8", "surrogatepass") for b in blobs]


def dealt(documents: DataFrame, starts: np.ndarray, with_next: bool = False, pack: Callable[[list], list[bytes]] = packed) -> DataFrame:
    """``range, late, doc_id, row_hash, packed``: each range in one partition, in ascending order of id.

    ``with_next``: the documents that begin a range also come, marked ``late``, at the end of the range
    before (those of the first range at the end of the last one), so every document meets its successor.
    Rows without an id are spread over all ranges and come first in them. Equal ids come in the order of
    the hash of their texts. ``pack`` turns texts into what is moved in their place.
    """

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = batch.column(0), max(1, len(starts))
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            values = ids.fill_null(0).to_numpy()
            hashes = batch.column(1).to_numpy()
            place = np.where(known, np.searchsorted(starts, values, "right") - 1, hashes % n)
            blobs = pack(batch.column(2).to_pylist())
            rows = np.arange(len(values))
            late = np.zeros(len(values), bool)
            if with_next and len(starts):
                again = np.flatnonzero(known & (starts[place] == values))
                rows, late = np.concatenate([rows, again]), np.concatenate([late, np.ones(len(again), bool)])
                place = np.concatenate([place, (place[again] - 1) % n])
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place.astype(np.int32)), pa.array(late), ids.take(take), batch.column(1).take(take), pa.array(blobs, pa.binary()).take(take)],
                names=["range", "late", "doc_id", "row_hash", "packed"],
            )

    with_package(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_hash"), F.col("text").cast("string"))
    spread = rows.mapInArrow(of_batches, "range int, late boolean, doc_id long, row_hash long, packed binary")
    placed = spread.repartitionById(max(1, len(starts)), F.col("range"))  # one range in each partition
    return placed.sortWithinPartitions("range", "late", "doc_id", "row_hash")
