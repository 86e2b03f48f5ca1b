"""Helpers that the operators share: staged tables, text buffers, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import drop_scratch, scratch_dir, ship_package

# The white space that separates words in all contracts (space, tab to carriage return).
WHITE_SPACE = b" \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

SLICE_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[list(WHITE_SPACE)] = True
_OTHER = np.zeros(256, bool)  # all ASCII but letters and digits
_OTHER[[b for b in range(128) if not chr(b).isalnum()]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_staged: list[str] = []  # folders of this driver's staged tables that are still there


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage ends there.

    A lost executor repeats nothing that was staged. The folder stays until ``drop_staged``.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_folders() -> list[str]:
    return list(_staged)


def drop_staged(spark: SparkSession, folders: list[str]) -> None:
    """Deletes staged tables that nothing reads any more."""
    for path in folders:
        drop_scratch(spark, path)
        _staged.remove(path)


def tokenizer_definition(path: str | None = None) -> bytes:
    """A tokenizer's file, read by the driver; by default the public one that the contract names."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as file:
        return file.read()


BATCH_BYTES = 8 << 20


def with_package(spark: SparkSession) -> SparkSession:
    """The session, with this package on its workers and Arrow batches of texts of at most BATCH_BYTES.

    Batches count rows by default, up to 64 MB each, on both sides of every task; a smaller limit that the
    session has already stays.
    """
    ship_package(spark)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(limit, None)
    if now is None or now in ("67108864", "67108864b", "64m", "64MB"):
        spark.conf.set(limit, str(BATCH_BYTES))
    return spark


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` does not have (compared without case)."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def known_id(column: str):
    """An id as text, empty for null, so that rows without an id join and group like any other."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def once_each(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of the keys, of rows that are equal where their keys are and have few different keys.

    Every task drops the copies that it meets itself, so few rows of a key with very many copies are shuffled. The
    different keys must be bounded, as each task remembers them.
    """
    names = rows.columns

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            new = []
            for k, key in enumerate(zip(*(batch.column(names.index(c)).to_pylist() for c in keys), strict=True)):
                if key not in seen:
                    seen.add(key)
                    new.append(k)
            yield batch.take(pa.array(new, pa.int64()))

    return rows.mapInArrow(of_batches, rows.schema).dropDuplicates(list(keys))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column as one array, and where each value starts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of values of about ``most`` bytes, so that working arrays stay small; a longer value stands alone."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1
        high = min(n, max(low + 1, high))
        yield low, high
        low = high


def words(data: np.ndarray, offsets: np.ndarray, low: int, high: int, bare: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of values ``low`` to ``high``, and the number of the first word of each value.

    Words are cut at white space, or if ``bare`` at all ASCII characters but letters and digits.
    """
    first, last = int(offsets[low]), int(offsets[high])
    inside = ~(_OTHER if bare else _SPACE)[data[first:last]]
    bounds = (offsets[low : high + 1] - first).astype(np.int64)
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(high - low + 1, np.int64)
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    before[bounds[:-1][bounds[:-1] < len(inside)]] = False
    ends_at = bounds[1:] - 1
    after[ends_at[ends_at >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts + first, ends + first, np.searchsorted(starts, bounds)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse modulo 2**64, up to n."""
    if len(_powers[0]) <= n:
        with np.errstate(over="ignore"):
            base, inverse = _BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))
            size = max(n + 1, 1 << 16)
            for k, b in enumerate((base, inverse)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (splitmix64 finalizer)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class RangeHash:
    """64-bit hashes of any ranges of one array, each in constant time after one pass."""

    def __init__(self, values: np.ndarray):
        power, self.inverse = _power(len(values) + 1)
        with np.errstate(over="ignore"):
            self.total = np.zeros(len(values) + 1, np.uint64)
            np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], out=self.total[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.total[ends] - self.total[starts]) * self.inverse[starts]

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(self.raw(starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each word given by its place in ``data``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    low, high = int(starts[0]), int(ends[-1])
    return RangeHash(data[low:high])(starts - low, ends - low)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words of one sequence."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[k : len(hashes) - n + 1 + k])
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def bitmap(df: DataFrame, column: str, bits: int):
    """A broadcast bitmap of 2**bits places of the hashes in a long column, of that size whatever their number.

    It only spares rows a join: what it lets through by chance must be told apart later.
    """
    place = F.col(column).bitwiseAND((1 << bits) - 1)
    found = df.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, int(`{column}` & 63))").alias("bit"))
    found = found.groupBy("word").agg(F.bit_or("bit").alias("bits"))  # at most 2**(bits - 6) rows
    out = np.zeros(1 << (bits - 6), np.int64)
    for batch in found.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return df.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
