"""Document fingerprints by a randomised edit embedding, bit-sampled banding and verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import mix, staged, with_package
from paperloom.llm.components import connected
from paperloom.llm.ordered import dealt, range_starts, unpacked

STATES, CLASSES = 1024, 64  # the walk's coins repeat after STATES steps; characters share CLASSES of coins
LEAST_SAMPLES = 128
FEW = 32  # texts fewer than this walk faster one by one than side by side
BAND = 4  # samples of a band
LIKENESS = 0.8
SMALL = 64


def _coins(seed: int = 7) -> np.ndarray:
    """For every step (modulo STATES) and class of characters, the step at which the walk has moved on,
    times CLASSES: the walk reads a character again until its coin says to go on."""
    on = mix(np.arange(STATES * CLASSES, dtype=np.uint64) + np.uint64(seed << 32)).reshape(STATES, CLASSES) & np.uint64(1)
    on[63::64] = 1  # it goes on within 64 steps
    twice = np.concatenate([on, on])
    steps = np.zeros((STATES, CLASSES), np.int64)
    ahead = np.zeros(CLASSES, np.int64)
    for s in range(2 * STATES - 1, -1, -1):
        ahead = np.where(twice[s] == 1, 1, ahead + 1)
        if s < STATES:
            steps[s] = ahead
    return (((np.arange(STATES)[:, None] + steps) % STATES) * CLASSES).astype(np.uint16).ravel()


_TABLE = _coins()
_LIST = _TABLE.tolist()
_zeros = np.zeros(0, np.uint8)
_sampled: dict[int, np.ndarray] = {}


def _depth(n: int) -> np.ndarray:
    """For each step of the walk, up to which level it is sampled; every level keeps half of the one before."""
    global _zeros
    if len(_zeros) < n:
        h = mix(np.arange(max(n, 1 << 16, 2 * len(_zeros)), dtype=np.uint64) + np.uint64(1 << 40))
        low = h & (~h + np.uint64(1))
        _zeros = np.minimum(63, np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.uint8)
        _sampled.clear()
    return _zeros[:n]


def _steps(level: int, n: int) -> np.ndarray:
    """The sampled steps of a level among the first n."""
    _depth(n)
    if level not in _sampled:
        _sampled[level] = np.flatnonzero(_zeros >= level)
    return _sampled[level][: np.searchsorted(_sampled[level], n)]


def embed(texts: list[str]) -> list[tuple[int, bytes]]:
    """Fingerprints of texts: a level and one byte for each sampled step of the walk.

    All texts walk with the same coins (Chakraborty, Goldenberg and Koucky 2016), so two texts with few
    edits read the same characters at most steps, and their edit distance becomes a Hamming distance. The
    walks of a batch run side by side. The step's byte is a hash of the character read and the two after it.
    """
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    # Step-major layout: the t-th characters of all texts that are long enough stand together.
    active = len(texts) - np.searchsorted(np.sort(sizes), np.arange(longest), "right")
    at = np.concatenate(([0], np.cumsum(active)))
    classes, walk = np.empty(int(at[-1]), np.uint16), np.empty(int(at[-1]), np.uint16)
    for lane, k in enumerate(order):
        classes[at[: sizes[k]] + lane] = ((codes[k] * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.uint16)
    before, index = np.zeros(len(texts), np.uint16), np.empty(len(texts), np.uint16)
    places, counts = at.tolist(), active.tolist()
    together = int(np.searchsorted(-active, -FEW, "right"))  # steps at which many texts walk side by side
    for t in range(together):
        a, n = places[t], counts[t]
        now = walk[a : a + n]
        np.add(before[:n], classes[a : a + n], out=index[:n])
        _TABLE.take(index[:n], out=now, mode="wrap")
        before = now
    for lane in range(counts[together] if together < longest else 0):  # the rest of the longest texts, one by one
        rest = at[together : sizes[order[lane]]] + lane
        start = int(before[lane])
        walk[rest] = np.fromiter(accumulate(classes[rest].tolist(), lambda s, c: _LIST[s + c], initial=start), np.uint16)[1:]
    out: list[tuple[int, bytes]] = [(0, b"")] * len(texts)
    for lane, k in enumerate(order):
        n = int(sizes[k])
        if not n:
            continue
        state = walk[at[:n] + lane]
        moved = state.copy()  # the difference of 16-bit states is the number of steps times CLASSES
        moved[1:] -= state[:-1]
        ends = np.cumsum(moved >> np.uint16(6), dtype=np.int64)
        c = np.concatenate([codes[k], np.zeros(2, np.uint32)])
        level = max(0, int(ends[-1] // LEAST_SAMPLES).bit_length() - 1)
        read = np.searchsorted(ends, _steps(level, int(ends[-1])), "right")
        with np.errstate(over="ignore"):
            h = mix(mix(mix(c[read].astype(np.uint64)) + c[read + 1]) + c[read + 2])
        out[k] = (level, (h >> np.uint64(56)).astype(np.uint8).tobytes())
    return out


def to_text(mark: tuple[int, bytes]) -> str:
    return f"{mark[0]:02x}{mark[1].hex()}"


def from_text(text: str) -> tuple[int, bytes]:
    return int(text[:2], 16), bytes.fromhex(text[2:])


def _at_level(mark: tuple[int, bytes], level: int) -> np.ndarray:
    """The samples that the mark has at the level or a higher one."""
    samples = np.frombuffer(mark[1], np.uint8)
    if level == mark[0]:
        return samples
    n = 1 << (level + 8)
    while True:  # steps until there are as many as samples
        depth = _depth(n)
        steps = depth[depth >= mark[0]]
        if len(steps) >= len(samples):
            return samples[steps[: len(samples)] >= level]
        n *= 2


def likeness(a: tuple[int, bytes], b: tuple[int, bytes]) -> float:
    """Share of the sampled steps at which two fingerprints agree; 1 for equal texts, also for two empty ones."""
    if a == b:
        return 1.0
    level = max(a[0], b[0])
    x, y = _at_level(a, level), _at_level(b, level)
    n = min(len(x), len(y))
    return float((x[:n] == y[:n]).sum()) / max(len(x), len(y), 1)


def band_keys(mark: tuple[int, bytes]) -> np.ndarray:
    """Keys of the bands, at the mark's level and the next: texts of like length meet at one of them."""
    keys = []
    for level in (mark[0], mark[0] + 1):
        samples = _at_level(mark, level)
        n = max(1, len(samples) // BAND)
        rows = np.zeros((n, BAND), np.uint64)
        rows.ravel()[: min(len(samples), n * BAND)] = samples[: n * BAND]
        with np.errstate(over="ignore"):
            value = (rows << (np.arange(BAND, dtype=np.uint64) * np.uint64(8))).sum(1)
            keys.append(mix(mix(value + np.uint64(1)) + np.arange(n, dtype=np.uint64) * np.uint64(64) + np.uint64(level)))
    return np.concatenate(keys)


def fingerprints(documents: DataFrame, chunk_chars: int = 1 << 22) -> DataFrame:
    """``doc_id``, ``row_hash`` (of the text) and ``fingerprint`` for every row; null texts are empty."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            marks = [to_text(m) for part in chunks(texts, chunk_chars) for m in embed(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.string())], names=["doc_id", "row_hash", "fingerprint"])

    with_package(documents.sparkSession)
    rows = documents.select("doc_id", F.xxhash64("text").alias("row_hash"), F.col("text").cast("string"))
    return rows.mapInArrow(of_batches, f"doc_id {dict(rows.dtypes)['doc_id']}, row_hash long, fingerprint string")


def compared_with_next(documents: DataFrame, ranges: int | None = None, chunk_chars: int = 1 << 22) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are.

    The next document is the one that follows in ascending order of doc_id, after the last the first; rows
    with one id follow each other in the order of their texts' hashes; a row without an id is its own next
    one. In the edited text, the last quarter (floor of n / 4 characters) gives way to the first as many
    characters (or all) of the next text.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null
    texts are empty; repeated rows come back repeated; an empty table gives an empty result; other columns
    are ignored. Each text moves once, compressed, to the task of its range of ids.
    """

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # the last row of its range so far: range, doc_id, text

        def of_rows(rows: list[tuple]) -> pa.RecordBatch:
            """Results of all rows that have a successor in the list: range, doc_id, text, late."""
            texts = [r[2] for r in rows]
            own, edited, after = [], [], []
            for k, row in enumerate(rows):
                if row[3]:
                    continue
                following = k if row[1] is None else k + 1 if k + 1 < len(rows) and rows[k + 1][0] == row[0] else None
                if following is None:
                    continue
                quarter = len(texts[k]) // 4
                own.append(k)
                after.append(following)
                edited.append(texts[k][: len(texts[k]) - quarter] + texts[following][:quarter])
            marks = embed(texts)
            changed = embed(edited)
            out = {
                "doc_id": pa.array([rows[k][1] for k in own], pa.int64()),
                "n_chars": pa.array([len(texts[k]) for k in own], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                "fingerprint": pa.array([to_text(marks[k]) for k in own], pa.string()),
                "edited_fingerprint": pa.array([to_text(m) for m in changed], pa.string()),
                "near_edited": pa.array([likeness(marks[k], m) for k, m in zip(own, changed, strict=True)], pa.float64()),
                "near_next": pa.array([likeness(marks[k], marks[j]) for k, j in zip(own, after, strict=True)], pa.float64()),
            }
            return pa.RecordBatch.from_pydict(out)

        size = 0
        for batch in batches:
            ranges, late, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for k in range(batch.num_rows):  # texts are unpacked as they are used
                if waiting and waiting[-1][3] and late[k] and waiting[-1][0] == ranges[k]:
                    continue  # of the rows with the next range's first id, the first is the successor
                text = unpacked(batch.column(4).slice(k, 1).to_pylist())[0]
                waiting.append((ranges[k], ids[k], text, late[k]))
                size += len(text)
                if size >= chunk_chars:
                    yield of_rows(waiting)
                    waiting, size = [r for r in waiting[-1:] if r[1] is not None], 0
        if waiting:
            yield of_rows(waiting)

    starts = range_starts(documents, ranges)
    return dealt(documents, starts, with_next=True).mapInArrow(
        of_batches,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def chunks(texts: list[str], most: int) -> Iterator[list[str]]:
    """Parts of a list of texts of about ``most`` characters."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _verify(least: float):
    """Links between fingerprints that share a band; rows ``key, low, high, block, fingerprint`` come sorted.

    Each group of key, low and high holds one block, all pairs of which are compared, or two, compared with each other.
    """

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, before = None, []
        for batch in batches:
            links = set()
            for *now, block, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mark = from_text(text)
                if now != group:
                    group, before = now, []
                for its_block, other, its in before:
                    if now[1] != now[2] and its_block == block:
                        continue
                    pair = (other, text) if other < text else (text, other)
                    if other != text and pair not in links and likeness(its, mark) >= least:
                        links.add(pair)
                if now[1] == now[2] or block == now[1]:
                    before.append((block, text, mark))
            pairs = sorted(links)
            yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.string()), "b": pa.array([p[1] for p in pairs], pa.string())})

    return of_batches


def near_duplicates(documents: DataFrame, least: float = LIKENESS, small: int = SMALL) -> DataFrame:
    """``doc_id``, ``row_hash``, ``fingerprint`` and ``class_id``, the smallest doc_id of its class, for every row.

    Distinct fingerprints emit a key for each band of BAND sampled steps; those that share a band are
    compared, and linked at a likeness of ``least`` or more. At 0.8 a pair shares a band of its 32 or more
    with a chance above 0.9999. The fingerprints of a band that more than ``small`` share are dealt into
    blocks of about ``small``, and every two blocks meet in a group of their own: all pairs are compared,
    whose number is the square of the band's, in groups of bounded size. Null and empty texts are one class; repeated rows come back
    repeated; rows without an id do not name a class; other columns are ignored.
    """
    prints = staged(fingerprints(documents), "marks")
    first = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            own = [band_keys(from_text(t)) for t in texts]
            index = np.repeat(np.arange(len(own)), [len(x) for x in own])
            flat = np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), batch.column(0).take(pa.array(index))], names=["key", "fingerprint"])

    banded = first.select("fingerprint").mapInArrow(keys, "key long, fingerprint string")
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / small).alias("blocks"))
    met = banded.join(shared, "key").withColumn("block", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "fingerprint")
    met = met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "block", "fingerprint")
    links = met.mapInArrow(_verify(least), "a string, b string")
    groups = connected(links).withColumnRenamed("node", "fingerprint")
    placed = first.join(groups, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    named = placed.groupBy("component").agg(F.min("first_id").alias("class_id"))
    names = placed.join(named, "component").select("fingerprint", "class_id")
    return prints.join(names, "fingerprint").select("doc_id", "row_hash", "fingerprint", "class_id")
