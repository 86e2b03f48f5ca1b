"""Token ids of documents in files of Huffman-coded blocks."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import staged, with_package
from paperloom.llm.huffman import MOST_BITS, Decoder, canonical, code_lengths, pack
from paperloom.llm.ordered import dealt, range_starts
from paperloom.session import scratch_dir

END = 1
BLOCK = 1 << 16  # ids of a block, about; it holds whole documents
CHECKPOINT = 1 << 10  # ids from one checkpoint to the next
MAGIC = b"HTB1"
HEADER = struct.Struct("<4sQQQQI")  # magic, ids before the block, ids, documents, checkpoints, ids between checkpoints

# The steps of the public tokenizer of words, whose pattern PIECES and PLAIN follow for Latin-1.
WORD_STEPS = (
    {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
PLAIN = re.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
MOST_KEPT = 700_000  # words and pieces that a worker remembers, some 170 bytes each

_encoders: dict[bytes, Encoder] = {}


class _Kept(dict):
    """Values that are made when they are first asked for, or taken from the table before this one."""

    def __init__(self, make: Callable[[bytes], bytes], older: dict[bytes, bytes]):
        super().__init__()
        self.make, self.older = make, older

    def __missing__(self, key: bytes) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def next(self) -> _Kept:
        """An empty table that still knows this one's values, but not those of the table before it."""
        self.older = {}
        return _Kept(self.make, self)


class Encoder:
    """Ids of texts by a tokenizer of the ``tokenizers`` library.

    Tokenizers with the steps WORD_STEPS never join what ASCII white space separates, and in words of ASCII
    and Latin-1 letters they cut at fixed places. So a text has the ids of its words one after the other,
    such a word those of its pieces, and the library's model reads every distinct piece once (words and pieces
    share one table, of MOST_KEPT entries at most). Other words go through the whole tokenizer, as do whole
    texts of other tokenizers.
    """

    def __init__(self, definition: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_buffer(definition)
        self.kind = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        steps = json.loads(definition)
        self.by_words = (steps["normalizer"], steps["pre_tokenizer"]) == WORD_STEPS
        special = [t["content"] for t in steps["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.letters_only = any(s.isalpha() for s in special)
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {c: to_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}
        self.words = _Kept(self._word, {})

    def _piece(self, piece: str) -> bytes:
        tokens = self.tokenizer.model.tokenize(piece if piece.isascii() else piece.translate(self.as_bytes))
        return array(self.code, [t.id for t in tokens]).tobytes()

    def _word(self, word: bytes) -> bytes:
        if word.isalpha() and not self.letters_only:  # of bytes: ASCII letters, one piece
            small = word.lower()
            return self._piece(word.decode()) if small == word else self.words[small]
        text = word.decode("utf-8", "replace")
        if PLAIN.fullmatch(text) and not self.special.search(text):
            pieces = PIECES.findall(text.lower())
            if len(pieces) == 1 and pieces[0] == text:
                return self._piece(text)
            return b"".join([self.words[p.encode()] for p in pieces])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __call__(self, texts: list[str | None], end: int = END) -> list[bytes]:
        out, last = [], np.array([end], self.kind).tobytes()
        if not self.by_words:
            found = self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
            return [np.array(e.ids, self.kind).tobytes() + last for e in found]
        for text in texts:
            words = (text or "").encode("utf-8", "replace").split()
            out.append(b"".join(map(self.words.__getitem__, words)) + last)
            if len(self.words) > MOST_KEPT // 2:
                self.words = self.words.next()
        return out


def encoder(definition: bytes) -> Encoder:
    """The encoder of this Python worker."""
    if definition not in _encoders:
        _encoders[definition] = Encoder(definition)
    return _encoders[definition]


def _numbers(spark: SparkSession, sent: Broadcast) -> tuple[str, int]:
    """How the ids of a tokenizer are kept, and how many there are. A task reads the tokenizer, as the driver has no use for it."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            own = encoder(sent.value)
            yield pa.RecordBatch.from_pydict({"kind": pa.array([own.kind]), "n": pa.array([own.tokenizer.get_vocab_size(with_added_tokens=True)], pa.int64())})

    return tuple(spark.range(0, 1, 1, 1).mapInArrow(of_batches, "kind string, n long").first())


def _staged_ids(documents: DataFrame, sent: Broadcast, end: int, ranges: int | None) -> DataFrame:
    """``range, offset, doc_id, ids, packed``: the ids of every document, in the order of the file within each range."""

    def packed(texts: list) -> list[bytes]:
        press = zstandard.ZstdCompressor(level=1)
        return [press.compress(x) for x in encoder(sent.value)(texts, end)]

    def with_offsets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = int(encoder(sent.value).kind[-1])
        last, offset = None, 0
        for batch in batches:
            blobs = batch.column(4).to_pylist()
            sizes = [zstandard.frame_content_size(b) // width for b in blobs]
            offsets = []
            for r, n in zip(batch.column(0).to_pylist(), sizes, strict=True):
                offset = offset if r == last else 0
                offsets.append(offset)
                last, offset = r, offset + n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(offsets, pa.int64()), batch.column(2), pa.array(sizes, pa.int64()), batch.column(4)],
                names=["range", "offset", "doc_id", "ids", "packed"],
            )

    rows = dealt(documents, range_starts(documents, ranges), pack=packed)
    return staged(rows.mapInArrow(with_offsets, "range int, offset long, doc_id long, ids long, packed binary"), "ids")


def _counts(ids: DataFrame, kind: str, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents; one row for each id reaches the driver."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, open_ = np.zeros(vocabulary, np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                found = b"".join([open_.decompress(blob) for blob in batch.column(0).slice(k, 1024).to_pylist()])
                total += np.bincount(np.frombuffer(found, kind), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    found = ids.select("packed").mapInArrow(of_batches, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(vocabulary, np.int64)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return counts


def block_bytes(start: int, ids: list[int | None], parts: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """One block: header, document ids and their numbers of token ids, bit offsets of the checkpoints, bits."""
    symbols = np.concatenate(parts)
    bits, at = pack(symbols, lengths, codes)
    checkpoints = at[::CHECKPOINT].astype("<u8")
    head = HEADER.pack(MAGIC, start, len(symbols), len(ids), len(checkpoints), CHECKPOINT)
    known = np.array([k is not None for k in ids], np.uint8)
    names = np.array([0 if k is None else k for k in ids], "<i8")
    sizes = np.array([len(p) for p in parts], "<u8")
    return b"".join([head, known.tobytes(), names.tobytes(), sizes.tobytes(), checkpoints.tobytes(), bits])


def read_blocks(blocks: list[bytes], decoder: Decoder) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Document id, number of ids before it, and ids of every document of some blocks, each read on its own."""
    data, at, counts, heads, base = [], [], [], [], 0
    for block in blocks:
        magic, start, n, documents, checkpoints, every = HEADER.unpack_from(block)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        place = HEADER.size
        known = np.frombuffer(block, np.uint8, documents, place)
        names = np.frombuffer(block, "<i8", documents, place := place + documents)
        sizes = np.frombuffer(block, "<u8", documents, place := place + 8 * documents).astype(np.int64)
        bits = np.frombuffer(block, "<u8", checkpoints, place := place + 8 * documents).astype(np.int64)
        stream = np.frombuffer(block, np.uint8, offset=place + 8 * checkpoints)
        data.append(stream)
        at.append(bits + 8 * base)
        counts.append(np.minimum(every, n - every * np.arange(checkpoints)))
        heads.append((start, known, names, sizes))
        base += len(stream)
    if not blocks:
        return
    ids = decoder(np.concatenate(data), np.concatenate(at), np.concatenate(counts))
    place = 0
    for start, known, names, sizes in heads:
        for k in range(len(sizes)):
            yield (int(names[k]) if known[k] else None), start, ids[place : place + sizes[k]]
            start += int(sizes[k])
            place += int(sizes[k])


def write(documents: DataFrame, definition: bytes, path: str, end: int = END, most_bits: int = MOST_BITS, ranges: int | None = None) -> None:
    """Writes the ids of all documents, in ascending order of doc_id, to a folder.

    ``path/blocks`` has one row for each block: ``start``, the number of ids before it, and ``block``, its
    bytes. ``path/code`` has the code: ``id`` and ``bits``, from the counts of all documents; canonical codes
    follow from these. The files are Parquet, so any file system that Spark writes to will do; a block can be
    decoded on its own, and from each of its checkpoints. Null and empty texts have only the end id. Rows
    with one doc_id stand in the order of their texts' hashes; rows without an id stand at the beginning of
    the range of ids that their text's hash falls to. An empty table gives an empty code and no blocks.
    """
    spark = documents.sparkSession
    with_package(spark)
    sent = spark.sparkContext.broadcast(definition)  # of the tokenizer's size
    ids = _staged_ids(documents, sent, end, ranges)
    kind, vocabulary = _numbers(spark, sent)
    lengths = code_lengths(_counts(ids, kind, max(vocabulary, end + 1)), most_bits)
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    code = pa.table({"id": pa.array(used), "bits": pa.array(lengths[used].astype(np.int64))})
    spark.createDataFrame(code).coalesce(1).write.parquet(f"{path}/code")
    before, starts = 0, {}
    for r in ids.groupBy("range").agg(F.sum("ids").alias("n")).orderBy("range").collect():  # a row for each range
        starts[r.range] = before
        before += r.n

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        names, parts, start, size = [], [], 0, 0

        def closed() -> pa.RecordBatch:
            block = block_bytes(start, names, parts, lengths, codes)
            return pa.RecordBatch.from_pydict({"start": pa.array([start], pa.int64()), "block": pa.array([block], pa.binary())})

        for batch in batches:
            for r, offset, name, n, blob in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                own = starts[r] + offset
                if names and (size >= BLOCK or own != start + size):
                    yield closed()
                    names, parts, size = [], [], 0
                if not names:
                    start = own
                names.append(name)
                parts.append(np.frombuffer(open_.decompress(blob), kind))
                size += n
        if names:
            yield closed()

    ids.mapInArrow(of_batches, "start long, block binary").write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files of ``write``."""
    with_package(spark)
    code = spark.read.parquet(f"{path}/code").toArrow()  # a row for each id of the vocabulary
    ids = code.column("id").to_numpy()
    lengths = np.zeros(ids.max(initial=0) + 1, np.uint8)
    lengths[ids] = code.column("bits").to_numpy()

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            for k in range(0, batch.num_rows, 16):
                rows = list(read_blocks(batch.column(0).slice(k, 16).to_pylist(), decoder))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([len(r[2]) for r in rows], pa.int64()),
                        pa.array([zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    blocks = spark.read.parquet(f"{path}/blocks").select("block")
    return blocks.mapInArrow(of_batches, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(documents: DataFrame, definition: bytes, path: str | None = None, **parameters) -> DataFrame:
    """Writes the documents' ids to a folder, a new one in the shared folder by default, and reads them back."""
    spark = documents.sparkSession
    path = path or scratch_dir(spark, "token-files")
    write(documents, definition, path, **parameters)
    return read(spark, path)
