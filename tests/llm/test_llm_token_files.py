import random
import zlib

import edge_cases
import numpy as np
import pytest

from paperloom.llm import huffman, token_files
from paperloom.llm.common import tokenizer_definition

tokenizers = pytest.importorskip("tokenizers")
ODD = "Hello  WORLD's x́ ́a é\x0bfoo\x1cbar aÀÖØßÿ×÷b ñ.É's ÀÉ$a ΣΑΣ. İ  z <|endoftext|> a<|startoftext|>b 'S don't 12345 ﬁ 한글 하\x85q  \r\n\t$$$ Å Å"


@pytest.fixture(scope="module")
def definition():
    return tokenizer_definition()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5000])
def test_codes_are_prefix_free_and_go_round(n):
    draw = np.random.default_rng(n)
    counts = np.zeros(20_000, np.int64)
    counts[draw.choice(20_000, n, replace=False)] = draw.zipf(1.3, n) % 10**6 + 1
    lengths = huffman.code_lengths(counts)
    used = lengths[lengths > 0].astype(float)
    assert lengths.max(initial=0) <= huffman.MOST_BITS and (n < 2 or (2.0**-used).sum() == 1)
    if n:
        symbols = np.flatnonzero(counts)[draw.integers(0, n, 3000)]
        bits, at = huffman.pack(symbols, lengths, huffman.canonical(lengths))
        starts = at[::100]
        out = huffman.Decoder(lengths)(np.frombuffer(bits, np.uint8), starts, np.full(len(starts), 100))
        assert (out == symbols).all()


def test_lengths_are_those_of_huffman_where_the_limit_does_not_bind():
    import heapq

    counts = [5, 9, 12, 13, 16, 45, 1, 1]
    heap = list(counts)
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((huffman.code_lengths(np.array(counts)) * np.array(counts)).sum()) == cost


def test_ids_by_words_are_the_ids_of_whole_texts(definition):
    whole = tokenizers.Tokenizer.from_buffer(definition)
    encode = token_files.Encoder(definition)
    assert encode.by_words
    draw = random.Random(1)
    texts = [ODD, "", None] + ["".join(draw.choice(ODD) for _ in range(draw.randrange(60))) for _ in range(1500)]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(ids, encode.kind).tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 1]


def test_files_give_back_every_id(spark, definition):
    whole = tokenizers.Tokenizer.from_buffer(definition)
    draw = random.Random(2)
    rows = [(k * 3, "".join(draw.choice(ODD) for _ in range(draw.randrange(200)))) for k in range(200)] + [(10_000, "many words of one long text " * 20_000)]
    docs = spark.createDataFrame(draw.sample(rows, len(rows)), "doc_id long, text string")
    for ranges in (None, 7):
        found = {r.doc_id: tuple(r)[1:] for r in token_files.round_trip(docs, definition, ranges=ranges).collect()}
        start = 0
        for i, text in rows:
            ids = [*whole.encode(text, add_special_tokens=False).ids, 1]
            assert found[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)


def test_edge_cases(spark, definition):
    found = token_files.round_trip(edge_cases.documents(spark), definition, ranges=2).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((i is None, i or 0) for i, _ in edge_cases.ROWS)
    ends = sorted((r.start, r.start + r.n_tokens) for r in found)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    by_id = sorted((r.doc_id, r.start) for r in found if r.doc_id is not None)
    assert [s for _, s in by_id] == sorted(s for _, s in by_id)
    assert {r.n_tokens for r in found if r.doc_id in (2, 3, 7)} == {1}
    assert token_files.round_trip(edge_cases.documents(spark).limit(0), definition).count() == 0


def test_the_driver_keeps_no_tokenizer(spark, definition, monkeypatch):
    monkeypatch.setattr(token_files, "_encoders", {})  # of this process; tasks have their own
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    assert token_files.round_trip(docs, definition).count() == 2
    assert not token_files._encoders
