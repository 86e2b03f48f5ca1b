import math
import random
import re
from collections import Counter

import numpy as np
import edge_cases

from paperloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_force(documents, items, top=10):
    docs = [(i, Counter(terms(t))) for i, t in documents]
    n = sum(1 for _, c in docs if c)
    total = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, c in docs:
            if c:
                m = 10 + (90 * sum(c.values()) * n) // total
                score = sum(
                    math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(terms(text)) if t in c
                )
                if score > 0:
                    found.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, k + 1, None if missing else i, -s) for k, (s, missing, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def search(spark, documents, items, **parameters):
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical.search(docs, asked, **parameters).collect()), key=repr)


def corpus(rng, n, vocabulary=300):
    names = [f"w{k}" for k in range(vocabulary)] + ["Ärger", "été", "日本", "A1b2"]
    weights = [1 / (k + 1) for k in range(len(names))]
    return [(k, " ,".join(rng.choices(names, weights, k=rng.choice([0, 1, 5, 30, 200, 3000])))) for k in range(n)]


def test_equals_brute_force_with_and_without_a_first_round(spark, monkeypatch):
    rng = random.Random(2)
    documents = corpus(rng, 400)
    items = [(k, " ".join(rng.choices([t for t in terms(documents[-1][1] + " w1 w7 w50 w200 w299 none")], k=rng.randint(0, 12)))) for k in range(30)]
    expected = brute_force(documents, items)
    assert search(spark, documents, items) == expected
    assert search(spark, documents, items, first_round=40) == expected
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 7)
    assert search(spark, documents, items, top=10) == expected


def test_many_blocks_of_items():
    made = list(lexical.blocks([(k, f"a b{k} c") for k in range(10)], most_items=4))
    assert [b.numbers for b in made] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    made = list(lexical.blocks([(0, "a"), (1, " ".join(f"t{k}" for k in range(50))), (2, None)], most_terms=5))
    assert [b.numbers for b in made] == [[0], [1], [2]] and len(made[1].terms) == 50 and len(made[2].terms) == 0


def test_levels_never_fall_below_the_count():
    counts = np.unique(np.concatenate([np.arange(1, 3000), 2 ** np.arange(1, 33), 2 ** np.arange(1, 32) + 1]))
    bound = lexical._LEVELS[lexical.levels(counts)]
    assert (bound >= counts).all() and len(lexical._LEVELS) == 256 and (np.diff(lexical._LEVELS) > 0).all()
    assert (bound[counts <= 128] == counts[counts <= 128]).all()


def test_bounds_hold_and_a_wide_text_has_a_wide_sketch():
    rng = np.random.default_rng(1)
    for size in (1, 100, 5000, 300_000):
        hashes = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        counts = rng.integers(1, 5000, len(hashes))
        width, places, made = lexical.sketch(hashes, counts)
        assert width >= 16 * len(hashes) and (np.diff(places.astype(np.int64)) > 0).all()
        at = np.searchsorted(places, (hashes & np.uint64(width - 1)).astype(np.uint32))
        assert (lexical._LEVELS[made[at]] >= counts).all()
        assert made.max() == lexical.levels(counts).max()


def rows_and_block(documents, item, weight):
    import pyarrow as pa

    data, offsets = lexical.flat(pa.array([t for _, t in documents]))
    rows = [(int(c.sum()), *lexical.sketch(h, c), h, c) for h, c in lexical.terms_of(data, offsets, 0, len(documents))]
    block = next(lexical.blocks([(0, item)]))
    block = lexical.Block(block.numbers, block.terms, block.places, np.full(len(block.terms), weight), len(documents), sum(r[0] for r in rows))
    columns = [
        pa.array(range(len(rows))), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]),
        pa.array([r[2].astype(lexical._place_kind(r[1])).tobytes() for r in rows]), pa.array([r[3].tobytes() for r in rows]),
        pa.array([r[4].tobytes() for r in rows]), pa.array([r[5].astype("<u4").tobytes() for r in rows]),
    ]
    return rows, block, pa.RecordBatch.from_arrays(columns, names=lexical.NAMES)


def test_few_documents_are_scored(monkeypatch):
    """Documents whose bound is below the threshold are not looked at, and crowded sketches lose nothing."""
    rng = random.Random(4)
    documents = corpus(rng, 3000, 2000)
    item = documents[-1][1][:60] + " w1500 w1700 w1900"
    expected = None
    for width, most in ((1 << 16, 60), (64, 3000)):
        monkeypatch.setattr(lexical, "LEAST_WIDTH", width)
        monkeypatch.setattr(lexical, "PLACES_PER_TERM", 0 if width == 64 else 16)
        _, block, batch = rows_and_block(documents, item, 5000)
        scored = []
        monkeypatch.setattr(lexical, "_descending", lambda b, f, real=_real_descending: (scored.append(k) or k for k in real(b, f)))
        out = next(lexical._search(block, 10, [1])(iter([batch.slice(k, 500) for k in range(0, 3000, 500)])))
        expected = expected or out.to_pydict()
        assert out.to_pydict() == expected and out.num_rows == 10 and len(scored) <= most


_real_descending = lexical._descending


def test_ties_nulls_and_repeats(spark):
    documents = [(9, "a b"), (3, "b A"), (3, "a b"), (None, "a b"), (5, None), (6, ""), (7, "..."), (8, "c " * 40)] + [(k, "filler text") for k in range(100, 130)]
    items = [(1, "A!"), (1, "a a"), (None, "c"), (2, None), (4, ""), (5, "nowhere")]
    expected = brute_force(documents, items)
    assert search(spark, documents, items) == expected
    assert [r for r in expected if r[0] == 1 and r[1] == 4][0][2] is None
    assert search(spark, [], items) == [] and search(spark, documents, []) == []
    assert search(spark, [(1, None)], items) == []


def test_edge_cases(spark):
    docs = edge_cases.documents(spark).withColumnRenamed("size", "rank").withColumnRenamed("seat", "item_id")
    asked = docs.selectExpr("doc_id AS item_id", "text", "lang AS doc_id", "source AS score")
    found = sorted((tuple(r) for r in lexical.search(docs, asked).collect()), key=repr)
    rows = [(i, t) for i, t in edge_cases.ROWS]
    assert found == brute_force(rows, rows)
