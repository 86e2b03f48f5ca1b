import random

import edge_cases
import pyarrow as pa

from paperloom.llm import decontaminate as d


def plain_score(a, b):
    """Smith-Waterman, cell by cell."""
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (d.MATCH if x == y else d.MISMATCH), row[j + 1] + d.GAP, new[j] + d.GAP))
            best = max(best, new[-1])
        row = new
    return best / (d.MATCH * len(a))


def tokens(text):
    ((_, hashes, _),) = d._tokens(pa.array([text]))
    return hashes.astype("<u4")


def test_alignment_equals_the_plain_recurrence():
    draw = random.Random(1)
    pairs = [([draw.randrange(6) for _ in range(draw.randrange(1, 20))], [draw.randrange(6) for _ in range(draw.randrange(0, 40))]) for _ in range(300)]
    import numpy as np

    score, _ = d.align([np.array(a, "<u4").tobytes() for a, _ in pairs], [np.array(b, "<u4").tobytes() for _, b in pairs])
    assert [round(float(s), 9) for s in score] == [round(plain_score(a, b), 9) for a, b in pairs]
    assert [len(x) for x in d.align([], [])] == [0, 0]


def test_leaks_equal_alignment_of_all_with_all(spark):
    draw = random.Random(2)
    vocabulary = [f"w{k}" for k in range(300)] + ["the", "of"] * 60
    sentence = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [sentence(draw.randrange(10, 60)) for _ in range(12)] + [sentence(150), sentence(4)]
    docs = []
    for k in range(120):
        words = sentence(draw.randrange(0, 400))
        if k % 3 == 0:
            own = list(draw.choice(items))
            for _ in range(draw.randrange(0, 1 + len(own) // 8)):
                own[draw.randrange(len(own))] = draw.choice(vocabulary)
            at = draw.randrange(len(words) + 1)
            words[at:at] = own
        docs.append((k, " ".join(words).capitalize() + "."))
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, ", ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in d.leaks(documents, benchmark).collect()}
    expected = {}
    for k, text in docs:
        t = tokens(text).tolist()
        for n, item in enumerate(items):
            own = tokens(" ".join(item)).tolist()
            if len(own) < d.LEAST_WORDS:
                continue
            cuts = [*range(0, len(own) - d.SEGMENT, d.SEGMENT), max(0, len(own) - d.SEGMENT)]
            score = max(plain_score(own[c : c + d.SEGMENT], t) for c in cuts)
            if score >= d.LEAST_SCORE:
                expected[k, n] = score
    assert {k: round(v, 9) for k, v in found.items()} == {k: round(v, 9) for k, v in expected.items()}
    clean = {r.doc_id for r in d.decontaminated(documents, benchmark).collect()}
    assert clean == {k for k, _ in docs} - {k for k, _ in expected}


def test_heavily_edited_items_equal_alignment_of_all_with_all(spark):
    draw = random.Random(5)
    fresh = (f"new{k}" for k in range(10**6))
    items = [[f"i{k}x{j}" if j % 4 else draw.choice(["the", "of", "and"]) for j in range(n)] for k, n in enumerate([15, 15, 20, 20, 30, 64, 8])]
    texts = []

    def planted(words):
        filler = [next(fresh) for _ in range(draw.randrange(0, 300))]
        at = draw.randrange(len(filler) + 1)
        texts.append(" ".join([*filler[:at], *words, *filler[at:]]))

    for item in items:
        planted([next(fresh) if j % 5 == 2 else w for j, w in enumerate(item)])  # runs of four unchanged words
        planted([next(fresh) if j % 3 == 2 else w for j, w in enumerate(item)])  # runs of two
        planted([w for j, x in enumerate(item) for w in ([x, next(fresh)] if j % 2 else [x])])  # a word put in after every two
        planted([w for x in item for w in (x, next(fresh))])  # after every word
        planted([w for j, w in enumerate(item) if j % 4 != 2])
        planted(item)
        for share in (0.2, 0.25, 0.3) * 8:
            planted([next(fresh) if draw.random() < share else w for w in item])
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): round(r.score, 9) for r in d.leaks(documents, benchmark).collect()}
    own = [tokens(" ".join(i)).tobytes() for i in items]
    score, _ = d.align([i for _ in texts for i in own], [t for x in texts for t in [tokens(x).tobytes()] for _ in own])
    pairs = [(k, n) for k in range(len(texts)) for n in range(len(own))]
    expected = {p: round(float(s), 9) for p, s in zip(pairs, score, strict=True) if s >= d.LEAST_SCORE}
    assert found == expected and len(found) > 100


def test_a_phrase_that_all_share_brings_no_pairs(spark, monkeypatch):
    """Items and documents that share six words only: no pair is aligned, and real leaks are still found."""
    fresh = (f"v{k}" for k in range(10**6))
    phrase = "which of the following best describes".split()
    items = [[*phrase, *[next(fresh) for _ in range(14)]] for _ in range(150)]
    texts = [" ".join([*[next(fresh) for _ in range(40)], *phrase, *[next(fresh) for _ in range(40)]]) for _ in range(1500)]
    texts += [" ".join([next(fresh) if j in (9, 15) else w for j, w in enumerate(i)]) for i in items[:20]]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    parts = d._parts(benchmark, 8).withColumn("part", d.F.xxhash64("item_id", "tokens"))
    seeds = d._seeds(parts)
    looked_up = parts.withColumn("least", d._least_places(d.F.octet_length("tokens") / 4, 0.5)).withColumn("asked", d.F.lit(3))
    passages = d._passages(documents, seeds, 1.0)
    rare = d._rare(seeds, looked_up, passages)
    common = {int(s) for shape in d.SHAPES for s in d.signed(d._triples(tokens(" ".join(phrase)).astype("uint64"), shape))}
    assert common and rare.where(d.F.col("seed").isin(*common)).select("part", "place").distinct().groupBy("part").count().agg({"count": "max"}).first()[0] < 3
    found = {(r.doc_id, r.item_id) for r in d.leaks(documents, benchmark).collect()}
    assert found == {(1500 + k, k) for k in range(20)}


def test_pairs_of_which_none_has_enough_seeds(spark):
    """Some seeds of an item meet a passage, too few for a score; nothing is left to align."""
    item = [f"i{k}" for k in range(40)]
    texts = [" ".join([*[f"x{j}" for j in range(30)], *item[:9], *[f"y{j}" for j in range(30)]])] * 3
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert d.leaks(documents, benchmark).count() == 0
    assert d.decontaminated(documents, benchmark).count() == 3


def test_edge_cases(spark):
    docs = edge_cases.documents(spark)
    items = spark.createDataFrame([(1, "the same id TWICE one text of more"), (None, None), (2, ""), (None, "A text without an id it is read all the same"), (3, "word " * 100)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in d.leaks(docs, items, least_words=5).collect()}
    assert found[None, None] == 1 and found[6, 3] == 1 and (4, 1) in found and (5, 1) not in found
    kept = d.decontaminated(docs, items)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 0 and kept.where("doc_id = 5").count() == 2
    assert d.leaks(docs.limit(0), items).count() == d.leaks(docs, items.limit(0)).count() == 0
    assert d.decontaminated(docs, items.limit(0)).count() == docs.count()
