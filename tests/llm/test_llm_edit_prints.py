import hashlib
import random

import edge_cases

from paperloom.llm import edit_prints
from paperloom.llm.edit_prints import embed, likeness, to_text


def text(draw, n):
    return "".join(draw.choice("abcdefgh ijklmnop é") for _ in range(n))


def test_fingerprints_do_not_depend_on_their_batch():
    draw = random.Random(1)
    texts = [text(draw, n) for n in [0, 1, 2, 5, 100, 3000, 40_000, *range(40)]]
    together = embed(texts)
    assert together == [embed([t])[0] for t in texts]
    few, edit_prints.FEW = edit_prints.FEW, 1
    assert together == embed(texts)  # all side by side
    edit_prints.FEW = few


def test_likeness_follows_the_edits():
    draw = random.Random(2)
    for n in (300, 3000, 20_000):
        a, b = text(draw, n), text(draw, n)
        x, y = embed([a])[0], embed([b])[0]
        assert likeness(x, x) == 1 and likeness(x, y) < 0.2
        tail = embed([a[: 3 * n // 4] + b[: n // 4]])[0]
        assert 0.6 < likeness(x, tail) < 0.9
        some = embed([a[: n // 2] + "#" + a[n // 2 :]])[0]
        assert likeness(x, some) > 0.45  # the walks meet again after an insertion
    near = [likeness(embed([a])[0], embed([a[:k] + "!" + a[k + 1 :]])[0]) for k in range(1000, 20_000, 1000)]
    assert min(near) > 0.95


def test_comparison_with_the_next_text_equals_brute_force(spark):
    draw = random.Random(3)
    rows = sorted({draw.randrange(10**9): text(draw, draw.randrange(300)) for _ in range(120)}.items())
    docs = spark.createDataFrame(draw.sample(rows, len(rows)), "doc_id long, text string")
    for ranges, chunk in ((None, 1 << 22), (17, 500)):
        found = {r.doc_id: tuple(r)[1:] for r in edit_prints.compared_with_next(docs, ranges, chunk).collect()}
        for k, (i, t) in enumerate(rows):
            after, q = rows[(k + 1) % len(rows)][1], len(t) // 4
            edited = t[: len(t) - q] + after[:q]
            a, e, b = embed([t])[0], embed([edited])[0], embed([after])[0]
            assert found[i] == (len(t), hashlib.sha256(edited.encode()).hexdigest(), to_text(a), to_text(e), likeness(a, e), likeness(a, b))


def test_near_texts_share_a_class_and_others_do_not(spark):
    draw = random.Random(4)
    base = [text(draw, 1500) for _ in range(30)]
    rows = [(k, b) for k, b in enumerate(base)] + [(100 + k, b[:700] + "#" + b[701:]) for k, b in enumerate(base)] + [(200, base[0])]
    found = {r.doc_id: r.class_id for r in edit_prints.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[k] == k for k in range(30)) and found[200] == 0
    assert sum(found[100 + k] == k for k in range(30)) >= 27  # a walk may seldom lose its way after an edit


def test_near_texts_of_shared_sections_meet_in_hot_bands(spark):
    draw = random.Random(6)
    early, late = [text(draw, 120) for _ in range(12)], [text(draw, 1400) for _ in range(3)]
    rows = list(enumerate(e + x for x in late for e in early))
    found = {r.doc_id: (r.fingerprint, r.class_id) for r in edit_prints.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=2).collect()}
    marks = {i: edit_prints.from_text(f) for i, (f, _) in found.items()}
    least = {i: i for i in marks}
    for _ in marks:  # classes of all pairs at the limit or above
        least = {i: min(least[j] for j in marks if likeness(marks[i], marks[j]) >= edit_prints.LIKENESS) for i in marks}
    assert {i: c for i, (_, c) in found.items()} == least and len(set(least.values())) < len(rows)


def test_edge_cases(spark):
    docs = edge_cases.documents(spark)
    found = edit_prints.compared_with_next(docs, ranges=3).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in found) == sorted((i is None, i or 0, len(t or "")) for i, t in edge_cases.ROWS)
    one = {r.n_chars: r for r in found if r.doc_id == 2}[0]
    assert one.near_edited == one.near_next == 1.0  # the next text, of id 3, is empty too
    assert {len({r.fingerprint for r in found if r.doc_id in ids}) for ids in ((2, 3), (1, 9), (5,))} == {1}
    assert edit_prints.compared_with_next(docs.limit(0)).count() == 0
    classes = {(r.doc_id, r.class_id) for r in edit_prints.near_duplicates(docs).collect()}
    assert {(1, 1), (9, 1), (2, 2), (3, 2), (None, 2)} <= classes
