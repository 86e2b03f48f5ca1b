import hashlib
import random
import re
import time

import edge_cases
import numpy as np

from paperloom.llm import pii
from paperloom.llm.tagger import Tagger


def brute_force(text):
    spans = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(pii.digits(m[0])) <= 19 and pii.luhn(pii.digits(m[0]))]
    return spans + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(pii.digits(m[0])) <= 15]


def test_base_spans_equal_the_plain_patterns():
    draw = random.Random(4)
    bits = ["a", "b.c", "@", "@x.y", "@d-e.f.g", ".", "1", "23", "255", "256", ".1", "+", "+1", " ", "-", "(", "4111111111111111", " 4012 8888 8888 1881", "é", "\n", "٣", "a@b", "0001"]
    for _ in range(20_000):
        text = "".join(draw.choice(bits) for _ in range(draw.randrange(1, 14)))
        assert pii.base_spans(text) == brute_force(text), text


def test_time_is_linear_in_the_text():
    start = time.perf_counter()
    pii.base_spans("a" * 300_000 + "@" + "1" * 300_000 + "." * 1000 + "+1" + " " * 100_000)
    assert time.perf_counter() - start < 5


def test_gradient_is_that_of_the_loss():
    tagger = Tagger(3, hidden=4)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    x = np.random.default_rng(0).integers(0, 98, (3, 7)).astype(np.uint8)
    y = np.random.default_rng(1).integers(0, 3, (3, 7)).astype(np.uint8)
    _, grad = tagger.gradient(x, y)
    for name, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        middle = tagger.p[name][at]
        tagger.p[name][at] = middle + 1e-4
        above = tagger.gradient(x, y)[0]
        tagger.p[name][at] = middle - 1e-4
        below = tagger.gradient(x, y)[0]
        tagger.p[name][at] = middle
        assert abs(g[at] - (above - below) / 2e-4) < 1e-3 * max(1, abs(g[at]))


def test_decoding_finds_the_best_path():
    from itertools import product

    draw = np.random.default_rng(2)
    tagger = Tagger(3, hidden=2)
    tagger.p["t"] = draw.normal(size=(3, 3)).astype(np.float32)
    scores = draw.normal(size=(4, 6, 3)).astype(np.float32)
    value = lambda s, p: sum(s[t, k] for t, k in enumerate(p)) + sum(tagger.p["t"][a, b] for a, b in zip(p, p[1:]))
    for s, found in zip(scores, tagger.decode(scores), strict=True):
        assert tuple(found) == max(product(range(3), repeat=6), key=lambda p: value(s, p))


def corpus(draw, n):
    fill = ["the", "house", "of", "many", "words", "and", "numbers", "12", "1999", "no", "more"]
    rows = []
    for k in range(n):
        words = [draw.choice(fill) for _ in range(30)]
        number = lambda m: "".join(str(draw.randrange(10)) for _ in range(m))
        kind = k % 4
        what = [f"jo.{number(2)}@mail{number(1)}.example.com", ".".join(str(draw.randrange(256)) for _ in range(4)), "4111 1111 1111 1111", f"+1 ({number(3)}) 555-{number(4)}"][kind]
        words[draw.randrange(2, 28)] = what
        rows.append((k, " ".join(words)))
    return rows


def test_tagger_learns_the_labelled_spans_and_finds_more(spark):
    draw = random.Random(5)
    docs = spark.createDataFrame(corpus(draw, 240), "doc_id long, text string")
    tagger = pii.train(docs, epochs=25)
    found = missed = other = 0
    for _, text in corpus(random.Random(6), 120):
        places = pii.stretches(text)
        marks = {(k, a + s, a + e) for (a, _), spans in zip(places, pii.tagged(tagger, [text[a:b] for a, b in places])) for k, s, e in spans}
        base = set(pii.base_spans(text))
        found, missed, other = found + len(base & marks), missed + len(base - marks), other + len(marks - base)
    assert found > 9 * missed and found > 4 * other
    for text, (base, spans) in [(t, f) for (_, t), f in zip(corpus(random.Random(7), 40), pii.find([t for _, t in corpus(random.Random(7), 40)], tagger))]:
        assert set(base) == set(brute_force(text)) <= set(spans)


def test_pieces_of_longer_numbers_are_no_spans():
    for kind, text, part, wanted in (
        (1, "at 10.0.0.300 now", "10.0.0.30", None), (1, "at 10.0.0.30 now", "10.0.0.30", "10.0.0.30"), (1, "v1.10.0.0.3", "10.0.0.3", None),
        (2, "94111111111111111", "4111111111111111", None), (3, "call (415) 555-0132.", "415) 555-0132", "(415) 555-0132"),
        (3, "call 415 555 01329", "415 555 0132", None), (0, "xjo@a.example", "jo@a.example", None),
    ):
        start = text.index(part)
        found = pii.whole(kind, text, start, start + len(part))
        assert (text[slice(*found)] if found else None) == wanted, text


def test_numbers_that_are_not_personal_are_left_and_home_numbers_found(spark):
    draw = random.Random(8)
    rows = [(k, t + f" in {draw.randrange(1000, 9999)} and room {draw.randrange(100, 999)}-{draw.randrange(10, 99)}, {draw.randrange(100, 999)} {draw.randrange(100, 999)} items") for k, t in corpus(draw, 320)]
    tagger = pii.train(spark.createDataFrame(rows, "doc_id long, text string"), epochs=25)
    calm = [f"of {draw.randrange(1000, 9999)} houses and {draw.randrange(100, 999)} {draw.randrange(100, 999)} more numbers" for _ in range(60)]
    assert sum(len(spans) for _, spans in pii.find(calm, tagger)) <= 3
    number = lambda m: "".join(str(draw.randrange(10)) for _ in range(m))
    homes = [f"many words and ({number(3)}) {number(3)}-{number(4)} of the house" for _ in range(30)] + [f"the house {number(3)} {number(3)} {number(4)} and more" for _ in range(30)]
    hits = sum(any(k == 3 for k, *_ in spans) for _, spans in pii.find(homes, tagger))
    assert hits >= 30


def test_a_long_stretch_is_tagged_as_a_whole():
    tagger = Tagger(9)
    text = "1 " * 5000
    assert pii.find([text], tagger)[0][0] == brute_force(text)


def test_edge_cases(spark):
    docs = edge_cases.documents(spark)
    found = pii.digest(docs).collect()
    assert len(found) == len(edge_cases.ROWS) and {r.base_sha256 for r in found} == {hashlib.sha256(b"").hexdigest()}
    assert pii.digest(docs.limit(0)).count() == 0
