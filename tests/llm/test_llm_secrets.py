import hashlib
import random
import re
import time
from collections import Counter

import edge_cases

from paperloom.llm import secrets


def brute_force(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def expected(doc_id, text):
    spans = brute_force(text or "")
    shown = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    return (doc_id, *(sum(x[3] == k for x in spans) for k in ("assign", "access", "hex")), hashlib.sha256(shown.encode()).hexdigest())


BITS = ["password: token: abcdef", "PassWd='hunter22'", "AKIA" + "A1" * 9, "AKIA123", "deadbeef" * 3, 'api_key = "abc.def/g=="', "apikey:xyz", "é𝒳 ", "\n", "token=secret=abcdef12", " sk_live_" + "a" * 20]
BITS += ["secret : 'abc", "ghp_" + "Z" * 36, "-----BEGIN RSA PRIVATE KEY-----", "https://u:pass@h/", "xoxb-1234567890ab", "Key", "AKIAAKIA" + "B" * 20, "0" * 23, "0" * 24, "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghij"]


def test_base_spans_equal_the_plain_patterns(spark):
    draw = random.Random(2)
    rows = [(k, "".join(draw.choice(BITS) for _ in range(draw.randrange(9)))) for k in range(300)]
    rows += [(None, "token=abcdefg"), (5, None), (7, "token=abcdefg"), (7, "token=abcdefg"), (8, "deadbeef" * 3000 + " token=abcdef1 " * 300)]
    found = secrets.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r)[:5] for r in found) == Counter(expected(*r) for r in rows)
    kinds = {s.split(":")[0] for r in found if r.spans for s in r.spans.split(",")}
    assert {"assign", "access", "hex", "pem", "hub", "live", "chat", "basic", "jwt"} <= kinds


def test_trigram_queries_never_miss_a_match():
    draw = random.Random(3)
    for rule in secrets.BASE + secrets.ADDED:
        query = secrets.trigram_query(rule.pattern)
        for _ in range(300):
            text = "".join(draw.choice(BITS) for _ in range(4))
            if re.search(rule.pattern, text):
                low = text.lower()
                held = {low[k : k + 3] for k in range(len(low))}
                assert all(any(s <= held for s in one_of) for one_of in query)


def test_queries_of_patterns():
    q = secrets.trigram_query
    assert q("[0-9a-f]{24,}") == [] and q("ab") == [] and q("a*bcd?") == []
    assert q("abcd") == [[frozenset({"abc", "bcd"})]]
    assert q("AKIA[A-Z]+") == [[frozenset({"aki", "kia"})]]
    assert q("(abc|abcd)x") == [[frozenset({"abc", "bcd", "cdx"}), frozenset({"abc", "bcx"})]]
    assert q("(foo|[a-z]+)bar") == [[frozenset({"bar"})]]


def test_edge_cases(spark):
    docs = edge_cases.documents(spark)
    found = secrets.digest(docs).collect()
    assert len(found) == len(edge_cases.ROWS) and {r.spans for r in found} == {""}
    assert secrets.digest(docs.limit(0)).count() == 0


def test_many_secrets_in_one_text_take_linear_time(spark):
    texts = {n: " ".join(f"token=abcdef{k % 97} some words" for k in range(n)) for n in (1, 255, 256, 257, 513, 10_000, 40_000)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert Counter(tuple(r)[:5] for r in secrets.digest(rows.where("doc_id < 1000")).collect()) == Counter(expected(n, t) for n, t in texts.items() if n < 1000)
    took = {}
    for n in (10_000, 40_000):
        start = time.perf_counter()
        assert tuple(secrets.digest(rows.where(f"doc_id = {n}")).first())[:5] == expected(n, texts[n])
        took[n] = time.perf_counter() - start
    assert took[40_000] < 8 * took[10_000] + 5
