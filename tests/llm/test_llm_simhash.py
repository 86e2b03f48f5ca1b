import random

import edge_cases
import numpy as np
import xxhash

from paperloom.llm import simhash
from paperloom.llm.components import connected


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, near):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_print_equals_its_definition():
    for text in [None, "", " \n ", "One", "one two THREE", "É È a b c d É", "a b c d e f g h a b c d", "x y z"]:
        assert simhash.fingerprint((text or "").encode()) == brute_print(text)


def test_components_are_those_of_brute_force_whatever_the_size_of_a_variant(spark):
    draw = random.Random(5)
    base, prints = draw.getrandbits(64), set()
    while len(prints) < 500:  # a dense cluster
        v = base
        for _ in range(draw.randrange(9)):
            v ^= 1 << draw.randrange(26)
        prints.add(v)
    v = draw.getrandbits(64)
    for _ in range(30):  # a chain of steps of four bits
        prints.add(v)
        for b in draw.sample(range(64), 4):
            v ^= 1 << b
    prints |= {draw.getrandbits(64) for _ in range(200)}
    values = sorted(int(x) for x in np.array(sorted(prints), np.uint64).view(np.int64))
    unsigned = {v: v & 0xFFFFFFFFFFFFFFFF for v in values}
    expected = groups(values, lambda a, b: (unsigned[a] ^ unsigned[b]).bit_count() <= 4)
    frame = spark.createDataFrame([(v,) for v in values], "print long")
    for small in (4, 64):  # small variants are paired, larger ones take the full balls
        found = {r.node: r.component for r in connected(simhash.links(frame, small=small)).collect()}
        assert {v: found.get(v, v) for v in values} == expected


def test_edge_cases_against_brute_force(spark):
    rows = [tuple(r) for r in simhash.near_duplicates(edge_cases.documents(spark)).select("doc_id", "print", "component_id").collect()]
    prints = {p for _, p, _ in rows}
    expected = sorted(brute_print(t) for _, t in edge_cases.ROWS)
    assert sorted(p & 0xFFFFFFFFFFFFFFFF for _, p, _ in rows) == expected
    of = groups(sorted(prints), lambda a, b: ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= 4)
    least = {}
    for i, p, _ in rows:
        if i is not None:
            least[of[p]] = min(least.get(of[p], i), i)
    assert all(c == least.get(of[p]) for _, p, c in rows)


def test_one_row_of_each_group_stays(spark):
    docs = edge_cases.documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    groups_of = {r.component for r in simhash.near_duplicates(docs).collect()}
    assert len(ids) == len(groups_of) and (False, 9) not in ids and ids.count((False, 5)) == 1
    assert simhash.keep_one(docs.limit(0)).count() == 0
