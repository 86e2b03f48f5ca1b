import math

import numpy as np

from paperloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, grid string, weight string, component string, z string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b", "c", "d") for i, v in rows], SCHEMA)


def brute_force(vectors, components=8):
    """Exact sums with whole numbers, the covariance as exact fractions rounded once."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(row[j] for row in x) for j in range(d)]
    centred = [[n * row[j] - sums[j] for j in range(d)] for row in x]
    cov = np.array([[sum(r[a] * r[b] for r in centred) / n**3 for b in range(d)] for a in range(d)])
    e, v = np.linalg.eigh(cov)
    order = np.argsort(-e)[:components]
    z = np.array([[c / n for c in row] for row in centred]) @ v[:, order] / np.sqrt(e[order])
    return n, [sum(c * c for c in row) for row in centred], z, e[order] / np.trace(cov)


def check(found, rows, components=8):
    n, deviations, z, explained = brute_force([v for _, v in rows], components)
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    signs = None
    for k, (i, _) in enumerate(rows):
        mine = by_id[i]
        assert sorted(mine) == list(range(1, len(explained) + 1))
        values = np.array([mine[c][0].whitened for c in sorted(mine)])
        signs = np.sign(values * z[k]) if signs is None else signs
        assert np.allclose(values, signs * z[k], atol=1e-8)
        for c, of_component in mine.items():
            for r in of_component:
                assert (r.n, r.deviation) == (n, deviations[k])
                assert abs(r.explained - explained[c - 1]) < 1e-12 and r.identity_error < 1e-9


def vectors(n, d, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.linspace(1, 0.05, d)).astype(np.float32).tolist()


def test_equals_brute_force(spark):
    rows = list(enumerate(vectors(300, 12)))
    check(whitening.whitened(table(spark, rows)), rows)


def test_copies_weigh_by_their_number_and_are_whitened_once(spark):
    some = vectors(90, 10)
    rows = list(enumerate([some[0]] * 150 + some))
    check(whitening.whitened(table(spark, rows)), rows)
    once = whitening.whitened(table(spark, rows), weights="one").collect()
    assert {r.n for r in once} == {90} and len(once) == len(rows) * 8


def test_grid_of_odd_numbers_and_widths(spark):
    rows = [(k, [(-1) ** k * 10.0 ** (k % 9), 0.0009 * k, -0.0001, float(k)]) for k in range(40)]
    n, deviations, _, _ = brute_force([v for _, v in rows])
    found = {r.vec_id: r.deviation for r in whitening.whitened(table(spark, rows)).collect()}
    assert found == {i: (d if d < 1 << 63 else None) for (i, _), d in zip(rows, deviations)}
    assert None in found.values() and any(found.values())


def test_keys_are_equal_only_for_equal_vectors():
    import pyarrow as pa

    values = [[0.0], [-0.0], [0.0001], [-0.0001], [40.0], [40.0001], [3e7], None, [None], [float("nan")], [float("inf")], [1e30], []]
    keys = whitening.grid_keys(pa.array(values, pa.list_(pa.float64())))
    assert keys[0] == keys[1] == keys[2] != keys[3]
    assert keys[4] == keys[5] and keys[7:12] == [None] * 5 and keys[12] == b"2"
    assert [len(k) for k in (keys[0], keys[4], keys[6])] == [3, 5, 9]
    assert whitening.grid_vectors([keys[3]]).tolist() == [[99_999]]
    sliced = pa.array(values, pa.list_(pa.float64())).slice(4, 3)
    assert whitening.grid_keys(sliced) == keys[4:7]


def test_edge_cases(spark):
    some = vectors(30, 9, seed=3)
    odd = [None, [], [None] * 9, [float("nan")] * 9, [float("inf")] + [0.0] * 8, [0.5] * 8, [3e38] * 9]
    rows = [(k, v) for k, v in enumerate(some)]
    found = whitening.whitened(table(spark, [*rows, *[(100 + k, v) for k, v in enumerate(odd)]]))
    check(found, rows)
    assert found.select("vec_id").distinct().count() == 30  # nothing of the odd ones
    repeated = whitening.whitened(table(spark, [*rows, (None, some[0]), (3, some[3])]))
    assert repeated.where("vec_id is null").count() == 8 and repeated.where("vec_id = 3").count() == 16
    assert whitening.whitened(table(spark, [])).count() == whitening.whitened(table(spark, [(1, [0.5, 1.0])])).count() == 0
    assert whitening.whitened(table(spark, [(k, [0.5, 1.0]) for k in range(5)])).count() == 0  # no spread
    line = whitening.whitened(table(spark, [(k, [k / 7, k / 7, 1.0]) for k in range(9)]))
    assert {r.component for r in line.collect()} == {1}


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(queries.op13_whitening(spark, folder), rows)
