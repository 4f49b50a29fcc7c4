import numpy as np

from spindrift.llm import multi_index as mi


def brute(rows, cosine=0.9):
    ids = [i for i, _ in rows]
    ok = [mi.usable(v) is not None for _, v in rows]
    n, root = np.zeros(len(rows), dtype=int), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    n[[a, b]] += 1
                    root[find(b)] = find(a)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: (int(n[k]), least[find(k)]) for k, i in enumerate(ids)}


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(17)
    rows = []
    for _ in range(60):
        c = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            rows.append((c + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.35])).tolist())
    rows += [rows[3]] * 40 + [(2.0 * np.array(rows[3])).tolist()]
    rows += rng.normal(size=(300, 16)).tolist()
    order = rng.permutation(len(rows))
    table = [(int(order[i]), rows[i]) for i in range(len(rows))]
    df = spark.createDataFrame([(i, v, 0) for i, v in table], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in mi.near_vectors(df).collect()}
    want = brute(table)
    assert len(got) == len(table)
    assert all(got[i]["n_links"] <= n for i, (n, _) in want.items())  # nothing below the cosine is linked
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert np.mean([got[i]["component_id"] == c for i, (_, c) in want.items()]) > 0.97
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_many_cells_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(mi, "CELL", 16)
    monkeypatch.setattr(mi, "MEMBERS", 32)
    monkeypatch.setattr(mi, "VISITORS", 64)
    rng = np.random.default_rng(18)
    c = rng.normal(size=(40, 8))
    table = [(i, (c[i % 40 if i % 3 else 0] + rng.normal(size=8) * 0.12).tolist()) for i in range(600)]
    got = {r["vec_id"]: r["n_links"] for r in mi.near_vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()}
    want = brute(table)
    assert all(got[i] <= n for i, (n, _) in want.items())
    assert sum(got.values()) >= 0.9 * sum(n for n, _ in want.values())


def test_multi_sequence_is_the_sorted_grid():
    rng = np.random.default_rng(19)
    for _ in range(50):
        p, q = rng.random(rng.integers(1, 9)), rng.random(rng.integers(1, 9))
        grid = (p[:, None] + q[None, :]).ravel()
        got = mi.multi_sequence(p, q, len(grid))
        assert sorted(got) == list(range(len(grid))) and np.allclose(grid[got], np.sort(grid))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0]),
        (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1e300, 1e299]), (12, [5e-324, 0.0]), (13, [0.0, 1.0]),
    ]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, v string, rep int, cell int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in mi.near_vectors(df).collect()}
    want = brute([r for k, r in enumerate(rows) if k != 9])
    assert got == want
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert mi.near_vectors(empty).count() == 0
    assert mi.near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()[0]["n_links"] == 0


def test_found_pairs_count_at_both_ends(spark, monkeypatch):
    monkeypatch.setattr(mi, "CELL", 16)
    rng = np.random.default_rng(21)
    base = rng.normal(size=(1500, 16))
    base /= np.linalg.norm(base, axis=1)[:, None]
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(axis=1)[:, None] * base
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    c = rng.uniform(0.9005, 0.93, size=1500)[:, None]
    x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * aside])
    cosines = x @ x.T
    np.fill_diagonal(cosines, 0)
    near = cosines >= 0.9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in mi.near_vectors(df).collect()}
    links = np.array([got[i][0] for i in range(len(x))])
    assert links.sum() >= 0.98 * near.sum() and (links <= near.sum(axis=1)).all()
    alone = np.flatnonzero(near.sum(axis=1) == 1)
    other = near[alone].argmax(axis=1)
    both = np.isin(other, alone)
    assert (links[alone[both]] == links[other[both]]).all()
    assert all((got[i][0] > 0) == (got[i][1] != i or any(got[j][1] == i for j in np.flatnonzero(near[i]))) for i in range(len(x)))
