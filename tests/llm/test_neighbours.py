import numpy as np

from papyra.llm import neighbours as N

SCHEMA = "id string, v array<float>, t int, s double"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, t, 1.0) for i, v, t in rows], SCHEMA)
    return {(r.key_a, r.key_b): r.similarity for r in N.nearest_vectors(spark, df, "id", "v", at="t", **kw).collect()}


def brute(rows, k, least=None):
    last = {}
    for i, v, t in sorted(rows, key=lambda r: r[2]):
        a = np.array([np.nan if x is None else x for x in v or []], np.float64)
        if len(a) == 8 and np.isfinite(a).all() and a.any():
            last[i] = a / np.linalg.norm(a)
    out = {}
    for i in last:
        near = sorted(((-round(float(last[i] @ last[j]), 6), j) for j in last if j != i))[:k]
        out |= {(i, j): -s for s, j in near if least is None or -s >= least}
    return out


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, 8))
    return [(f"p{i:03d}", [float(np.float32(x)) for x in base[i % len(base)] + rng.normal(scale=0.15, size=8)], i) for i in range(n)]


def same(got, want):
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-5 for p in want)


def test_exact_with_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "ROWS_A_BLOCK", 20)
    rows = vectors(200, 1)
    same(run(spark, rows, k=3, width=8, probes=1000), brute(rows, 3))


def test_threshold_with_all_blocks_and_split_tiles(spark, monkeypatch):
    monkeypatch.setattr(N, "ROWS_A_BLOCK", 50)
    monkeypatch.setattr(N, "TILE", 16)
    rows = vectors(200, 2)
    same(run(spark, rows, k=4, width=8, least=0.9, probes=1000), brute(rows, 4, 0.9))


def test_unusable_repeated_and_scaled_vectors(spark):
    v = [float(x) for x in range(1, 9)]
    rows = [("a", v, 1), ("a", [-x for x in v], 0), ("b", [3 * x for x in v], 1), ("c", None, 1), ("d", [0.0] * 8, 1), ("e", [float("nan")] + v[1:], 1), ("f", v[:7], 1), ("g", [None] + v[1:], 1), ("h", [float("inf")] + v[1:], 1), ("a", v, 1), ("b", None, 9)]
    same(run(spark, rows, k=5, width=8), {("a", "b"): 1.0, ("b", "a"): 1.0})


def test_copies_are_expanded_to_k_neighbours_each(spark):
    v, w = [1.0] * 8, [1.0] * 7 + [0.5]
    rows = [(f"c{i:02d}", v, 0) for i in range(30)] + [("z", w, 0)]
    got = run(spark, rows, k=3, width=8, least=0.9)
    same(got, brute(rows, 3, 0.9))
    assert len(got) == 31 * 3


def test_empty_and_single(spark):
    assert run(spark, [], k=3, width=8) == {} and run(spark, [("a", [1.0] * 8, 0)], k=3, width=8) == {}


def test_quantised_products_stay_within_their_bound():
    rng = np.random.default_rng(3)
    x, y = N.unit(rng.normal(size=(300, 64))), N.unit(rng.normal(size=(200, 64)))
    (cx, sx, rx), (cy, sy, ry) = N.quantised(x), N.quantised(y)
    near = (cx.astype(int) @ cy.astype(int).T) * sx[:, None] * sy[None, :]
    assert (np.abs(near - x @ y.T) <= ry[None, :] + rx[:, None] * (1 + ry[None, :]) + 1e-12).all()


def test_recall_of_near_pairs_with_the_default_blocks(spark):
    """Against brute force on vectors without structure but for near pairs."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(1500, 64))
    near = base[:200] + rng.normal(scale=0.3, size=(200, 64))
    x = np.concatenate([base, near]).astype(np.float32)
    u = N.unit(x)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    want = {(f"{i:04d}", f"{j:04d}") for i, j in zip(*np.nonzero(s >= 0.9))}
    df = spark.createDataFrame([(f"{i:04d}", [float(z) for z in v]) for i, v in enumerate(x)], "id string, v array<float>")
    got = {(r.key_a, r.key_b) for r in N.nearest_vectors(spark, df, "id", "v", 5, 64, 0.9).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) > 100
