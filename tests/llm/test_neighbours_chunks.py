import pytest

from papyra.llm import neighbours as N
from tests.llm.test_neighbours import brute, run, same, vectors


@pytest.mark.parametrize("block, tile", [(50, 16), (1000, 64)])
def test_exact_without_threshold_in_tiles_of_several_chunks(spark, monkeypatch, block, tile):
    monkeypatch.setattr(N, "ROWS_A_BLOCK", block)
    monkeypatch.setattr(N, "TILE", tile)
    monkeypatch.setattr(N.np, "ceil", lambda x: x * 0 + 1)  # no tile is split, as if the sample hadn't shown their size
    rows = vectors(200, 6)
    same(run(spark, rows, k=5, width=8, probes=1000), brute(rows, 5))


@pytest.mark.parametrize("q, h", [(60, 40), (3, 40), (60, 3)])
def test_pairs_for_both_sides(q, h):
    rng = N.np.random.default_rng(7)
    x, y = N.unit(rng.normal(size=(q, 8))), N.unit(rng.normal(size=(h, 8)))
    i, j, _ = N.tile_pairs(x, y, 5, None, False, both=True)
    got, s = set(zip(i.tolist(), j.tolist())), x @ y.T
    assert {(a, b) for a in range(q) for b in N.np.argsort(-s[a])[:5].tolist()} | {(a, b) for b in range(h) for a in N.np.argsort(-s[:, b])[:5].tolist()} <= got
