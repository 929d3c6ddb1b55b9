import numpy as np
import pytest

from papyra.llm import neighbours as N


def keyed(n):
    keys = np.zeros(n, N.NATIVE)
    keys["lo"] = np.arange(n)
    return keys


def test_a_tile_of_near_duplicates_keeps_k_a_row():
    rng = np.random.default_rng(1)
    x = N.unit(rng.normal(size=64) + rng.normal(scale=0.01, size=(4096, 64)))
    i, j, s = N.tile_pairs(x, x, 5, 0.9, True)
    assert np.bincount(i).max() == 5 and len(i) == 5 * 4096 and (i != j).all()
    exact = np.where(np.eye(4096, dtype=bool), -2, x @ x.T)
    assert np.allclose(np.sort(s.reshape(4096, 5), axis=1), np.sort(exact, axis=1)[:, -5:])


@pytest.mark.parametrize("block", [64, 4096])
def test_groups_are_exact_with_all_blocks_and_remember_guests(monkeypatch, block):
    monkeypatch.setattr(N, "ROWS_A_BLOCK", block)
    rng = np.random.default_rng(2)
    raw, more = rng.normal(size=(500, 16)).astype(np.float32), rng.normal(size=(200, 16)).astype(np.float32)
    group = N.Group(raw, keyed(500), 4, None, 1 << 40)
    group.residents()
    guests = keyed(200)
    guests["lo"] += 500
    parts = [group.guests(more[:90], guests[:90]), group.guests(more[90:], guests[90:])]
    x, y = N.unit(raw), N.unit(more)
    s = y @ x.T
    assert {(a, b) for g in parts for a, b in zip(g[0]["lo"].tolist(), g[1]["lo"].tolist())} == {(500 + r, c) for r in range(200) for c in np.argsort(-s[r])[:4].tolist()}
    a, b, _ = group.out()
    full = np.concatenate((np.where(np.eye(500, dtype=bool), -2, x @ x.T), s.T), axis=1)
    assert set(zip(a["lo"].tolist(), b["lo"].tolist())) == {(r, c) for r in range(500) for c in np.argsort(-full[r])[:4].tolist()}


def recall(vectors, k=5):
    """Of the blocks of one level, for vectors in one group: the share of the k nearest that share a probed block."""
    group = N.Group(vectors, keyed(len(vectors)), k, None, N.PROBES * N.BLOCKS_A_PROBE)
    group.residents()
    a, b, _ = group.out()
    x, hit = N.unit(vectors).astype(np.float32), 0
    got = {}
    for r, c in zip(a["lo"].tolist(), b["lo"].tolist()):
        got.setdefault(r, set()).add(c)
    for lo in range(0, len(x), 2000):
        s = x[lo : lo + 2000] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
        for r, row in enumerate(np.argpartition(-s, k, axis=1)[:, :k].tolist()):
            hit += len(got[lo + r] & set(row))
    return hit / (k * len(x))


@pytest.mark.parametrize("blocks, rows", [(500, 12_000), (1000, 12_000)])
def test_recall_of_plain_nearest_neighbours(monkeypatch, blocks, rows):
    """Vectors around 600 centres, as texts around topics are, in many blocks."""
    monkeypatch.setattr(N, "ROWS_A_BLOCK", rows // blocks)
    rng = np.random.default_rng(3)
    topics = rng.normal(size=(600, 64))
    x = (topics[rng.integers(600, size=rows)] + rng.normal(scale=0.5, size=(rows, 64))).astype(np.float32)
    assert recall(x) >= 0.95
