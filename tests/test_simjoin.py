import numpy as np
import pytest

import __spark_entry__ as entry
from kgspark.operators import simjoin


def _spread(n: int, dim: int, seed: int) -> np.ndarray:
    """Vectors that point everywhere, so hardly a list can be left out; every third has a near copy."""
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, dim))
    m[1::3] = m[::3][: len(m[1::3])] + 0.3 * rng.standard_normal((len(m[1::3]), dim))
    return m.astype(np.float32)


def _pairs(m: np.ndarray, least: float) -> set[tuple[int, int]]:
    u = m.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(u @ u.T >= least)) if i < j}


def _shuffled(spark) -> int:
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    rows = sc.statusStore().executorList(False)
    return sum(rows.apply(i).totalShuffleWrite() for i in range(rows.size()))


@pytest.mark.parametrize("query", ["semantic_dedup", "similar_names", "vector_pairs_threshold"])
def test_vectors_are_not_copied_for_each_list(spark, tmp_path, query):
    m = _spread(3000, 64, 5)
    rows = [(i, f"name {i:05d}", ["a" if i % 2 else "b", "c" if i % 7 else "d"], m[i].tolist()) for i in range(3000)]
    spark.createDataFrame(rows, "rec_id long, canonical_name string, base_types array<string>, embedding array<float>").write.parquet(f"{tmp_path}/kg_entities.parquet")
    before = _shuffled(spark)
    got = entry.queries()[query](spark, str(tmp_path)).collect()
    # each vector is 256 bytes and is moved at most twice; with a copy for each list that it meets 18 MB were written
    assert _shuffled(spark) - before < 3000 * 256 * 6
    if query == "vector_pairs_threshold":
        assert {(r["a"], r["b"]) for r in got} == {(a, b) for a, b in _pairs(m, 0.8) if set(rows[a][2]) & set(rows[b][2])}
        return
    near = {(rows[a][1], rows[b][1]) for a, b in _pairs(m, 0.9)}
    assert len(near) > 500
    if query == "similar_names":
        assert {(r["a"], r["b"]) for r in got} == near
    else:
        assert {r["name"] for r in got} == {x for p in near for x in p} and {(r["survivor"], r["name"]) for r in got if r["name"] != r["survivor"]} == near


@pytest.mark.parametrize("kind", ["float", "double"])
def test_join_in_many_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(simjoin, "BLOCK", 4 * 16 * 140)
    m, other = _spread(500, 16, 6), _spread(30, 5, 7)
    m[400:] = m[:100] * np.float32(3)  # copies of another length
    m[230:390] = m[230]  # a list that does not fit a block
    tags = [[["x"], ["y"], ["x", "y"], [], None][i % 5] for i in range(530)]
    rows = [(f"k{i:04d}", r.tolist(), tags[i]) for i, r in enumerate([*m, *other])] + [("k9999", [1.0, 2.0], ["x"]), ("k9998", None, ["x"]), ("k0000", m[0].tolist(), tags[0])]
    df = spark.createDataFrame(rows, f"name string, embedding array<{kind}>, tags array<string>")
    for least in (0.5, 0.9):
        want = _pairs(m, least) | {(a + 500, b + 500) for a, b in _pairs(other, least)}
        got = [(int(r["a"][1:]), int(r["b"][1:])) for r in simjoin.similar(df, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    tagged = [(int(r["a"][1:]), int(r["b"][1:])) for r in simjoin.similar(df, 0.5, block="tags").collect()]
    assert sorted(tagged) == sorted((a, b) for a, b in _pairs(m, 0.5) | {(a + 500, b + 500) for a, b in _pairs(other, 0.5)} if set(tags[a] or []) & set(tags[b] or []))


def test_short_vectors_lose_no_pair():
    """Products along the axes, with what is left, are those of the whole vectors at least."""
    m = _spread(400, 64, 8).astype(np.float64)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    axes = simjoin._axes(u, 0.8)
    assert axes is not None and len(axes) < 64
    p = simjoin._short(u, axes)
    assert (p @ p.T >= u @ u.T - 1e-6).all()
