"""Embedding near-duplicates against brute force."""

import brute
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from talkgrain.llm import components, embed


def vectors(seed=1, groups=12, dim=24):
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=dim) for _ in range(300)]
    for _ in range(groups):
        base = rng.normal(size=dim)
        base /= np.linalg.norm(base)
        # Steps up to the largest angle that links.
        out += [base + rng.normal(size=dim) * s / np.sqrt(dim) for s in np.linspace(0, 0.32, 40)]
    out += [out[5], out[5], out[310], 3 * out[7]]
    return np.array(out, np.float32)


def expected(x):
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    links = y @ y.T >= 0.95
    np.fill_diagonal(links, False)
    a, b = np.nonzero(links)
    return links.sum(1), brute.groups(len(x), zip(a.tolist(), b.tolist(), strict=True), list(range(len(x))))


@pytest.mark.parametrize("tile", [None, 16])
def test_recall(spark, monkeypatch, tile):
    if tile:
        monkeypatch.setattr(embed, "TILE", tile)
        monkeypatch.setattr(embed, "SENT", 32)
    x = vectors()
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)],
                               "vec_id bigint, embedding array<float>, node int")
    got = {r["vec_id"]: r for r in embed.near_duplicates(df.repartition(4)).collect()}
    links, component = expected(x)
    found = np.array([got[k]["n_links"] for k in range(len(x))])
    assert (found <= links).all()
    assert found.sum() >= 0.98 * links.sum()
    same = [got[k]["component_id"] == component[k] for k in range(len(x))]
    assert np.mean(same) > 0.97
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in got.values())


def test_exact_where_all_lists_are_probed(spark):
    x = vectors(seed=2)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: r for r in embed.near_duplicates(df, lists=1).collect()}
    links, component = expected(x)
    assert [got[k]["n_links"] for k in range(len(x))] == links.tolist()
    assert [got[k]["component_id"] for k in range(len(x))] == component


def spread(dim, effective):
    """Deviations by direction whose variances have the effective dimension (sum squared over sum of squares)."""
    low, high = 0.0, 12.0
    for _ in range(60):
        power = (low + high) / 2
        v = np.arange(1, dim + 1.0) ** -power
        low, high = (power, high) if v.sum() ** 2 / (v * v).sum() > effective else (low, power)
    return np.sqrt(v / v.sum())


@pytest.mark.parametrize(("dim", "effective"), [(64, 64), (384, 8), (384, 4.3), (768, 2.5), (768, 4)])
def test_recall_whatever_the_spread(spark, tmp_path, dim, effective):
    rng = np.random.default_rng(dim)
    by = spread(dim, effective)
    base = rng.normal(size=(2400, dim)) * by
    # Steps that spread like the vectors, and steps that spread evenly.
    steps = [rng.normal(size=(300, dim)) * d * rng.uniform(0.05, 0.32, (300, 1)) for d in (by, 1 / np.sqrt(dim))]
    x = np.concatenate([base, *(base[k * 300:k * 300 + 300] + s for k, s in enumerate(steps))]).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}), tmp_path / "x.parquet")
    got = embed.near_duplicates(spark.read.parquet(str(tmp_path / "x.parquet")).repartition(8)).toPandas()
    found = got.sort_values("vec_id")["n_links"].to_numpy()
    links, _ = expected(x)
    assert (found <= links).all()
    assert found.sum() >= 0.97 * links.sum()


def test_nothing_is_lost_where_nothing_is_measured(spark, monkeypatch):
    monkeypatch.setattr(embed, "LEAST_LINKED", 10_000)
    x = vectors(seed=3)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in embed.near_duplicates(df).collect()}
    assert [got[k] for k in range(len(x))] == expected(x)[0].tolist()


def test_sizes_and_lengths(spark):
    rows = [(1, [1e-24, 0.0]), (2, [2e-24, 0.0]), (3, [1e20, 0.0]), (4, [2e20, 1e19]), (5, [0.0, 3e300]),
            (6, [0.0, 1e-310]), (7, [1.0, 0.0, 0.0]), (8, [3.0, 0.0, 0.1]), (9, [0.0, 1.0, 0.0]), (10, [4.0])]
    rows += [(20 + k, [1.0, 1e-12 * k, 0.0, 0.0]) for k in range(3)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed.near_duplicates(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (1, 7), 8: (1, 7),
                   9: (0, 9), 10: (0, 10), 20: (2, 20), 21: (2, 20), 22: (2, 20)}


def test_one_vector_in_most_rows(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_ROWS", 20)
    rows = [(k, [1.0, 2.0] if k % 3 else [1.0, float(-k)]) for k in range(90)] + [(90, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in embed.near_duplicates(df).collect()}
    links, _ = expected(np.array([v for _, v in rows[:-1]], np.float32))
    assert [got[k] for k in range(90)] == links.tolist() and got[90] == 0


def test_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, [1.0]), (9, []), (None, [1.0, 0.0]), (2, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted(map(str, map(tuple, embed.near_duplicates(df).collect())))
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (None, 0, None, False)]
    want += [(k, 0, k, True) for k in range(3, 10)]
    assert got == sorted(map(str, want))
    assert embed.near_duplicates(df.limit(0)).count() == 0
    assert embed.near_duplicates(df.where("vec_id = 3")).collect()[0]["n_links"] == 0
