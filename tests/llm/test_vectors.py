import numpy as np
import pytest

from pii_spark.llm import vectors
from pii_spark.llm.queries import op4_projections


def brute_force(rows):
    good = [(k, np.array(v, np.float32).astype(float)) for k, v in rows
            if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, parent = {k: 0 for k, _ in rows}, {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(good):
        for b, y in good[:i]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                links[a] += 1
                links[b] += 1
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return sorted((k, links[k], find(k), find(k) == k) for k, _ in rows)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    made = [rng.normal(size=24) for _ in range(300)]
    for base, size, noise in ((0, 60, 0.05), (1, 40, 0.3), (2, 30, 0.45), (3, 12, 0.0)):
        made += [made[base] * rng.uniform(0.1, 9) + noise * rng.normal(size=24) for _ in range(size)]
    made += [made[5]] * 9 + [rng.normal(size=8) for _ in range(5)] + [made[-1][:8]]
    values = [[float(np.float32(x)) for x in v] for v in made]
    values += [None, [], [0.0] * 24, [None] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1e-40] * 24, [2e-40] * 24, [3e38] * 24]
    return [(int(k), v) for k, v in zip(rng.permutation(len(values)), values, strict=True)]


def result(df):
    return sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect())


def test_query_equals_brute_force(spark, rows, tmp_path, monkeypatch):
    # Small cells and blocks, so that several tables and meetings of blocks take part; recall so high
    # that none of these few pairs is missed.
    for name, value in (("CELL", 40), ("BLOCK", 25)):
        monkeypatch.setattr(vectors, name, value)
    data = [(k, v, k % 3, 1) for k, v in rows]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, rep long").repartition(3).write.parquet(
        str(tmp_path / "embeddings.parquet"))
    assert result(op4_projections(spark, str(tmp_path))) == brute_force(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    n, d = 4000, 64
    x = vectors.unit(rng.normal(size=(n, d)))
    side = rng.normal(size=(n, d))
    side = vectors.unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    y = 0.901 * x + np.sqrt(1 - 0.901**2) * side
    plan = vectors.Plan(0.9, 50_000)
    assert plan.bits == 8 and plan.tables > 10
    shared = (vectors.cell_codes(x, plan) == vectors.cell_codes(y, plan)).any(axis=1)
    counted, _ = vectors.directions(d, plan.tables, plan.bits)
    enough = (np.abs(x @ counted - y @ counted) <= plan.window).sum(axis=1) >= plan.least
    assert (shared & enough).mean() >= 0.995


def test_links_in_large_cells():
    # Pairs just over the threshold, in cells as large as two blocks that meet.
    rng = np.random.default_rng(6)
    n, d, plan = 1024, 64, vectors.Plan(0.9, 50_000)
    met = []
    for _ in range(6):
        x = vectors.unit(rng.normal(size=(n, d)))
        side = rng.normal(size=(n, d))
        side = vectors.unit(side - (side * x).sum(axis=1, keepdims=True) * x)
        units = np.concatenate([x, 0.901 * x + np.sqrt(1 - 0.901**2) * side])
        want = {(int(i), int(j)) for i, j in np.argwhere(np.triu(units @ units.T >= 0.9, 1))}
        for second in (np.zeros(2 * n, bool), np.arange(2 * n) >= n):
            found = {(min(p), max(p)) for p in zip(*(f.tolist() for f in vectors.links_between(units, second, plan)), strict=True)}
            assert len(want) >= n and found <= want
            met.append(len(found) / len(want))
    assert np.mean(met) >= 0.998


def test_null_and_repeated_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.1]), (3, [1.0, 0.1]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = vectors.near_vectors(df).collect()
    assert sorted(r["n_links"] for r in got) == [0, 2, 2, 2]
    assert vectors.near_vectors(df.limit(0)).count() == 0
