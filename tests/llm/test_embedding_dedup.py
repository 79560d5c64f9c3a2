"""Links and components equal those of all pairs of vectors."""

import numpy as np
import pytest

from lexmill.llm import embedding_dedup


def vectors(seed, dimension=24, n=260):
    rng = np.random.RandomState(seed)
    rows = rng.normal(size=(n, dimension))
    for i in range(0, n, 3):
        rows[i] = rows[rng.randint(n)] * rng.uniform(0.5, 2) + rng.normal(size=dimension) * rng.uniform(0, 0.5)
    for i in range(0, n, 17):
        rows[i] = rows[1]
    return [(i + 10, [float(np.float32(x)) for x in row]) for i, row in enumerate(rows)]


def odd():
    return [(1, None), (2, []), (3, [0.0] * 24), (4, [1.0, None] + [0.0] * 22), (5, [float("nan")] * 24), (6, [float("inf")] + [1.0] * 23), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (None, [1.0] * 24), (9, [3e38] * 24), (9, [3e38] * 24)]


def brute(rows):
    units = []
    for i, v in rows:
        ok = i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append((np.array(v) / np.abs(v).max()) / np.linalg.norm(np.array(v) / np.abs(v).max()) if ok else None)
    label = {i: i for i, _ in rows if i is not None}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.9:
                links[a] += 1
                links[b] += 1
                x, y = find(rows[a][0]), find(rows[b][0])
                label[max(x, y)] = min(x, y)
    return sorted(((i, n, None if i is None else find(i)) for (i, _), n in zip(rows, links, strict=True)), key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "n", 1, 2) for i, v in rows], "vec_id long, embedding array<float>, node string, a long, size long")
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.linked(df, **options).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_brute_force(spark, seed):
    rows = vectors(seed) + odd()
    assert found(spark, rows, block_size=8) == brute(rows)


def test_chunks_and_cells(spark, monkeypatch):
    """Cells that are cut into chunks of a few points find the same links."""
    monkeypatch.setattr(embedding_dedup, "CHUNK", 40)
    monkeypatch.setattr(embedding_dedup, "MAX_CELLS", 5)
    rows = vectors(3)
    assert found(spark, rows, block_size=8) == brute(rows)


def test_pigeonhole_cells_lose_no_pair():
    """Each pair within a block's range meets in the cell of either point."""
    rng = np.random.RandomState(0)
    rows = rng.normal(size=(400, 8))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    space = embedding_dedup.Space(np.eye(8), [0, 4, 8], [rows[:9, :4], rows[:9, 4:]], [0.05, 0.05])
    for b, points, home, visits in embedding_dedup.places(space, rows):
        square = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
        i, j = np.nonzero(square <= space.budgets[b])
        assert visits[i, home[j]].all()


def test_empty_table(spark):
    assert found(spark, []) == []
