import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from custvalue.llm import impact as I


def brute(rows, every, k):
    good = {}
    for name, vector in rows:
        if name is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        good.setdefault((name, tuple(math.floor(64 * x) for x in vector)))
    out = []
    for q, a in good:
        if q % every:
            continue
        scores = sorted(
            (-sum(x * y for x, y in zip(a, b)), c)
            for c, b in good if c != q and len(a) == len(b)
        )
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, every, k):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = I.top_k(df, F.col("vec_id") % every == 0, k)
    return sorted(tuple(r) for r in found.collect())


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(I, "QUERIES_PER_CELL", 20)
    monkeypatch.setattr(I, "VECTORS_PER_CELL", 100)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 12).astype(np.float32).tolist()) for i in range(300)]
    assert run(spark, rows, 5, 20) == brute(rows, 5, 20)


def test_ties_copies_and_hard_rows(spark):
    same = [0.5, -0.25, 0.125]
    rows = [(i, same) for i in range(60)] + [(7, same), (None, same), (100, None), (101, [])]
    rows += [(102, [0.1, None, 0.2]), (103, [float("nan"), 0.0, 0.0]), (104, [float("inf")] * 3)]
    rows += [(200, [1.0, 2.0]), (205, [3.0, 0.5]), (210, [0.0] * 3), (300, [9.0] * 5)]
    assert run(spark, rows, 5, 20) == brute(rows, 5, 20)


def test_empty_tables_and_queries(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert I.top_k(df, F.lit(True)).collect() == []
    some = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert I.top_k(some, F.lit(False)).collect() == []
    assert I.top_k(some, F.lit(True)).collect() == []


def test_segments_fall_in_impact_and_add_up():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-30, 30, (200, 16))
    index = I.Index(np.arange(200), vectors, np.float32)
    assert len(index.segments) > 1
    assert (sum(part for part, _ in index.segments) == vectors).all()
    least = [np.abs(part[part != 0]).min() for part, _ in index.segments if part.any()]
    assert least == sorted(least, reverse=True)
    assert index.segments[-1][1].max() == 0


def test_large_numbers_are_exact_or_refused(spark):
    rows = [(i, [float(2**18 + i), 1.0 / (i + 1)]) for i in range(30)]
    assert run(spark, rows, 5, 3) == brute(
        [(n, np.array(v, np.float32).tolist()) for n, v in rows], 5, 3
    )
    with pytest.raises(Exception, match="beyond"):
        run(spark, [(0, [1e30]), (1, [1e30])], 5, 3)


def test_repeated_queries_and_candidates_over_several_cells(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 16)
    monkeypatch.setattr(I, "QUERIES_PER_CELL", 10)
    monkeypatch.setattr(I, "VECTORS_PER_CELL", 40)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(200)]
    # Every third row twice more, a query and a candidate forty times.
    many = rows + rows[::3] * 2 + [rows[20]] * 40 + [rows[21]] * 40
    found = run(spark, many, 5, 20)
    assert found == brute(rows, 5, 20)
    assert len(found) == 40 * 20
    assert len({(q, c) for q, _, c, _ in found}) == len(found)


def test_an_id_with_several_vectors_keeps_each(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.5, 0.0])]
    assert run(spark, rows, 5, 20) == [(0, 1, 1, 4096), (0, 2, 1, 4096), (0, 3, 2, 2048)]
