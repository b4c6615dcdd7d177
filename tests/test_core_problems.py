import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sigilite.operators.hotkeys import heavy_keys, key_totals
from sigilite.operators.snapshots import snapshot_changes


def _totals(df, **options):
    rows = key_totals(df, {"k": F.col("k"), "r": F.col("r")}, F.col("v"), F.col("m"), F.col("o"), **options).collect()
    return {(r.key_field, r.key_value): (r.n_rows, r.total, r.changes) for r in rows}


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaaaaaab") if i % 3 else None, f"r{i % 5}", rng.choice([None, 1, 2, 500]), rng.choice([None, 1, 2]), i * 7 % 3001, "x") for i in range(3000)]
    return rows, "k string, r string, v int, m int, o bigint, __key string"


def _brute(rows):
    out = {}
    for field, i in (("k", 0), ("r", 1)):
        for row in sorted(rows, key=lambda r: r[4]):
            n, s, c, last = out.get((field, row[i]), (0, None, 0, "start"))
            out[field, row[i]] = (n + 1, s if row[2] is None else (s or 0) + row[2], c + (last != "start" and last != row[3]), row[3])
    return {k: v[:3] for k, v in out.items()}


@pytest.mark.parametrize("chunk_rows, parts", [(100_000, 1), (100, 7), (7, 3), (1, 2)])
def test_any_chunks_and_layout(spark, skewed, chunk_rows, parts):
    rows, schema = skewed
    shuffled = random.Random(chunk_rows).sample(rows, len(rows))
    assert _totals(spark.createDataFrame(shuffled, schema).repartition(parts), chunk_rows=chunk_rows) == _brute(rows)


def test_hot_keys_empty_and_ties(spark, skewed):
    df = spark.createDataFrame([("a", "r", 1, 1, 5, "")] * 40 + [("b", "r", None, None, None, "")], skewed[1])
    assert _totals(df, chunk_rows=4) == {("k", "a"): (40, 40, 0), ("k", "b"): (1, None, 0), ("r", "r"): (41, 40, 1)}
    assert _totals(df.limit(0)) == {}
    totals = key_totals(df, {"k": F.col("k")}, F.col("v"), F.col("m"), F.col("o"))
    assert [r.key_value for r in heavy_keys(totals, 0.5).collect()] == ["a"]


T0 = datetime(2024, 1, 1)


def _changes(df, **options):
    rows = snapshot_changes(df, "no", "key", "at", {"p": F.col("p"), "s": F.col("s")}, **options).collect()
    return sorted(((r.no, r.key, r.change) for r in rows), key=str)


def test_snapshots_equal_brute_force(spark):
    rng = random.Random(5)
    rows, states, state = [], {}, {}
    for no in (1, 2, 4, 5):
        for _ in range(60):
            k = rng.choice([None] + [f"k{i}" for i in range(300)])
            if rng.random() < 0.3:
                state.pop(k, None)
            else:
                state[k] = (rng.choice("pq"), rng.choice(["s", None]))
        states[no] = dict(state)
        for k, (p, s) in state.items():
            if rng.random() < 0.2:
                rows.append((no, k, T0, "old", "old", "x"))
            rows += [(no, k, T0 + timedelta(days=1), p, s, "x")] * rng.choice([1, 1, 2])
    rows.append((None, "k1", T0, "z", "z", "x"))
    want = []
    for a, b in ((1, 2), (2, 4), (4, 5)):
        for k in states[a].keys() | states[b].keys():
            old, new = states[a].get(k), states[b].get(k)
            if old != new:
                want.append((b, k, "added" if old is None else "removed" if new is None else "changed"))
    df = spark.createDataFrame(rows, "no int, key string, at timestamp, p string, s string, __h string")
    for chunk_rows in (1, 4, 64):
        assert _changes(df.repartition(3), chunk_rows=chunk_rows) == sorted(want, key=str)


def test_snapshots_edge_cases(spark):
    schema = "no int, key string, at timestamp, p string, s string"
    df = spark.createDataFrame([(1, "a", None, "p", "s"), (2, "a", T0, "p", "s"), (2, "a", None, "q", "s"), (2, None, T0, None, None), (3, "a", T0, "p", "S")], schema)
    assert _changes(df) == sorted([(2, None, "added"), (3, "a", "changed"), (3, None, "removed")], key=str)
    assert _changes(df.limit(0)) == []
    with pytest.raises(TypeError):
        snapshot_changes(df, "no", "key", "p", {"s": F.col("s")})
