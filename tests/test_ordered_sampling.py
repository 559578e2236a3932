import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenloom.operators import ordered, sampling


def test_places(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 10**6), i) for i in range(500)] + [("hot", i * 7 % 501, i) for i in range(500)] + [("n", None, 1), ("n", 4, 2)]
    df = spark.createDataFrame(rows, "g string, x long, part_ long").repartition(5)
    key = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])
    for by in ([], ["g"]):
        got = ordered.places(df, ["x", "part_"] if by else ["g", "x", "part_"], by, range_rows=40).collect()
        seen, want = Counter(), {}
        for r in sorted(rows, key=key):
            want[r] = seen[r[0] if by else 0]
            seen[r[0] if by else 0] += 1
        assert {(r.g, r.x, r.part_): r.place for r in got} == want and len(got) == len(rows)


def test_ranges_grow_before_they_become_too_many(spark, monkeypatch):
    """A fixed number of rows a range must not make tasks and files without end; places and runs stay the same."""
    of = ordered.ranges_of
    assert [of(n, 1000) for n in (0, 1, 1000, 1001, 1024 * 1000)] == [1, 1, 1, 2, 1024]
    assert of(43_000_000, 1000) == of(1 << 30, 1000) == 1024 and of(1 << 31, 1000) == of(1 << 31, ordered.RANGE_ROWS) == 2048
    assert of(1 << 31, 1 << 22) == 512
    monkeypatch.setattr(ordered, "MOST_RANGES", 3)
    df = spark.range(100).select((99 - F.col("id")).alias("x"), F.lit("k").alias("context"))
    assert ordered.in_ranges(df, ["x"], 10).select("part").distinct().count() == 3
    assert sorted((r.x, r.place) for r in ordered.places(df, ["x"], range_rows=10).collect()) == [(i, i) for i in range(100)]
    got = ordered.runs(df, ["x"], ["context"], 7, 10).collect()
    assert sorted((r.x, r.place, r.run_start, r.chunk) for r in got) == brute_runs([(i, "k") for i in range(100)], 7)


def brute_runs(rows, size):
    out, start, chunk, last = [], 0, -1, object()
    for i, (o, k) in enumerate(rows):
        if i == 0 or k != last:
            start, last = i, k
        chunk += (i - start) % size == 0
        out.append((o, i, start, chunk))
    return out


@pytest.mark.parametrize(("size", "keys"), [(1, "ab"), (3, "a"), (4, "abc"), (1000, "ab")])
def test_runs_over_ranges(spark, size, keys):
    """Runs longer than a range, runs that end at a range's end, null keys; one range and many."""
    rng = random.Random(size)
    names = [c for c in keys for _ in range(rng.choice([1, 2, 90]))] * 3 + [None, None]
    rows = [(i * 3, k) for i, k in enumerate(names)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "ord long, context string").withColumn("n", F.lit("clash"))
    for range_rows in (7, 10**6):
        got = ordered.runs(df, ["ord"], ["context"], size, range_rows).collect()
        assert sorted((r.ord, r.place, r.run_start, r.chunk) for r in got) == brute_runs(rows, size)
    assert ordered.runs(df.limit(0), ["ord"], ["context"], 2).count() == 0
    with pytest.raises(ValueError):
        ordered.runs(df, ["ord"], ["context"], 0)


def test_batches_of_shards_and_mixed_groups(spark):
    rows = [(s, i, "d", "x" if i % 10 < 7 else "y", i != 8) for s in (0, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "shard int, ord long, dataset string, context string, labelled boolean")
    got = sampling.batch_runs(df, 4, "shard", range_rows=6)
    batches = {}
    for r in got.collect():
        batches.setdefault((r.shard, r.batch), []).append(r.ord)
    want, at = {}, 0
    for tens in range(4):
        for piece in ([0, 1, 2, 3], [4, 5, 6], [7, 8, 9]):
            want[at] = [10 * tens + p for p in piece]
            at += 1
    assert {k: sorted(v) for k, v in batches.items()} == {(s, b): v for s in (0, 1) for b, v in want.items()}
    one = sampling.batch_runs(df.filter("shard = 0"), 4, range_rows=6)
    assert [(r.batch, r.dataset) for r in sampling.mixed_groups(one).collect()] == [(2, "d")]
    assert {(r.batch, r.n) for r in sampling.gene_groups(one).collect()} == {(b, len(v)) for b, v in want.items()}


def test_keyed_permutations_take_every_place_once(spark):
    sizes = [1, 2, 3, 4, 5, 17, 255, 256, 257, 3000]
    df = spark.createDataFrame([(n, k, x) for n in sizes for k in (1, 99) for x in range(n)], "n long, key long, x long")
    got = {}
    for r in sampling.with_permuted(df, "y", F.col("x"), F.col("n"), F.col("key")).collect():
        got.setdefault((r.n, r.key), {})[r.x] = r.y
    assert all(sorted(m.values()) == list(range(n)) for (n, _), m in got.items())
    a, b = got[3000, 1], got[3000, 99]
    assert sum(a[x] == x for x in a) < 20 and sum(a[x] == b[x] for x in a) < 20
    assert abs(sum(x * y for x, y in a.items()) / 3000 - 1499.5**2) < 0.1 * 1499.5**2  # near uncorrelated


@pytest.mark.parametrize("replicas", [1, 4])
def test_blended_epochs(spark, replicas):
    members = {"a": 37, "b": 10, "c": 1, "off": 9}
    weights = {"a": 1.0, "b": 2.0, "c": 1.0, "off": 0.0}
    rows = spark.createDataFrame([(g, i * 5) for g, n in members.items() for i in range(n)], "group string, row long").repartition(3)
    table = spark.createDataFrame(list(weights.items()), "group string, weight double")
    epochs = list(range(9))
    got = sampling.blended_epochs(rows, table, epochs, replicas, seed=3, range_rows=8).collect()
    total = -(-48 // replicas) * replicas
    counts = dict(zip("abc", sampling.largest_remainder([1.0, 2.0, 1.0], total), strict=True))
    for e in epochs:
        own = [r for r in got if r.epoch == e]
        assert Counter(r.group for r in own) == counts
        assert sorted((r.replica, r["at"]) for r in own) == [(p, i) for p in range(replicas) for i in range(total // replicas)]
    for g, n in members.items():
        drawn = [r for r in got if r.group == g]
        cycles = Counter(r.cycle for r in drawn)
        for c in list(cycles)[:-1]:
            if c < max(cycles):  # whole cycles take every row once, across epochs
                assert sorted(r.row for r in drawn if r.cycle == c) == [i * 5 for i in range(n)]
    slots = {e: [r.group for r in sorted((r for r in got if r.epoch == e), key=lambda r: (r.replica, r["at"]))] for e in (0, 1)}
    assert slots[0] != slots[1] and slots[0] != sorted(slots[0])
    again = sampling.blended_epochs(rows, table, [4], replicas, seed=3, range_rows=1000).collect()
    assert sorted(again) == sorted(r for r in got if r.epoch == 4)


def test_draws_are_computed_once_and_without_a_shuffle(spark):
    """After rows are numbered an epoch takes two permutations a row, each once, and no task is as large as a group."""
    rows = spark.createDataFrame([("a" if i % 50 else "b", i) for i in range(2000)], "group string, row long")
    table = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "group string, weight double")
    got = sampling.blended_epochs(rows, table, [0, 1], 2, seed=1, range_rows=100)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and "Window" not in plan
    assert plan.count("places_of(") == 2
    assert got.count() == 4000


def test_permuted_numbers_in_their_range_only():
    x = np.arange(1 << 12)
    n, key = np.full(len(x), len(x)), np.full(len(x), 5)
    assert sorted(sampling.permuted(x, n, key)) == list(range(len(x))) and len(sampling.permuted(x[:0], n[:0], key[:0])) == 0
    large = (1 << 46) + 12345  # the most that squares below PRIME need
    far = sampling.permuted(np.array([0, large - 1]), np.array([large] * 2), np.array([7, 7]))
    assert ((far >= 0) & (far < large)).all() and far[0] != far[1]
    for bad in (-1, 1 << 12):
        with pytest.raises(ValueError, match="outside its range"):
            sampling.permuted(np.array([bad]), n[:1], key[:1])


def test_blend_problems(spark):
    rows = spark.createDataFrame([("a", 1)], "group string, row long")
    make = lambda *w: {(r.group, r.problem) for r in sampling.blend_problems(rows, spark.createDataFrame(list(w), "group string, weight double")).collect()}
    assert make(("a", 1.0), ("b", 0.0)) == set()
    assert make(("a", -1.0), ("b", 2.0)) == {("a", "negative weight"), ("b", "no rows")}
    assert make(("a", 0.0)) == {(None, "no positive weight")}
