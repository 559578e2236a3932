import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from screenloom.llm.vector_codes import compress_vectors, integers, largest, nearest


def brute(rows, parts=8, entries=16, rounds=6):
    """The definition in Python integers: (vec_id, code, error, label_error) of the kept rows, and the digest of the codebooks."""
    fine = [(i, l, v) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, _, v in fine), default=0) // parts)
    kept = []
    for i, l, v in fine:
        x = [math.floor(4096 * np.float64(np.float32(c))) for c in v]
        if all(abs(c) <= largest(parts * width) for c in x):
            kept.append((i, l, x + [0] * (parts * width - len(x))))
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    cut = lambda x, p: tuple(x[p * width : (p + 1) * width])
    books = [[cut(x, p) for _, _, x in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((c - d) ** 2 for c, d in zip(a, b, strict=True))
    best = lambda x, p: min(range(len(books[p])), key=lambda e: (far(cut(x, p), books[p][e]), e))
    for _ in range(rounds if kept else 0):
        groups = {}
        for _, _, x in kept:
            for p in range(parts):
                groups.setdefault((p, best(x, p)), []).append(cut(x, p))
        for (p, e), own in groups.items():
            books[p][e] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    out, totals = [], {}
    for i, l, x in kept:
        index = [best(x, p) for p in range(parts)]
        error = sum(far(cut(x, p), books[p][e]) for p, e in enumerate(index))
        totals[l] = totals.get(l, 0) + error
        out.append((i, l, "".join(f"{e:02x}" for e in index), error))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, code, error, totals[l]) for i, l, code, error in out), key=str), digest


def compare(spark, rows, parts=4, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = compress_vectors(df, parts=parts, **options).collect()
    want, digest = brute(rows, parts=parts, **options)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} <= {digest}
    return got


@pytest.mark.parametrize("scale", [0.0, 1e-4, 0.3, 900.0])
def test_codes_equal_exact_arithmetic(spark, scale):
    """At scale 0 and 1e-4 nearly all distances tie, at 900 float32 rounds the inputs."""
    rng = random.Random(4)
    compare(spark, [(i * 3, [rng.gauss(0, scale) for _ in range(12)], rng.choice([1, 2, None])) for i in range(160)], entries=6, rounds=3)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [0.5, 1.0, -0.25], 1), (5, [0.5, 1.0, -0.25], 1), (None, [1.0, 2.0], None), (1, None, 1), (2, [1.0, None], 2), (3, [nan, 0.0], 3), (4, [0.0, -inf], 3),
        (7, [], 2), (6, [1e30, 0.0], 1), (8, [-0.0001] * 7, None), (9, [0.0, 0.5, 0.5, 0.5, 0.5, 0.5, 0.25], 3),
    ]
    got = compare(spark, rows, entries=4, rounds=2)
    assert len(got) == 6
    assert len(compare(spark, rows[:1], entries=16, rounds=2)) == 1
    assert compare(spark, []) == [] and compare(spark, rows[3:7]) == [] and len(compare(spark, [(1, [], 1)])) == 1
    clash = spark.createDataFrame([(1, [1.0, 2.0], "a", 3, "x")], "vec_id long, embedding array<double>, label string, id int, code string")
    assert compress_vectors(clash, parts=2).first().code == "0000"


def test_screening_never_decides_wrongly():
    rng = np.random.default_rng(9)
    undecided = 0
    for k in range(300):
        width, top = int(rng.integers(1, 40)), int(2 ** rng.integers(1, 27))
        base = rng.integers(-top, top + 1, (1, width))
        book = base + rng.integers(-3, 4, (16, width)) if k % 2 else rng.integers(-top, top + 1, (16, width))
        x = np.concatenate([book + rng.integers(-1, 2, book.shape), rng.integers(-top, top + 1, (16, width))])
        index, sure = nearest(x, book)
        exact = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (index == exact.argmin(axis=1)).all()
        undecided += int((~sure).sum())
    assert undecided > 0


def test_integers_floor_down_and_fill_up():
    column = pa.array([[0.1, -0.1, 1.0], None, [0.5], [float("nan"), 0.0, 0.0]], type=pa.list_(pa.float32()))
    x, kept = integers(column, 4)
    assert x.tolist() == [[409, -410, 4096, 0], [2048, 0, 0, 0]] and kept.tolist() == [0, 2]
