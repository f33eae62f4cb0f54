import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveknn.llm import negatives
from sieveknn.llm.residues import MAX_SCORE, primes_for, product, split

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, is_anchor, positives=5, wanted=3, low=50, high=95, scale=256):
    ready = {}
    for vec_id, label, vector in rows:
        if None in (vec_id, label) or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        q = tuple(math.floor(scale * x) for x in vector)
        ready[(vec_id, label, q)] = None
    out = []
    for anchor in ready:
        if not is_anchor(anchor[0]):
            continue
        scored = [(-sum(a * b for a, b in zip(anchor[2], r[2], strict=False)), r[0], r) for r in ready if r != anchor]
        same = sorted(x[:2] for x in scored if x[2][1] == anchor[1])[:positives]
        for negative_score, positive in same:
            p = -negative_score
            hard = sorted(x[:2] for x in scored if x[2][1] != anchor[1] and low * p <= -100 * x[0] <= high * p)[:wanted]
            out += [(anchor[0], positive, rank, n, p, -s) for rank, (s, n) in enumerate(hard, start=1)]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA, every=3, **options):
    frame = spark.createDataFrame(rows, schema).withColumns({"q": F.lit("x"), "mark": F.lit(1), "anchor": F.lit("a"), "score": F.lit(0)})
    return sorted(map(tuple, negatives.mine_negatives(frame.repartition(3), F.col("vec_id") % every == 0, **options).collect()))


def some_rows(seed, n=120, width=7, spread=1.0):
    rng = random.Random(seed)
    return [(i, rng.randrange(3), [rng.gauss(0.3, 0.4) * spread for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"anchor_bytes": 3_000}, {"positives": 2, "negatives": 7, "low_percent": 10, "high_percent": 99}])
def test_equals_brute_force(spark, options):
    rows = some_rows(1)
    names = {"negatives": "wanted", "low_percent": "low", "high_percent": "high", "positives": "positives"}
    plain = {names[k]: v for k, v in options.items() if k in names}
    assert mined(spark, rows, **options) == brute(rows, lambda i: i % 3 == 0, **plain)


def test_ties_repeated_rows_and_rows_that_take_no_part(spark):
    rows = some_rows(2, 40) + [(100 + i, i % 2, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)]
    rows += rows[:5] + [(200, None, [1.0] * 7), (201, 1, None), (None, 1, [1.0] * 7), (202, 0, [None] * 7)]
    rows += [(203, 0, [float("nan")] * 7), (204, 0, [float("inf")] + [0.0] * 6), (207, 2, [0.0] * 7), (210, 1, [-0.001] * 7)]
    rows += [(213, 1, []), (216, 1, [0.7, 0.7]), (3, 2, [0.25] * 7), (-6, 0, [0.5] * 7)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 3 == 0)


def test_large_components_take_more_primes(spark):
    rows = some_rows(3, 60, 5, 1e5)
    assert mined(spark, rows) == brute(rows, lambda i: i % 3 == 0)
    with pytest.raises(ValueError, match="beyond"):
        mined(spark, [(0, 1, [1e300]), (1, 1, [1.0])])


def test_nothing_to_mine(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0])]) == []
    assert mined(spark, [(0, None, [1.0]), (1, 1, None)]) == []
    assert mined(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == []  # no anchor


@pytest.mark.parametrize("width", [1, 63, 64, 65, 300])
def test_products_are_exact_at_the_bounds(width):
    rng = np.random.default_rng(width)
    edge = int((MAX_SCORE / width) ** 0.5)
    for most in (1, 300, edge):
        a, b = (rng.integers(-most, most, (20, width), endpoint=True) for _ in range(2))
        a[0], b[0], b[1] = most, most, -most
        primes = primes_for(width * most * most)
        assert (product(split(a, primes), split(b, primes), primes) == a @ b.T).all()
    # residues that sum to the most a float32 is asked to hold
    primes = primes_for(10**9)
    worst = np.full((2, 64), primes[0] // 2)
    worst[1] *= -1
    assert (product(split(worst, primes), split(worst, primes), primes) == worst @ worst.T).all()


def test_one_scan_a_phase_and_block(spark, sf_dir):
    from sieveknn.llm.queries import op13_hard_negatives

    plan = op13_hard_negatives(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan and plan.count("MapInArrow") == 1
