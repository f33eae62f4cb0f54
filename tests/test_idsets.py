"""Bitmaps of ids against sets of ids."""

import random

import pytest
from pyspark.sql import functions as F

from sieveknn.operators import idsets
from sieveknn.operators.idsets import Matches, fits_broadcast, id_bitmaps, measure, together, with_flags
from sieveknn.plans import hybrid

SCHEMA = "id long, kind int"


@pytest.mark.parametrize("broadcast", [True, False])
def test_members_are_the_matching_ids(spark, broadcast):
    rng = random.Random(1)
    ids = [rng.choice([rng.randrange(-70_000, 70_000), rng.randrange(50), rng.randrange(1 << 40)]) for _ in range(3000)]
    ids += [0, 1, -1, 32_767, 32_768, 32_769, -32_768, 65_536]
    meta = spark.createDataFrame([(i, rng.randrange(4)) for i in ids] + [(None, 1), (ids[0], 2)], SCHEMA)
    rows = spark.createDataFrame([(i,) for i in ids + [rng.randrange(-70_000, 70_000) for _ in range(3000)]] + [(None,)], "id long").withColumn("extra", F.lit("e"))
    clauses = ["kind = 1", "kind > 5", F.col("kind") % 2 == 0]
    sets = [{r.id for r in meta.filter(c).collect() if r.id is not None} for c in clauses]
    found = with_flags(rows, id_bitmaps(meta, clauses), together(measure(meta, clauses)), broadcast)
    assert found.columns == ["id", "extra", "f0", "f1", "f2"]
    want = [(r.id, "e", *[r.id in s for s in sets]) for r in rows.collect() if r.id is not None and any(r.id in s for s in sets)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_measure(spark):
    meta = spark.createDataFrame([(5, 1), (70_000, 1), (None, 1), (9, 2), (None, 3)], SCHEMA)
    one, two, none, unnamed = measure(meta, ["kind = 1", "kind = 2", "kind = 7", "kind = 3"])
    assert one == Matches(5, 3, 5, 70_000) and two == Matches(5, 1, 9, 9) and none == Matches(5, 0)
    assert one.most_buckets == 3 and two.most_buckets == 1 and none.most_buckets == 0
    assert unnamed == Matches(5, 1) and together([one, two, none]) == Matches(5, 4, 5, 70_000)
    assert fits_broadcast(one) and not fits_broadcast(Matches(1 << 50, 1 << 49, 0, 1 << 50))


@pytest.mark.parametrize("matching", [999, 1000, 1001])
@pytest.mark.parametrize("broadcast", [True, False])
def test_null_and_repeated_ids_at_every_size(spark, monkeypatch, matching, broadcast):
    """One path: around the size where ids are listed as a hint, the hits obey the same rule."""
    emb = spark.range(1500).select("id", F.array(F.lit(1.0).cast("float"), (F.col("id") % 50).cast("float")).alias("embedding"))
    emb = emb.unionAll(spark.createDataFrame([(None, [1.0, 3.0])], "id long, embedding array<float>"))
    meta = spark.range(matching - 3).select("id", F.lit(1).alias("kind"))
    meta = meta.unionAll(spark.createDataFrame([(None, 1), (0, 1), (0, 1), (1400, 2)], SCHEMA))
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 3.0])], "qid long, qvec array<double>")
    if not broadcast:
        monkeypatch.setattr(idsets, "MAX_BROADCAST_BITMAPS", 0)
    hits = hybrid.search_prefilter(emb, meta, queries, "kind = 1", 2000).collect()
    for qid in (1, 2):
        assert sorted(r.id for r in hits if r.qid == qid) == list(range(matching - 3))
    assert hybrid.search_prefilter(emb, meta.filter("id is null"), queries, "kind = 1").collect() == []
    post = hybrid.search_postfilter(emb, meta, queries, "kind = 1", 5, oversample=400).collect()
    assert [r.id for r in sorted(post) if r.qid == 2] == [3, 53, 103, 153, 203]


def test_a_range_of_ids_limits_the_scan(spark, tmp_path):
    path = str(tmp_path / "vectors")
    spark.range(5000).select("id", F.array(F.lit(1.0).cast("float")).alias("embedding")).write.parquet(path)
    meta = spark.range(2000, 4500).select("id", F.lit(1).alias("kind"))
    queries = spark.createDataFrame([(1, [1.0])], "qid long, qvec array<double>")
    hits = hybrid.search_prefilter(spark.read.parquet(path), meta, queries, "kind = 1", 3)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,2000), LessThanOrEqual(id,4499)" in plan and "BroadcastHashJoin" in plan
    assert [r.id for r in hits.orderBy("rank").collect()] == [2000, 2001, 2002]
