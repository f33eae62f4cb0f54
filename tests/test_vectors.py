import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveknn.functions import (
    approx_eq,
    byte_histogram_encoder,
    cosine_distance,
    encode_images,
    encode_text,
    l2_normalize,
    l2_sq_distance,
    letter_count_encoder,
    pool_query,
    query_by_id,
)


def test_normalize_leaves_zero_vector(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id long, v array<float>")
    got = {r.id: r.n for r in df.select("id", l2_normalize("v").alias("n")).collect()}
    assert got[1] == pytest.approx([0.6, 0.8])
    assert got[2] == [0.0, 0.0]
    assert got[3] is None


def test_distances(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    row = df.select(
        cosine_distance("a", "b").alias("c"),
        l2_sq_distance(l2_normalize("a"), l2_normalize("b")).alias("l"),
        cosine_distance("a", [0.0, 0.0]).alias("z"),
    ).first()
    assert row.c == pytest.approx(1 - 24 / 25)
    assert row.l == pytest.approx(2 * row.c)
    assert row.z == 1.0


def test_pool_normalizes_each_member_first(spark):
    df = spark.createDataFrame([(1, [10.0, 0.0]), (1, [0.0, 0.1]), (2, [0.0, 5.0]), (2, None)], "qid long, vec array<double>")
    got = {r.qid: r.qvec for r in pool_query(df).collect()}
    assert got[1] == pytest.approx([2**-0.5, 2**-0.5])
    assert got[2] == pytest.approx([0.0, 1.0])


def test_pool_without_vectors_fails(spark):
    df = spark.createDataFrame([(1, None)], "qid long, vec array<double>")
    with pytest.raises(Exception, match="no vectors"):
        pool_query(df).collect()


def test_query_by_id(spark):
    emb = spark.createDataFrame([(5, [0.0, 2.0]), (6, [1.0, 0.0])], "id long, embedding array<float>")
    assert [tuple(r) for r in query_by_id(emb, 5).collect()] == [(5, [0.0, 1.0])]


def test_float_equality_is_close_and_asymmetric(spark):
    rows = [
        (1, 1.0, 1.0 + 5e-10), (2, 1.0, 1.0 + 5e-9), (3, None, 1.0), (4, float("nan"), float("nan")),
        (5, float("inf"), float("inf")), (6, float("inf"), float("-inf")), (7, 1.0, float("inf")), (8, 0.0, 1e-9),
    ]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    assert [r.id for r in df.filter(approx_eq(df, "a", "b")).orderBy("id").collect()] == [1, 5, 8]
    flags = df.select("id", approx_eq(df, "a", "b").alias("e"), (~approx_eq(df, "a", "b")).alias("n")).collect()
    assert all(r.e is not None for r in flags)
    ints = spark.createDataFrame([(10**12, 10**12 + 1), (7, 7)], "a long, b long")
    assert ints.filter(approx_eq(ints, "A", "b")).count() == 1


def test_encoders(spark, tmp_path):
    df = spark.createDataFrame([(1, "abba c"), (2, None), (3, "")], "id int, caption string")
    got = {r.id: r.embedding for r in encode_text(df, "caption", letter_count_encoder()).collect()}
    assert got[1][:4] == [2.0, 2.0, 1.0, 0.0] and len(got[1]) == 26
    assert got[2] is None and sum(got[3]) == 0
    for name, content in (("a.img", b"\x00\x00\x05"), ("b.img", b"\xff"), ("c.txt", b"no")):
        (tmp_path / name).write_bytes(content)
    images = encode_images(spark, str(tmp_path), byte_histogram_encoder(), glob="*.img")
    rows = {r.path.rsplit("/", 1)[1]: r.embedding for r in images.collect()}
    assert set(rows) == {"a.img", "b.img"}
    assert rows["a.img"][0] == 2 and rows["a.img"][5] == 1 and rows["b.img"][255] == 1


def test_encoder_is_made_once_per_task(spark):
    def factory():
        made = np.random.default_rng().integers(1 << 40)
        return lambda texts: np.full((len(texts), 1), made % 1000003, dtype=np.float32)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        df = spark.range(0, 100, 1, 1).select(F.col("id").cast("string").alias("t"))
        assert encode_text(df, "t", factory).select(F.col("embedding")[0].alias("x")).distinct().count() == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
