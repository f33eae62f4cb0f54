import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sieveknn.sources import (
    check_alignment,
    describe,
    read_embeddings,
    read_metadata,
    read_npy,
    require_alignment,
    row_count,
    with_global_id,
    write_bucketed,
    write_metadata,
    write_npy,
    write_report,
)


@pytest.fixture(scope="module")
def shards(spark, tmp_path_factory):
    """Three shards whose names sort as _1, _10, _2."""
    import pandas as pd

    folder = tmp_path_factory.mktemp("meta")
    for number, rows in ((1, [0, 1, 2]), (2, [30, 31]), (10, [10, 11, 12, 13])):
        frame = pd.DataFrame({"n": rows, "similarity": [float("nan") if r % 2 else r / 10 for r in rows]})
        frame.to_parquet(folder / f"metadata_{number}.parquet", index=False)
    (folder / "other.txt").write_text("not a shard")
    return str(folder)


def test_read_all_shards(spark, shards):
    df = read_metadata(spark, f"{shards}/metadata_*.parquet")
    assert row_count(df).first().n_rows == 9
    assert df.filter("similarity is null").count() == 4  # NaN became NULL
    assert df.filter("similarity > 1e9").count() == 0
    assert [tuple(r) for r in describe(df).collect()] == [("n", "bigint"), ("similarity", "double")]
    with pytest.raises(AnalysisException):
        read_metadata(spark, f"{shards}/nothing_*.parquet")


def test_global_ids_follow_sorted_names(spark, shards):
    got = with_global_id(read_metadata(spark, f"{shards}/metadata_*.parquet"))
    rows = [(r.id, r.n) for r in got.orderBy("id").collect()]
    assert rows == list(enumerate([0, 1, 2, 10, 11, 12, 13, 30, 31]))
    assert got.columns == ["id", "n", "similarity"]


def test_global_ids_survive_a_filter(spark, shards):
    got = with_global_id(read_metadata(spark, f"{shards}/metadata_*.parquet")).filter("n >= 12")
    assert sorted((r.id, r.n) for r in got.collect()) == [(5, 12), (6, 13), (7, 30), (8, 31)]


def test_global_ids_over_split_files(spark, tmp_path):
    spark.range(0, 50_000, 1, 2).select("id", F.rand(1).alias("x")).write.parquet(str(tmp_path / "big"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = with_global_id(spark.read.parquet(str(tmp_path / "big")), "gid")
        row = got.agg(F.count("*"), F.countDistinct("gid"), F.min("gid"), F.max("gid"), F.count_if(F.col("id") == F.col("gid"))).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tuple(row) == (50_000, 50_000, 0, 49_999, 50_000)


def test_write_metadata_round_trip(spark, shards, tmp_path):
    df = read_metadata(spark, f"{shards}/metadata_*.parquet", nan_as_null=False)
    write_metadata(df, str(tmp_path / "clean"), sort_by=["similarity"])
    again = read_metadata(spark, str(tmp_path / "clean"), nan_as_null=False)
    assert again.filter("isnan(similarity)").count() == 0 and again.count() == 9
    with pytest.raises(AnalysisException):
        write_metadata(df, str(tmp_path / "clean"))


@pytest.fixture
def npy_shards(tmp_path):
    rng = np.random.default_rng(3)
    parts = {1: rng.standard_normal((5, 4)), 2: rng.standard_normal((3, 4)), 10: rng.standard_normal((7, 4))}
    np.save(tmp_path / "text_emb_1.npy", parts[1].astype(np.float16))
    np.save(tmp_path / "text_emb_2.npy", parts[2].astype(np.float64))
    np.save(tmp_path / "text_emb_10.npy", np.asfortranarray(parts[10].astype(np.float32)))
    np.save(tmp_path / "img_emb_1.npy", parts[1])
    order = np.concatenate([parts[1].astype(np.float16), parts[10].astype(np.float32), parts[2]])
    return tmp_path, order.astype(np.float32)


@pytest.mark.parametrize("partition_bytes", [16, 1 << 20])
def test_read_npy(spark, npy_shards, partition_bytes):
    folder, want = npy_shards
    df = read_npy(spark, f"{folder}/text_emb_*.npy", partition_bytes)
    assert df.schema.simpleString() == "struct<id:bigint,embedding:array<float>>"
    rows = df.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(15))
    assert np.array_equal(np.array([r.embedding for r in rows], dtype=np.float32), want)


def test_read_npy_errors(spark, npy_shards):
    folder, _ = npy_shards
    with pytest.raises(Exception, match="no .npy file"):
        read_npy(spark, f"{folder}/none_*.npy").count()
    np.save(folder / "text_emb_3.npy", np.zeros((2, 5)))
    with pytest.raises(Exception, match="widths differ"):
        read_npy(spark, f"{folder}/text_emb_*.npy").count()


def test_npy_round_trip(spark, tmp_path):
    emb = spark.range(40).select("id", F.array(F.col("id").cast("float"), F.lit(1.5).cast("float")).alias("embedding"))
    write_npy(emb, str(tmp_path / "out"), 3)
    rows = read_npy(spark, f"{tmp_path}/out/part_*.npy").collect()
    assert sorted((r.id, r.embedding[0]) for r in rows) == [(i, float(i)) for i in range(40)]


def test_npy_writer_streams_many_batches_and_refuses_to_mix(spark, tmp_path):
    emb = spark.range(5000).select("id", F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("embedding"))
    out = tmp_path / "out"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        write_npy(emb.orderBy(F.desc("id")), str(out), 2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    parts = [np.load(f) for f in sorted(out.iterdir())]
    assert [f.name for f in sorted(out.iterdir())] == ["part_000000.npy", "part_000001.npy"]
    assert all(p.dtype == np.float32 for p in parts) and np.array_equal(np.concatenate(parts)[:, 0], np.arange(5000))
    with pytest.raises(Exception, match="holds .npy files already"):
        write_npy(emb, str(out), 1)
    write_npy(emb.filter("id < 10"), str(out), 1, overwrite=True)
    assert [f.name for f in out.iterdir()] == ["part_000000.npy"] and read_npy(spark, f"{out}/*.npy").count() == 10


def test_a_failed_npy_write_leaves_nothing(spark, tmp_path):
    emb = spark.createDataFrame([(i, [1.0] * (2 if i < 50 else 3)) for i in range(100)], "id long, embedding array<float>")
    for bad in (emb, emb.filter("id in (0, 99)"), spark.createDataFrame([(1, None)], emb.schema), spark.createDataFrame([(1, [None])], emb.schema)):
        with pytest.raises(Exception, match="widths differ|is null"):
            write_npy(bad, str(tmp_path / "bad"), 2)
        assert not list((tmp_path / "bad").iterdir())
    write_npy(emb.limit(0), str(tmp_path / "none"), 2)
    assert not list((tmp_path / "none").iterdir())


def test_alignment(spark):
    meta = spark.createDataFrame([(0,), (1,), (2,)], "id long")
    emb = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (5, [0.0, 0.0])], "id long, embedding array<float>")
    assert tuple(check_alignment(meta, emb, dim=2).first()) == (3, 3, 1, 1, 1)
    with pytest.raises(ValueError, match="do not align"):
        require_alignment(meta, emb)
    good = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "id long, embedding array<float>")
    require_alignment(meta, good)
    assert tuple(check_alignment(meta.limit(0), good.limit(0)).first()) == (0, 0, 0, 0, 0)


def test_alignment_of_a_repeated_id(spark):
    meta = spark.range(3000).select(F.lit(7).cast("long").alias("id"))
    emb = meta.withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    assert tuple(check_alignment(meta, emb).first()) == (3000, 3000, 0, 0, 0)


def test_read_embeddings_reads_two_columns(spark, sf_dir):
    df = read_embeddings(spark, f"{sf_dir}/embeddings.parquet", "vec_id")
    assert df.columns == ["id", "embedding"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "label" not in plan.split("ReadSchema:")[1]


def test_report(spark, tmp_path):
    df = spark.createDataFrame([(0, "Hybrid", 0.5)], "workload int, strategy string, recall double")
    write_report(df, str(tmp_path / "r"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "r")).collect()] == [("0", "Hybrid", "0.5")]


def test_bucketed_tables_join_without_shuffle(spark):
    emb = spark.range(200).select("id", F.array(F.lit(1.0).cast("float")).alias("embedding"))
    write_bucketed(emb, "emb_bucketed", 4)
    write_bucketed(spark.range(200).withColumn("w", F.col("id") % 3), "meta_bucketed", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("emb_bucketed").join(spark.table("meta_bucketed").filter("w = 1").select("id"), "id", "left_semi")
        assert joined.count() == 67
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE emb_bucketed")
        spark.sql("DROP TABLE meta_bucketed")
