import corpus_pipeline
import pytest
from sieveknn.llm.queries import CORPUS_ORACLE, CORPUS_QUERIES

from checks.compare import comparable, connect, type_differences


def test_stages(spark, messy, labels, tmp_path):
    sf = str(tmp_path)
    messy.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/{name}")
        after = spark.read.parquet(f"{sf}/{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        if name in ("mixing", "encoding"):
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in docs.collect()}
        else:
            assert 0 < after.count() <= docs.count()
        docs = after
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, docs.collect()))


def test_no_rows(spark, nothing, labels, tmp_path):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", list(CORPUS_ORACLE))
def test_sql(spark, sf_dir, name):
    result = CORPUS_QUERIES[name](spark, sf_dir)
    cursor = connect(sf_dir).execute(CORPUS_ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(result.columns) and not type_differences(result.schema, cursor.description)
    assert comparable(result.collect(), result.columns) == comparable(cursor.fetchall(), columns)
