import pytest
from pyspark.errors import AnalysisException

from sieveknn import fixtures as fx
from sieveknn.operators import filters
from sieveknn.plans.evaluate import compare_filters, same_selection
from sieveknn.sources import nan_to_null

ROWS = [
    (0, "NSFW", "CC-BY", 0.3, 1024, 512),
    (1, None, None, None, 2048, 2048),
    (2, "UNLIKELY", "CC-BY", 0.30005, 20000, 20000),
    (3, "UNSURE", None, float("nan"), 512, 1024),
    (4, "UNLIKELY", "PD", 2000.0, 100, 30000),
]
SCHEMA = "id long, NSFW string, LICENSE string, similarity double, original_width long, original_height long"


@pytest.fixture(scope="module")
def meta(spark):
    return nan_to_null(spark.createDataFrame(ROWS, SCHEMA)).cache()


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize(
    "where, expected",
    [
        ("nsfw = 'NSFW'", [0]),
        ("nsfw == 'UNLIKELY'", [2, 4]),
        ("nsfw != 'UNLIKELY'", [0, 3]),
        ('nsfw = "NSFW"', [0, 2, 3, 4]),  # a quoted identifier: compared with itself, so not null
        ("similarity > 0.3", [2, 4]),
        ("similarity >= 0.3", [0, 2, 4]),
        ("similarity < 0.30005", [0]),
        ("similarity is null", [1, 3]),
        ("similarity = similarity", [0, 2, 4]),
        ("similarity = 0.3", [0]),
        ("original_width = 100", [4]),
        ("original_width > 10800", [2]),
        ("original_width = original_height", [1, 2]),
        ("original_width >= original_height and license is not NULL", [0, 2]),
        ("license is NULL or nsfw = 'NSFW'", [0, 1, 3]),
        ("nsfw = 'NOPE'", []),
    ],
)
def test_where(meta, where, expected):
    assert ids(filters.filter_where(meta, where)) == expected


def test_bad_clause_raises(meta):
    with pytest.raises(AnalysisException):
        filters.filter_where(meta, "no_such_column = 1")
    with pytest.raises(Exception, match="PARSE|Syntax"):
        filters.filter_where(meta, "nsfw = = 1")


def test_keyword_filters(meta):
    assert ids(filters.filter_by(meta, nsfw="UNLIKELY", similarity_min=0.3)) == [2, 4]
    assert ids(filters.filter_by(meta, width_max=1024)) == [0, 3, 4]
    assert ids(filters.filter_by(meta, height_min=17944)) == [2, 4]  # open above
    assert ids(filters.filter_by(meta, similarity_max=0.0, null_as_zero=True)) == [1, 3]
    assert ids(filters.filter_by(meta)) == []
    with pytest.raises(ValueError, match="unknown condition"):
        filters.filter_by(meta, colour="red")


def test_filters_agree(meta):
    assert same_selection(meta, "nsfw = 'UNLIKELY' and similarity >= 0.3", filters.filter_by(meta, nsfw="UNLIKELY", similarity_min=0.3))
    row = compare_filters(filters.filter_where(meta, "id < 3"), filters.filter_where(meta, "id > 1")).first()
    assert (row.n_a, row.n_b, row.only_a, row.only_b) == (3, 3, 2, 2)


def test_profile_and_values(meta):
    got = [tuple(r) for r in filters.conjunct_profile(meta, ["original_width > 0", "nsfw = 'NSFW'", "similarity > 0.3"]).collect()]
    assert got == [("nsfw = 'NSFW'", 1), ("similarity > 0.3", 2), ("original_width > 0", 5)]
    assert sorted(r.LICENSE for r in filters.distinct_values(meta).collect()) == ["CC-BY", "PD"]
    assert ids(filters.rows_with_license(meta, "CC-BY")) == [0, 2]
    with pytest.raises(ValueError):
        filters.conjunct_profile(meta, [])


def test_selectivity(meta):
    row = filters.selectivity(meta, "license is null").first()
    assert (row.n_filtered, row.n_total, row.selectivity) == (2, 5, 0.4)
    assert filters.selectivity(meta.limit(0), "license is null").first().selectivity == 0.0


@pytest.mark.parametrize("max_rows", [None, 10])
def test_fetch_keeps_result_order(spark, meta, max_rows):
    hits = spark.createDataFrame([(1, 2, 0, 0.2), (1, 1, 4, 0.1), (0, 1, 2, 0.5)], "qid long, rank int, id long, dist double")
    rows = filters.fetch_rows(meta, hits, max_rows).collect()
    assert [(r.qid, r.rank, r.id, r.NSFW) for r in rows] == [(0, 1, 2, "UNLIKELY"), (1, 1, 4, "UNLIKELY"), (1, 2, 0, "NSFW")]
    empty = filters.fetch_rows(meta, hits.limit(0), max_rows)
    assert empty.collect() == [] and "LICENSE" in empty.columns


def test_filter_reaches_the_scan(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    plan = filters.filter_where(orders, "o_totalprice > 1000")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
