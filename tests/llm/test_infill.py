import hashlib
import random
import re

import pytest
from corpus_rows import EXTRA, SCHEMA
from pyspark.sql import functions as F

from sieveknn.llm import infill


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 50:
        return (doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


def lines_of(seed):
    rng = random.Random(seed)
    odd = ["", "\n", "\n\n\n", "$1 \\2 $", "a\r\nb", " x\u0085y", "😀 日本", "<P", "P>", "<", "\x00"]
    return "".join(rng.choice([*odd, "word " * rng.randrange(4)]) + rng.choice(["\n", "", "\n"]) for _ in range(rng.randrange(1, 60)))


def test_equals_brute_force_on_odd_texts(spark, messy):
    rows = [(i, lines_of(i)) for i in range(200)]
    rows += [(900, "a <S> b\nc"), (901, "<M>"), (None, "x\ny\nz"), (7, "one"), (7, "one"), (902, "no end"), (903, "end\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in EXTRA.items()})
    docs = docs.unionByName(messy.select(docs.columns))
    got = sorted(map(tuple, infill.fill_in_middle(docs).collect()), key=repr)
    assert got == sorted((brute(r.doc_id, r.text) for r in docs.collect()), key=repr)


def test_very_long_texts_need_no_deep_stack(spark):
    rows = [(i, ("line\n" * 400_000) + "x" * 1_000_000) for i in range(3)] + [(9, "\n" * 300_000)]
    got = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(*r) for r in rows)


def test_restored_texts_are_the_input(spark, messy):
    report = infill.fill_in_middle_report(messy).select("doc_id", "restored_sha256")
    wanted = [(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in messy.collect()]
    assert sorted(map(tuple, report.collect()), key=repr) == sorted(wanted, key=repr)


def test_no_rows(spark, nothing):
    assert infill.fill_in_middle_report(nothing).collect() == []
    assert SCHEMA  # the table has its columns


def test_shares_and_marks_are_parameters(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(300)], "doc_id long, text string")
    some = infill.fill_in_middle(docs, seed=1, fim_percent=40, spm_percent=0, marks=("[pre]", "[suf]", "[mid]"))
    forms = {r.form: r.n_rows for r in some.groupBy("form").agg(F.count("*").alias("n_rows")).collect()}
    assert set(forms) == {"plain", "psm"} and 80 < forms["psm"] < 160
    back = some.select(infill.restore(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]")).alias("text"))
    assert {r.text for r in back.collect()} == {"a\nb\nc\n"}
    assert some.where("form = 'psm' and not startswith(output, '[pre]')").isEmpty()


@pytest.mark.parametrize("marks", [("<P>", "<P>x", "<M>"), ("", "a", "b"), ("aa", "b", "c"), ("xy", "yz", "c")])
def test_marks_that_could_be_mistaken_are_refused(spark, marks):
    with pytest.raises(ValueError, match="marks"):
        infill.fill_in_middle(spark.createDataFrame([(1, "a")], "doc_id long, text string"), marks=marks)


def test_plan_is_a_projection_of_the_scan(spark, sf_dir):
    from sieveknn.llm.queries import op11_fill_in_middle

    plan = op11_fill_in_middle(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
