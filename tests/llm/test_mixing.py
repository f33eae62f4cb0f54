import math
from collections import Counter

import pytest
from corpus_rows import SCHEMA

from sieveknn.llm import mixing


@pytest.fixture(scope="module")
def uneven(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "big" if i % 10 < 7 else ("mid" if i % 10 < 9 else None), 1) for i in range(3000)]
    return spark.createDataFrame(rows, SCHEMA)


def test_plan_meets_target_and_keeps_all(uneven):
    plan = mixing.mix_plan(uneven, target_entropy=0.97, max_repetition=50.0).collect()
    assert len(plan) == 3000 and min(r.copies for r in plan) == 1
    tokens = Counter()
    for r in plan:
        tokens[r.source] += r.copies * r.n_tokens
    total = sum(tokens.values())
    shares = [v / total for v in tokens.values()]
    assert -sum(s * math.log(s) for s in shares) / math.log(3) == pytest.approx(0.97, abs=0.01)
    for source in tokens:
        weight = next(r.weight for r in plan if r.source == source)
        assert tokens[source] / total == pytest.approx(weight, abs=0.01)
        repetition = next(r.repetition for r in plan if r.source == source)
        own = sum(r.n_tokens for r in plan if r.source == source)
        # Within one document of the budget.
        assert 0 <= math.floor(repetition * own) - tokens[source] <= 7


def test_repetition_limit_wins(uneven):
    plan = mixing.mix_plan(uneven, target_entropy=1.0, max_repetition=1.5).collect()
    assert max(r.repetition for r in plan) == pytest.approx(1.5, abs=1e-4) and {r.copies for r in plan} == {1, 2}


def test_last_pass_takes_whole_blocks_in_order(uneven):
    plan = mixing.mix_plan(uneven, target_entropy=1.0, max_repetition=1.5, block_docs=20).collect()
    mid = [r for r in plan if r.source == "mid"]
    per_block = {}
    for r in mid:
        per_block.setdefault(r.block, set()).add(r.copies)
    assert sum(len(c) > 1 for c in per_block.values()) <= 1 and len(per_block) > 5


def test_natural_mixture(uneven):
    assert {r.copies for r in mixing.mix_plan(uneven, target_entropy=0.0).collect()} == {1}


def test_mix_repeats_whole_rows(messy):
    plan = Counter()
    for r in mixing.mix_plan(messy).collect():
        plan[r.doc_id] += r.copies
    rows = mixing.mix(messy)
    assert rows.columns == messy.columns
    assert Counter(r.doc_id for r in rows.collect()) == plan


def test_nothing_and_no_tokens(spark, nothing):
    assert mixing.mix_plan(nothing).count() == 0 and mixing.mix(nothing).count() == 0
    empty = spark.createDataFrame([(1, "", None, "a", 0), (2, None, None, None, 0)], SCHEMA)
    assert [(r.weight, r.copies) for r in mixing.mix_plan(empty).collect()] == [(0.0, 1), (0.0, 1)]
