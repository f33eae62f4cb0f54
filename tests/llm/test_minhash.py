import random
import re
from itertools import combinations

import numpy as np
import pytest

from sieveknn.llm import minhash
from sieveknn.llm.common import LOWER, UPPER
from sieveknn.llm.components import connected

from corpus_rows import SCHEMA, messy_rows

TABLE = str.maketrans(UPPER, LOWER)


def shingles(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(TABLE))
    return frozenset(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components(rows, percent=85, size=3):
    sets = {(i, t): shingles(t, size) for i, t, *_ in rows}
    ids = sorted({i for i, _ in sets if i is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in combinations([(i, s) for (i, _), s in sets.items() if i is not None and s], 2):
        if 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    by_set = {s: find(i) for (i, _), s in sets.items() if i is not None and s}
    return {k: (len(s), (find(k[0]) if k[0] is not None else by_set.get(s))) for k, s in sets.items()}


def family(rng, n, length=110):
    """Copies of one text with more and fewer changed words: some link with the first only through others."""
    base = [f"v{rng.randrange(500)}" for _ in range(length)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(length)] = f"c{rng.randrange(500)}"
        rows.append((1000 + i, " ".join(words), None, None, None))
    return rows


@pytest.mark.parametrize("rows", [messy_rows(), family(random.Random(4), 120)], ids=["messy", "family"])
def test_against_brute_force(spark, rows, monkeypatch):
    found = minhash.near_groups(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = components(rows)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == sorted((str(i), want[(i, t)][0], str(want[(i, t)][1])) for i, t, *_ in rows)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in found)


def test_long_lists_in_blocks(spark, monkeypatch):
    rows = family(random.Random(9), 100)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    found = minhash.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    want = components(rows)
    assert {r.doc_id: r.component_id for r in found} == {i: c for (i, _), (_, c) in want.items()}


def test_keep_one(messy):
    rows = messy_rows()
    want = components(rows, 80, 5)
    kept = minhash.keep_one(messy, percent=80, size=5).collect()
    assert kept[0].asDict().keys() == set(messy.columns)
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert sorted(ids) == sorted({i for (i, _), (_, c) in want.items() if i is not None and i == c})


def test_one_id_on_several_texts_and_rows_without_id(spark):
    rng = random.Random(4)
    base, clean, lone = (" ".join(f"{x}{rng.randrange(5000)}" for _ in range(80)) for x in "abc")
    rows = [(1, base, "x"), (2, base + " tail", "y"), (2, clean, "y"), (None, lone, "z"), (None, lone, "z"), (None, base + " other", "z"), (None, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number string")
    kept = sorted((tuple(r) for r in minhash.keep_one(docs, percent=80, size=5).collect()), key=repr)
    assert kept == sorted([(1, base, "x"), (2, clean, "y"), (None, lone, "z"), (None, None, "n")], key=repr)


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, n)) for n in (0, 1, 50, 400, 5000, 5000)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    assert (minhash.intersections(sets) - np.diag(np.diag(minhash.intersections(sets))) == np.array(want) - np.diag([len(s) for s in sets])).all()


def test_threshold_rarely_misses():
    rng = np.random.default_rng(3)
    for percent in (80, 85):
        low = minhash.matches_for(percent)
        for _ in range(60):
            union = rng.integers(0, 2**63, 200, dtype=np.uint64)
            shared = 2 * percent  # of 200
            a, b = union[: shared + (200 - shared) // 2], np.concatenate([union[:shared], union[shared + (200 - shared) // 2 :]])
            assert (minhash.signature(a) == minhash.signature(b)).sum() >= low


def test_connected(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    found = connected(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.label for r in found.collect()} == {x: find(x) for x in root}


def test_nothing(nothing):
    assert minhash.near_groups(nothing).count() == 0 and minhash.keep_one(nothing).count() == 0
