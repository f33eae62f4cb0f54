import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveknn.llm import passages
from sieveknn.llm.automata import SuffixAutomaton, covered


def brute(rows, length, known=None):
    """One row per document; ``known`` counts windows elsewhere in place of those of the rows."""
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    windows = [[tuple(w[k : k + length]) for k in range(len(w) - length + 1)] for _, w in texts]
    places = Counter(x for own in windows for x in own)
    out = []
    for (doc_id, words), own in zip(texts, windows, strict=True):
        gone = {p for k, x in enumerate(own) if (places[x] > 1 if known is None else x in known) for p in range(k, k + length)}
        kept = b" ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(docs, *args):
    return sorted(map(tuple, passages.remove_passages(docs, *args).collect()), key=repr)


def copied_rows(seed, n=60, size=40):
    """Texts that copy spans of each other and of themselves, many through a shared line."""
    rng = random.Random(seed)
    rows, line = [], [f"line{i}" for i in range(14)]
    for i in range(n):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(size))]
        for _ in range(rng.randrange(4)):
            source = rng.choice(rows)[1].split() if rows else line
            a = rng.randrange(len(source) + 1)
            words += source[a : a + rng.randrange(60)] + line * rng.randrange(2)
        rows.append((i, rng.choice([" ", "  ", "\n", "\t"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = copied_rows(seed)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 12) == brute(rows, 12)


def test_frequent_strings_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(passages, "HEAVY_SHARE", 50)
    rows = copied_rows(3)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len(passages._heavy_keys(passages._rows(frame), 12).value) > 0
    assert got(frame, 12) == brute(rows, 12)


def test_messy_rows_and_repeats_inside_one_text(spark, messy):
    loop = " ".join(f"a{i % 7}" for i in range(60))
    more = spark.createDataFrame([(70, "x " * 36), (71, "x " * 0 + "y " * 35), (72, loop), (73, loop[:-3] + "\x85 z"), (None, loop)], "doc_id long, text string")
    docs = messy.unionByName(more, allowMissingColumns=True).withColumns({c: F.lit(1) for c in ("data", "ta", "did", "spans", "first")})
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()], 35)


def test_no_rows(spark, nothing):
    assert got(nothing) == []


def test_a_passage_in_many_texts(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"own{i} b{i} c{i} {passage} d{i} e{i}" if i % 3 == 0 else " ".join(f"{i}v{k}" for k in range(60))) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows, 35)


def test_known_passages(spark, messy):
    rng = random.Random(5)
    known = [" ".join(f"k{rng.randrange(9)}" for _ in range(30)) for _ in range(20)]
    rows = [(i, " ".join([f"w{i}", *rng.choice(known).split()[rng.randrange(20) :], "k1 k2", rng.choice(known)])) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(messy.select("doc_id", "text"))
    reference = spark.createDataFrame([(x,) for x in [*known, known[0], None, ""]], "text string")
    windows = {tuple(x.encode().split()[k : k + 9]) for x in known for k in range(22)}
    found = sorted(map(tuple, passages.remove_known(docs, reference, 9).collect()), key=repr)
    assert found == brute([tuple(r) for r in docs.collect()], 9, windows)


def test_a_reference_without_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(passages, "REFERENCE_BYTES", 10)
    docs = spark.createDataFrame([(1, "more than ten bytes")], "doc_id long, text string")
    with pytest.raises(ValueError, match="broadcast"):
        passages.remove_known(docs, docs)


@pytest.mark.parametrize("seed", range(20))
def test_automaton_counts_places_and_matches(seed):
    rng = random.Random(seed)
    sequences = [([rng.randrange(3) for _ in range(rng.randrange(1, 30))], rng.randrange(1, 3)) for _ in range(rng.randrange(1, 6))]
    automaton = SuffixAutomaton()
    for sequence, weight in sequences:
        automaton.add(sequence, weight)
    automaton.count_places()
    places = Counter()
    for s, weight in sequences:
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                places[tuple(s[a:b])] += weight
    asked = [rng.randrange(4) for _ in range(60)]
    for least in (1, 2, 3):
        wanted = [max((k for k in range(e + 2) if k == 0 or places[tuple(asked[e + 1 - k : e + 1])] >= least)) for e in range(len(asked))]
        assert automaton.matching(asked, least) == wanted


def test_covered_spans_are_maximal():
    assert covered([0, 1, 2, 3, 1, 2, 0, 3, 4, 0, 0, 0, 3], 3) == [(1, 4), (5, 9), (10, 13)]
    assert covered([0, 1, 2, 3, 1, 3, 3], 3) == [(1, 7)]
    assert covered(np.array([0, 1, 2]), 3) == [] and covered([], 3) == []
