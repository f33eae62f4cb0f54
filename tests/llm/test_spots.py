import hashlib
import re
from itertools import combinations

import pytest
from corpus_rows import SCHEMA, invented, messy_rows
from pyspark.sql import functions as F

from sieveknn.llm import spots

COMMON = set(spots.COMMON_WORDS)


def signature_words(text):
    """(antecedent, chain) pairs, read off word by word."""
    words = [w for w in re.split(r"[^\w]+|_+", text.lower()) if w]
    found = set()
    content = [w for w in words if w not in COMMON]
    if content:
        found.add(("^", " ".join(content[:2])))
    places = [i for i, w in enumerate(words) if w not in COMMON]
    for j in range(spots.GAP - 1, len(places) - 1):
        if places[j + 1] - places[j + 1 - spots.GAP] == spots.GAP:
            found.add((content[j], " ".join(content[j + 1 : j + 3])))
    for i, w in enumerate(words):
        if w in COMMON:
            chain = [x for x in words[i + 1 :] if x not in COMMON][:2]
            if chain:
                found.add((w, " ".join(chain)))
    return found


def test_signatures_against_brute_force(spark):
    texts = ["", "the", "the cat", "a cat and a dog", "The of cat, THE dog; the the bird", "no common words here? none", "one two three four the five six seven eight nine ten of", "der Ölbaum und die Straße"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    hashed = lambda pairs: spark.createDataFrame(list(pairs) or [("", "")], "a string, c string").select(F.xxhash64("a", "c").alias("h"))
    for row in docs.select("text", spots.signatures(F.col("text")).alias("s")).collect():
        want = signature_words(row.text)
        assert set(row.s) == ({r.h for r in hashed(want).collect()} if want else set())


def brute(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = {}
    for k, (doc_id, text, *_) in enumerate(ordered):
        text, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        jaccard = lambda a, b: 1.0 if a == b else (len(x & y) / len(x | y) if (x := signature_words(a)) and (y := signature_words(b)) else 0.0)
        out[(doc_id, text)] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(text, edited), jaccard(text, following))
    return out


@pytest.mark.parametrize("rows", [[r for r in messy_rows() if r[0] != 5], [(7, "the one only", None, None, None)]], ids=["messy", "single"])
def test_report(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows)
    found = spots.fingerprint_report(docs).collect()
    assert len(found) == len(rows)
    keyed = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in found}
    for (doc_id, _), (n, sha, near_edited, near_next) in want.items():
        r = keyed[(doc_id, n, sha)]
        assert r.near_edited == pytest.approx(near_edited, abs=1e-6) and r.near_next == pytest.approx(near_next, abs=1e-6)


def test_repeated_rows_and_nothing(messy, nothing):
    found = [r for r in spots.fingerprint_report(messy).collect() if r.doc_id == 5]
    assert len(found) == 2 and found[0].fingerprint == found[1].fingerprint
    assert spots.fingerprint_report(nothing).count() == 0 and spots.near_pairs(nothing).count() == 0


def test_near_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(12)
    base = [invented(rng, 80) for _ in range(6)]
    rows = []
    for i in range(60):
        words = base[i % 6].split()
        for _ in range(i % 5):
            words[rng.randrange(80)] = f"new{rng.randrange(99)}"
        rows.append((i, " ".join(words), None, None, None))
    sets = {i: signature_words(t) for i, t, *_ in rows}
    first = {}
    for i, s in sets.items():
        first.setdefault(frozenset(s), i)
    kept = sorted(first.values())
    want = {(a, b) for a, b in combinations(kept, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    found = {(r.doc_id, r.other_id) for r in spots.near_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == want and want


def test_texts_without_common_words_are_not_known_by_their_start(spark):
    one, two = (["same start", *(f"{kind}{k}" for k in range(200))] for kind in ("left", "right"))
    rows = [(i, " ".join(words), None, None, None) for i, words in enumerate((one, two, one[:-1] + ["end"]))]
    found = {r.doc_id: r for r in spots.fingerprint_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[1].near_next < 0.02 and found[2].near_next < 0.02 and found[0].near_edited > 0.3
    assert len(found[0].fingerprint) == 16 * found[0].n_signatures and found[0].n_signatures > 150
    pairs = spots.near_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.doc_id, r.other_id) for r in pairs] == [(0, 2)]
