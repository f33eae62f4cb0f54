import hashlib
import random

import numpy as np
import pytest

from sieveknn.llm import repeats
from sieveknn.llm.suffixes import LENGTH, SuffixArray, pack, unpack, window_runs

from corpus_rows import SCHEMA, messy_rows


def removed(rows):
    """Brute force: a set of all windows of smaller ids."""
    out, seen = {}, set()
    last = float("inf")
    for key in sorted({last if i is None else i for i, *_ in rows}):
        mine = set()
        for doc_id, text, *_ in rows:
            if (last if doc_id is None else doc_id) != key:
                continue
            data = (text or "").encode()
            cut = bytearray(len(data))
            for s in range(len(data) - LENGTH + 1):
                w = data[s : s + LENGTH]
                mine.add(w)
                if w in seen:
                    cut[s : s + LENGTH] = b"\1" * LENGTH
            spans = sum(1 for k in range(len(cut)) if cut[k] and not (k and cut[k - 1]))
            kept = bytes(c for c, r in zip(data, cut, strict=True) if not r)
            out[(doc_id, text)] = (len(data), sum(cut), spans, hashlib.sha256(kept).hexdigest())
        seen |= mine
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = repeats.remove_repeats(docs).collect()
    want = removed(rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == sorted((str(i), *want[(i, t)]) for i, t, *_ in rows)


def test_messy(spark):
    check(spark, messy_rows())


def test_nested_and_overlapping_repeats(spark):
    rng = random.Random(5)
    alphabet = "abc"
    parts = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (49, 50, 51, 80, 130, 400)]
    rows = [(i, "".join(rng.choice(parts + ["é", "-", "zz"]) for _ in range(rng.randrange(1, 9))), None, None, None) for i in range(60)]
    rows += [(200 + i, "z" * n, None, None, None) for i, n in enumerate((49, 50, 51, 500, 500))]
    check(spark, rows)


def test_maximal_repeats(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(60))
    rows = [(i, f"{'xyzuv'[i] * (3 + i)}{passage}{'12345'[i] * 40}", None, None, None) for i in range(5)]
    groups = repeats.maximal_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    name = hashlib.sha256(passage.encode()).hexdigest()
    assert {(r.doc_id, r.start, r.length) for r in groups if r.repeat_sha256 == name} == {(i, 3 + i, 60) for i in range(5)}


def test_suffix_array_against_brute_force():
    rng = np.random.default_rng(2)
    records = [bytes(rng.integers(97, 99, int(n), dtype=np.uint8)) for n in rng.integers(5, 40, 12)] + [b"\0\0\0\0a\0\0\0\0", b"\0\0\0\0"]
    windows = np.array([max(1, len(r) - 3) for r in records])
    size = np.array([len(r) for r in records])
    array = SuffixArray(np.frombuffer(b"".join(records), np.uint8), np.cumsum(size) - size, size, windows)
    tails = [records[k][o:] for k, o in zip(array.record, array.offset, strict=True)]
    ordered = [tails[i] for i in array.order]
    common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    assert [t.ljust(64, b"\0") for t in ordered] == sorted(t.ljust(64, b"\0") for t in tails)
    assert array.lcp[1:].tolist() == [common(a, b) for a, b in zip(ordered, ordered[1:], strict=False)]
    for length, low, high in array.intervals(4):
        inner = array.lcp[low + 1 : high]
        assert inner.min() == length
        assert (low == 0 or array.lcp[low] < length) and (high == len(ordered) or array.lcp[high] < length)


def test_equal_windows_have_equal_keys():
    rng = random.Random(8)
    passage = bytes(rng.randrange(256) for _ in range(200))
    keys = []
    for front in (b"", b"abc", bytes(77)):
        text = front + passage + b"end"
        found = {}
        for key, a, b in zip(*window_runs(text), strict=True):
            found.update(dict.fromkeys(range(int(a), int(b)), int(key)))
        assert sorted(found) == list(range(len(text) - LENGTH + 1))
        keys.append([found[len(front) + s] for s in range(151)])
    assert keys[0] == keys[1] == keys[2]


@pytest.mark.parametrize("n", [0, 1, 300])
def test_pack(n):
    a, b = np.arange(n, dtype=np.int64) - 5, np.arange(n).astype(np.uint32)
    x, y = unpack(pack(a, b), np.int64, np.uint32)
    assert x.tolist() == a.tolist() and y.tolist() == b.tolist()


def test_nothing(nothing):
    assert repeats.remove_repeats(nothing).count() == 0 and repeats.maximal_repeats(nothing).count() == 0


def test_extra_columns(messy):
    assert repeats.remove_repeats(messy).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
