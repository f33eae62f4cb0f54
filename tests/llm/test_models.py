"""Toxicity, language and language-model scores."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus_rows import SCHEMA, messy_rows

from pyspark.sql import functions as F
from sieveknn.llm import attention, language, lm_scoring, recurrent, toxicity
from sieveknn.llm.boosting import boost, isotonic, sigmoid
from sieveknn.llm.common import LOWER, UPPER, documents


def numeric(value, loss, at, step=1e-5):
    old = value[at]
    value[at] = old + step
    up = loss()
    value[at] = old - step
    down = loss()
    value[at] = old
    return (up - down) / (2 * step)


def largest(gradient):
    return np.unravel_index(np.argmax(np.abs(gradient)), gradient.shape)


def test_recurrent_gradients(monkeypatch):
    monkeypatch.setattr(recurrent, "_f", np.float64)
    net = recurrent.Network.fresh(["a", "b", "c"], 3)
    rng = np.random.default_rng(0)
    rows, lengths, target = rng.integers(0, 256, (5, 8)).astype(np.uint8), np.array([8, 8, 3, 1, 8]), np.array([0, 1, 2, 1, 0])
    _, gradients = net.gradients(rows, lengths, target)
    for value, gradient in zip(net.parameters(), gradients, strict=True):
        at = largest(gradient)
        assert gradient[at] == pytest.approx(numeric(value, lambda: net.gradients(rows, lengths, target)[0], at), rel=1e-4)


def test_windows_hold_every_byte():
    for n in (0, 1, 63, 64, 65, 1000):
        rows, lengths = recurrent.windows(bytes(range(256)) * 4 if n == 1000 else b"x" * n)
        assert lengths.sum() == (1024 if n == 1000 else n) and len(rows) == -(-int(lengths.sum()) // 64)


def test_attention_gradients():
    rng = np.random.default_rng(1)
    rows = [rng.integers(3, 40, n) for n in (0, 5, 50, 90)]
    model = attention.train(rows, np.bincount(np.concatenate(rows), minlength=40).astype(float), 1, 2, slots=20, classes=5, width=4, steps=0)
    for name in model.p:
        model.p[name] = model.p[name].astype(np.float64) + (0.1 * rng.normal(size=model.p[name].shape) if name != "embed" else 0)
    x, y, _ = model.blocks(rows)
    _, gradients = model.gradients(x, y)
    for name, gradient in gradients.items():
        at = largest(gradient)
        assert gradient[at] == pytest.approx(numeric(model.p[name], lambda: model.gradients(x, y)[0], at), rel=1e-3)


def test_attention_is_a_distribution_and_causal():
    rng = np.random.default_rng(2)
    rows = [rng.integers(3, 30, n) for n in (40, 60)]
    model = attention.train(rows, np.bincount(np.concatenate(rows), minlength=30).astype(float), 1, 2, slots=16, classes=4, width=4, steps=5)
    total = np.exp(model.log_probabilities([np.array([i]) for i in range(30)]) - 0.0)
    alone = [float(np.exp(model.log_probabilities([np.array([], np.int64)])[0]))]
    # P(first id) summed over ids, by taking off the end's probability: at most one, and with the end exactly one.
    x, y, _ = model.blocks([np.array([i]) for i in range(30)])
    first = []
    for i in range(30):
        xi, yi, _ = model.blocks([np.array([i])])
        f = model.forward(xi)
        p = f["c"][0, 0, model.kind[i]] * math.exp(model.share[i])
        for at, inside, member in model._members(f["g"], yi):
            if 0 in at:
                p *= inside[list(at).index(0), member[list(at).index(0)]]
        first.append(p)
    assert sum(first) == pytest.approx(1.0, abs=1e-4) and total.sum() <= 1 + 1e-6 and 0 < alone[0] < 1
    # A later id does not change what is said about earlier ones.
    a, b = rng.integers(3, 30, 50), None
    b = a.copy()
    b[-1] = 5
    fa, fb = model.forward(model.blocks([a])[0]), model.forward(model.blocks([b])[0])
    width = fa["c"].shape[-1]
    assert np.allclose(fa["c"].reshape(-1, width)[:50], fb["c"].reshape(-1, width)[:50])


def test_scoring_equals_the_trained_form(monkeypatch):
    monkeypatch.setattr(attention, "MEMBERS", 3)
    rng = np.random.default_rng(4)
    rows = [rng.integers(3, 60, n) for n in (0, 31, 32, 200)]
    model = attention.train(rows, np.bincount(np.concatenate(rows), minlength=60).astype(float), 1, 2, slots=40, classes=6, width=8, steps=20)
    x, y, owner = model.blocks(rows)
    f = model.forward(x)
    log = np.log(np.take_along_axis(f["c"], model.kind[y][:, :, None], 2)[:, :, 0]) + model.share[y]
    for at, inside, member in model._members(f["g"], y):
        log.reshape(-1)[at] += np.log(inside[np.arange(len(at)), member])
    want = np.bincount(owner, np.where(y < 0, 0, log).sum(axis=1))
    assert model.log_probabilities(rows, batch=3) == pytest.approx(want, rel=1e-4)


def test_boosting_and_calibration():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = boost(x[:2000], y[:2000])
    p = sigmoid(trees.raw(x[2000:]))
    assert ((p > 0.5) == (y[2000:] == 1)).mean() > 0.95
    at, value = isotonic(trees.raw(x[2000:]), y[2000:])
    assert (np.diff(at) > 0).all() and (np.diff(value) >= 0).all() and 0 < value[0] and value[-1] < 1


def test_language_on_held_out_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    found = language.language_report(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert len(found) == len(truth) and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.93 * len(held)


def test_language_of_messy_rows(messy, nothing):
    found = language.language_report(messy).collect()
    texts = {i: t for i, t, *_ in messy_rows() if i is not None}
    for r in found:
        if r.doc_id is not None:
            letters = any(c.isalpha() for c in texts[r.doc_id] or "")
            assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    assert len(found) == len(messy_rows()) and language.language_report(nothing).count() == 0


def test_language_without_any_label(spark):
    docs = spark.createDataFrame([(1, "some words", None, None, 1)], SCHEMA)
    assert [tuple(r) for r in language.language_report(docs).collect()] == [(1, zlib.crc32(b"1") % 3 == 1, "und", 0.0)]


def test_toxicity_on_held_out_documents(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    found = toxicity.score_toxicity(documents(spark, sf), labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right >= 0.95 * len(held)


def test_toxicity_of_messy_rows(spark, messy, nothing, labels):
    found = toxicity.score_toxicity(messy, labels).collect()
    assert len(found) == len(messy_rows()) and all(0 <= r.score <= 1 for r in found)
    kept = toxicity.drop_toxic(messy, labels)
    assert kept.columns == messy.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in found if not r.predicted)
    none = spark.createDataFrame([], labels.schema)
    assert {r.score for r in toxicity.score_toxicity(messy, none).collect()} == {0.0}
    assert toxicity.score_toxicity(nothing, labels).count() == 0


def test_ids_that_training_never_meets_take_no_memory():
    rng = np.random.default_rng(6)
    rows = [rng.integers(0, 3000, 800) for _ in range(42)]
    counts = np.bincount(np.concatenate(rows), minlength=50_002).astype(float)
    counts[50_001] = len(rows)
    top = attention.frequent(counts)
    model = attention.fresh(np.ones((len(top) + 1,) * 2), top, counts, 50_000, 50_001)
    x, y, _ = model.blocks(rows)
    tracemalloc.start()
    trainer = attention.Trainer(model, 0)
    trainer.learn(x, y, 0.02)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6
    # All that may follow the start, met or not, adds up to one.
    model = trainer.model
    first = np.arange(len(counts))
    x, _, _ = model.blocks([np.array([], np.int64)])
    g = np.repeat(model._states(x, model._tables())["g"][:1], len(first), axis=0)
    c = model._class_weights(g[:1])[0].astype(np.float64)
    log = np.log(c[model.kind] / c.sum()) + model.share + model._member_logs(g, first)
    assert np.exp(log).sum() == pytest.approx(1.0, abs=1e-3) and np.isfinite(model.log_probabilities([np.array([49_000, 5, 49_001])])).all()


def test_training_leaves_out_the_loss_and_needless_cuts():
    rng = np.random.default_rng(8)
    rows = [rng.integers(3, 60, n) for n in (0, 31, 32, 200)]
    model = attention.train(rows, np.bincount(np.concatenate(rows), minlength=60).astype(float), 1, 2, slots=40, classes=6, width=8, steps=3)
    x, y, _ = model.blocks(rows)
    loss, whole = model.gradients(x, y)
    none, short = model.gradients(x, y, with_loss=False)
    assert loss > 0 and none == 0 and all((whole[k] == short[k]).all() for k in whole)
    # What may exceed 60 is cut off, also where lengths alone cannot tell; nothing else is changed.
    wide = rng.normal(0, 40, (50, 8)).astype(np.float32)
    assert (attention._exp(wide.copy(), float(wide.max())) == np.exp(np.minimum(wide, np.float32(60)))).all() and wide.max() > 60
    near = np.minimum(wide, np.float32(59))
    assert (attention._exp(near.copy(), 59.0) == np.exp(near)).all() and np.isfinite(attention._exp(wide.copy(), math.nan)).all()
    for name in ("query", "classes", "member"):
        model.p[name] = model.p[name] * np.float32(1e4)
        assert np.isfinite(model.log_probabilities(rows)).all()


def test_words_are_counted_where_they_are_read(messy):
    frame = lm_scoring.count_words(messy)
    plan = frame._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and frame.dtypes == [("word", "string"), ("c", "bigint")]


def test_word_scores_against_brute_force(messy, nothing):
    table = str.maketrans(UPPER, LOWER)
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(table)), None]
    counts = Counter()
    for i, t, *_ in messy_rows():
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)), 6))
        for i, t, *_ in messy_rows()
    )
    for head in (5, 100_000):
        found = lm_scoring.score_texts(messy, head_words=head, sample_rows=20).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == want
        assert {r.train_tokens for r in found} == {n} and all(r.score < 0 for r in found)
    assert lm_scoring.score_texts(nothing).count() == 0


def test_every_position_trains_the_network(spark, monkeypatch):
    # Behind its first 640 ids the long text repeats a pair that stands nowhere else.
    rows = [(i, 0, True, [3 + (i * 7 + k) % 20 for k in range(30)]) for i in range(40)] + [(99, 0, True, [5] * 700 + [41, 42] * 6000), (7, 0, False, [50] * 900)]
    encoded = spark.createDataFrame(rows, "doc_id long, th long, train boolean, ids array<int>").repartition(3)
    seen = []
    learn = lm_scoring.train_round

    def counted(*args):
        seen.append(learn(*args) / args[3])
        return seen[-1]

    monkeypatch.setattr(lm_scoring, "train_round", counted)
    model = lm_scoring.fit(encoded, 60)
    assert sum(seen) == sum(len(ids) + 1 for *_, train, ids in rows if train)
    score = lambda *ids: model.log_probabilities([np.array(ids)])[0]
    assert score(*[41, 42] * 20) > score(*[41, 41] * 20) + 20
    # Ids outside the frequent ones have rows, classes and weights of their own.
    assert len(set(model.slot.tolist())) == len(model.slot) and len(model.p["member"]) == len(model.slot)


def test_scores_do_not_depend_on_the_files(messy):
    one, many = ({(r.doc_id, r.n_subwords): r.score for r in lm_scoring.score_texts(messy.repartition(n)).collect()} for n in (1, 5))
    assert one.keys() == many.keys() and len(one) > 40
    assert all(math.isclose(one[k], many[k], rel_tol=1e-4) for k in one)


def test_trainers_get_their_documents_in_one_order_from_any_layout(spark):
    rows = [(i, i * 31, [i]) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, th long, ids array<int>")
    seen = [
        [(r.p, r.ids[0]) for r in lm_scoring.dealt(frame.repartition(n), 7).select(F.spark_partition_id().alias("p"), "ids").collect()]
        for n in (1, 6)
    ]
    assert seen[0] == seen[1] and {p for p, _ in seen[0]} == set(range(7)) and {i for _, i in seen[0]} == set(range(600))


def test_a_rare_language_is_in_the_sample(spark):
    rows = [(i, f"some words number {i}", "xx" if i in (5001, 5002, 5004, 5005) else "en", None, 1) for i in range(5010)]
    found = language.training_windows(spark.createDataFrame(rows, SCHEMA), 50)
    want = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in (5001, 5002, 5004, 5005))
    assert want and (found["lang"] == "xx").sum() == want and 50 <= (found["lang"] == "en").sum() <= 150
