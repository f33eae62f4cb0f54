import random
from pathlib import Path

import pytest
import sentencepiece
from corpus_rows import invented, messy_rows

from sieveknn.llm import pieces

MODEL = Path(pieces.MODEL_PATH).read_bytes()
TEXTS = [t for _, t, *_ in messy_rows() if t] + [
    "  two  spaces ", "\n\nlines\r\n\tand tabs", "don't stop: e.g. f(x)=[1,2];", "naïve café 😀👍🏽 日本語 ▁", "a" * 500, "  ", "x ", "...!!!", "def f():\n        return  1",
]


@pytest.fixture(scope="module")
def machine():
    return pieces.Transducer(MODEL)


def test_same_ids_as_the_library(machine):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    for text in TEXTS:
        assert machine.encode(text) == library.encode(text)


def test_unigram_weights_against_all_paths():
    """The same pieces read as a unigram model: the path of the least weight of the whole text."""
    # Field 3 of the trainer's fields (field 2) is the model type: 2 is BPE, 1 is unigram.
    trainer = next(v for k, v in pieces._fields(MODEL) if k == 2)
    machine = pieces.Transducer(MODEL.replace(trainer, trainer.replace(b"\x18\x02", b"\x18\x01", 1)))
    assert not machine.bpe
    for text in [invented(random.Random(1), 40), "unigram paths, of: plain (words)...", "ein paar Wörter für 日本"]:
        whole = machine.normalise(text)
        best = [0.0] + [float("inf")] * len(whole)
        for i in range(len(whole)):
            for j in range(i + 1, min(len(whole), i + 20) + 1):
                if whole[i:j] in machine.ids:
                    best[j] = min(best[j], best[i] - machine.scores[machine.ids[whole[i:j]]])
        assert sum(-machine.scores[i] for i in machine.encode(text)) == pytest.approx(best[-1])


def test_round_trip(machine):
    for text in TEXTS:
        assert machine.decode(machine.encode(text)) == text.replace("▁", " ")


def test_table_stays_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_SEGMENTS", 10)
    table = pieces._Table(lambda key: (len(key),))
    assert [table[f"word{i}"] for i in range(100)] == [(len(f"word{i}"),) for i in range(100)] and len(table) <= 10


def test_operator(spark, messy, nothing):
    found = pieces.encode(messy).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, *_ in messy_rows())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    by_id = {i: t or "" for i, t, *_ in messy_rows() if i is not None}
    for r in found:
        if r.doc_id is not None:
            assert list(r.ids) == library.encode(by_id[r.doc_id]) and r.n_tokens == len(r.ids)
            assert r.round_trip == ("▁" not in by_id[r.doc_id])
    decoded = pieces.decode(pieces.encode(messy)).collect()
    assert {r.text for r in decoded if r.doc_id is not None} == {t.replace("▁", " ") for t in by_id.values()}
    assert pieces.encode(nothing).count() == 0
