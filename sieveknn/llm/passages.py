"""Passages that stand in more than one place: every word under a repeated window of words is removed.

The reference is the corpus itself, so its suffix automata have no size bound and can't all be broadcast. They are
dealt in shards: a window's key is the smallest hash of the six-word strings in it, equal windows have equal keys, and
the automaton of a shard holds the windows of the shard's keys.

1. Runs of windows with the same key are counted by key; those of a key that occurs once are done.
2. The words of the other runs (pieces) are cut from one row of each distinct text. Equal pieces are added up before they
   move on.
3. Each shard builds one automaton of its distinct pieces, with the number of places of each state, and streams the pieces
   through it. The matching statistics are the longest strings that stand in two places; where they reach ``length``
   words, the maximal span is removed.
4. Spans go back to their texts by joins that Spark can split where a passage is in very many documents.

Six-word strings that are very frequent (more than one run in ``HEAVY_SHARE``, so at most that many) are broadcast and come after
all others in the choice of keys: a line that a third of all documents share doesn't become the key of their windows.

``remove_known`` is the same against a given reference of bounded size, whose automaton is broadcast.

* A null text has no words. Rows with equal text, also repeated rows, are different places, so each removes the other.
  A null id changes nothing: a result depends on the texts alone.
* Texts below ``length`` words keep all. Very long texts are one row in a task at a time. No rows give no rows.
* Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sieveknn.llm.automata import LENGTH, SuffixAutomaton, Words, covered, window_runs
from sieveknn.llm.common import stored, whole_text
from sieveknn.session import ship_package

SHARD_BYTES = 1 << 20  # of distinct pieces behind one automaton
HEAVY_SHARE = 20_000
SLICE_BYTES = 1 << 17  # of text whose words are looked at together
REFERENCE_BYTES = 16 << 20  # of a reference whose automaton is broadcast
_LAST = (1 << 63) - 1


def _rows(docs: DataFrame) -> DataFrame:
    """``doc_id, did, ta, tb, data``: the text in bytes, named by two hashes."""
    data = whole_text().cast("binary")
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    return docs.select("doc_id", did.alias("did"), F.xxhash64(data).alias("ta"), F.xxhash64(F.lit(1), data).alias("tb"), data.alias("data"))


def _texts(batches):
    """Parts of the batches with some ``SLICE_BYTES`` of text, and the words of their texts."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("data")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            part = batch.slice(at, stop - at)
            yield part, Words(part.column("data"))
            at = stop


def _find_runs(shared, length: int):
    """``key, ta, first, places`` of every run; ``places`` is 2 if the key stands twice in the text."""

    def run(batches):
        for part, words in _texts(batches):
            key, text, first, _, twice = window_runs(words.hashes, words.sizes, shared.value, length)
            columns = (key, part.column("ta").to_numpy()[text], first.astype(np.int32), 1 + twice.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "ta", "first", "places"])

    return run


def _cut_pieces(shared, length: int):
    """``key, ta, tb, first, places, piece`` of the runs that ``firsts`` names."""

    def run(batches):
        for part, words in _texts(batches):
            key, text, first, behind, _ = window_runs(words.hashes, words.sizes, shared.value, length)
            marks = part.column("firsts")
            # A name that two texts share may bring places of the other text.
            named = np.repeat(np.arange(part.num_rows) << 32, pc.list_value_length(marks).to_numpy()) + marks.flatten().to_numpy()
            chosen = np.flatnonzero(np.isin((text << 32) + first, named))
            of, at = text[chosen], (np.cumsum(words.sizes) - words.sizes)[text[chosen]]
            spans = zip((at + first[chosen]).tolist(), (at + behind[chosen] + length - 1).tolist(), strict=True)
            columns = [pa.array(key[chosen]), *(part.column(c).take(pa.array(of)) for c in ("ta", "tb"))]
            columns += [pa.array(first[chosen].astype(np.int32)), part.column("places").take(pa.array(of))]
            columns.append(pa.array([words.joined(a, b) for a, b in spans], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["key", "ta", "tb", "first", "places", "piece"])

    return run


def _scan_shard(length: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Spans of the pieces of a shard: ``key, name, begins, ends``."""
        numbers: dict[bytes, int] = {}
        pieces = [[numbers.setdefault(w, len(numbers)) for w in piece.split(b" ")] for piece in frame["piece"]]
        automaton = SuffixAutomaton()
        for piece, places in zip(pieces, frame["places"].tolist(), strict=True):
            automaton.add(piece, places)
        automaton.count_places()
        out = []
        for key, name, piece in zip(frame["key"].tolist(), frame["name"].tolist(), pieces, strict=True):
            spans = covered(automaton.matching(piece, 2), length)
            if spans:
                out.append((key, name, [a for a, _ in spans], [b for _, b in spans]))
        return pd.DataFrame(out, columns=["key", "name", "begins", "ends"])

    return run


def _finish(batches):
    for batch in batches:
        out = []
        for data, spans in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = data.split()
            keep = np.ones(len(words), bool)
            for span in spans or ():
                keep[span["begin"] : span["behind"]] = False
            kept = words if keep.all() else [words[k] for k in np.flatnonzero(keep).tolist()]
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        n_words, n_removed, digest = zip(*out, strict=True) if out else ((), (), ())
        columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _heavy_keys(rows: DataFrame, length: int):
    """The keys that more than one run in ``HEAVY_SHARE`` has, sorted; a broadcast of 160 KB at most."""
    context = rows.sparkSession.sparkContext
    none = context.broadcast(np.empty(0, np.uint64))
    counts = rows.select("ta", "data").mapInArrow(_find_runs(none, length), _RUN).groupBy("key").count()
    seen = Observation()
    counts = stored(counts.observe(seen, F.sum("count").alias("runs")).where("count > 1"), "run-counts")
    total = seen.get["runs"] or 0
    heavy = counts.where(F.col("count") > total // HEAVY_SHARE).select("key").toArrow()
    return context.broadcast(np.sort(heavy.column("key").to_numpy().view(np.uint64)))


_RUN = "key long, ta long, first int, places int"


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """``ta, tb, spans``: the words under repeated windows, for each text that has any."""
    heavy = _heavy_keys(rows, length)
    runs = stored(rows.select("ta", "data").mapInArrow(_find_runs(heavy, length), _RUN), "runs")
    several = runs.groupBy("key").agg(F.sum("places").alias("n")).where("n > 1").select("key")
    marks = runs.select("key", "ta", "first").join(several, "key", "left_semi").groupBy("ta").agg(F.collect_set("first").alias("firsts"))
    texts = rows.groupBy("ta", "tb").agg(F.min("did").alias("low"), F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("places"))
    wanted = texts.join(marks, "ta")
    # One row of each text; two rows of the same id and text do no harm.
    cut = rows.select("ta", "tb", "did", "data").join(wanted, ["ta", "tb"]).where("did = low")
    pieces = cut.select("ta", "tb", "places", "firsts", "data").mapInArrow(
        _cut_pieces(heavy, length), "key long, ta long, tb long, first int, places int, piece binary"
    )
    pieces = stored(pieces.withColumn("name", F.xxhash64("piece")), "pieces")
    distinct = pieces.groupBy("key", "name", "piece").agg(F.least(F.sum("places"), F.lit(2)).cast("int").alias("places"))
    size = pieces.agg(F.sum(F.length("piece"))).first()[0] or 0
    shards = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES)
    found = distinct.groupBy(F.pmod("key", F.lit(shards)).alias("shard")).applyInPandas(
        _scan_shard(length), "key long, name long, begins array<int>, ends array<int>"
    )
    span = F.explode(F.arrays_zip("begins", "ends"))
    placed = pieces.select("key", "name", "ta", "tb", "first").join(found, ["key", "name"]).select("ta", "tb", "first", span.alias("s"))
    both = F.struct((F.col("first") + F.col("s.begins")).alias("begin"), (F.col("first") + F.col("s.ends")).alias("behind"))
    return placed.groupBy("ta", "tb").agg(F.collect_set(both).alias("spans"))


def remove_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256``."""
    ship_package(docs.sparkSession)
    rows = _rows(docs)
    done = rows.select("doc_id", "ta", "tb", "data").join(repeated_spans(rows, length), ["ta", "tb"], "left")
    return done.select(F.col("doc_id").cast("long"), "data", "spans").mapInArrow(
        _finish, "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )


def remove_known(docs: DataFrame, reference: DataFrame, length: int = LENGTH) -> DataFrame:
    """The same, removing what ``reference (text)`` has: its words' automaton is broadcast, documents are only streamed.

    A reference above ``REFERENCE_BYTES`` raises ValueError.
    """
    spark = docs.sparkSession
    ship_package(spark)
    known = reference.select(whole_text().cast("binary").alias("data"))
    size = known.agg(F.sum(F.length("data"))).first()[0] or 0
    if size > REFERENCE_BYTES:
        raise ValueError(f"a reference of {size} bytes is above the {REFERENCE_BYTES} that are broadcast")
    numbers: dict[bytes, int] = {}
    automaton = SuffixAutomaton()
    for row in known.distinct().toLocalIterator():
        automaton.add([numbers.setdefault(w, len(numbers)) for w in bytes(row.data).split()])
    automaton.count_places()
    shared = spark.sparkContext.broadcast((numbers, automaton))

    def run(batches):
        words, own = shared.value
        for batch in batches:
            spans = []
            for data in batch.column("data").to_pylist():
                matched = own.matching(words.get(w, -1) for w in data.split())
                spans.append([{"begin": a, "behind": b} for a, b in covered(matched, length)])
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("behind", pa.int32())]))
            yield from _finish([pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("data"), pa.array(spans, kind)], names=["doc_id", "data", "spans"])])

    rows = _rows(docs).select(F.col("doc_id").cast("long"), "data")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
