"""Language-model scores: a causal self-attention model over subword ids, and a word unigram beside it.

Subword ids are those of a public byte-level BPE vocabulary. Counts of words and of subword ids are taken over all training documents (crc32(doc_id) mod 7 is not 2).
The network learns from every position of all of them: in each of up to ``ROUNDS`` rounds trainers take gradient steps over
their share of the round's documents, and the weights are averaged in Spark. Rounds, trainers and the order inside a share
are hashes of id and text, so the scores don't depend on how the table is cut into files. The number of trainers grows with
the square root of the corpus, as do the steps of each. It scores every whole text in overlapping windows.

The words of a text are looked up in two ways: the ``HEAD_WORDS`` most frequent ones in a table that goes with
the tasks, all others by a join with the stored counts, so no vocabulary has to fit anywhere.

* A null text is empty; an empty text has one token, its end.
* Rows without an id are not learned from, and ``held_out`` is false for them. Without training rows all
  words are unknown and the untrained network scores.
* A very long text is encoded and scored whole; it goes to one trainer, which reads its share as a stream.
* Repeated rows (same id and text) get equal scores. Further columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, compress
from operator import not_
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveknn.llm.attention import BATCH, BLOCK, BUFFER, AttentionModel, Trainer, fresh, frequent, neighbours
from sieveknn.llm.common import hash_sample, remainder, stored, whole_text
from sieveknn.session import new_scratch_path, ship_package

ROUNDS = 8  # each training document is in one of them
SHARE = 100  # a trainer's part of a round is this many times the square root of the round's positions
LEAST_STEPS = 500  # small tables are passed over several times
HEAD_WORDS = 200_000
VOCABULARY_PATH = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits a text before its pieces are merged.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BATCH_IDS = 400_000
_BATCH_BYTES = 4_000_000  # of text, encoded or looked up together
_PART = 1 << 14  # numbers of a row when arrays are summed


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, th, train, text``; ``th`` tells rows of one id with different texts apart."""
    text = whole_text()
    return docs.select("doc_id", F.xxhash64(text).alias("th"), F.coalesce(remainder(F.col("doc_id"), 7) != 2, F.lit(False)).alias("train"), text.alias("text"))


def _cuts(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths add up to at most ``most``, or of a single longer row."""
    ends, at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), 0
    while at < len(lengths):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, stop
        at = stop


def _text_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, stop in _cuts(pc.binary_length(batch.column(column)).to_numpy(), _BATCH_BYTES):
            yield batch.slice(at, stop - at)


def _words(text: pa.BinaryScalar) -> list[bytes]:
    """The words of a text, A-Z in lower case; bytes are split at the same six characters as ``WORD``."""
    return text.as_buffer().to_pybytes().lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """``word, c`` over the training documents; the end of a text is the null word."""
    training = _keyed(docs).where("train")

    def run(batches):
        for batch in _text_slices(batches, 0):
            counts = Counter(chain.from_iterable(map(_words, batch.column(0).cast(pa.binary()))))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    ship_package(docs.sparkSession)
    words = training.select("text").mapInArrow(run, "word string, c long")
    ends = training.select(F.lit(None).cast("string").alias("word"), F.lit(1).cast("long").alias("c"))
    return words.unionByName(ends).groupBy("word").agg(F.sum("c").alias("c"))


_encodings: dict[int, tiktoken.Encoding] = {}


def encoding(vocabulary: bytes) -> tiktoken.Encoding:
    """The encoding of a vocabulary file (lines of base64 and rank), made once in each worker."""
    name = hash(vocabulary)
    if name not in _encodings:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, vocabulary.splitlines())}
        _encodings[name] = tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[name]


def subwords(docs: DataFrame, vocabulary_path: str = VOCABULARY_PATH) -> DataFrame:
    """``doc_id, th, train, ids`` of every whole text; the vocabulary is read on the driver and sent with the tasks."""
    ship_package(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(vocabulary_path).read_bytes())

    def run(batches):
        encode = encoding(vocabulary.value).encode_ordinary
        for batch in _text_slices(batches, 3):
            rows = [np.array(encode(t.as_py()), np.int32) for t in batch.column(3)]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], ids], names=["doc_id", "th", "train", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return _keyed(docs).mapInArrow(run, f"doc_id {kind}, th long, train boolean, ids array<int>")


def _parts(values: np.ndarray, task: int) -> Iterator[pa.RecordBatch]:
    """An array as rows ``part, task, values``."""
    for part, at in enumerate(range(0, len(values), _PART)):
        cut = values[at : at + _PART]
        lists = pa.ListArray.from_arrays(pa.array([0, len(cut)], pa.int32()), pa.array(cut, pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([task], pa.int32()), lists], names=["part", "task", "values"])


def _summed(frame: DataFrame, run) -> np.ndarray | None:
    """The sum of the arrays that ``run`` yields in each task; parts are summed in Spark, in the order of the tasks."""

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        total = np.sum([r.values.to_numpy() for r in table["values"]], axis=0)
        return pa.table({"part": table["part"][:1], "values": pa.array([total], pa.list_(pa.float64()))})

    parts = frame.mapInArrow(run, "part int, task int, values array<double>").groupBy("part").applyInArrow(add, "part int, values array<double>")
    rows = parts.toArrow().sort_by("part")["values"]
    return np.concatenate([r.values.to_numpy() for r in rows]) if len(rows) else None


def _id_lists(lists: pa.ListArray) -> Iterator[list[np.ndarray]]:
    """The lists in runs of at most ``_BATCH_IDS`` ids, or of a single longer list."""
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    for at, stop in _cuts(np.diff(offsets), _BATCH_IDS):
        yield [values[offsets[k] : offsets[k + 1]] for k in range(at, stop)]


def neighbour_counts(ids: DataFrame, top: np.ndarray, size: int, start: int, end: int) -> np.ndarray:
    def run(batches):
        total = None
        for batch in batches:
            for run_of in _id_lists(batch.column(0)):
                found = neighbours([np.concatenate([[start], r, [end]]) for r in run_of], top, size)
                total = found if total is None else np.add(total, found, out=total)
        if total is not None:
            yield from _parts(total.reshape(-1), TaskContext.get().partitionId())

    total = _summed(ids, run)
    return np.zeros((len(top) + 1,) * 2) if total is None else total.reshape(len(top) + 1, -1)


def train_round(ids: DataFrame, model: AttentionModel, speed: float, passes: int = 1) -> int:
    """Lets ``model`` learn from every position of ``ids``; returns how many there were, ends included, times ``passes``.

    Each task takes steps on a copy of the weights; the new weights are their average by positions. Its partition number is its seed.
    """
    shared = ids.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        task = TaskContext.get().partitionId()
        trainer, seen, held, size = Trainer(shared.value, task), 0, [], 0

        def learn() -> int:
            x, y, _ = shared.value.blocks(held)
            for _ in range(passes):
                trainer.learn(x, y, speed)
            return passes * int((y >= 0).sum())

        for batch in batches:
            for r in chain.from_iterable(_id_lists(batch.column(0))):
                held.append(r)
                size += len(r) // BLOCK + 1
                if size >= BUFFER:
                    seen += learn()
                    held, size = [], 0
        if held:
            seen += learn()
        if seen:
            weights = np.concatenate([v.reshape(-1) for v in trainer.model.trained().values()]).astype(np.float64)
            yield from _parts(np.concatenate([[1.0], weights]) * seen, task)

    total = _summed(ids, run)
    shared.unpersist()
    if total is None:
        return 0
    at = 1
    for value in model.trained().values():
        value[...] = (total[at : at + value.size] / total[0]).reshape(value.shape)
        at += value.size
    return round(total[0])


def round_of() -> Column:
    """The round that a training document is in."""
    return F.pmod(F.xxhash64("doc_id", "th", F.lit("round")), F.lit(ROUNDS)).cast("int")


def stored_ids(encoded: DataFrame) -> DataFrame:
    """``encoded`` and ``round``, stored in a folder for each round; rows that aren't learned from are in round -1."""
    path = new_scratch_path(encoded.sparkSession, "lm-ids")
    placed = encoded.withColumn("round", F.when(F.col("train"), round_of()).otherwise(-1))
    placed.write.partitionBy("round").parquet(path)
    return encoded.sparkSession.read.schema(placed.schema).parquet(path)


def dealt(training: DataFrame, trainers: int) -> DataFrame:
    """``ids`` with the documents of each trainer in the partition of its number, in an order that only they decide."""
    trainer = F.pmod(F.xxhash64("doc_id", "th", F.lit("trainer")), F.lit(trainers)).cast("int")
    placed = training.select("doc_id", "th", "ids").repartitionById(trainers, trainer)
    return placed.sortWithinPartitions(F.xxhash64("doc_id", "th", F.lit("order")), "doc_id", "th").select("ids")


def fit(encoded: DataFrame, vocabulary: int, sample_rows: int | None = None) -> AttentionModel:
    """The model of ``vocabulary`` ids and two more, the start and the end of a text.

    Counts of ids are over all training rows (one number for each id reaches the driver), and the network learns from
    every position of them; only where ``sample_rows`` is given, it learns from so many documents.
    """
    training = encoded.where("train")
    start, end = vocabulary, vocabulary + 1
    counts = np.zeros(vocabulary + 2)
    for row in training.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("c")).collect():
        counts[row["id"]] = row["c"]
    counts[end] = training.count()
    total = counts.sum()
    if sample_rows is not None:
        # Names are chosen first, so that only the sample's ids move; at most sample_rows names are broadcast.
        chosen = hash_sample(training.select("doc_id", "th").distinct(), sample_rows)
        training = training.join(F.broadcast(chosen), ["doc_id", "th"])
        total = training.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    top = frequent(counts)
    rounds = min(ROUNDS, max(1, int(total) // (BATCH * BLOCK)))  # a round is at least a whole step
    trainers = max(1, math.ceil(math.sqrt(total / rounds) / SHARE))
    before = neighbour_counts(training.select("ids").coalesce(trainers), top, len(counts), start, end)
    model = fresh(before, top, counts, start, end)
    if not total:
        return model
    passes = max(1, math.ceil(LEAST_STEPS * BATCH * BLOCK / total / 8))
    if "round" not in training.columns:
        training = training.withColumn("round", round_of())
    for k in range(rounds):
        train_round(dealt(training.where(F.col("round") % rounds == k), trainers), model, 0.02 * (1 - 0.9 * k / rounds), passes)
    return model


def attention_scores(encoded: DataFrame, model: AttentionModel) -> DataFrame:
    """``doc_id, th, n_subwords, score``: log10 probability of every id of a text, and its end."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            scores = np.concatenate([np.empty(0), *map(shared.value.log_probabilities, _id_lists(lists))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pc.list_value_length(lists).cast(pa.int64()), pa.array(scores / math.log(10))],
                names=["doc_id", "th", "n_subwords", "score"],
            )

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "th", "ids").mapInArrow(run, f"doc_id {kind}, th long, n_subwords long, score double")


def head_of(counts: DataFrame, head_words: int) -> DataFrame:
    """The most frequent words, at most ``head_words``: whole classes of frequency, found from the classes' sizes."""
    level = F.floor(F.log2("c") * 16)
    words = counts.where("word is not null")
    cut, room = 1 << 20, head_words
    for row in sorted(words.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        room -= row["n"]
        if room < 0:
            break
        cut = row["level"]
    return words.where(level >= cut)


def unigram_parts(docs: DataFrame, counts: DataFrame, head_words: int = HEAD_WORDS) -> DataFrame:
    """``doc_id, th, train, n_tokens, known, log_counts``: tokens of each text, those known, the sum of log10(c + 1)."""
    spark = docs.sparkSession
    ship_package(spark)
    table = {r["word"].encode(): math.log10(r["c"] + 1) for r in head_of(counts, head_words).toLocalIterator()}
    ends = counts.where("word is null").first()
    end_value = math.log10(ends["c"] + 1) if ends else 0.0
    shared = spark.sparkContext.broadcast(table)

    def run(batches):
        find = shared.value.get
        for batch in _text_slices(batches, 3):
            n, known, value, tail, times = [], [], [], [], []
            for text in batch.column(3).cast(pa.binary()):
                words = _words(text)
                found = list(map(find, words))
                # A word of the table has a number above 0.
                rest = Counter(compress(words, map(not_, found)))
                n.append(len(words) + 1)
                known.append(len(words) - sum(rest.values()) + (ends is not None))
                value.append(math.fsum(filter(None, found)) + end_value)
                tail.append(list(rest))
                times.append(list(rest.values()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(value, pa.float64()),
                 pa.array(tail, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))],
                names=["doc_id", "th", "train", "n_tokens", "known", "log_counts", "tail", "times"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, th long, train boolean, n_tokens long, known long, log_counts double, tail array<string>, times array<int>"
    parts = stored(_keyed(docs).mapInArrow(run, schema), "lm-words")
    rare = parts.select("doc_id", "th", F.explode(F.arrays_zip("tail", "times")).alias("w")).select("doc_id", "th", F.col("w.tail").alias("word"), F.col("w.times").alias("tf"))
    sums = (
        rare.join(counts.where("word is not null"), "word")
        .groupBy("doc_id", "th")
        .agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("value"))
    )
    # Rows repeated with the same id and text have been summed together.
    rows = parts.groupBy("doc_id", "th").agg(F.count("*").alias("m"), *[F.first(c).alias(c) for c in ("train", "n_tokens", "known", "log_counts")])
    both = rows.join(sums.withColumnsRenamed({"doc_id": "d2", "th": "t2"}), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left")
    return both.select(
        "doc_id",
        "th",
        "m",
        "train",
        "n_tokens",
        (F.col("known") + F.coalesce(F.col("more") / F.col("m"), F.lit(0))).cast("long").alias("known"),
        (F.col("log_counts") + F.coalesce(F.col("value") / F.col("m"), F.lit(0.0))).alias("log_counts"),
    )


def score_texts(docs: DataFrame, vocabulary_path: str = VOCABULARY_PATH, sample_rows: int | None = None, head_words: int = HEAD_WORDS) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords``."""
    counts = stored(count_words(docs), "lm-counts")
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    tokens, kinds = totals["n"] or 0, totals["v"]
    encoded = stored_ids(subwords(docs, vocabulary_path))
    vocabulary = encoding(Path(vocabulary_path).read_bytes()).n_vocab
    scores = attention_scores(encoded, fit(encoded, vocabulary, sample_rows)).dropDuplicates(["doc_id", "th"])
    scores = scores.withColumnsRenamed({"doc_id": "d3", "th": "t3"})
    parts = unigram_parts(docs, counts, head_words)
    both = parts.join(scores, F.col("doc_id").eqNullSafe(F.col("d3")) & (F.col("th") == F.col("t3")))
    each = both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return each.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out"),
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.lit(math.log10(tokens + kinds + 1))).alias("base_score"),
        "score",
        "n_subwords",
    )
