"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

The model file is compiled to a transducer: the normaliser (space to U+2581, dummy prefix), one arc for
each piece, weighted with its negative score, and for a character that no piece covers the arcs of its
UTF-8 bytes. For a BPE model it is composed with an acceptor of neighbouring pieces: two pieces may
follow each other only if no merge across their seam comes before the merges that made them. Exactly
one path for each text passes it, the one the merges would find. A unigram model needs no acceptor: the
path of the least weight wins. Composing with the input and taking the shortest path in the tropical
semiring is one sweep over its characters.

No piece crosses from a word into the next U+2581, and hardly any from a letter into a punctuation mark
or back, so a text falls into segments at those states, and the path of a segment seen before is
taken from a bounded table. Where the pieces allow a cut is read from the model.

* A null or empty text has no ids and decodes to an empty text.
* ``round_trip`` says whether the decoded ids are the text; a text that itself holds U+2581 comes back
  with spaces there, as the model defines it, and is marked false.
* Repeated rows are encoded alike; further columns of the input are ignored by ``encode`` and kept by
  ``decode``.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sieveknn.llm.common import whole_text
from sieveknn.session import ship_package

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
TABLE_SEGMENTS = 300_000  # segments whose paths a worker remembers
TABLE_LENGTH = 40  # characters of the longest of them
BATCH_BYTES = 4 << 20
# Numbers of the model file's format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class Transducer:
    """A compiled model; ``encode`` and ``decode`` work on one text."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        model_type, self.dummy_prefix, self.squeeze, charsmap = UNIGRAM, True, True, b""
        for number, value in _fields(model):
            if number == 1:
                entry = dict(_fields(value))
                self.pieces.append(entry.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0)
                self.kinds.append(entry.get(3, NORMAL))
            elif number == 2:
                model_type = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                charsmap = spec.get(2, b"")
                self.dummy_prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if charsmap or model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models without a character map are supported")
        self.bpe = model_type == BPE
        usable = [i for i, kind in enumerate(self.kinds) if kind in (NORMAL, USER_DEFINED)]
        self.ids = {self.pieces[i]: i for i in usable}
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else None
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, kind in enumerate(self.kinds) if kind == BYTE}
        self.unknown_cost = UNKNOWN_PENALTY - min(self.scores[i] for i in usable)
        self.spines: dict[int, tuple] = {}
        self.follows: dict[int, dict[int, bool]] = {}  # by left piece; at most the square of the pieces, in practice few
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece crosses into the next word")
        self.arcs: dict = {}
        for piece, i in self.ids.items():
            if self.bpe and len(piece) > 1 and self._merge(piece) != [piece]:
                continue  # no sequence of merges ends in it
            node = self.arcs
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = i
        # A segment ends before a space mark, and around marks that no piece joins to a letter or another character.
        joined = {pair for p in self.ids for pair in zip(p, p[1:], strict=False)}
        letter = r"[^\W\d_]"
        ascii_marks = [c for c in map(chr, range(128)) if not c.isalnum()]
        ends = {b for a, b in joined if re.match(letter, a) and not re.match(letter, b)}
        begins = {a for a, b in joined if re.match(letter, b) and not re.match(letter, a)}
        after = "[" + re.escape("".join(c for c in ascii_marks if c not in ends)) + "]"
        around = "[" + re.escape("".join(c for c in ascii_marks if c not in begins | ends)) + "]"
        self.segments = re.compile(
            f"{SPACE}*{letter}+(?=[{SPACE}]|{after}|\\Z)|{SPACE}*{around}+(?={SPACE}|{letter}|\\Z)|{SPACE}*[^{SPACE}]+|{SPACE}+"
        ).findall
        self.surface = [self._surface(i) for i in range(len(self.pieces))]
        self.cost = np.array([-s for s in self.scores])
        self.is_byte = np.array([k == BYTE for k in self.kinds])
        self.paths, self.words = _Table(self.path), _Table(self._word)

    def _surface(self, i: int) -> bytes:
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.kinds[i] == CONTROL:
            return b""
        return " ⁇ ".encode() if self.kinds[i] == UNKNOWN else self.pieces[i].encode()

    # --- the acceptor of neighbours -------------------------------------------------------------
    def _merge(self, piece: str, tree: dict | None = None) -> list[str]:
        """Merges the characters of one piece, best score and then leftmost first."""
        parts = list(piece)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                break
            if tree is not None:
                tree[parts[at] + parts[at + 1]] = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, i: int) -> tuple[list, list]:
        """(piece, weight of the merge that uses it up) from the whole piece to its last and first character."""
        found = self.spines.get(i)
        if found is None:
            tree: dict = {}
            self._merge(self.pieces[i], tree)
            sides = []
            for side in (1, 0):
                name, used_up, spine = self.pieces[i], float("inf"), []
                while True:
                    spine.append((name, used_up))
                    if name not in tree:
                        break
                    used_up = -self.scores[self.ids[name]]
                    name = tree[name][side]
                sides.append(spine)
            found = self.spines[i] = tuple(sides)
        return found

    def _may_follow(self, left: int, right: int) -> bool:
        ids, scores = self.ids, self.scores
        for x, x_used in self._spine(left)[0]:
            for y, y_used in self._spine(right)[1]:
                i = ids.get(x + y)
                # A merge over the seam wins if it comes before x is used up, and not after y is.
                if i is not None and -scores[i] < x_used and -scores[i] <= y_used:
                    return False
        return True

    # --- shortest paths ----------------------------------------------------------------------------
    def _fallback(self, char: str) -> tuple[int, ...]:
        if self.bytes:
            return tuple(self.bytes[b] for b in char.encode("utf-8", "replace"))
        return (self.unknown,)

    def path(self, segment: str) -> tuple[int, ...]:
        """The ids on the shortest path of a segment."""
        n = len(segment)
        far = float("inf")
        cost = [far] * (n + 1)
        cost[0] = 0.0
        last: list = [None] * (n + 1)  # arc on the best path to a state
        came = [0] * (n + 1)
        start, scores, bpe, seams = self.arcs, self.scores, self.bpe, self.follows
        for i in range(n):
            here = cost[i]
            if here == far:
                continue
            before = last[i]
            known = None
            if bpe and before.__class__ is int:
                known = seams.get(before)
                if known is None:
                    known = seams[before] = {}
            node = start
            for j in range(i, n):
                node = node.get(segment[j])
                if node is None:
                    break
                arc = node.get("")
                if arc is None:
                    continue
                weight = here - scores[arc]
                if weight < cost[j + 1]:
                    if known is not None:
                        passes = known.get(arc)
                        if passes is None:
                            passes = known[arc] = self._may_follow(before, arc)
                        if not passes:
                            continue
                    cost[j + 1], last[j + 1], came[j + 1] = weight, arc, i
            if here + self.unknown_cost < cost[i + 1] and "" not in start.get(segment[i], ()):
                cost[i + 1], last[i + 1], came[i + 1] = here + self.unknown_cost, self._fallback(segment[i]), i
        out: list = []
        at = n
        while at:
            arc = last[at]
            if arc.__class__ is int:
                out.append(arc)
            else:
                out.extend(reversed(arc))
            at = came[at]
        return tuple(reversed(out))

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return ((" " if self.dummy_prefix else "") + text).replace(" ", SPACE)

    def encode(self, text: str) -> list[int]:
        text = self.normalise(text)
        words = text.split(SPACE)
        if words[0] or "" in words[1:]:  # no mark in front, or several in a row
            return list(chain.from_iterable(map(self.paths.__getitem__, self.segments(text))))
        return list(chain.from_iterable(map(self.words.__getitem__, words[1:])))

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a word behind one space mark."""
        return tuple(chain.from_iterable(map(self.paths.__getitem__, self.segments(SPACE + word))))

    def decode(self, ids) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


class _Table(dict):
    """Paths of segments or words; computes what it lacks, and starts anew when full."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key: str) -> tuple[int, ...]:
        found = self.compute(key)
        if len(key) <= TABLE_LENGTH:
            if len(self) >= TABLE_SEGMENTS:
                self.clear()
            self[key] = found
        return found


_compiled: dict[int, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """The transducer of a model, compiled once in each worker."""
    key = hash(model)
    if key not in _compiled:
        _compiled[key] = Transducer(model)
    return _compiled[key]


def _ids_array(rows: list[list[int]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))))


def encode(docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """``doc_id, n_tokens, ids, n_byte_tokens, cost, round_trip``: the ids of each whole text.

    ``cost`` is the path's weight. The model file is read on the driver and sent with the tasks.
    """
    ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def run(batches):
        machine = compiled(model.value)
        for batch in batches:
            texts = batch.column(1)
            start = 0
            while start < len(texts):  # a few megabytes at a time, whole texts always
                rows, trips, size = [], [], 0
                while start + len(rows) < len(texts) and (not rows or size < BATCH_BYTES):
                    text = texts[start + len(rows)].as_py()
                    ids = machine.encode(text)
                    trips.append(machine.decode(ids) == text)
                    rows.append(ids)
                    size += len(text)
                lists = _ids_array(rows)
                lengths = np.array([len(r) for r in rows], np.int64)
                flat, owner = lists.values.to_numpy(), np.repeat(np.arange(len(rows)), lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(rows)),
                        pa.array(lengths),
                        lists,
                        pa.array(np.bincount(owner, machine.is_byte[flat], len(rows)).astype(np.int64)),
                        pa.array(np.bincount(owner, machine.cost[flat], len(rows))),
                        pa.array(trips, pa.bool_()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "n_byte_tokens", "cost", "round_trip"],
                )
                start += len(rows)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids array<int>, n_byte_tokens long, cost double, round_trip boolean"
    )


def decode(frame: DataFrame, ids: str = "ids", output: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """The frame with the text of its id lists; a null list gives a null text."""
    ship_package(frame.sparkSession)
    model = frame.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def run(batches):
        machine = compiled(model.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = pa.array([None if x is None else machine.decode(x) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, output])

    schema = StructType([*frame.schema.fields, StructField(output, StringType())])
    return frame.withColumn(ids, F.col(ids).cast("array<int>")).mapInArrow(run, schema)
