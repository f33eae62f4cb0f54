"""Repeated passages: maximal repeats of 50 bytes or more, and texts without what an earlier document has.

No suffix array of the whole corpus is ever in one place. Every 50-byte window has a key, the smallest hash of the
24-byte strings in it; equal windows have equal keys, so windows are dealt by key, and neighbours with the same key
travel as one record.

1. Keys alone are dealt first, one for some fourteen bytes; only those that two documents have go on.
2. Their records go to the task of the key. It sorts its windows into an enhanced suffix array and scans it with a
   stack for common-prefix intervals. An interval whose occurrences have different bytes in front (left
   diverse) is a maximal repeat, output with all its occurrences.
3. A window is removed if its interval holds a smaller ``doc_id``; the spans go back to their documents.

Repeats within one task's rows are settled there: of equal keys or records one travels, so a passage that
a third of all documents share costs one record for each task. Documents with the same text are
represented by the one with the smallest id.

* A null text is empty; texts below 50 bytes have no window. A null id counts as larger than any other, and
  such rows remove nothing from each other.
* Repeated rows (same id and text) get equal results. Further columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveknn.llm.common import stored, whole_text
from sieveknn.llm.suffixes import GRAM, LENGTH, SuffixArray, pack, split_rows, unpack, window_runs
from sieveknn.session import ship_package

_LAST = (1 << 63) - 1
GROUP_BYTES = 3 << 20  # text behind a task's group of keys, and in a block of documents
SLICE_BYTES = 6 << 20  # text whose keys are sorted together
MAX_BROADCAST_IDS = 2_000_000
_KEY_KINDS = (np.uint32, np.uint16, np.int64, np.int64, np.uint32, np.uint8)
_SPAN_KINDS = (np.int64, np.uint32, np.uint32)
_RECORD_KINDS = (np.int64, np.int64, np.uint32, np.uint32, np.uint32)


def _rows(docs: DataFrame, parts: int) -> DataFrame:
    """``doc_id, did, rid, copy, blk, data``: ``copy`` marks a text that a smaller id has, ``rid`` names id and text."""
    text = whole_text()
    plain = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("did"), text.cast("binary").alias("data"), F.sha2(text.cast("binary"), 256).alias("sha")
    ).withColumn("rid", F.xxhash64("did", "sha"))
    groups = plain.groupBy("sha").agg(F.min("did").alias("low"), F.max("did").alias("high")).where("low < high")
    groups = stored(groups.select("sha", "low"), "repeat-groups")
    copies = stored(plain.select("did", "rid", "sha").join(groups, "sha").where("did > low").select("rid").distinct(), "repeat-copies")
    few = copies.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    marked = copies.withColumn("copy", F.lit(True))
    return (
        plain.drop("sha")
        .join(F.broadcast(marked) if few else marked, "rid", "left")
        .select("doc_id", "did", "rid", F.coalesce("copy", F.lit(False)).alias("copy"), F.pmod("rid", F.lit(parts)).cast("int").alias("blk"), "data")
    )


def _frame(rows: list[tuple[int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame({"part": np.array([r for r, _ in rows], np.int32), "blob": [b for _, b in rows]})


def _send_keys(parts: int):
    """Step 1, on the documents' side: blobs of (key, did, rid, first, settled) for the tasks of the keys."""

    def run(batches):
        for batch in slices(batches):
            found = [window_runs(x.as_buffer().to_pybytes()) for x in batch.column(2)]
            n = np.array([len(k) for k, _, _ in found])
            if not n.sum():
                continue
            did, rid = (np.repeat(batch.column(c).to_numpy(), n) for c in (0, 1))
            key, first = (np.concatenate([f[c] for f in found]) for c in (0, 1))
            order = np.lexsort((did, key))
            key, did, rid, first = key[order], did[order], rid[order], first[order].astype(np.uint32)
            new = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.cumsum(new) - 1
            at = np.flatnonzero(new)
            several = (np.maximum.reduceat(did, at) > np.minimum.reduceat(did, at))[group]
            # A key that several documents here have is settled; one of them tells the other tasks.
            part = np.where(several & ~new, np.abs(rid) % parts, (key % np.uint64(parts)).astype(np.int64))
            state = several.astype(np.uint8) + (several & ~new)
            # 48 bits of a key do beside the part it is in: by chance equal ones are told apart by their bytes later.
            columns = (key.astype(np.uint32), (key >> np.uint64(32)).astype(np.uint16), did, rid, first, state)
            # In the order of the documents, so that what is constant in one packs well.
            rows = [(p, pack(*(c[i[np.argsort(order[i])]] for c in columns))) for p, i in split_rows(part)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["part", "blob"])

    return run


def slices(batches):
    """The batches in pieces of a few megabytes of their third column; a long text is a piece of its own."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def _shared_keys(blocks: int):
    """Step 1, on the keys' side: blobs of (rid, first) for the blocks of documents."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        low, high, did, rid, first, state = (np.concatenate(c) for c in zip(*(unpack(b, *_KEY_KINDS) for b in frame["blob"]), strict=True))
        key = low.astype(np.int64) | high.astype(np.int64) << 32
        chosen = state > 0
        compare = np.flatnonzero(state < 2)
        if len(compare):
            compare = compare[np.lexsort((did[compare], key[compare]))]
            k, d = key[compare], did[compare]
            new = np.concatenate([[True], k[1:] != k[:-1]])
            at = np.flatnonzero(new)
            chosen[compare] |= (np.maximum.reduceat(d, at) > np.minimum.reduceat(d, at))[np.cumsum(new) - 1]
        rid, first = rid[chosen], first[chosen]
        return _frame([(p, pack(rid[i], first[i])) for p, i in split_rows(rid % blocks)])

    return run


def _send_records(parts: int, settle: bool, context: int):
    """Step 2, on the documents' side: the bytes of runs with shared keys, for the tasks of the keys.

    With ``settle``, of equal records here only the one of the smallest id travels with its bytes.
    """

    def run(docs: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(docs) or not len(wanted):
            return _frame([])
        rid, first = (np.concatenate(c) for c in zip(*(unpack(b, np.int64, np.uint32) for b in wanted["blob"]), strict=True))
        by_row = dict(split_rows(rid))
        seen: dict[bytes, int] = {}
        out: list[tuple] = []  # part, did, rid, first, windows, size, bytes; no bytes: settled here
        docs = docs.drop_duplicates("rid").sort_values("did", kind="stable")
        for did, row, data in zip(docs["did"].tolist(), docs["rid"].tolist(), docs["data"], strict=True):
            mine = by_row.get(row)
            if mine is None:
                continue
            keys, starts, ends = window_runs(data)
            for k in np.searchsorted(starts, np.unique(first[mine])).tolist():
                a, b = int(starts[k]), int(ends[k])
                piece = data[a : b + LENGTH - 1 + context]
                # The byte in front goes along, for the test of left diversity.
                if settle and seen.setdefault(piece, did) < did:
                    out.append((abs(row) % parts, did, row, a, b - a, 0, b""))
                else:
                    out.append((int(keys[k] % np.uint64(parts)), did, row, a, b - a, len(piece), (data[a - 1 : a] if a else b"\0") + piece))
        part = np.array([x[0] for x in out], np.int64)
        rows = []
        for p, i in split_rows(part) if len(part) else ():
            mine = [out[k] for k in i]
            head = pack(*[np.array([x[c] for x in mine], kind) for c, kind in enumerate(_RECORD_KINDS, start=1)])
            body = pack(np.frombuffer(b"".join(x[6] for x in mine), np.uint8))
            rows.append((p, len(head).to_bytes(4, "little") + head + body))
        return _frame(rows)

    return run


def _records(frame: pd.DataFrame):
    """Columns (did, rid, first, windows, size) of the records, and their bytes, each with one in front."""
    columns, bodies = [], []
    for blob in frame["blob"]:
        size = int.from_bytes(blob[:4], "little")
        columns.append(unpack(blob[4 : 4 + size], *_RECORD_KINDS))
        bodies.append(unpack(blob[4 + size :], np.uint8)[0])
    return [np.concatenate(c) for c in zip(*columns, strict=True)], np.concatenate(bodies)


def _build(columns, body, reach: int = LENGTH + GRAM) -> tuple[SuffixArray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of the records with bytes; did and rid of its records, and the byte in front of each window."""
    did, rid, first, count, size = columns
    keep = size > 0
    did, rid, first, count, size = did[keep], rid[keep], *(c[keep].astype(np.int64) for c in (first, count, size))
    begin = np.cumsum(size + 1) - size
    array = SuffixArray(body, begin, size, count, reach)
    front = body[begin[array.record] + array.offset - 1]
    return array, did, rid, np.stack([first[array.record] + array.offset, front.astype(np.int64)])


def _scan_spans(blocks: int):
    """Step 3: blobs of (rid, first, behind), the removed bytes, for the blocks of documents."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        columns, body = _records(frame)
        _, rid0, first0, count0, size0 = columns
        settled = size0 == 0
        spans = [(rid0[settled], first0[settled].astype(np.int64), first0[settled].astype(np.int64) + count0[settled] + LENGTH - 1)]
        if (~settled).any():
            array, did, rid, place = _build(columns, body)
            owner = did[array.record][array.order]
            removed = np.zeros(len(array.order), bool)
            edge = behind = -1
            # Parents come after their children; the outermost interval holds all windows with the same 50 bytes.
            for _, low, high in reversed(array.intervals(LENGTH)):
                if edge <= low and high <= behind:
                    continue
                edge, behind = low, high
                mine = owner[low:high]
                removed[low:high] = mine > mine.min()
            windows = np.sort(array.order[removed])
            if len(windows):
                record, at = array.record[windows], place[0][windows]
                cut = np.flatnonzero((record[1:] != record[:-1]) | (at[1:] != at[:-1] + 1)) + 1
                starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
                spans.append((rid[record[starts]], at[starts], at[ends] + LENGTH))
        row, a, b = (np.concatenate(c) for c in zip(*spans, strict=True))
        return _frame([(p, pack(row[i], a[i].astype(np.uint32), b[i].astype(np.uint32))) for p, i in split_rows(row % blocks)])

    return run


def _scan_repeats(reach: int):
    """Left-diverse intervals with all their occurrences."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        columns, body = _records(frame)
        out = []
        if (columns[4] > 0).any():
            array, did, rid, (place, front) = _build(columns, body, reach)
            for length, low, high in array.intervals(LENGTH):
                members = array.order[low:high]
                if len(np.unique(front[members])) > 1 or (place[members] == 0).any():
                    rows = array.record[members]
                    name = hashlib.sha256(body[_bytes_at(columns, members[0], array, length)].tobytes()).hexdigest()
                    out += [(name, length, int(d), int(r), int(s)) for d, r, s in zip(did[rows], rid[rows], place[members], strict=True)]
        return pd.DataFrame(out, columns=["repeat_sha256", "length", "did", "rid", "start"])

    return run


def _bytes_at(columns, window: int, array: SuffixArray, length: int) -> slice:
    size = columns[4][columns[4] > 0].astype(np.int64)
    begin = np.cumsum(size + 1) - size
    at = int(begin[array.record[window]] + array.offset[window])
    return slice(at, at + length)


def _finish(docs: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    by_row: dict[int, np.ndarray] = {}
    if len(spans):
        rid, a, b = (np.concatenate(c) for c in zip(*(unpack(x, *_SPAN_KINDS) for x in spans["blob"]), strict=True))
        by_row = dict(split_rows(rid))
    out = []
    for doc_id, row, copy, data in zip(docs["doc_id"].tolist(), docs["rid"].tolist(), docs["copy"].tolist(), docs["data"], strict=True):
        data = bytes(data)
        mine = by_row.get(row)
        cut: list[list[int]] = []
        if copy and len(data) >= LENGTH:
            cut = [[0, len(data)]]
        elif mine is not None:
            for x, y in sorted(zip(a[mine].tolist(), b[mine].tolist(), strict=True)):
                if cut and x <= cut[-1][1]:
                    cut[-1][1] = max(cut[-1][1], y)
                else:
                    cut.append([x, y])
        digest, at = hashlib.sha256(), 0
        for x, y in cut:
            digest.update(data[at:x])
            at = y
        digest.update(data[at:])
        out.append((doc_id, len(data), sum(y - x for x, y in cut), len(cut), digest.hexdigest()))
    frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def _partitions(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // GROUP_BYTES)


def _record_blobs(rows: DataFrame, parts: int, settle: bool = True, context: int = 0) -> DataFrame:
    first = rows.where("not copy")
    keys = first.select("did", "rid", "data").mapInArrow(_send_keys(parts), "part int, blob binary")
    shared = keys.groupBy("part").applyInPandas(_shared_keys(parts), "part int, blob binary")
    dealt = rows.select("blk", "doc_id", "did", "rid", "copy", "data").groupBy("blk")
    return dealt.cogroup(shared.groupBy("part")).applyInPandas(_only_first(_send_records(parts, settle, context)), "part int, blob binary")


def _only_first(send):
    """Copies of a text are dealt with the documents, so that the last step finds the same exchange; they send nothing."""

    def run(docs: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        return send(docs[~docs["copy"]] if len(docs) else docs, wanted)

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    ship_package(docs.sparkSession)
    parts = _partitions(docs)
    rows = _rows(docs, parts)
    spans = _record_blobs(rows, parts).groupBy("part").applyInPandas(_scan_spans(parts), "part int, blob binary")
    dealt = rows.select("blk", "doc_id", "did", "rid", "copy", "data").groupBy("blk")
    return dealt.cogroup(spans.groupBy("part")).applyInPandas(
        _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def maximal_repeats(docs: DataFrame, context: int = 200) -> DataFrame:
    """``repeat_sha256, length, doc_id, start``: left-diverse repeats of 50 bytes or more, a row for each occurrence.

    Lengths are those of the first ``LENGTH + context`` bytes; of a longer passage this is the beginning.
    Occurrences in equal texts are given for the smallest id. All occurrences of a passage meet in the
    task of its key, which ``remove_repeats`` does not need.
    """
    ship_package(docs.sparkSession)
    parts = _partitions(docs)
    found = _record_blobs(_rows(docs, parts), parts, False, context).groupBy("part").applyInPandas(
        _scan_repeats(LENGTH + context), "repeat_sha256 string, length int, did long, rid long, start long"
    )
    return found.select("repeat_sha256", "length", F.when(F.col("did") < _LAST, F.col("did")).alias("doc_id"), "start").distinct()
