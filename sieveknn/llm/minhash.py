"""Near duplicates by MinHash: an inverted join of signature coordinates, confirmed on full sets.

A document's set holds its distinct word shingles (64-bit hashes). Of 48 minima, two sets with Jaccard index
0.85 agree in 28 or more but for 1.8 pairs in a million (``matches_for``, five standard deviations below the mean; at
0.80 it is 24, missed by 0.8 in a million); so each document is posted under the ``48 - 28 + 1`` rarest of its (coordinate, value) pairs, and any two
that agree in 28 meet in one of those lists. Coordinates that no other document has come first in that order and are never
joined.

1. Documents with the same set are one; the smallest id represents them.
2. In each list every member meets the list's hub, the member whose values are most common. Pairs are
   counted for collisions, then confirmed by the intersection of their sets. That settles most groups
   of copies, with as many pairs as members.
3. Lists that still hold several components are finished exactly: numpy counts the collisions of their
   members, block by block, and members that may link to another component are compared on their
   full sets. A block gives the edges that unite components, at most one for each, never all pairs.

* Null and empty texts have an empty set and link with nothing. Fewer words than a shingle make one shingle.
* ``near_groups`` goes by ids: rows that share one are one node of the graph. Rows without an id are never
  representatives; they take the component of an equal set, else none, and are not marked as kept.
* ``keep_one`` goes by texts: a row without an id, or whose id stands on several texts, gets a number made of id and text,
  above all usual ids. So nothing goes because another text of its id goes. Of equal rows (id and text) one stays.
* No rows give no rows; further columns are ignored by ``near_groups`` and kept by ``keep_one``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveknn.llm.common import stored, whole_text
from sieveknn.llm.components import connected
from sieveknn.session import ship_package

COORDINATES = 48
PERCENT = 85  # 100 * intersection >= PERCENT * union
SHINGLE = 3
BLOCK = 2048  # members of a list that are compared at a time
GROUP_ROWS = 20_000  # rows of short lists that one call takes together
MAX_BROADCAST_IDS = 2_000_000

_U = np.uint64
_seeds = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, size=(2, COORDINATES), dtype=np.uint64)
_ADD, _TIMES = _seeds[0], _seeds[1] | _U(1)


def matches_for(percent: int) -> int:
    """Collisions that a pair at the threshold has almost surely: five standard deviations below the mean."""
    p = percent / 100
    return max(1, math.floor(COORDINATES * p - 5 * math.sqrt(COORDINATES * p * (1 - p))))


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit numbers."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text in UTF-8; ``bytes.lower`` and ``split`` know ASCII only."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        out = _mixed(out + h[k : k + n] + _U(k + 1))
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each coordinate's hash, as int32."""
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        best = np.minimum(best, (((part[None, :] ^ _ADD[:, None]) * _TIMES[:, None]) >> _U(32)).min(axis=1))
    return best.astype(np.uint32).view(np.int32)


def _sums(shingles: np.ndarray) -> tuple[int, int]:
    """Two sums that name a set."""
    return int(shingles.sum(dtype=np.uint64).view(np.int64)), int(_mixed(shingles ^ _U(0x5DEECE66D)).sum(dtype=np.uint64).view(np.int64))


def _texts(column: pa.Array):
    return (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column.cast(pa.binary()))


def sign(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, n, sa, sb, sig`` of every document: set size, the set's name and its signature."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            n, names, sigs = [], [], []
            for text in _texts(batch.column(1)):
                found = shingle_set(text, size)
                n.append(len(found))
                names.append(_sums(found))
                sigs.append(signature(found))
            flat = np.concatenate(sigs) if sigs else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array([x for x, _ in names], pa.int64()),
                    pa.array([x for _, x in names], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * COORDINATES, pa.int32()), pa.array(flat)),
                ],
                names=["doc_id", "n", "sa", "sb", "sig"],
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return plain.mapInArrow(run, "doc_id long, n long, sa long, sb long, sig array<int>")


def full_sets(docs: DataFrame, ids: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``rep, shingles`` of the documents in ``ids(rep)``; the ids are broadcast while they are few."""
    plain = docs.select(F.col("doc_id").cast("long").alias("rep"), whole_text().alias("text"))
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    chosen = plain.join(F.broadcast(ids) if few else ids, "rep", "left_semi")

    def run(batches):
        for batch in batches:
            sets = [shingle_set(text, size).view(np.int64) for text in _texts(batch.column(1))]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            values = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))], names=["rep", "shingles"]
            )

    return chosen.mapInArrow(run, "rep long, shingles array<long>")


def _prefixes(reps: DataFrame, matches: int) -> DataFrame:
    """``rep, n, weight, i, v``: the rarest coordinates of each representative that others have, too.

    ``weight`` sums the logarithms of its lists' lengths; it is largest in the middle of a group.
    """
    posted = reps.select("rep", "n", F.posexplode("sig").alias("i", "v"))
    lists = stored(posted.groupBy("i", "v").agg(F.count("*").alias("f")).where("f > 1"), "near-lists")
    ranked = (
        posted.join(lists, ["i", "v"])
        .groupBy("rep", "n")
        .agg(F.array_sort(F.collect_list(F.struct("f", "i", "v"))).alias("shared"), F.sum(F.log("f")).alias("weight"))
    )
    room = F.size("shared") - F.lit(matches - 1)  # what the prefix holds besides coordinates of one document only
    prefix = ranked.where(room > 0).select("rep", "n", F.round("weight", 6).alias("weight"), F.explode(F.slice("shared", 1, room)).alias("e"))
    return prefix.select("rep", "n", "weight", "e.i", "e.v")


def _star_links(docs: DataFrame, reps: DataFrame, prefix: DataFrame, percent: int, size: int) -> DataFrame:
    """``a, b``: confirmed links of members with the hubs of their lists."""
    hubs = prefix.groupBy("i", "v").agg(F.max(F.struct("weight", (-F.col("rep")).alias("m"), "n")).alias("h"), F.count("*").alias("f")).where("f > 1")
    hubs = stored(hubs.select("i", "v", (-F.col("h.m")).alias("b"), F.col("h.n").alias("nb")), "near-hubs")
    fits = (F.col("rep") != F.col("b")) & (100 * F.least("n", "nb") >= percent * F.greatest("n", "nb"))
    pairs = stored(prefix.join(hubs, ["i", "v"]).where(fits).select(F.col("rep").alias("a"), "b").distinct(), "near-pairs")
    one = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa"))
    two = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    likely = stored(pairs.join(one, "a").join(two, "b").where(equal >= matches_for(percent)).select("a", "b"), "near-likely")
    ids = likely.select(F.col("a").alias("rep")).unionByName(likely.select(F.col("b").alias("rep"))).distinct()
    sets = stored(full_sets(docs, stored(ids, "near-ids"), size), "near-sets")
    left = likely.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    # No distinct here: it would hold all rows of a hub together, and Spark could not split them.
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _in_blocks(members: DataFrame, total: int) -> DataFrame:
    """Members with ``g`` and ``blk``: short lists many to a group, long ones by pairs of blocks."""
    groups = max(1, -(-total // GROUP_ROWS)) * 4
    blocks = F.ceil(F.col("f") / F.lit(BLOCK)).cast("int")
    blk = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    short = F.concat(F.lit("s:"), F.pmod(F.xxhash64("i", "v"), F.lit(groups)))
    pair = lambda y: F.concat_ws(":", F.lit("l"), "i", "v", F.least("blk", y), F.greatest("blk", y))
    marked = members.withColumn("blk", blk).withColumn("blocks", blocks)
    group = F.when(F.col("blocks") == 1, F.array(short)).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair))
    return marked.withColumn("g", F.explode(group)).drop("blocks")


def _lists(frame: pd.DataFrame):
    """The rows of each list of a group, as index arrays."""
    order = np.lexsort((frame["v"].to_numpy(), frame["i"].to_numpy()))
    i, v = frame["i"].to_numpy()[order], frame["v"].to_numpy()[order]
    cuts = np.flatnonzero((i[1:] != i[:-1]) | (v[1:] != v[:-1])) + 1
    return [part for part in np.split(order, cuts) if len(part) > 1]


def _across(frame: pd.DataFrame, rows: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of a list's rows are worth comparing: other components, like sizes, other blocks if there are two."""
    label, n, blk = (frame[c].to_numpy()[rows] for c in ("label", "n", "blk"))
    open_pairs = label[:, None] != label[None, :]
    open_pairs &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    if blk.min() != blk.max():
        open_pairs &= blk[:, None] != blk[None, :]
    return open_pairs


def _finish(docs: DataFrame, reps: DataFrame, prefix: DataFrame, labels: DataFrame, percent: int, size: int) -> DataFrame:
    """``a, b``: links that unite components which the hubs left apart."""
    known = prefix.select("rep", "n", "i", "v").join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left")
    known = stored(known.withColumn("label", F.coalesce("label", "rep")), "near-known")
    lists = known.groupBy("i", "v").agg(
        F.count("*").alias("f"), F.min("label").alias("low"), F.max("label").alias("high"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("who")
    )
    # Lists of the same members are worth one comparison.
    lists = lists.where("low < high").groupBy("f", "who").agg(F.min(F.struct("i", "v")).alias("k")).select("k.i", "k.v", "f")
    lists = stored(lists, "near-open")
    members = stored(known.join(lists, ["i", "v"]), "near-members")
    total = members.count()
    ship_package(docs.sparkSession)
    matches = matches_for(percent)

    def likely(frame: pd.DataFrame) -> pd.DataFrame:
        flagged = []
        for rows in _lists(frame):
            pairs = _across(frame, rows, percent)
            if not pairs.any():
                continue
            sigs = np.stack(frame["sig"].to_numpy()[rows])
            step = max(1, (1 << 23) // (len(rows) * COORDINATES))
            hit = np.zeros(len(rows), bool)
            for at in range(0, len(rows), step):
                equal = (sigs[at : at + step, None, :] == sigs[None, :, :]).sum(axis=2, dtype=np.int16) >= matches
                equal &= pairs[at : at + step]
                hit[at : at + step] |= equal.any(axis=1)
                hit |= equal.any(axis=0)
            flagged.append(rows[hit])
        chosen = np.concatenate(flagged) if flagged else np.empty(0, np.int64)
        return frame.iloc[chosen][["i", "v", "rep", "n", "label"]]

    signed = members.join(reps.select("rep", "sig"), "rep")
    found = _in_blocks(signed, total).groupBy("g").applyInPandas(likely, "i int, v int, rep long, n long, label long").distinct()
    found = stored(found, "near-flagged")
    sizes = stored(found.groupBy("i", "v").agg(F.count("*").alias("f")), "near-sizes")
    ids = stored(found.select("rep").distinct(), "near-ids")
    rows = found.join(sizes, ["i", "v"]).join(full_sets(docs, ids, size), "rep")

    def confirmed(frame: pd.DataFrame) -> pd.DataFrame:
        edges = []
        for rows in _lists(frame):
            sets = [np.asarray(frame["shingles"].iloc[r], np.int64) for r in rows]
            inter = intersections(sets)
            n = np.array([len(s) for s in sets])
            linked = 100 * inter >= percent * (n[:, None] + n[None, :] - inter)
            linked &= _across(frame, rows, percent)
            root: dict[int, int] = {}
            rep, label = frame["rep"].to_numpy()[rows], frame["label"].to_numpy()[rows]

            def find(x: int) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, y in zip(*np.nonzero(np.triu(linked)), strict=True):
                one, two = find(int(label[x])), find(int(label[y]))
                if one != two:
                    root[max(one, two)] = min(one, two)
                    edges.append((int(rep[x]), int(rep[y])))
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return _in_blocks(rows, total).groupBy("g").applyInPandas(confirmed, "a long, b long").distinct()


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over the values of two sets or more."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[value]
    owner, column = owner[keep], number[value[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    total, width = int(shared.sum()), 4096
    for at in range(0, total, width):
        low, high = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), min(width, total - at)), np.float32)
        part[owner[low:high], column[low:high] - at] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _components(docs: DataFrame, percent: int, size: int) -> tuple[DataFrame, DataFrame]:
    """The stored signatures of all documents, and ``n, sa, sb, component_id`` of all sets."""
    signed = stored(sign(docs, size), "near-signed")
    reps = signed.where("n > 0 and doc_id is not null").groupBy("n", "sa", "sb").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    reps = stored(reps, "near-reps")
    prefix = stored(_prefixes(reps, matches_for(percent)), "near-prefix")
    links = stored(_star_links(docs, reps, prefix, percent, size), "near-links")
    more = stored(_finish(docs, reps, prefix, connected(links), percent, size), "near-more")
    labels = connected(links.unionByName(more))
    sets = reps.select("n", "sa", "sb", "rep").join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left")
    return signed, stored(sets.select("n", "sa", "sb", F.coalesce("label", "rep").alias("component_id")), "near-components")


def _with_component(rows: DataFrame, sets: DataFrame) -> DataFrame:
    found = rows.where("n > 0").join(sets, ["n", "sa", "sb"], "left")
    alone = rows.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return found.unionByName(alone)


def near_groups(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    signed, sets = _components(docs, percent, size)
    return _with_component(signed.select("doc_id", "n", "sa", "sb"), sets).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a number that names one text: the id, where it does so already."""
    texts = docs.select("doc_id", F.xxhash64(whole_text()).alias("th")).where("doc_id is not null")
    several = texts.groupBy("doc_id").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a < b").select("doc_id")
    several = stored(several, "near-several")
    made = F.pmod(F.xxhash64("doc_id", whole_text()), F.lit(1 << 62)) + F.lit(1 << 62)
    if several.isEmpty():
        return docs.withColumn(name, F.when(F.col("doc_id").isNull(), made).otherwise(F.col("doc_id").cast("long")))
    twice = docs.join(several, "doc_id", "left_semi").withColumn(name, made)
    once = docs.join(several, "doc_id", "left_anti")
    once = once.withColumn(name, F.when(F.col("doc_id").isNull(), made).otherwise(F.col("doc_id").cast("long")))
    return once.unionByName(twice.select(*[F.col(f"`{c}`") for c in once.columns]))


def keep_one(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One document of each component, the one with the smallest number, with all columns."""
    name = "number"
    while name in docs.columns:
        name += "_"
    rows = _numbered(docs, name)
    signed, sets = _components(rows.select(F.col(name).alias("doc_id"), "text"), percent, size)
    found = _with_component(signed.select("doc_id", "n", "sa", "sb"), sets)
    dropped = stored(found.where("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct(), "near-dropped")
    few = dropped.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    left = rows.join(F.broadcast(dropped) if few else dropped, name, "left_anti")
    again = stored(signed.groupBy(F.col("doc_id").alias(name)).count().where("count > 1").select(name), "near-again")
    if not again.isEmpty():
        repeated = left.join(again, name, "left_semi").dropDuplicates([name])
        left = left.join(again, name, "left_anti").unionByName(repeated)
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
