import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sieveknn.llm import exact
from sieveknn.llm.common import LOWER, UPPER

from corpus_rows import messy_rows

TABLE = str.maketrans(UPPER, LOWER)


def expected():
    groups = defaultdict(list)
    for doc_id, text, *_ in messy_rows():
        groups[(text or "").translate(TABLE)].append(doc_id)
    return groups


@pytest.mark.parametrize(
    "settings",
    [{}, {"capacity": 4}, {"capacity": 2, "key_bits": 3}, {"capacity": 4, "hot_rows": 1}, {"capacity": 2, "key_bits": 2, "hot_rows": 2}],
    ids=["plain", "many buckets", "collisions", "hot keys", "hot keys and collisions"],
)
def test_against_brute_force(messy, settings):
    rows = exact.exact_groups(messy, **settings).collect()
    want = []
    for norm, ids in expected().items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))


def test_entries_form_chains_in_buckets_of_one_owner(messy):
    index = exact.build_index(messy, capacity=2, key_bits=3)
    entries = index.entries.withColumn("file", F.input_file_name()).collect()
    assert len(entries) == len(expected())
    chains, owners = defaultdict(list), defaultdict(set)
    for e in entries:
        chains[(e.bucket, e.key)].append((e.chain, bytes(e.sha)))
        owners[e.bucket].add(e.file)
    assert max(map(len, chains.values())) > 1 and len(chains) <= 8
    for chain in chains.values():
        assert [n for n, _ in sorted(chain)] == list(range(1, len(chain) + 1)) and len({sha for _, sha in chain}) == len(chain)
    assert all(len(files) == 1 for files in owners.values())


def test_keep_one_leaves_one_whole_row_of_each_text(messy):
    kept = exact.keep_one(messy).collect()
    assert kept[0].asDict().keys() == set(messy.columns)
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(max((i for i in ids if i is not None), default=None)) for ids in expected().values())


def test_directory_doubles_until_buckets_fit(spark):
    keys = spark.range(4000).selectExpr("xxhash64(id) as key")
    directory = exact.build_directory(keys, capacity=80)
    assert directory.depth >= 6
    slots = {r.slot: r for r in directory.slots.collect()}
    fill, slot_fill = defaultdict(int), defaultdict(int)
    for row in keys.collect():
        slot = (row.key % (1 << 64)) >> (64 - directory.depth)
        fill[slots[slot].bucket] += 1
        slot_fill[slot] += 1
    assert max(fill.values()) <= 80 and directory.least == min(r.local for r in slots.values()) < directory.depth
    for slot, (_, local, bucket) in slots.items():
        # A bucket of local depth d is named by the first of its 2 ** (depth - d) slots; its half would not have to be split.
        spare = directory.depth - local
        assert bucket == slot >> spare << spare
        if local:
            parent = [n for s, n in slot_fill.items() if s >> spare + 1 == slot >> spare + 1]
            assert sum(parent) > 80


def test_the_depth_grows_with_keys_that_share_their_first_bits(spark):
    keys = spark.range(64).selectExpr("id as key")
    directory = exact.build_directory(keys, capacity=16)
    assert directory.depth == 60 and sorted({r.local for r in directory.slots.collect()}) == [60]
    assert exact.build_directory(keys, capacity=64).depth == 0


def test_a_hot_key_is_dealt_to_many_owners(spark):
    rows = [(i, "Same Text" if i % 3 else f"text {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in exact.exact_groups(docs, capacity=16, hot_rows=25).collect()}
    assert {(r.keep_id, r.group_size) for i, r in found.items() if i % 3} == {(599, 400)}
    assert all(r.keep_id == i and r.kept for i, r in found.items() if i % 3 == 0)


def test_nothing(nothing):
    assert exact.exact_groups(nothing).count() == 0 and exact.keep_one(nothing).count() == 0
