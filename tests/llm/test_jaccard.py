import random

import numpy as np
import pytest
from helpers import documents, slow_components

from orrery.llm import jaccard
from orrery.llm.common import split_by_ids, without_ids
from orrery.llm.graph import components


def near_copies(seed, groups=12, words=80):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out, i = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 12, words, 3 * words]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append((i, rng.choice([" ", "\n", "  "]).join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
            i += 1
    rng.shuffle(out)
    return [*out, (1000, None), (1001, ""), (1002, " \n"), (1003, "Solo"), (1004, "solo"), (1005, "a b")]


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (2, 70)])
def test_equals_brute_force(spark, size, percent):
    pairs = near_copies(size * percent)
    docs = documents(spark, pairs).repartition(5).withColumnRenamed("source", "key")
    want = slow_components(pairs, size, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_components(docs, size, percent, count=True).collect()}
    assert got == want
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, size, percent).collect()}
    assert got == {i: x[:2] for i, x in want.items()}


def test_large_groups_in_blocks(spark, monkeypatch):
    pairs = near_copies(8, groups=6)
    monkeypatch.setattr(jaccard, "GROUP_SETS", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_components(documents(spark, pairs).repartition(4), 3, 80, count=True).collect()}
    assert got == slow_components(pairs, 3, 80)


def test_kept_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(6)
    common = np.unique(rng.integers(0, 1 << 63, 50).astype(np.uint64))
    for _ in range(300):
        n = int(rng.integers(2, 300))
        a = np.unique(np.concatenate([rng.integers(0, 1 << 63, n).astype(np.uint64), rng.choice(common, 5)]))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.06], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(a) // 20))).astype(np.uint64)]))
        if len(b) and jaccard.linked(a, b, 80) and not np.array_equal(a, b):
            small, edges = min(len(a), len(b)), jaccard.bands(80)
            band = int(np.searchsorted(edges, small, "right")) - 1
            assert np.intersect1d(jaccard.signatures(a, common, 80, band), jaccard.signatures(b, common, 80, band)).size
            assert int(np.searchsorted(edges, max(len(a), len(b)), "right")) - 1 - band in (0, 1)


def test_rows_without_or_with_the_same_id(spark):
    text = " ".join(f"x{i}" for i in range(30))
    docs = documents(spark, [(None, text), (4, text), (4, text), (2, text), (7, None), (8, "other"), (None, "alone")])
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard.jaccard_components(docs, 3, 90).collect())
    assert got == [(-1, -1), (-1, 2), (2, 2), (4, 2), (4, 2), (7, 7), (8, 8)]
    kept = jaccard.drop_near_copies(documents(spark, [(4, text), (2, text), (2, text), (7, None), (7, None), (8, "other"), (None, "alone")]))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 7, 8]
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, one_task):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900 + i) for i in range(60)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
    assert got == {n: find(n) for n in root if find(n) != n}


def test_bitmap_split(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k").selectExpr("k", "k * 2 as v").union(spark.sql("select cast(null as bigint), 0L"))
    ids = spark.createDataFrame([(i,) for i in range(0, 300, 3)] + [(None,)], "doc_id long")
    maybe, clean = split_by_ids(rows, "k", ids)
    assert maybe.count() + clean.count() == 1001 and clean.where("k is null or (k < 300 and k % 3 = 0)").count() == 0 and maybe.count() < 250
    left = without_ids(rows, "k", ids)
    assert left.count() == 900 and left.columns == rows.columns
