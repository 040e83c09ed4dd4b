from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meridia.llm import decontaminate, jaccard_join, substring_dedup
from meridia.llm.components import connected_components
from tests.llm.conftest import prose, words_of


def shingle_set(text, k):
    w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components_by_force(rows, k, num, den):
    sets = {}
    for i, t in rows:
        sets[i] = shingle_set(t, k)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 4, 5)])
def test_components_equal_brute_force(docs, corpus, k, num, den):
    got = jaccard_join.jaccard_components(docs, k=k, threshold=(num, den)).collect()
    assert len(got) == docs.count()
    expected = components_by_force([(i, t) for i, t, *_ in corpus], k, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == expected
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_components_of_nothing(empty):
    assert jaccard_join.jaccard_components(empty).collect() == []


def test_keys_lose_no_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(4, 120))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = a.copy()
        for _ in range(int(rng.integers(1, max(2, n // 6)))):
            b[rng.integers(0, len(b))] = rng.integers(0, 2**63)
        b = np.unique(b[: len(b) - int(rng.integers(0, 2))])
        frequent = np.zeros(1 << (jaccard_join.SLOT_BITS - 3), np.uint8)
        slot = rng.choice(a, len(a) // 2, replace=False) >> np.uint64(64 - jaccard_join.SLOT_BITS)
        np.bitwise_or.at(frequent, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
        shared = len(np.intersect1d(a, b))
        if len(a) != len(b) or shared < len(a):
            if 5 * shared >= 4 * (len(a) + len(b) - shared):
                assert len(np.intersect1d(jaccard_join.prefix_keys(a, 4, 5, frequent), jaccard_join.prefix_keys(b, 4, 5, frequent)))
                assert len(np.intersect1d(jaccard_join.part_keys(a, 4, 5), jaccard_join.part_keys(b, 4, 5)))


def near_sets(groups, each, least, most, seed):
    """Groups of near copies: random sets, each with a few tokens changed."""
    rng, sets = np.random.default_rng(seed), []
    for _ in range(groups):
        base = rng.integers(0, 2**63, int(rng.integers(least, most)), dtype=np.uint64)
        for _ in range(each):
            v = base.copy()
            v[rng.integers(0, len(v), len(v) // 25)] = rng.integers(0, 2**63, len(v) // 25, dtype=np.uint64)
            sets.append(np.unique(v))
    return sets


def pairs_by_trees(sets, num, den, **more):
    size, packed = np.array([len(s) for s in sets]), [jaccard_join.signature(s, num, den) for s in sets]
    found = []
    for c, small in jaccard_join._same_width(size, num, den):
        for x, y in jaccard_join.tree_pairs(size[c], [packed[i] for i in c], num, den, **{k: v[c] if isinstance(v, np.ndarray) else v for k, v in more.items()}):
            here = small[x] | small[y]
            found += zip(c[x[here]].tolist(), c[y[here]].tolist(), strict=True)
    return found


def test_trees_leave_every_link_once():
    sets = near_sets(25, 8, 20, 200, 4)
    force = {(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(np.intersect1d(sets[i], sets[j])) >= 9 * len(np.union1d(sets[i], sets[j]))}
    assert force
    for num, den in ((1, 2), (4, 5)):
        assert {(max(p), min(p)) for p in pairs_by_trees(sets, num, den)} >= force
    pairs = pairs_by_trees(sets, 9, 10)
    left = {(max(p), min(p)) for p in pairs}
    assert len(left) == len(pairs) and left >= force
    xs, ys = (np.array(v) for v in zip(*pairs, strict=True))
    assert {(max(p), min(p)) for p in zip(*(v.tolist() for v in jaccard_join.linked_pairs(xs, ys, sets, 9, 10)), strict=True)} == force
    chunk = np.arange(len(sets)) % 2
    assert {(max(p), min(p)) for p in pairs_by_trees(sets, 9, 10, chunk=chunk)} >= {(i, j) for i, j in force if chunk[i] != chunk[j]}
    assert all(chunk[i] != chunk[j] for i, j in pairs_by_trees(sets, 9, 10, chunk=chunk))


def test_inner_nodes_prune():
    sets = [s for s in near_sets(60, 20, 100, 120, 5)]
    pruned: list[int] = []
    pairs = pairs_by_trees(sets, 9, 10, group=np.arange(len(sets)) // 20, pruned=pruned)
    assert sum(pruned[:-1]) > 0  # pairs of inner nodes
    leaves = len(sets) // jaccard_join.LEAF
    assert len(pairs) < 60 * 20 * 20 and sum(pruned) > leaves * leaves / 40


def test_labels_join_what_pairs_join():
    rng = np.random.default_rng(6)
    label, parent = np.arange(200), list(range(200))
    for _ in range(4):
        xs, ys = rng.integers(0, 200, (2, 40))
        label = jaccard_join.joined(label, xs, ys)
        for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
            a, b = parent[x], parent[y]
            parent = [min(a, b) if p in (a, b) else p for p in parent]
        assert label.tolist() == parent


def test_frequent_slots_come_last(spark):
    rows = [(i, f"one two three four five six w{i} x{i} y{i} z{i}") for i in range(5)]
    frequent = jaccard_join.frequent_slots(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 3, True)
    words = next(jaccard_join.words_of(pa.array(["one two three four five six", "w1 x1 y1 z1"])))
    held = [[int(frequent[int(t) >> 64 - jaccard_join.SLOT_BITS + 3] >> (int(t) >> 64 - jaccard_join.SLOT_BITS & 7) & 1) for t in s] for s in words.shingle_sets(3)]
    assert held == [[1] * 4, [0] * 2]


def test_rows_of_a_bitmap(spark):
    slots = [0, 1, 7, 8, 32767, 32768, 40000, (1 << jaccard_join.SLOT_BITS) - 1]
    df = spark.createDataFrame([(s, str(s)) for s in slots] + [(2, "2"), (9, "9"), (39999, "39999")], "slot long, text string")
    got = jaccard_join.in_blocks(df, jaccard_join.slot_blocks(df.where(F.col("slot").isin(slots)))).collect()
    assert sorted((r.slot, r.text) for r in got) == sorted((s, str(s)) for s in slots)


def test_thresholds_under_a_half_are_refused(empty):
    with pytest.raises(ValueError, match="1/2"):
        jaccard_join.jaccard_join(empty, threshold=(2, 5))


def test_large_clusters_are_cut_without_loss(docs, corpus, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", 2)
    got = jaccard_join.jaccard_components(docs.where("doc_id IS NOT NULL"), k=3, threshold=(90, 100)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_by_force([(i, t) for i, t, *_ in corpus], 3, 90, 100)


def links_by_force(rows, k, num, den):
    """Linked pairs of positions in rows."""
    sets = [shingle_set(t, k) for _, t in rows]
    return {(x, y) for x in range(len(rows)) for y in range(x) if sets[x] and sets[y] and den * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y])}


@pytest.fixture
def near_copies(spark, corpus):
    """The corpus, a group of near copies, one id with two texts, and a repeated row."""
    base = prose(random.Random(12), 150).split()
    near = [(500 + i, " ".join([*base[:i], "other", *base[i + 1 :]])) for i in range(0, 150, 9)]
    rows = [*[(i, t) for i, t, *_ in corpus], *near, (500, near[3][1]), (500, near[4][1] + " end"), near[5]]
    return rows, spark.createDataFrame([*rows, (None, near[0][1])], "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("chunk", [1024, 3])
def test_every_link_is_counted_once(near_copies, chunk, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    rows, df = near_copies
    links = links_by_force(rows, 3, 90, 100)
    n = Counter(x for pair in links for x in pair)
    expected = sorted((i, n[x]) for x, (i, _) in enumerate(rows))
    got = jaccard_join.jaccard_join(df, k=3, threshold=(90, 100)).collect()
    assert sorted((r.doc_id, r.n_links) for r in got if r.doc_id is not None) == expected
    assert [r.n_links for r in got if r.doc_id is None] == [None]
    same = {tuple(r) for r in jaccard_join.jaccard_components(df, k=3, threshold=(90, 100)).collect()}
    assert {tuple(r)[:3] for r in got} == same


def test_listed_links_equal_brute_force(near_copies, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", 3)
    rows, df = near_copies
    first = {}
    for i, t in rows:
        s = frozenset(shingle_set(t, 3))
        first[s] = min(i, first.get(s, i))
    copies = Counter(frozenset(shingle_set(t, 3)) for _, t in rows)
    expected = set()
    for x, y in links_by_force(rows, 3, 90, 100):
        s, t = (frozenset(shingle_set(rows[i][1], 3)) for i in (x, y))
        if s != t:
            (a, m), (b, n) = sorted([(first[s], copies[s]), (first[t], copies[t])])
            expected.add((a, b, m, n))
    got = [tuple(r) for r in jaccard_join.jaccard_links(df, k=3, threshold=(90, 100)).collect()]
    assert len(got) > 100 and set(got) == expected


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, 200), (200, 300), (300, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, 100: 100, 200: 100, 300: 100}


def dedup_by_force(rows, window):
    words = [words_of(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for at in range(len(w) - window + 1):
            if seen[tuple(w[at : at + window])] > 1:
                gone.update(range(at, at + window))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [1, 10, 35, 70])
def test_substring_dedup_equals_brute_force(docs, window):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, substring_dedup.substring_dedup(docs, window=window).collect()), key=str)
    assert got == dedup_by_force(rows, window)


def test_levels_double():
    assert substring_dedup.levels(35) == [18, 35]
    assert substring_dedup.levels(100) == [25, 50, 100]
    assert all(b <= 2 * a for n in range(1, 300) for a, b in zip(substring_dedup.levels(n)[:-1], substring_dedup.levels(n)[1:], strict=True))


def test_substring_dedup_of_nothing(empty):
    assert substring_dedup.substring_dedup(empty, window=10).collect() == []


@pytest.fixture
def items(spark, corpus):
    import random

    rng = random.Random(9)
    long = corpus[20][1].split()
    texts = [corpus[16][1], " ".join(long[5:40]), " ".join(long[5:30]) + " " + prose(rng, 4), prose(rng, 20), "one two", None, "", corpus[16][1]]
    return spark.createDataFrame([(100 + i, t, "z") for i, t in enumerate(texts)], "item_id long, text string, id string")


def test_contamination_equals_brute_force(docs, items):
    expected = []
    for d in docs.collect():
        for i in items.collect():
            short = len(words_of(i.text)) < 5
            want = shingle_set(i.text, 5)
            n = len(want & shingle_set(d.text, len(words_of(i.text)) if short and want else 5))
            if want and 5 * n >= 4 * len(want):
                expected.append((d.doc_id, i.item_id, n, len(want)))
    got = [tuple(r)[:4] for r in decontaminate.contaminated(docs, items).collect()]
    assert expected
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_dropping_contaminated_rows_in_blocks(docs, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    bad = {r.doc_id for r in decontaminate.contaminated(docs, items).collect()}
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id not in bad)


def test_contamination_of_nothing(docs, empty, items):
    assert decontaminate.contaminated(empty, items).collect() == []
    assert decontaminate.contaminated(docs, items.where("false")).collect() == []
    assert decontaminate.drop_contaminated(docs, items.where("false")).count() == docs.count()


@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_short_items_are_found_inside_long_documents(spark, kind):
    docs = spark.createDataFrame([(1, "so it goes on and ON. again"), (2, "goes it so"), (3, "on and on. and on"), (4, None), (5, "")], "doc_id int, text string")
    items = spark.createDataFrame([(str(i), t) for i, t in enumerate(["On and", "goes", "and on. and on", "not there", None, ""])], "item_id string, text string").withColumn("item_id", F.col("item_id").cast(kind))
    got = {(r.doc_id, str(r.item_id), r.n_shared, r.n_item) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, "0", 1, 1), (3, "0", 1, 1), (1, "1", 1, 1), (2, "1", 1, 1), (3, "2", 1, 1)}
    assert decontaminate.contaminated(docs, items).schema["item_id"].dataType == items.schema["item_id"].dataType
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()) == [4, 5]
