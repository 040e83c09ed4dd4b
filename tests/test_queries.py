"""Every query with SQL gives DuckDB's rows; the others are held against loops below."""

from __future__ import annotations

import math

import duckdb
import pytest

from meridia.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    relation = duck.sql(catalogue.ORACLE[name])
    assert sorted(relation.columns) == columns
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=str)
    expected = sorted((tuple(map(plain, r)) for r in relation.select(", ".join(f'"{c}"' for c in columns)).fetchall()), key=str)
    assert got == expected


def test_greedy_match(spark, sf_dir):
    from meridia.plans.join_queries import _pairs

    left = {}
    for r in sorted(_pairs(spark, sf_dir).where("a % 2 = 0 AND b % 2 = 1").collect(), key=lambda r: (-r.c, r.a, r.b)):
        used = left.setdefault(r.label, (set(), set(), []))
        if r.a not in used[0] and r.b not in used[1]:
            used[0].add(r.a)
            used[1].add(r.b)
            used[2].append((r.label, r.a, r.b))
    got = sorted((r.label, r.a, r.b) for r in catalogue.QUERIES["greedy_match"](spark, sf_dir).collect())
    assert got == sorted(x for v in left.values() for x in v[2])


def test_block_actions(spark, sf_dir):
    from meridia.plans.fixtures import frames

    tracks = {}
    for r in frames(spark, sf_dir).orderBy("case_id", "frame_index").collect():
        tracks.setdefault(r.case_id, []).append(r)
    expected = {}
    for case, rows in tracks.items():
        moves = {}
        for before, r in zip([None, *rows[:-1]], rows, strict=True):
            moves[r.frame_index // 16] = moves.get(r.frame_index // 16, 0.0) + (0.0 if before is None else r.x - before.x)
        debt = 0.0
        for block in sorted(moves):
            debt += moves[block]
            action = math.trunc(debt / 25.0)
            debt -= action * 25.0
            expected[case, block] = action
    got = {(r.case_id, r.block): r.action for r in catalogue.QUERIES["block_actions"](spark, sf_dir).collect()}
    assert got == expected


def test_similarity_alignment(spark, sf_dir):
    """Points on one line leave the turn about it open, so the points are compared and not the matrices."""
    import numpy as np

    from meridia.plans.fixtures import frames

    tracks = {}
    for r in frames(spark, sf_dir).collect():
        tracks.setdefault(r.case_id, []).append((r.x, r.y, r.z))
    for r in catalogue.QUERIES["similarity_alignment"](spark, sf_dir).collect():
        p, m = np.array(tracks[r.case_id]), np.array(r.rotation).reshape(3, 3)
        target = np.stack([2 * p[:, 2] + 1, 2 * p[:, 1] - 3, -2 * p[:, 0]], axis=1)
        assert m @ m.T == pytest.approx(np.eye(3), abs=1e-9)
        assert np.linalg.det(m) == pytest.approx(1)
        assert r.scale * p @ m.T + np.array(r.translation) == pytest.approx(target, abs=1e-6)


def test_merge_short_runs(spark, sf_dir):
    """Against a loop over the runs of each case, made again from the measurements."""
    from meridia.plans import sequence_queries

    expected = {}
    for r in sequence_queries.labelled_runs(spark, sf_dir).orderBy("case_id", "run").collect():
        expected.setdefault(r.case_id, []).append([r.label, r.length])
    for items in expected.values():
        while len(items) > 1 and min(n for _, n in items) < 3:
            short = [n for _, n in items].index(min(n for _, n in items))
            sides = [k for k in (short - 1, short + 1) if 0 <= k < len(items)]
            into = sides[0] if len(sides) == 1 or items[sides[0]][1] >= items[sides[1]][1] else sides[1]
            items[into][1] += items[short][1]
            del items[short]
            k = 1
            while k < len(items):
                if items[k][0] == items[k - 1][0]:
                    items[k - 1][1] += items[k][1]
                    del items[k]
                else:
                    k += 1
    got = {}
    for r in catalogue.QUERIES["merge_short_runs"](spark, sf_dir).orderBy("case_id", "run").collect():
        got.setdefault(r.case_id, []).append([r.label, r.length])
    assert got == expected


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())


def test_shortlist(spark, sf_dir):
    groups = {}
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").collect():
        x0, y0 = r.l_quantity, r.l_discount * 300
        groups.setdefault(r.l_suppkey, []).append((r.l_orderkey * 10 + r.l_linenumber, x0, y0, x0 * 1.5 + 5, y0 + 6 + r.l_tax * 100))
    area = lambda b: (b[3] - b[1]) * (b[4] - b[2])
    expected = {}
    for key, boxes in groups.items():
        kept = []
        for b in sorted(boxes, key=lambda b: (-area(b), b[0])):
            shared = [max(0, min(b[3], k[3]) - max(b[1], k[1])) * max(0, min(b[4], k[4]) - max(b[2], k[2])) for k in kept]
            if len(kept) < 5 and all(s < 0.7 * (area(b) + area(k) - s) for s, k in zip(shared, kept, strict=True)):
                kept.append(b)
        expected[key] = sorted(b[0] for b in kept)
    got = {}
    for r in catalogue.QUERIES["shortlist"](spark, sf_dir).collect():
        got.setdefault(r.l_suppkey, []).append(r.id)
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_metrics_of_tiers():
    from meridia.operators.evaluation import metrics_of

    assert metrics_of("t1, T4") == ["validity", "control", "completion_revisit"]
    assert len(metrics_of()) == 13
    with pytest.raises(ValueError):
        metrics_of("T9")
