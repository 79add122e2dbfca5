import math
import random

import numpy as np
import pytest

from geoloom.llm import percentiles as P
from geoloom.llm.clusters import compact_groups, describe, grid_clusters
from geoloom.llm.queries import p5_clusters, p5_found

PS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def leaf(values):
    v = np.sort(np.array(values, float))
    u, first, n = np.unique(v, return_index=True, return_counts=True)
    return len(v), u, first + n, first


def rank_error(values, answer, p):
    v = np.sort(values)
    rank = min(max(math.ceil(p * len(v)), 1), len(v))
    return max(0, int(np.searchsorted(v, answer, "left")) + 1 - rank, rank - int(np.searchsorted(v, answer, "right")))


@pytest.mark.parametrize("ties", [False, True])
def test_bound_over_levels(ties):
    rng = np.random.default_rng(1)
    eps, levels, everything, nodes = 0.01, 4, [], []
    for _ in range(48):
        values = rng.integers(0, 40, rng.integers(1, 3000)).astype(float) if ties else rng.lognormal(0, 3, rng.integers(1, 3000))
        everything.append(values)
        nodes.append(P.compress(leaf(values), 2 * int(eps * len(values) / levels)))
    for level, fan in ((2, 4), (3, 4), (4, 3)):
        nodes = [P.merge(nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
        nodes = [P.compress(s, 2 * int(eps * s[0] * level / levels)) for s in nodes]
    (s,), values = nodes, np.concatenate(everything)
    assert s[0] == len(values) and len(s[1]) < 2 / eps * levels
    for p in PS:
        answer, bound = P.query(s, p)
        assert rank_error(values, answer, p) <= bound <= eps * len(values)


def test_grouped(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(6000):
        g = rnd.choice(["hot", "hot", "hot", "b", None])
        rows.append((g, rnd.choice([1, None]), rnd.choice([rnd.gauss(0, 1), 0.5]), rnd.choice([1, 2, 3, None]), "x", 1))
    rows += [("c", 1, math.nan, 1, "x", 1), ("c", 1, None, 1, "x", 1), ("d", 1, math.inf, 1, "x", 1), ("d", 1, -math.inf, 2, "x", 1)]
    df = spark.createDataFrame(rows, "g string, y int, v double, day int, n string, part int").repartition(5)
    got = P.grouped_percentiles(df, ["g", "y"], "v", PS, part_by="day", eps=0.01).collect()
    groups = {(r[0], r[1]) for r in rows if r[2] is not None and not math.isnan(r[2])}
    assert {(r.g, r.y) for r in got} == groups and len(got) == len(groups) * len(PS)
    for r in got:
        values = np.array([x[2] for x in rows if (x[0], x[1]) == (r.g, r.y)])
        assert r.n == len(values) and rank_error(values, r.percentile, r.p) <= r.rank_error <= 0.01 * r.n
    assert P.grouped_percentiles(df.limit(0), ["g", "y"], "v", PS, part_by="day").count() == 0


def brute_groups(points, eps):
    near = {i: {j for j in points if math.dist(points[i], points[j]) <= eps} for i in points}
    return {(min(near[i]), i) for i in points if len(near[i]) >= 3 and all(near[j] == near[i] for j in near[i])}


def brute_components(points, eps):
    label = {i: i for i in points}
    for _ in points:
        for i in points:
            label[i] = min(label[j] for j in points if math.dist(points[i], points[j]) <= eps)
    return label


def test_clusters(spark):
    rnd = random.Random(3)
    points = {}
    for k in range(40):
        cx, cy, r = rnd.uniform(0, 9000), rnd.uniform(0, 9000), rnd.choice([5, 60, 90, 250])
        for _ in range(rnd.randint(1, 6)):
            points[len(points) + 1] = (cx + rnd.uniform(-r, r), cy + rnd.uniform(-r, r))
    for k in range(60):  # a chain and a stack
        points[1000 + k] = (20_000.0 + 190 * k, 0.0)
        points[2000 + k] = (40_000.0, 40_000.0)
    rows = [(i, x, y, "c") for i, (x, y) in points.items()]
    rows += [rows[0], (None, 1.0, 1.0, "c"), (9001, None, 1.0, "c"), (9002, math.nan, 1.0, "c"), (9003, 1.0, math.inf, "c")]
    df = spark.createDataFrame(rows, "id long, x double, y double, cell string")
    members = grid_clusters(df, 200.0)
    got = {r.id: r.cluster_id for r in members.collect()}
    assert got == brute_components(points, 200.0)
    assert {tuple(r) for r in compact_groups(members, 200.0).collect()} == brute_groups(points, 200.0)
    about = {r.cluster_id: r for r in describe(members).collect()}
    assert about[2000].size == about[2000].densest == 60 and about[2000].typical_ids == [2000, 2001, 2002]
    assert set(about) == set(got.values())
    dense = grid_clusters(df, 200.0, min_points=5).collect()
    assert all((r.cluster_id is None) == (r.cell_count is None or r.cell_count < 5) for r in dense) and len(dense) == len(points)


def test_large_groups_and_nothing(spark):
    ring = [(i, 1000 + 99 * math.cos(i), 1000 + 99 * math.sin(i)) for i in range(300)]
    wide = [(1000 + i, 9000 + 120 * math.cos(i), 1000 + 120 * math.sin(i)) for i in range(300)]
    df = spark.createDataFrame(ring + wide, "id long, x double, y double")
    assert {tuple(r) for r in compact_groups(grid_clusters(df, 200.0), 200.0).collect()} == {(0, i) for i in range(300)}
    assert grid_clusters(df.limit(0), 200.0).count() == 0 == describe(grid_clusters(df.limit(0), 200.0)).count()


def test_described_clusters_are_whole(spark, tmp_path):
    points = {1: (0.0, 0.0), 2: (150.0, 0.0), 3: (75.0, 145.0)}  # a group with one id to a cell
    points |= {10 + k: (5000.0 + k, 5000.0) for k in range(4)} | {20: (5150.0, 5000.0)}  # a dense cell and a neighbour
    points |= {30: (9000.0, 0.0), 31: (9100.0, 0.0)}  # a pair
    rnd = random.Random(5)
    points |= {100 + k: (20_000 + rnd.uniform(0, 3000), rnd.uniform(0, 3000)) for k in range(150)}
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in points.items()], "id long, x double, y double")
    df.write.parquet(f"{tmp_path}/centroid_df.parquet")
    got = {r.cluster_id: r for r in p5_clusters(spark, str(tmp_path)).collect()}
    members = {}
    for i, c in brute_components(points, 200.0).items():
        members.setdefault(c, set()).add(i)
    assert {c: r["size"] for c, r in got.items()} == {c: len(m) for c, m in members.items() if len(m) >= 3}
    assert got[1]["size"] == 3 and got[10]["size"] == 5 and 30 not in got
    assert all(set(r.typical_ids) <= members[c] for c, r in got.items())
    assert {r.cluster_id for r in p5_found(spark, str(tmp_path)).collect()} <= set(got)


def test_plan_does_not_depend_on_the_number_of_tasks(spark):
    df = spark.range(5000).selectExpr("id % 3 as g", "id % 7 as day", "cast(id as double) as v")
    plans = []
    for tasks in (2, 33):
        rows = df.repartition(tasks)
        answer = P.grouped_percentiles(rows, ["g"], "v", [0.5], part_by="day")
        text = answer._jdf.queryExecution().optimizedPlan().toString()
        plans.append((text.count("MapInArrow"), text.count("RepartitionByExpression")))
    assert plans[0] == plans[1] == (5, 3)


def test_packed_summaries_and_hot_groups(monkeypatch):
    for a in ([], [0, 0, 3], [5, 260, 70_000], [1 << 40, (1 << 40) + 1]):
        assert P._unpack_rising(P._pack_rising(np.array(a, np.int64))).tolist() == a
    rng = np.random.default_rng(3)
    values, eps = rng.normal(size=200_000), 0.01
    rows = [(7, *P._pack(P.compress(leaf(v), 2 * int(eps * len(v) / 4)))) for v in np.split(values, 400)]
    batch = P.pa.RecordBatch.from_arrays([P.pa.array(c) for c in zip(*rows)], ["g", "n", "v", "le", "lt"])
    (out,) = P._merge_sorted(["g"], eps / 2)(iter([batch]))
    s = P._unpack(*[out[c][0].as_py() for c in ("n", "v", "le", "lt")])
    assert s[0] == len(values) and len(s[1]) < 4 / eps
    assert all(rank_error(values, *P.query(s, p)[:1], p) <= P.query(s, p)[1] <= eps * len(values) for p in PS)
