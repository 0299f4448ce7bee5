import random

import pytest

from memloom.operators import hierarchy as H


def brute(parent):
    out = {}
    for v in parent:
        seen, x, k = {}, v, 0
        while True:
            if x in seen:
                out[v] = ("cycle" if seen[x] == 0 else "below_cycle", -1, -1 if seen[x] == 0 else -2)
                break
            seen[x] = k
            p = parent[x]
            if p is None or p not in parent:
                out[v] = ("tree", x, k)
                break
            x, k = p, k + 1
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, parent_id long, name string")


def check(spark, parent, monkeypatch=None):
    nodes = H.hierarchy(frame(spark, [(v, p, "x") for v, p in parent.items()])).collect()
    assert {r.id: (r.node_state, r.root_id, r.depth) for r in nodes} == brute(parent)
    return nodes


def test_shapes(spark):
    check(spark, {1: None, 2: 1, 3: 2, 4: 99, 5: 5, 6: 5, 7: 8, 8: 9, 9: 7, 10: 7, 11: 10, -3: 2, 12: -3})


def test_random_forest_with_rings_intervals_and_paths(spark):
    r = random.Random(4)
    parent = {v: (None if r.random() < 0.1 else r.choice([v - 1, r.randint(1, 60), 77])) for v in range(1, 61)}
    nodes = check(spark, parent)
    df = spark.createDataFrame(nodes)
    pairs = {(a.ancestor_id, a.id, a.distance) for a in H.ancestor_pairs(df).collect()}
    want = set()
    for v, (state, _, depth) in brute(parent).items():
        x = v
        for k in range(1, depth + 1):
            x = parent[x]
            want.add((x, v, k))
    assert pairs == want
    assert sum(n.descendants or 0 for n in nodes) == len(want)
    for row in H.paths(df).collect():
        ids = [int(x) for x in row.path.split("/")]
        assert ids[-1] == row.id and all(parent[b] == a for a, b in zip(ids, ids[1:]))


def test_hot_parent_is_sorted_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(H, "SIBLINGS_PER_BUCKET", 7)
    check(spark, {1: None} | {v: 1 for v in range(2, 90)} | {v: v - 50 for v in range(100, 120)})


def test_nulls_repeats_and_empty(spark):
    rows = [(None, 1, "x"), (1, None, None), (2, 1, "a"), (2, 1, "a"), (3, 2, None)]
    got = {r.id: r.depth for r in H.hierarchy(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 1, 3: 2}
    assert H.hierarchy(frame(spark, [])).count() == 0


@pytest.mark.parametrize("length", [1, 2, 33])
def test_chain(spark, length):
    check(spark, {v: v - 1 if v > 1 else None for v in range(1, length + 1)})
