import heapq
import random

import numpy as np

from memloom.llm import near_duplicates as D
from memloom.llm import neighbours as N


def exact(rows, every=20, k=10):
    seen = {}
    for i, g, v in rows:
        if i is None or g is None or v is None or len(v) != 64 or any(x is None for x in v):
            continue
        x = np.array(v, np.float32).astype(float)
        if np.isfinite(x).all() and x.any():
            seen[i] = (g, x / np.linalg.norm(x))
    out = {}
    for i, (g, x) in seen.items():
        if i % every == 0:
            others = sorted((-round(float(x @ y), 9), j) for j, (h, y) in seen.items() if h == g and j != i)
            out[i] = {j for _, j in others[:k]}
    return out


def vectors(n, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 64))
    rows = [(i, "ab"[i % 3 == 0], (centres[r.integers(12)] + 0.4 * r.normal(size=64)).astype(np.float32).tolist()) for i in range(n)]
    same = rows[7][2]
    rows += [(n + i, rows[7][1], same) for i in range(60)]  # equal vectors under many ids
    rows += [(9000, None, same), (9001, "a", None), (9002, "a", same[:32]), (9003, "a", [0.0] * 64), (9004, "a", [float("nan")] * 64), (None, "a", same), (9020, "lonely", same), rows[20], (9005, "a", [None] * 64)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, g, v, "clash") for i, g, v in rows], "vector_id long, source_type string, vector array<float>, vec string")


def test_small_groups_exactly(spark):
    rows = vectors(300)
    got = {}
    for r in N.nearest(frame(spark, rows)).collect():
        got.setdefault(r.vector_id, set()).add(r.neighbour_id)
    assert got == {i: s for i, s in exact(rows).items() if s}
    assert N.nearest(frame(spark, rows).limit(0)).count() == 0
    assert N.nearest(frame(spark, [(9003, "a", [0.0] * 64)])).count() == 0


def test_many_leaves_blocks_and_sets_reach_the_recall(spark, monkeypatch):
    for name, value in (("LEAF_ROWS", 60), ("BLOCK_ROWS", 32), ("QUERIES_PER_TASK", 8), ("SAMPLE_ROWS", 1500)):
        monkeypatch.setattr(N, name, value)
    rows = vectors(2500)
    want, got = exact(rows), {}
    for r in N.nearest(frame(spark, rows), recall=0.98).collect():
        got.setdefault(r.vector_id, set()).add(r.neighbour_id)
    hit = sum(len(got[i] & s) for i, s in want.items() if s)
    assert hit / sum(len(s) for s in want.values()) >= 0.95


def test_large_leaves_get_a_level_of_their_own(spark, monkeypatch):
    """A tree that its sample keeps small: leaves are split where they are, and neighbours are found as before."""
    monkeypatch.setattr(N, "SAMPLE_ROWS", 120)
    monkeypatch.setattr(N, "LEAF_ROWS", 25)
    monkeypatch.setattr(N, "SPLIT_ROWS", 100)
    monkeypatch.setattr(N, "FIT_ROWS", 400)
    r = np.random.default_rng(5)
    centres = r.normal(size=(30, 64))
    x = np.vstack([centres[r.integers(30)] + 0.5 * r.normal(size=64) for _ in range(1500)] + [centres[0]] * 300).astype(np.float32)
    df = spark.createDataFrame([(i, "fact" if i % 5 else "entity", v.tolist()) for i, v in enumerate(x)], "vector_id long, source_type string, vector array<float>")
    scratch = N.Scratch(spark, "check")
    got = {}
    for row in N.nearest(df, recall=0.99).collect():
        got.setdefault(row.vector_id, set()).add(row.neighbour_id)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float64)
    hit = want = 0
    for q in range(0, len(x), 20):
        own = np.array([i for i in range(len(x)) if (i % 5 > 0) == (q % 5 > 0) and i != q])
        sims = np.round((x[own].astype(np.float64) / np.linalg.norm(x[own].astype(np.float64), axis=1, keepdims=True)) @ (x[q].astype(np.float64) / np.linalg.norm(x[q].astype(np.float64))), 9)
        best = own[np.lexsort((own, -sims))[:10]]
        hit, want = hit + len(got.get(q, set()) & set(best.tolist())), want + 10
    assert hit / want > 0.93
    placed = spark.createDataFrame([(i, "g", 3, v.tobytes()) for i, v in enumerate(x)], "id long, grp string, leaf int, vec binary")
    fine, below, big = N._deepened(placed, scratch, 64)
    assert fine.count() == len(x) == fine.select("id").distinct().count() and below.count() == big.count() == 1 and fine.select("leaf").distinct().count() > 10


def test_visits_are_best_bin_first(monkeypatch):
    monkeypatch.setattr(N, "LEAF_ROWS", 20)
    x = np.random.default_rng(1).normal(size=(900, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = N.Tree(x, len(x), 0)
    assert sorted(np.bincount(tree.assign(x), minlength=len(tree.leaves)) > 0) == [True] * len(tree.leaves)
    for q in x[:5]:
        heap, order = [(0.0, 0)], []
        while heap:
            _, node = heapq.heappop(heap)
            if tree.leaf[node] >= 0:
                order.append(tree.leaf[node])
            for kid in tree.children[node]:
                heapq.heappush(heap, (-float(q @ tree.centres[kid]), int(kid)))
        assert order == tree.all_bins(q[None])[0].tolist() == tree.best_bins(q[None], len(tree.leaves))[0].tolist() and order[:3] == tree.best_bins(q[None], 3)[0].tolist()


def corpus(seed=6):
    r = random.Random(seed)
    word = lambda: r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()) + str(r.randint(0, 40))
    rows = []
    for i in range(90):
        words = [word() for _ in range(r.choice([30, 45, 60, 90, 140, 300, 700]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(r.choice([0, 0, 1, 2])):
            copy = list(words)
            for _ in range(r.randint(0, len(words) // 12)):
                copy[r.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy).upper() if r.random() < 0.3 else ", ".join(copy)))
    rows += [(len(rows) + i, rows[3][1]) for i in range(5)]
    return rows


def test_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "LEAF_ROWS", 16)
    rows = corpus()
    extra = [(*rows[0], None), (900, None, ""), (None, rows[1][1], None), (901, "too short", "x")]
    df = spark.createDataFrame([(i, t, None) for i, t in rows] + extra, "id long, content string, summary string")
    members, pairs = D.near_duplicates(df)
    got = {(r.id_a, r.id_b) for r in D.all_pairs(members, pairs).collect()}
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in rows if len(w := D.WORD.findall(t.lower())) >= 40}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert got == want and len(want) > 20
    table = D.groups(members, pairs).collect()
    assert {r.id for r in table} == set(sets) and all(r.rep <= r.id for r in table)
    members, pairs = D.near_duplicates(df.limit(0))
    assert members.count() == 0 and pairs.count() == 0


def test_bound_never_falls_below_the_overlap():
    r = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(r.integers(0, 400, 150).astype(np.uint64) * np.uint64(2654435761))
        b = np.unique(r.integers(0, 400, 150).astype(np.uint64) * np.uint64(2654435761))
        (x, over_x, _), (y, over_y, _) = D.planes(a, 64), D.planes(b, 64)
        assert int(np.bitwise_count(x & y).sum()) + min(over_x, over_y) >= len(np.intersect1d(a, b))


def test_very_long_near_duplicates_are_found(spark):
    words = [f"w{i}" for i in range(80_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:76_000] + [f"x{i}" for i in range(4_000)])), (3, " ".join(f"y{i}" for i in range(80_000)))]
    members, pairs = D.near_duplicates(spark.createDataFrame([(i, t, None) for i, t in rows], "id long, content string, summary string"))
    assert [(r.id_a, r.id_b) for r in D.all_pairs(members, pairs).collect()] == [(1, 2)]


def test_low_thresholds_lose_nothing(spark, monkeypatch):
    """Sets of very different size: points of many groups are folded to those of few, more than once."""
    monkeypatch.setattr(D, "LEAF_ROWS", 7)
    r = random.Random(4)
    base = [f"w{i}" for i in range(2600)]
    rows = []
    for i in range(26):
        n = r.choice([90, 200, 420, 900, 1300, 2500])
        start = r.choice([0, 0, 5, 40])
        words = base[start : start + n]
        for _ in range(r.randint(0, 12)):
            words[r.randrange(n)] = f"x{r.randint(0, 10 ** 6)}"
        rows.append((i, " ".join(words), None))
    df = spark.createDataFrame(rows, "id long, content string, summary string")
    for threshold in (0.2, 0.4):
        members, pairs = D.near_duplicates(df, threshold=threshold)
        sets = {i: set(zip(t.split(), t.split()[1:], t.split()[2:])) for i, t, _ in rows}
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
        assert {(x.id_a, x.id_b) for x in D.all_pairs(members, pairs).collect()} == want and len(want) > 20
