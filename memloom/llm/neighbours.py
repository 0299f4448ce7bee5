"""Most similar vectors for every query vector, by a hierarchical k-means tree.

The tree is fitted on a bounded sample of each group (``SAMPLE_ROWS`` in all), every usable row is put into one leaf,
and a query visits leaves best bin first.  How many leaves it visits is calibrated: for a few sample queries the exact
neighbours are found by one pass over all rows, and the visits are widened until the wanted share of them lies in the
visited leaves.  Visited leaves are searched exactly, in double precision.

Best bin first takes the nearest node from a priority queue and adds its children, which are scored only then; it stops
at the calibrated number of leaves.  (A leaf leaves the queue in the order of the largest distance on its path; the
calibration, which needs the place of every leaf, computes that order for its few queries at once.)

The tree above is bounded by its sample.  A leaf that holds more than ``SPLIT_ROWS`` rows gets a level below it, fitted on
a bounded sample of its own rows by the task that has them, and queries open the calibrated share of its parts, so leaves
stay small whatever the number of rows.

Leaves are cut into blocks of bounded size by a hash of the id, and the queries that visit a leaf into bounded sets, so
no task holds a whole group of copies, however hot.

Defined results: unusable are rows with a null id or group, a vector that is null, has another length, a null, NaN or
infinite number, or only zeros; repeated ids count once; equal similarities (after rounding to 9 decimals) go to the
smaller id; a group with fewer than k other rows gives all of them; a group of one gives none; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.scratch import Scratch
from memloom.tables import SENT_KEYS, once_by_key

#: Rows that the trees are fitted on, over all groups together (16 MB of 64 floats).
SAMPLE_ROWS = 60_000
#: Rows that a leaf should hold; a leaf that is larger is searched in blocks of BLOCK_ROWS.
LEAF_ROWS = 1_000
BLOCK_ROWS = 4_096
QUERIES_PER_TASK = 8_192
#: A leaf of more rows gets a level of its own, of at most so many parts, fitted on about so many of its rows.
SPLIT_ROWS, MOST_PARTS, FIT_ROWS = 16_000, 512, 8_192
BRANCHES = 16
CALIBRATION_QUERIES = 150


class Tree:
    """Nodes in breadth-first order; ``leaf[i]`` is the number of node i as a leaf, else -1."""

    def __init__(self, sample: np.ndarray, rows: int, first_leaf: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        centres, parent, leaf, members = [sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])], [-1], [-1], [np.arange(len(sample))]
        scale = rows / max(1, len(sample))
        at = 0
        while at < len(centres):
            own = members[at]
            if len(own) * scale > LEAF_ROWS and len(own) >= 32:
                branches = int(min(BRANCHES, max(2, np.ceil(len(own) * scale / LEAF_ROWS)), len(own) // 16))
                label = _kmeans(sample[own], branches, rng)
                groups = [own[label == g] for g in range(branches)]
                groups = [g for g in groups if len(g)]
                if len(groups) > 1:
                    for g in groups:
                        centre = sample[g].mean(axis=0)
                        centres.append(centre / max(1e-12, np.linalg.norm(centre)))
                        parent.append(at)
                        leaf.append(-1)
                        members.append(g)
                    at += 1
                    continue
            leaf[at] = first_leaf
            first_leaf += 1
            at += 1
        self.centres, self.parent, self.leaf = np.asarray(centres, dtype=np.float32), np.asarray(parent), np.asarray(leaf)
        self.children = [np.flatnonzero(self.parent == i) for i in range(len(parent))]
        self.child_centres = [self.centres[kids] for kids in self.children]
        self.leaves = np.flatnonzero(self.leaf >= 0)
        ways = []
        for node in self.leaves:
            way = []
            while node > 0:
                way.append(node)
                node = self.parent[node]
            ways.append(way[::-1])
        depth = max(1, *map(len, ways))
        # Nodes from the root's child to the leaf; -1, behind the last centre, fills up.
        self.ways = np.array([way + [-1] * (depth - len(way)) for way in ways])

    def assign(self, unit: np.ndarray) -> np.ndarray:
        """Leaf number of each row, going down to the nearest child."""
        out = np.empty(len(unit), dtype=np.int32)
        todo = [(0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            near = (unit[rows] @ self.centres[kids].T).argmax(axis=1)
            todo += [(kid, rows[near == i]) for i, kid in enumerate(kids)]
        return out

    def best_bins(self, unit: np.ndarray, visits: int) -> np.ndarray:
        """The first ``visits`` leaf numbers of a best-bin-first search for each query."""
        visits = min(visits, len(self.leaves))
        out = np.empty((len(unit), visits), dtype=np.int64)
        for row, query in zip(out, unit, strict=True):
            queue, found = [(0.0, 0)], 0
            while found < visits:
                node = heappop(queue)[1]
                if self.leaf[node] >= 0:
                    row[found] = self.leaf[node]
                    found += 1
                else:
                    kids = self.children[node]
                    for far, kid in zip((-(self.child_centres[node] @ query)).tolist(), kids.tolist(), strict=True):
                        heappush(queue, (far, kid))
        return out

    def all_bins(self, unit: np.ndarray) -> np.ndarray:
        """All leaf numbers in the order of ``best_bins``, for a few queries."""
        visits = len(self.leaves)
        order = np.empty((len(unit), visits), dtype=np.int64)
        for a in range(0, len(unit), 256):
            far = np.hstack([-(unit[a : a + 256] @ self.centres.T), np.full((len(unit[a : a + 256]), 1), -np.inf, np.float32)])
            keys = far[:, self.ways]  # query, leaf, step of its way
            ranks = []
            for _ in range(self.ways.shape[1]):
                # The farthest node on the way opens last; below it the order is again that of the farthest.
                ranks.append(keys.max(axis=2))
                opened = keys.argmax(axis=2)
                keys[np.arange(self.ways.shape[1])[None, None, :] <= opened[:, :, None]] = -np.inf
            order[a : a + 256] = np.lexsort(ranks[::-1], axis=1)[:, :visits]
        return self.leaf[self.leaves][order]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centre = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        label = (x @ centre.T).argmax(axis=1)
        for g in range(k):
            own = x[label == g]
            if len(own):
                c = own.mean(axis=0)
                centre[g] = c / max(1e-12, np.linalg.norm(c))
            else:
                centre[g] = x[rng.integers(len(x))]
    return label


def _unit(x: np.ndarray, kind: type = np.float32) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(kind)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of a binary column of packed float32 numbers."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), dtype=np.float32).reshape(len(parts), dim) if parts else np.zeros((0, max(dim, 0)), np.float32)


def usable(df: DataFrame, id_col: str, group_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, grp, vec): usable rows with their numbers packed as float32."""
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("grp"), F.col(vector_col).cast("array<float>").alias("v")
    ).filter(F.col("id").isNotNull() & F.col("grp").isNotNull() & (F.size("v") == dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            keep = pa.array(good)
            packed = pa.array([r.tobytes() for r in x[good]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), packed], ["id", "grp", "vec"])

    return rows.mapInArrow(run, "id long, grp string, vec binary")


def _best(sims: np.ndarray, ids: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row of ``sims`` the places of its k best, ties to the smaller id.  ``ids`` ascend."""
    n = sims.shape[1]
    if n <= k:
        yield from (np.lexsort((ids, -row)) for row in sims)
        return
    width = min(n, k + 22)
    top = np.argpartition(-sims, width - 1, axis=1)[:, :width]
    vals = np.take_along_axis(sims, top, axis=1)
    kth = -np.partition(-vals, k - 1, axis=1)[:, k - 1]
    least = vals.min(axis=1)
    for i, row in enumerate(sims):
        places = np.flatnonzero(row >= kth[i]) if width < n and least[i] >= kth[i] else top[i]
        yield places[np.lexsort((ids[places], -row[places]))][:k]


def nearest(
    df: DataFrame, id_col: str = "vector_id", group_col: str = "source_type", vector_col: str = "vector", *,
    dim: int = 64, k: int = 10, every: int = 20, recall: float = 0.995,
) -> DataFrame:
    """(vector_id, neighbour_id, similarity, place): the k nearest others, for ids divisible by ``every``."""
    spark = df.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = usable(df, id_col, group_col, vector_col, dim)
    counts = dict(df.filter(F.col(group_col).isNotNull()).groupBy(F.col(group_col).cast("string")).count().toLocalIterator())
    if not counts:
        return spark.createDataFrame([], "vector_id long, neighbour_id long, similarity double, place int")
    share = SAMPLE_ROWS // len(counts)
    keep = F.lit(False)
    for grp, n in counts.items():
        keep = keep | ((F.col("grp") == grp) & (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, share / n)) + 1))
    sample = rows.filter(keep).toArrow()
    found = sample.column("grp").to_numpy(zero_copy_only=False)
    numbers = _unit(_matrix(sample.column("vec"), dim)) if len(found) else np.zeros((0, dim), np.float32)
    trees: dict[str, Tree] = {}
    first = 0
    for grp, n in sorted(counts.items()):
        order = np.argsort(sample.column("id").to_numpy()[found == grp], kind="stable")
        trees[grp] = Tree(numbers[found == grp][order], n, first)
        first += len(trees[grp].leaves)
    shared = spark.sparkContext.broadcast(trees)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, grp = _unit(_matrix(batch.column(2), dim)), batch.column(1).to_numpy(zero_copy_only=False)
            leaf = np.empty(len(x), dtype=np.int32)
            for g in set(grp):
                leaf[grp == g] = shared.value[g].assign(x[grp == g])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf), batch.column(2)], ["id", "grp", "leaf", "vec"])

    stored = scratch.write(rows.mapInArrow(place, "id long, grp string, leaf int, vec binary"), "stored")
    stored, below, big = _deepened(stored, scratch, dim)
    visits, opened = _calibrate(stored, below, trees, found, numbers, sample.column("id").to_numpy(), dim, k, recall)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, grp, vec = _unit(_matrix(batch.column(2), dim)), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            for g in set(grp):
                at = np.flatnonzero(grp == g)
                leaves = shared.value[g].best_bins(x[at], visits[g])
                again = pa.array(np.repeat(at, leaves.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(again), pa.array(leaves.ravel().astype(np.int32)), vec.take(again)], ["qid", "qleaf", "qvec"])

    asking = stored.filter(F.pmod(F.col("id"), F.lit(every)) == 0).dropDuplicates(["id"]).select("id", "grp", "vec")
    asked = scratch.write(asking.mapInArrow(visit, "qid long, qleaf int, qvec binary"), "asked")
    asked = _asked_below(asked, below, big, opened, scratch, dim)
    sizes = (
        stored.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
        .join(asked.groupBy(F.col("qleaf").alias("leaf")).agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_TASK).cast("int").alias("parts")), "leaf")
    )
    sizes = scratch.write(sizes, "sizes")
    sent = F.broadcast(sizes) if sizes.count() <= SENT_KEYS else sizes
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = stored.join(sent, "leaf").select("leaf", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), upto("parts").alias("part"), "id", "vec")
    queries = asked.join(sent.withColumnRenamed("leaf", "qleaf"), "qleaf").select(
        "qleaf", upto("blocks").alias("qblock"), F.pmod(F.xxhash64("qid", F.lit(1)), F.col("parts")).cast("int").alias("qpart"), "qid", "qvec"
    )

    def search(asks: pa.Table, has: pa.Table) -> pa.Table:
        out = ([], [], [])
        if asks.num_rows and has.num_rows:
            ids, where = np.unique(has.column("id").to_numpy(), return_index=True)
            x = _unit(_matrix(has.column("vec"), dim)[where], np.float64)
            qids, q = asks.column("qid").to_numpy(), _unit(_matrix(asks.column("qvec"), dim), np.float64)
            for a in range(0, len(q), 256):
                sims = np.round(q[a : a + 256] @ x.T, 9)
                own = np.searchsorted(ids, qids[a : a + 256])
                hit = np.flatnonzero((own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == qids[a : a + 256]))
                sims[hit, own[hit]] = -9.0
                for i, places in enumerate(_best(sims, ids, k)):
                    places = places[sims[i, places] > -8]
                    out[0].append(np.full(len(places), qids[a + i]))
                    out[1].append(ids[places])
                    out[2].append(sims[i, places])
        joined = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"vector_id": joined[0].astype(np.int64), "neighbour_id": joined[1].astype(np.int64), "similarity": joined[2].astype(np.float64)})

    pairs = (
        queries.groupBy("qleaf", "qblock", "qpart")
        .cogroup(data.groupBy("leaf", "block", "part"))
        .applyInArrow(search, "vector_id long, neighbour_id long, similarity double")
    )
    best = Window.partitionBy("vector_id").orderBy(F.desc("similarity"), F.asc("neighbour_id"))
    return pairs.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def _deepened(stored: DataFrame, scratch: Scratch, dim: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(rows with their final leaf, centres (top, centres) of the leaves with a level below, sizes (top, n) of these).

    The tree above is as large as its bounded sample; a leaf that is too large for it gets a level fitted on a bounded
    sample of its own rows, where they are.  Final leaves are numbered top * MOST_PARTS + part.
    """
    big = scratch.write(stored.groupBy(F.col("leaf").alias("top")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPLIT_ROWS), "big")
    number = (F.col("leaf").cast("long") * MOST_PARTS).alias("leaf")
    if not big.count():
        return stored.select("id", "grp", number, "vec"), None, None
    sent = F.broadcast(big)  # a row for each leaf of the bounded tree, at most
    own = stored.join(sent, F.col("leaf") == F.col("top"))

    def fit(t: pa.Table) -> pa.Table:
        x = _unit(_matrix(t.column("vec"), dim))
        parts = int(max(1, min(MOST_PARTS, -(-t.column("n")[0].as_py() // LEAF_ROWS), len(x) // 8)))
        label = _kmeans(x, parts, np.random.default_rng(17))
        centres = np.stack([x[label == g].mean(axis=0) if (label == g).any() else x[g] for g in range(parts)])
        centres /= np.maximum(1e-12, np.linalg.norm(centres, axis=1, keepdims=True))
        return pa.table({"top": pa.array([t.column("top")[0].as_py()], pa.int32()), "centres": pa.array([centres.astype(np.float32).tobytes()], pa.binary())})

    picked = own.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_003)) < F.lit(1_000_003) * F.lit(FIT_ROWS) / F.col("n")).select("top", "n", "vec")
    below = scratch.write(picked.groupBy("top").applyInArrow(fit, "top int, centres binary"), "below")

    def put(rows: pa.Table, level: pa.Table) -> pa.Table:
        kept = ["id", "grp", "vec"]
        if not rows.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "grp": pa.array([], pa.string()), "leaf": pa.array([], pa.int64()), "vec": pa.array([], pa.binary())})
        top = rows.column("top")[0].as_py()
        part = (_unit(_matrix(rows.column("vec"), dim)) @ _matrix(level.column("centres"), -1).reshape(-1, dim).T).argmax(axis=1) if level.num_rows else np.zeros(rows.num_rows, np.int64)
        return rows.select(kept).append_column("leaf", pa.array(top * MOST_PARTS + part, pa.int64())).select(["id", "grp", "leaf", "vec"])

    chunks = F.ceil(F.col("n") / FIT_ROWS).cast("int")
    rows = own.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(6)), chunks).cast("int")).select("id", "grp", "vec", "top", "chunk")
    levels = below.join(sent, "top").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).select((F.col("top") + 0).alias("_top"), "chunk", "centres").withColumnRenamed("chunk", "_chunk")
    placed = rows.groupBy("top", "chunk").cogroup(levels.groupBy("_top", "_chunk")).applyInArrow(put, "id long, grp string, leaf long, vec binary")
    rest = stored.join(sent, F.col("leaf") == F.col("top"), "left_anti").select("id", "grp", number, "vec")
    return scratch.write(rest.unionByName(placed), "deepened"), below, big


def _asked_below(asked: DataFrame, below: DataFrame | None, big: DataFrame | None, opened: float, scratch: Scratch, dim: int) -> DataFrame:
    """The visits with final leaves: of a leaf with a level below, the nearest share ``opened`` of its parts."""
    number = (F.col("qleaf").cast("long") * MOST_PARTS).alias("qleaf")
    if below is None:
        return asked.select("qid", number, "qvec")
    tops = F.broadcast(big.select("top"))
    own = asked.join(tops, F.col("qleaf") == F.col("top"))
    ways = scratch.write(own.groupBy("top").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_TASK).cast("int").alias("ways")), "ways")

    def choose(asks: pa.Table, level: pa.Table) -> pa.Table:
        if not asks.num_rows or not level.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "qleaf": pa.array([], pa.int64()), "qvec": pa.array([], pa.binary())})
        centres = _matrix(level.column("centres"), -1).reshape(-1, dim)
        most = int(min(len(centres), max(1, np.ceil(opened * len(centres)))))
        near = np.argsort(-(_unit(_matrix(asks.column("qvec"), dim)) @ centres.T), axis=1, kind="stable")[:, :most]
        again = pa.array(np.repeat(np.arange(asks.num_rows), most))
        top = asks.column("top")[0].as_py()
        return pa.table({"qid": asks.column("qid").take(again), "qleaf": pa.array(top * MOST_PARTS + near.ravel(), pa.int64()), "qvec": asks.column("qvec").take(again)})

    asks = own.join(F.broadcast(ways), "top").withColumn("way", F.pmod(F.xxhash64("qid"), F.col("ways")).cast("int")).select("qid", "qvec", "top", "way")
    levels = below.join(F.broadcast(ways), "top").select((F.col("top") + 0).alias("_top"), F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("_way"), "centres")
    chosen = asks.groupBy("top", "way").cogroup(levels.groupBy("_top", "_way")).applyInArrow(choose, "qid long, qleaf long, qvec binary")
    rest = asked.join(tops, F.col("qleaf") == F.col("top"), "left_anti").select("qid", number, "qvec")
    return scratch.write(rest.unionByName(chosen), "asked-below")


def _calibrate(stored: DataFrame, below: DataFrame | None, trees: dict[str, Tree], found: np.ndarray, numbers: np.ndarray, ids: np.ndarray, dim: int, k: int, recall: float) -> tuple[dict[str, int], float]:
    """Leaves to visit in each group, and the share of the parts of a leaf with a level below, so that ``recall`` of the exact
    neighbours of sample queries is reached."""
    asks = {g: np.flatnonzero(found == g) for g in trees}
    rng = np.random.default_rng(3)
    asks = {g: (p if len(p) <= CALIBRATION_QUERIES else rng.choice(p, CALIBRATION_QUERIES, replace=False)) for g, p in asks.items()}
    tested = {g: (ids[p], numbers[p]) for g, p in asks.items() if len(p)}
    shared = stored.sparkSession.sparkContext.broadcast(tested)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, grp = _unit(_matrix(batch.column(3), dim)), batch.column(1).to_numpy(zero_copy_only=False)
            own, leaf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for g in set(grp) & set(shared.value):
                at = np.flatnonzero(grp == g)
                sims = shared.value[g][1] @ x[at].T
                sims[shared.value[g][0][:, None] == own[at][None, :]] = -9
                top = np.argpartition(-sims, min(k, sims.shape[1]) - 1, axis=1)[:, :k]
                new = [np.take_along_axis(sims, top, axis=1), leaf[at][top]]
                if g in best:
                    new = [np.hstack([a, b]) for a, b in zip(best[g], new, strict=True)]
                    cut = np.argsort(-new[0], axis=1)[:, :k]
                    new = [np.take_along_axis(a, cut, axis=1) for a in new]
                best[g] = new
        for g, (sims, leaf) in best.items():
            n = sims.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g] * sims.size), pa.array(np.repeat(np.arange(len(sims)), n)), pa.array(leaf.ravel()), pa.array(sims.ravel().astype(np.float64))],
                ["grp", "ask", "leaf", "sim"],
            )

    # A redelivered row is no second neighbour.
    near = once_by_key(stored.select("id", "grp", "leaf", "vec"), "id").mapInArrow(exact, "grp string, ask long, leaf long, sim double").filter("sim > -8")
    top = near.withColumn("n", F.row_number().over(Window.partitionBy("grp", "ask").orderBy(F.desc("sim")))).filter(F.col("n") <= k)
    rows = top.select("grp", "ask", "leaf").toPandas()  # k rows for each of the sample queries
    rows["part"], rows["leaf"] = rows["leaf"] % MOST_PARTS, rows["leaf"] // MOST_PARTS
    visits = dict.fromkeys(trees, 1)
    for g, own in rows.groupby("grp"):
        order = trees[g].all_bins(tested[g][1])
        rank = np.empty((len(order), int(trees[g].leaf.max()) + 1), dtype=np.int64)
        np.put_along_axis(rank, order.astype(np.int64), np.arange(order.shape[1])[None, :].repeat(len(order), 0), axis=1)
        ranks = np.sort(rank[own["ask"].to_numpy(), own["leaf"].to_numpy()])
        need = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1
        visits[g] = min(len(trees[g].leaves), need)
    return visits, _share_below(stored, below, rows, tested, dim, recall)


def _share_below(stored: DataFrame, below: DataFrame | None, rows: pd.DataFrame, tested: dict[str, tuple], dim: int, recall: float) -> float:
    """The share of a leaf's parts, nearest first, in which ``recall`` of the sample queries' neighbours there lie."""
    if below is None or rows.empty:
        return 1.0
    where = [(int(leaf), int(part), tested[g][1][ask].astype(np.float32).tobytes()) for g, ask, leaf, part in zip(rows["grp"], rows["ask"], rows["leaf"], rows["part"], strict=True)]
    asked = stored.sparkSession.createDataFrame(where, "top int, part int, qvec binary").join(below, "top")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, query, centres in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                sims = np.frombuffer(centres.as_py(), np.float32).reshape(-1, dim) @ np.frombuffer(query.as_py(), np.float32)
                out.append(float((sims >= sims[part.as_py()]).sum() / len(sims)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], ["share"])

    shares = np.sort(asked.select("part", "qvec", "centres").mapInArrow(place, "share double").toPandas()["share"].to_numpy())
    return float(shares[min(len(shares) - 1, int(np.ceil(recall * len(shares))) - 1)]) if len(shares) else 1.0
