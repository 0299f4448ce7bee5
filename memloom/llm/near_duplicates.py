"""Near-duplicate records: pairs whose sets of word shingles have a Jaccard similarity of a threshold or more.

Method: a count-vector R-tree.  Shingles are hashed into groups, the counts per group are a point, and the overlap of
two sets is at most the sum of the coordinate minima of their points.  Points are packed into leaves by size and class,
the leaves' boxes bound the overlap of all their pairs, leaf pairs that may hold a pair are compared point by point by
the same bound, and the pairs that survive are verified on the sets themselves.  Nothing is lost: every step only drops
pairs whose bound is below what the threshold needs.

The number of groups grows with the sets (at least half as many as shingles), since fewer groups could not tell
unrelated sets apart; as it is a power of two, a point with more groups folds exactly to one with fewer.  Counts are
kept as unary bit planes, so that a coordinate minimum is an AND and its sum a population count.

Sets that are equal are one class and enter the tree once, however many records share them.

Defined results: a null id or text is left out, as is a text of fewer words than the minimum; repeated ids count once;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.scratch import Scratch

WORD = re.compile(r"[^\W_]+")
#: Points in a leaf, at most, and bytes of their planes (both sides of a pair of leaves stand in one task).
LEAF_ROWS = 4_096
LEAF_BYTES = 8_000_000
PLANES = 4
LEAST_GROUPS = 64
_K = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str, width: int, hashes: dict[str, int]) -> tuple[int, np.ndarray]:
    """(words, ascending hashes of the distinct shingles)."""
    words = WORD.findall(text.lower())
    if len(words) < width:
        return len(words), np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(w) - width + 1
    h = w[:n].copy()
    for i in range(1, width):
        h = _mix(h) * _K + w[i : i + n]
    return len(words), np.unique(_mix(h))


def groups_for(n: int) -> int:
    """Groups of the point of a set of n shingles; sets of similar size differ by a factor of two at most."""
    g = LEAST_GROUPS
    while g * 2 < n:
        g *= 2
    return g


def planes(shingles: np.ndarray, groups: int) -> tuple[np.ndarray, int, np.ndarray]:
    """(bit planes as uint64 words, what the counts exceed the planes by, counts)."""
    counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    unary = counts[None, :] > np.arange(PLANES)[:, None]
    return np.packbits(unary, axis=1).view(np.uint64).ravel(), int(np.maximum(counts - PLANES, 0).sum()), counts


def _texts(df: DataFrame, id_col: str, text_col: str, field: str, least_words: int) -> DataFrame:
    """(field, id, least, body) of the records that may have enough words."""
    return df.select(F.lit(field).alias("field"), F.col(id_col).cast("long").alias("id"), F.lit(least_words).alias("least"), F.col(text_col).cast("string").alias("body")).filter(
        F.col("id").isNotNull() & (F.length("body") >= 2 * least_words - 1)
    )


def _each_set(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[str, int, np.ndarray]]:
    hashes = _Hashes()
    for batch in batches:
        for field, i, least, text in zip(*(batch.column(k) for k in range(4)), strict=True):
            words, s = shingle_set(text.as_py(), width, hashes)
            if words >= least.as_py() and len(s):
                yield field.as_py(), i.as_py(), s


def _batched(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: int = 4_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def points_of(texts: DataFrame, width: int) -> DataFrame:
    """(field, id, n, sig, own, folded, over, over_half, box): the points of all records; sig is equal for equal sets.

    Only points leave the task: the sets, many times larger, are made again for the few records to be verified.
    """
    names = ["field", "id", "n", "sig", "own", "folded", "over", "over_half", "box"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for field, i, s in _each_set(batches, width):
                groups = groups_for(len(s))
                own, over, counts = planes(s, groups)
                folded, over_half, _ = planes(s, max(groups // 2, LEAST_GROUPS))
                box = counts.reshape(-1, LEAST_GROUPS).sum(axis=0).astype(np.int32)
                yield field, i, len(s), xxhash.xxh3_128_digest(s.tobytes()), own.tobytes(), folded.tobytes(), over, over_half, box.tobytes()

        yield from _batched(rows(), names, kinds)

    return texts.mapInArrow(run, "field string, id long, n int, sig binary, own binary, folded binary, over int, over_half int, box binary")


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """(field, id, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(((f, i, s.tobytes()) for f, i, s in _each_set(batches, width)), ["field", "id", "shingles"], [pa.string(), pa.int64(), pa.binary()], 500)

    return texts.mapInArrow(run, "field string, id long, shingles binary")


def _leaf_rows(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per leaf: its size range, class, box and packed points."""
    fine = F.floor(F.log("n") / 0.0025).cast("int")
    sizes = reps.groupBy("field", F.expr(_GROUPS_SQL).alias("groups"), fine.alias("bin")).count().toPandas()
    # Bins of a quarter percent: a few thousand rows at most, whatever the number of records.
    keys, leaf = {}, 0
    for (_, wide), own in sizes.sort_values("bin").groupby(["field", "groups"]):
        held = 0
        most = max(1, min(LEAF_ROWS, LEAF_BYTES // (PLANES * int(wide) // 8)))  # rows of a leaf
        for f, g, b, c in own.itertuples(index=False):
            parts = -(-int(c) // most)
            if parts > 1:
                leaf += bool(held)
                keys[f, g, b] = (leaf, parts)
                leaf, held = leaf + parts, 0
            else:
                if held + c > most:
                    leaf, held = leaf + 1, 0
                keys[f, g, b] = (leaf, 1)
                held += c
        leaf += bool(held)
    spark = reps.sparkSession
    table = spark.createDataFrame([(f, int(g), int(b), a, p) for (f, g, b), (a, p) in keys.items()], "field string, groups int, bin int, leaf0 long, parts int")
    placed = (
        reps.withColumn("groups", F.expr(_GROUPS_SQL)).withColumn("bin", fine)
        .join(F.broadcast(table), ["field", "groups", "bin"])
        .withColumn("leaf", F.col("leaf0") + F.pmod(F.xxhash64("id"), F.col("parts")))
        .select("leaf", "field", "groups", "id", "n", "own", "folded", "over", "over_half", "box")
    )

    def pack(points: pa.Table) -> pa.Table:
        _, first = np.unique(points.column("id").to_numpy(), return_index=True)  # redelivered rows fall into one leaf
        n = points.column("n").to_numpy()[first]
        order = first[np.argsort(n, kind="stable")]
        box = np.frombuffer(b"".join(points.column("box").to_pylist()), np.int32).reshape(-1, LEAST_GROUPS).max(axis=0)
        pick = lambda c: points.column(c).to_numpy()[order].astype(np.int64).tobytes()
        one = lambda x: pa.array([x])

        def joined(c: str) -> bytes:
            raw = points.column(c).to_pylist()
            return b"".join(raw[i] for i in order)

        return pa.table({
            "leaf": one(points.column("leaf")[0].as_py()), "field": one(points.column("field")[0].as_py()), "groups": pa.array([points.column("groups")[0].as_py()], pa.int32()),
            "least": pa.array([int(n.min())], pa.int32()), "most": pa.array([int(n.max())], pa.int32()), "box": one(box.astype(np.int64).tobytes()),
            "ids": one(pick("id")), "ns": one(pick("n")), "own": one(joined("own")), "folded": one(joined("folded")), "over": one(pick("over")), "over_half": one(pick("over_half")),
        })

    kind = "leaf long, field string, groups int, least int, most int, box binary, ids binary, ns binary, own binary, folded binary, over binary, over_half binary"
    return scratch.write(placed.groupBy("leaf").applyInArrow(pack, kind), "leaves")


_GROUPS_SQL = f"cast(greatest({LEAST_GROUPS}, shiftleft(1, cast(ceil(log2(n / 2.0)) as int))) as int)"


def _leaf_pairs(leaves: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b) of leaves that may hold a similar pair: their sizes are near enough and their boxes overlap enough."""
    slot = lambda n: F.floor(F.log(n) / F.lit(-float(np.log(threshold)))).cast("int")
    meta = leaves.select("leaf", "field", "least", "most", "box")
    left = meta.select(*[F.col(c).alias(f"{c}_a") for c in meta.columns], F.explode(F.sequence(slot(F.col("least")), slot(F.col("most")))).alias("slot"))
    right = meta.select(*[F.col(c).alias(f"{c}_b") for c in meta.columns], F.explode(F.sequence(slot(F.col("least")) - 1, slot(F.col("most")) + 1)).alias("slot_b"))
    near = left.join(right, (F.col("field_a") == F.col("field_b")) & (F.col("slot") == F.col("slot_b"))).filter(
        (F.col("leaf_a") <= F.col("leaf_b")) & (F.col("least_b") * threshold <= F.col("most_a")) & (F.col("least_a") * threshold <= F.col("most_b"))
    ).dropDuplicates(["leaf_a", "leaf_b"])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            boxes = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64).reshape(batch.num_rows, -1) for c in ("box_a", "box_b")]
            most = np.minimum(*boxes).sum(axis=1)
            need = threshold / (1 + threshold) * (batch.column("least_a").to_numpy().astype(float) + batch.column("least_b").to_numpy())
            keep = pa.array(most >= np.floor(need))
            yield pa.RecordBatch.from_arrays([batch.column("leaf_a").filter(keep), batch.column("leaf_b").filter(keep)], ["a", "b"])

    return scratch.write(near.mapInArrow(bound, "a long, b long"), "leaf-pairs")


def _folded(ids: np.ndarray, ns: np.ndarray, over: np.ndarray, bits: np.ndarray, groups: int, wanted: int) -> tuple[np.ndarray, ...]:
    """Points of more groups as points of ``wanted`` ones: counts of the halves are added, as often as it takes.

    The number of groups is a power of two and a shingle's group its lowest bits, so the upper half folds onto the lower.
    What a point's planes do not show of a count stays in ``over``, from which no bound becomes too small.
    """
    while groups > wanted:
        counts = np.unpackbits(bits.view(np.uint8).reshape(len(ids), PLANES, -1), axis=2).sum(axis=1, dtype=np.int64)
        counts = counts[:, : groups // 2] + counts[:, groups // 2 :]
        groups //= 2
        over = over + np.maximum(counts - PLANES, 0).sum(axis=1)
        unary = counts[:, None, :] > np.arange(PLANES)[None, :, None]
        bits = np.packbits(unary, axis=2).reshape(len(ids), -1).view(np.uint64)
    return ids, ns, over, bits


def _candidates(leaves: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(field, id_a, id_b) whose bound on the overlap reaches what the threshold needs."""
    payload = ["groups", "ids", "ns", "own", "folded", "over", "over_half"]
    side = lambda s: leaves.select(F.col("leaf").alias(f"leaf_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in payload], *(["field"] if s == "a" else []))
    tasks = max(1, min(pairs.count(), 64 * leaves.sparkSession.sparkContext.defaultParallelism))
    both = pairs.join(side("a"), F.col("a") == F.col("leaf_a")).join(side("b"), F.col("b") == F.col("leaf_b")).repartition(tasks, "a", "b")
    share = threshold / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                groups = min(row["groups_a"], row["groups_b"])
                got = []
                for s in "ab":
                    fold = row[f"groups_{s}"] > groups
                    ids, ns, over = (np.frombuffer(row[f"{c}_{s}"], np.int64) for c in ("ids", "ns", "over_half" if fold else "over"))
                    bits = np.frombuffer(row[f"{'folded' if fold else 'own'}_{s}"], np.uint64).reshape(len(ids), -1)
                    got.append(_folded(ids, ns, over, bits, max(LEAST_GROUPS, row[f"groups_{s}"] // 2) if fold else groups, groups))
                (ids_a, n_a, over_a, bits_a), (ids_b, n_b, over_b, bits_b) = got
                by_word = np.ascontiguousarray(bits_b.T)
                for lo in range(0, len(ids_a), 128):
                    hi = min(lo + 128, len(ids_a))
                    first = np.searchsorted(n_b, np.floor(n_a[lo] * threshold))
                    last = np.searchsorted(n_b, np.ceil(n_a[hi - 1] / threshold), "right")
                    if row["a"] == row["b"]:
                        first = max(first, lo)
                    if first >= last:
                        continue
                    most = np.minimum(over_a[lo:hi, None], over_b[None, first:last]).astype(np.int32)
                    part = np.zeros(most.shape, np.uint16 if groups * PLANES <= 65_535 else np.int32)  # holds as many bits as a point has
                    for w in range(by_word.shape[0]):
                        part += np.bitwise_count(bits_a[lo:hi, w, None] & by_word[w, None, first:last])
                    most += part
                    i, j = np.nonzero(most >= np.ceil(share * (n_a[lo:hi, None] + n_b[None, first:last]) - 1e-6))
                    i, j = i + lo, j + first
                    if row["a"] == row["b"]:
                        i, j = i[i < j], j[i < j]
                    x, y = ids_a[i], ids_b[j]
                    yield pa.RecordBatch.from_arrays([pa.array([row["field"]] * len(x), pa.string()), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["field", "id_a", "id_b"])

    return both.mapInArrow(run, "field string, id_a long, id_b long")


#: Up to so many candidate records (16 bytes each) are sent to every task to pick their texts; beyond, they are joined.
SENT_IDS = 500_000


def similar_classes(texts: DataFrame, threshold: float, width: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(members (field, id, rep), pairs of representatives (field, rep_a, rep_b, similarity)) of ``texts``."""
    points = scratch.write(points_of(texts, width), "points")
    classes = points.groupBy("field", "sig").agg(F.min("id").alias("rep"))
    members = scratch.write(points.select("field", "id", "sig").distinct().join(classes, ["field", "sig"]).select("field", "id", "rep"), "members")
    reps = points.join(members.filter("id = rep").select("field", "id"), ["field", "id"], "left_semi").drop("sig")
    leaves = _leaf_rows(reps, scratch)
    pairs = _leaf_pairs(leaves, threshold, scratch)
    found = scratch.write(_candidates(leaves, pairs, threshold), "candidates")
    needed = scratch.write(found.select("field", F.explode(F.array("id_a", "id_b")).alias("id")).distinct(), "needed")
    few = needed.count() <= SENT_IDS
    chosen = texts.join(F.broadcast(needed) if few else needed, ["field", "id"], "left_semi")
    sets = scratch.write(sets_of(chosen.select("field", "id", "least", "body"), width).dropDuplicates(["field", "id"]), "sets")
    side = lambda s: sets.select("field", F.col("id").alias(f"id_{s}"), F.col("shingles").alias(f"set_{s}"))
    both = found.join(side("a"), ["field", "id_a"]).join(side("b"), ["field", "id_b"]).select("field", "id_a", "id_b", "set_a", "set_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, union = np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows, np.int64)
            for i, (a, b) in enumerate(zip(batch.column(3), batch.column(4), strict=True)):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                at = np.searchsorted(y, x)
                shared[i] = (y[np.minimum(at, len(y) - 1)] == x).sum()
                union[i] = len(x) + len(y) - shared[i]
            keep = pa.array(shared >= threshold * union - 1e-9)
            cols = [batch.column(i).filter(keep) for i in range(3)] + [pa.array(shared / union).filter(keep)]
            yield pa.RecordBatch.from_arrays(cols, ["field", "rep_a", "rep_b", "similarity"])

    return members, both.mapInArrow(verify, "field string, rep_a long, rep_b long, similarity double")


def near_duplicates(episodes: DataFrame, threshold: float = 0.7, width: int = 3, content_words: int = 40, summary_words: int = 25) -> tuple[DataFrame, DataFrame]:
    """Members and representative pairs of the episodes' contents and summaries; see ``similar_classes``."""
    scratch = Scratch(episodes.sparkSession, "near-duplicates")
    texts = _texts(episodes, "id", "content", "content", content_words).unionByName(_texts(episodes, "id", "summary", "summary", summary_words))
    return similar_classes(texts, threshold, width, scratch)


def all_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(field, id_a, id_b) of all similar records, copies included, the smaller id first."""
    a = members.select("field", F.col("rep").alias("rep_a"), F.col("id").alias("x"))
    b = members.select("field", F.col("rep").alias("rep_b"), F.col("id").alias("y"))
    across = pairs.select("field", "rep_a", "rep_b").join(a, ["field", "rep_a"]).join(b, ["field", "rep_b"]).select("field", "x", "y")
    inside = a.withColumnRenamed("rep_a", "rep").join(b.withColumnRenamed("rep_b", "rep"), ["field", "rep"]).filter("x < y").select("field", "x", "y")
    return across.unionByName(inside).select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(field, id, rep, links): per record its class and the number of other classes it is similar to."""
    ends = pairs.select("field", F.col("rep_a").alias("rep")).unionByName(pairs.select("field", F.col("rep_b").alias("rep")))
    links = ends.groupBy("field", "rep").agg(F.count(F.lit(1)).alias("links"))
    return members.join(links, ["field", "rep"], "left").select("field", "id", "rep", F.coalesce("links", F.lit(0)).alias("links"))
