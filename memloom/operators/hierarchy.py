"""Parent-child links to full hierarchies.

Method: leaves are peeled until only rings stay, the trees that are left get Euler tours, and parallel list ranking of
the tours gives entry and exit positions from which depth, root, ancestors, paths and descendants follow.

* Peeling is done 2**k levels at a time: a node survives 2**k peels exactly if it is the 2**k-th ancestor of some node,
  so the survivors are the image of the parent function applied 2**k times, and every round squares that function.
  The number of rounds is the logarithm of the longest chain, whatever the shape of the forest.
* List ranking is pointer jumping on the successor function of the tour, which is injective: no join key repeats on
  either side, so no tree and no parent, however large, makes a hot key there.
* Children of one parent are put in order within buckets of bounded size and the buckets are chained, so that no window
  ever holds all children of a hot parent.

Defined results: rows with a null id are dropped; a repeated id counts once and takes its smallest parent; a parent that
is null or not in the table ends the chain; a node that is its own parent is a ring of one; an empty table gives no
rows; further columns of the input are ignored.  Ids must lie within +-2**62.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from memloom.scratch import Scratch

#: Largest number of siblings that one window sorts.
SIBLINGS_PER_BUCKET = 20_000
#: Ways over which a block of 2,048 tour positions or more is spread, one for each 1,024 up to so many.
SPREAD = 1_024
#: Ways over which the nodes of one tree are spread to learn its size.
ROOT_WAYS = 16


def parent_links(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """One row (id, parent) per id; parent is null where the chain ends."""
    nodes = (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent"))
        .filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("parent").alias("parent"))
    )
    linked = nodes.filter(F.col("parent").isNotNull())
    known = nodes.select(F.col("id").alias("known"))
    checked = linked.join(known, F.col("parent") == F.col("known"), "left").select("id", F.col("known").alias("parent"))
    return nodes.filter(F.col("parent").isNull()).unionByName(checked)


def _squared(jump: DataFrame) -> DataFrame:
    """(id, jump) applied twice; ids whose second step leads nowhere are dropped."""
    step = jump.select(F.col("id").alias("via"), F.col("jump").alias("to"))
    return jump.join(step, F.col("jump") == F.col("via")).select("id", F.col("to").alias("jump"))


def peel(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(ring ids, ids whose chain never ends).  Both empty for a forest.

    Finite chains have nodes of every length up to their own, and so have the tails that lead into rings: so nothing more
    is peeled once a round leaves the number of ids, and then that of the ids they lead to, as it was.
    """
    jump = scratch.write(links.filter(F.col("parent").isNotNull()).select("id", F.col("parent").alias("jump")), "jump")
    rows, images = -1, -1
    while True:
        seen = Observation()
        jump = scratch.write(_squared(_squared(jump)).observe(seen, F.count(F.lit(1)).alias("n")), "jump")
        now = seen.get["n"]
        if now == 0:
            break
        if now == rows:
            image = jump.agg(F.countDistinct("jump")).first()[0]
            if image == images:
                break
            images = image
        rows = now
    return jump.select(F.col("jump").alias("id")).distinct(), jump.select("id")


def _entry(node: Column) -> Column:
    return node * 2


def _exit(node: Column) -> Column:
    return node * 2 + 1


def euler_successors(tree: DataFrame, scratch: Scratch) -> DataFrame:
    """Tour elements (elem, next, weight) of a forest (id, parent): 2*id enters a node, 2*id+1 leaves it."""
    children = tree.filter(F.col("parent").isNotNull())
    sizes = children.groupBy(F.col("parent").alias("of")).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(SIBLINGS_PER_BUCKET)).cast("long").alias("buckets")
    )
    placed = children.join(sizes, F.col("parent") == F.col("of")).select(
        "id", "parent", F.pmod(F.xxhash64("id"), F.col("buckets")).alias("bucket")
    )
    within = Window.partitionBy("parent", "bucket").orderBy("id")
    placed = scratch.write(
        placed.withColumn("sibling", F.lead("id").over(within)).withColumn("nth", F.row_number().over(within)), "siblings"
    )
    heads = placed.filter("nth = 1").select(F.col("parent").alias("of"), F.col("bucket").alias("at"), F.col("id").alias("head"))
    chain = Window.partitionBy("of").orderBy("at")
    heads = heads.withColumn("following", F.lead("head").over(chain)).withColumn("rank", F.row_number().over(chain))
    hops = heads.filter(F.col("following").isNotNull()).select("of", "at", "following")
    ends = placed.filter(F.col("sibling").isNull()).join(
        hops, (F.col("parent") == F.col("of")) & (F.col("bucket") == F.col("at")), "left"
    )
    leaving_children = placed.filter(F.col("sibling").isNotNull()).select("id", _entry(F.col("sibling")).alias("next")).unionByName(
        ends.select("id", F.coalesce(_entry(F.col("following")), _exit(F.col("parent"))).alias("next"))
    )
    leaving = leaving_children.unionByName(
        tree.filter(F.col("parent").isNull()).select("id", F.lit(None).cast("long").alias("next"))
    ).select(_exit(F.col("id")).alias("elem"), "next", F.lit(-1).cast("long").alias("weight"))
    first = heads.filter("rank = 1").select("of", "head")
    entering = tree.select("id").join(first, F.col("id") == F.col("of"), "left").select(
        _entry(F.col("id")).alias("elem"),
        F.coalesce(_entry(F.col("head")), _exit(F.col("id"))).alias("next"),
        F.lit(1).cast("long").alias("weight"),
    )
    return entering.unionByName(leaving)


def _jumped(state: DataFrame) -> DataFrame:
    """Every element's pointer moved to where its successor's points, with what lies between."""
    ahead = state.select(*[F.col(c).alias(f"a_{c}") for c in ("elem", "next", "to_end", "weight_to_end", "last")])
    moved = state.filter(F.col("next").isNotNull()).join(ahead, F.col("next") == F.col("a_elem")).select(
        "elem", F.col("a_next").alias("next"), (F.col("to_end") + F.col("a_to_end")).alias("to_end"),
        (F.col("weight_to_end") + F.col("a_weight_to_end")).alias("weight_to_end"), F.col("a_last").alias("last"),
    )
    return state.filter(F.col("next").isNull()).unionByName(moved)


def rank_list(elements: DataFrame, scratch: Scratch) -> DataFrame:
    """(elem, to_end, weight_to_end, last) of linked lists (elem, next, weight), by pointer jumping.

    Each round jumps twice before it writes, and the write itself counts the pointers that are left.
    """
    state = scratch.write(
        elements.select(
            "elem", "next", F.lit(1).cast("long").alias("to_end"), F.col("weight").alias("weight_to_end"),
            F.when(F.col("next").isNull(), F.col("elem")).alias("last"),
        ),
        "ranks",
    )
    left = 1
    while left:
        seen = Observation()
        state = scratch.write(_jumped(_jumped(state)).observe(seen, F.count("next").alias("left")), "ranks")
        left = seen.get["left"]
    return state.drop("next")


def hierarchy(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """One row per id: node_state, root_id, depth, entry, exit, descendants.

    node_state is 'tree', 'cycle' (on a ring; depth -1) or 'below_cycle' (its chain leads into a ring; depth -2); the
    last two have root_id -1 and no interval.  Within a root, u lies below v exactly if entry(v) < entry(u) < exit(v).
    """
    scratch = Scratch(df.sparkSession, "hierarchy")
    links = scratch.write(parent_links(df, id_col, parent_col), "links")
    ring, endless = peel(links, scratch)
    tree = links.join(endless, "id", "left_anti")
    ranks = rank_list(euler_successors(tree, scratch), scratch)
    # An element's node is elem >> 1 for either sign; 'last' leaves the root.
    side = ranks.withColumn("id", F.expr("shiftright(elem, 1)")).withColumn("enters", F.expr("elem % 2 = 0"))
    nodes = side.groupBy("id").agg(
        F.max(F.when(F.col("enters"), F.col("to_end"))).alias("from_end"),
        F.max(F.when(~F.col("enters"), F.col("to_end"))).alias("left_from_end"),
        F.max(F.when(F.col("enters"), -F.col("weight_to_end"))).alias("depth"),
        F.max(F.expr("shiftright(last, 1)")).alias("root_id"),
    )
    trees = nodes.select(
        "id", F.lit("tree").alias("node_state"), "root_id", F.col("depth").cast("int").alias("depth"),
        (-F.col("from_end")).alias("entry"), (-F.col("left_from_end")).alias("exit"),
        ((F.col("from_end") - F.col("left_from_end") - 1) / 2).cast("long").alias("descendants"),
    )
    nothing = F.lit(None).cast("long")
    rings = ring.select(
        "id", F.lit("cycle").alias("node_state"), F.lit(-1).cast("long").alias("root_id"), F.lit(-1).alias("depth"),
        nothing.alias("entry"), nothing.alias("exit"), nothing.alias("descendants"),
    )
    below = endless.join(ring, "id", "left_anti").select(
        "id", F.lit("below_cycle").alias("node_state"), F.lit(-1).cast("long").alias("root_id"), F.lit(-2).alias("depth"),
        nothing.alias("entry"), nothing.alias("exit"), nothing.alias("descendants"),
    )
    return trees.unionByName(rings).unionByName(below)


def ancestor_pairs(nodes: DataFrame, levels: int = 40) -> DataFrame:
    """(ancestor_id, id, distance) for every pair of a tree, from the entry-exit intervals of ``hierarchy``.

    Each interval is cut into its canonical dyadic blocks and each entry stands in one block of every size, so an
    equality join on (root, size, block) finds every pair exactly once and compares nothing else.
    """
    tree = nodes.filter(F.col("node_state") == "tree").select(
        "id", "root_id", "depth", (-F.col("exit")).alias("low"), (-F.col("entry")).alias("high")
    )
    # The open interval (low, high) of an ancestor in positions from the end; block b of level l is [b*2**l, (b+1)*2**l).
    inner = tree.filter("high - low > 1").select("id", "root_id", "depth", (F.col("low") + 1).alias("l"), F.col("high").alias("r"))
    spans = inner.withColumn("level", F.explode(F.expr(f"sequence(0, least({levels}, cast(ceil(log2(r - l + 1)) as int)))")))
    size = F.expr("shiftleft(1L, level)")
    twice = F.expr("shiftleft(1L, level + 1)")
    first, last = F.ceil(F.col("l") / size).cast("long"), F.floor(F.col("r") / size).cast("long")
    # A canonical block lies in [l, r) while the block of twice its size does not.
    block = F.explode(F.array_distinct(F.array(first, last - 1)))
    blocks = (
        spans.withColumn("block", block)
        .withColumn("from", F.col("block") * size)
        .withColumn("outer", F.floor(F.col("from") / twice).cast("long") * twice)
        .filter((F.col("from") >= F.col("l")) & (F.col("from") + size <= F.col("r")))
        .filter((F.col("outer") < F.col("l")) | (F.col("outer") + twice > F.col("r")))
        .select(F.col("id").alias("ancestor_id"), F.col("depth").alias("above"), "root_id", "level", "block")
    )
    # How high a tree's blocks go follows from the size of its root's interval: one row for each tree, joined by a hash of both.
    tops = inner.filter(F.col("id") == F.col("root_id")).select(F.col("root_id"), F.expr("cast(ceil(log2(r - l + 1)) as int)").alias("top"), F.explode(F.sequence(F.lit(0), F.lit(ROOT_WAYS - 1))).alias("way"))
    points = (
        tree.withColumn("way", F.pmod(F.xxhash64("id"), F.lit(ROOT_WAYS)).cast("int")).join(tops, ["root_id", "way"])
        .withColumn("level", F.explode(F.expr(f"sequence(0, least({levels}, top))")))
        .select("id", "depth", "root_id", "level", F.expr("shiftright(high, level)").alias("block"))
    )
    # A large tree's top levels have few blocks, in which all its nodes stand: those blocks are spread over the nodes' hashes.
    ways = lambda level: F.expr(f"cast(least({SPREAD}L, greatest(1L, shiftright(shiftleft(1L, {level}), 10))) as int)")
    points = points.withColumn("salt", F.pmod(F.xxhash64("id"), ways("level")).cast("int"))
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), ways("level") - 1)))
    return blocks.join(points, ["root_id", "level", "block", "salt"]).select(
        "ancestor_id", "id", (F.col("depth") - F.col("above")).cast("int").alias("distance")
    )


def paths(nodes: DataFrame) -> DataFrame:
    """(id, path): ids from the root down to the node itself, joined by '/'.  Only tree nodes have a path."""
    above = ancestor_pairs(nodes).groupBy("id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor_id"))), lambda x: x["ancestor_id"]).alias("above")
    )
    return nodes.filter(F.col("node_state") == "tree").join(above, "id", "left").select(
        "id", F.concat_ws("/", F.coalesce(F.col("above").cast("array<string>"), F.array().cast("array<string>")), F.col("id").cast("string")).alias("path")
    )
