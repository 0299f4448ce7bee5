"""Analytical reads: every function takes a ``Model`` (and parameters) and returns a DataFrame.

Times 'now' and 'today' are always parameters, every limit has a total order, joins that only count are grouped first.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import fragment_content, fragment_type, normalized_path, sanitized
from memloom.plans.model import Model, visible

TODAY, NOW = date(2026, 5, 13), datetime(2026, 5, 13, 18)
EXCLUDED_TYPE = "episode_topic"
#: Predicates that stand for open work, and what names a deadline.
OPEN_PREDICATES = ["open_question", "next_step", "pending", "todo", "goal", "blocker", "decision_pending"]
DEADLINE_WORDS = ["얼마 안", "deadline", "이번주", "내일", "urgent", "마감", "EOD", "this week", "오늘까지", "금일까지", "tomorrow"]
#: Open predicates of these tables, which use other words for them.
STORED_OPEN = ["blocked_by", "scheduled_for", "depends_on"]


def _best(df: DataFrame, by: list[str], order: list, limit: int) -> DataFrame:
    """The first rows of each group with their place; ranks are cut before the shuffle, so a hot group stays small."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= limit)


# --- timelines and histograms -------------------------------------------------------------------------------------
def timeline_page(m: Model, workspace_id: int = 1, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of a workspace's turns, newest first, each row with the total."""
    own = m.turns_of(workspace_id)
    page = own.orderBy(F.desc("said_at"), F.desc("id")).offset(offset).limit(limit).select("id", "episode_id", "sequence", "said_at")
    total = own.agg(F.count(F.lit(1)).alias("total"))
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)  # one row


def date_buckets(m: Model) -> DataFrame:
    return m.turns.groupBy("workspace_id", "day").agg(F.count(F.lit(1)).alias("turns"))


def subject_date_buckets(m: Model) -> DataFrame:
    """Distinct turns of a subject and everything below it, by day."""
    closure = subject_closure(m)
    return m.links.join(closure, F.col("subject_id") == F.col("descendant_id")).groupBy("ancestor_id", "day").agg(F.countDistinct("turn_id").alias("turns"))


def on_this_day(m: Model, today: date = TODAY) -> DataFrame:
    return m.turns_where(
        (F.month("day") == today.month) & (F.dayofmonth("day") == today.day) & (F.col("day") != F.lit(today))
    ).select("id", "workspace_id", "day", F.substring("text", 1, 200).alias("excerpt"))


def last_episodes(m: Model, per_workspace: int = 3) -> DataFrame:
    newest = Window.partitionBy("workspace_id").orderBy(F.desc("created_at"), F.desc("id"))
    return (
        m.episodes.filter(visible(F.col("metadata"))).withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= per_workspace)
        .select("workspace_id", "place", "id", F.substring(F.coalesce(F.nullif(F.col("human_summary"), F.lit("")), F.col("summary")), 1, 150).alias("summary"))
    )


def diaries_by_date(m: Model) -> DataFrame:
    """Summarised episodes with the time of their first turn and how many they have."""
    spans = m.turns.filter("episode_id is not null").groupBy("episode_id").agg(F.min("said_at").alias("first_at"), F.count(F.lit(1)).alias("turns"))
    told = m.episodes.filter(visible(F.col("metadata")) & (F.length(F.trim("summary")) > 0))
    return told.join(spans, F.col("id") == F.col("episode_id"), "left").select(
        "id", "workspace_id", F.to_date(F.coalesce("first_at", "created_at")).alias("day"), F.coalesce("turns", F.lit(0)).alias("turns")
    )


# --- subjects and entities ------------------------------------------------------------------------------------------
def subject_closure(m: Model) -> DataFrame:
    """(ancestor_id, descendant_id, distance) of the subject tree, each node below itself at distance 0."""
    from memloom.operators.hierarchy import ancestor_pairs, hierarchy

    nodes = hierarchy(m.entities.select("id", "parent_id"))
    pairs = ancestor_pairs(nodes).select("ancestor_id", F.col("id").alias("descendant_id"), "distance")
    own = m.entities.select(F.col("id").alias("ancestor_id"), F.col("id").alias("descendant_id"), F.lit(0).alias("distance"))
    return pairs.unionByName(own)


def subject_feed(m: Model, per_subject: int = 5) -> DataFrame:
    """The latest turns of a subject and everything below it."""
    closure = subject_closure(m)
    below = m.links.join(closure, F.col("subject_id") == F.col("descendant_id")).select("ancestor_id", "turn_id", "day").distinct()
    newest = Window.partitionBy("ancestor_id").orderBy(F.desc("day"), F.desc("turn_id"))
    return below.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= per_subject)


def subject_tree(m: Model) -> DataFrame:
    """Linked subjects only; a parent that is not linked makes its child a root."""
    counts = m.links.groupBy("subject_id").agg(F.countDistinct("turn_id").alias("turns"))
    own = m.entities.select("id", "parent_id", "name").join(counts, F.col("id") == F.col("subject_id"))
    parents = counts.select(F.col("subject_id").alias("linked_parent"))
    return own.join(parents, F.col("parent_id") == F.col("linked_parent"), "left").select(
        "id", F.col("linked_parent").alias("parent_id"), "name", "turns", F.col("linked_parent").isNull().alias("is_root")
    )


def subjects_by_turns(m: Model) -> DataFrame:
    counts = m.links.groupBy("subject_id").agg(F.countDistinct("turn_id").alias("turns"))
    parents = m.entities.select(F.col("id").alias("p_id"), F.col("name").alias("parent_name"))
    return (
        m.entities.join(counts, F.col("id") == F.col("subject_id"), "left").join(parents, F.col("parent_id") == F.col("p_id"), "left")
        .select("id", "name", "parent_name", F.coalesce("turns", F.lit(0)).alias("turns"))
    )


def entity_index(m: Model) -> DataFrame:
    """Names with their facts and links and their workspace's totals."""
    counts = m.facts.groupBy("workspace_id", "subject").agg(F.count(F.lit(1)).alias("facts"), F.max("valid_from").alias("latest"))
    return counts.join(degree(m).withColumnRenamed("name", "subject"), ["workspace_id", "subject"], "left").select(
        "workspace_id", "subject", "facts", "latest", F.coalesce("degree", F.lit(0)).alias("degree")
    ).join(m.facts.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("workspace_facts")), "workspace_id")


def entity_groups(m: Model) -> DataFrame:
    """The index by type: entities of each type with their facts, types with most facts first, session labels left out."""
    kind = F.coalesce(F.lower(F.trim("entity_type")), F.lit("other"))
    facts = m.fact_entities.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("facts"))
    own = m.entities.select("id", "workspace_id", kind.alias("kind")).filter(F.col("kind") != EXCLUDED_TYPE).join(facts, "id", "left")
    grouped = own.groupBy("workspace_id", "kind").agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum("facts"), F.lit(0)).alias("facts"))
    return _best(grouped, ["workspace_id"], [F.desc("facts"), F.asc("kind")], 2**31 - 1)


def top_entities(m: Model, limit: int = 10) -> DataFrame:
    counts = m.facts.groupBy("workspace_id", "subject").agg(F.count(F.lit(1)).alias("facts"))
    joined = counts.join(degree(m).withColumnRenamed("name", "subject"), ["workspace_id", "subject"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return _best(joined, ["workspace_id"], [F.desc("facts"), F.desc("degree"), F.asc("subject")], limit).select("workspace_id", "place", "subject", "facts", "degree")


def entity_counts(m: Model, name: str | None = None) -> DataFrame:
    """Per subject of a workspace: facts, outgoing and incoming relations, episodes."""
    key = ["workspace_id", "subject"]
    facts = m.facts.groupBy(*key).agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("episode_id").alias("episodes"))
    out = m.relations.groupBy("workspace_id", F.col("source").alias("subject")).agg(F.count(F.lit(1)).alias("outgoing"))
    into = m.relations.groupBy("workspace_id", F.col("target").alias("subject")).agg(F.count(F.lit(1)).alias("incoming"))
    page = facts.join(out, key, "left").join(into, key, "left").na.fill(0, ["outgoing", "incoming"])
    return page.filter(F.lower("subject") == name.lower()) if name else page


def entity_page(m: Model, facts: int = 30, relations: int = 24, episodes: int = 10) -> DataFrame:
    """(workspace_id, entity_id, part, place, ref, label): every entity's page.

    Parts are the entity itself, its parent and children (most turns first), its latest facts, its relations both ways
    and the episodes it was last spoken of in; an entity without one of them has no rows for it.
    """
    own = m.entities.select("id", "workspace_id", "name", "entity_type", "parent_id")
    row = lambda df, part, ref, label: df.select("workspace_id", "entity_id", F.lit(part).alias("part"), F.col("place").cast("int").alias("place"), F.col(ref).cast("long").alias("ref"), label.alias("label"))
    head = row(own.withColumn("entity_id", F.col("id")).withColumn("place", F.lit(1)), "entity", "id", F.concat_ws(" / ", "name", "entity_type"))
    above = own.select(F.col("id").alias("parent_id"), "workspace_id", F.col("name").alias("above"))
    pairs = own.select(F.col("id").alias("child"), "name", "parent_id", "workspace_id").join(above, ["parent_id", "workspace_id"])
    parent = row(pairs.withColumn("entity_id", F.col("child")).withColumn("place", F.lit(1)), "parent", "parent_id", F.col("above"))
    turns = m.links.groupBy(F.col("subject_id").alias("child")).agg(F.count(F.lit(1)).alias("turns"))
    ranked = pairs.join(turns, "child", "left").withColumn("entity_id", F.col("parent_id"))
    children = row(_best(ranked, ["workspace_id", "entity_id"], [F.desc(F.coalesce("turns", F.lit(0))), F.asc("child")], 2**31 - 1), "child", "child", F.col("name"))
    known = m.facts.join(m.fact_entities, "hint_id")
    told = row(_best(known, ["workspace_id", "entity_id"], [F.desc_nulls_last("valid_from"), F.asc("hint_id")], facts), "fact", "hint_id", F.concat_ws(" ", "predicate", "object_value"))
    named = m.entity_names
    ends = [
        m.relations.join(named.withColumnRenamed("key", "near"), (F.lower(F.trim(a)) == F.col("near")) & (m.relations.workspace_id == named.workspace_id)).select(
            m.relations.workspace_id, "entity_id", "hint_id", "valid_from", F.concat_ws(" ", F.lit(way), "relation_type", b).alias("label"), F.lit(way).alias("way")
        )
        for a, b, way in (("source", "target", "out"), ("target", "source", "in"))
    ]
    edges = row(_best(ends[0].unionByName(ends[1]), ["workspace_id", "entity_id"], [F.desc_nulls_last("valid_from"), F.asc("hint_id"), F.asc("way")], relations), "relation", "hint_id", F.col("label"))
    shown = m.episodes.filter(visible(F.col("metadata"))).select(F.col("id").alias("episode_id"), F.substring(F.coalesce(F.nullif("human_summary", F.lit("")), "summary", F.lit("")), 1, 400).alias("summary"))
    spoken = m.links.groupBy("workspace_id", F.col("subject_id").alias("entity_id"), "episode_id").agg(F.min("day").alias("day")).join(m.entities.select(F.col("id").alias("entity_id"), "workspace_id"), ["entity_id", "workspace_id"])
    recent = row(_best(spoken.join(shown, "episode_id"), ["workspace_id", "entity_id"], [F.desc_nulls_last("day"), F.asc("episode_id")], episodes), "episode", "episode_id", F.col("summary"))
    out = head
    for part in (parent, children, told, edges, recent):
        out = out.unionByName(part)
    return out


# --- facts -----------------------------------------------------------------------------------------------------------
def fact_dedup(m: Model) -> DataFrame:
    """The same triple once: its first hint is the source, the others reinforce it."""
    triple = ["workspace_id", "subject", "predicate", "object_value"]
    first = m.facts.groupBy(*[F.col(c).alias(f"_{c}") for c in triple]).agg(F.min("hint_id").alias("fact_id"))
    same = F.lit(True)
    for c in triple:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return m.facts.join(first, same).select("hint_id", "episode_id", "fact_id", F.when(F.col("hint_id") == F.col("fact_id"), "source").otherwise("reinforcing").alias("role"))


def fact_history(m: Model) -> DataFrame:
    """How many other values a subject has for the same predicate, and the latest of them."""
    # In a struct's order null comes first, so the largest one is the latest.
    latest = F.max(F.struct("valid_from", "hint_id", "object_value"))
    return m.facts.groupBy("workspace_id", "subject", "predicate").agg(latest.alias("l"), F.count(F.lit(1)).alias("versions")).select(
        "workspace_id", "subject", "predicate", "l.object_value", "l.hint_id", "versions"
    )


def top3_facts(m: Model) -> DataFrame:
    return _best(m.facts, ["workspace_id", "subject"], [F.desc_nulls_last("valid_from"), F.asc("hint_id")], 3).select("workspace_id", "subject", "place", "hint_id", "predicate", "object_value")


def topic_stats(m: Model, limit: int = 10) -> DataFrame:
    counts = m.facts.groupBy("workspace_id", "predicate").agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("subject").alias("subjects"))
    return _best(counts, ["workspace_id"], [F.desc("facts"), F.asc("predicate")], limit).select("workspace_id", "predicate", "facts", "subjects")


def open_items(m: Model, predicates: Sequence[str] = (*OPEN_PREDICATES, *STORED_OPEN)) -> DataFrame:
    """Facts with an open predicate, with the time of the last turn of their episode."""
    last = m.turns.filter("episode_id is not null").groupBy("episode_id").agg(F.max("said_at").alias("worked_at"))
    return m.facts_where(F.col("predicate").isin(list(predicates))).join(last, "episode_id", "left").select(
        "hint_id", "workspace_id", "subject", "predicate", F.substring("object_value", 1, 120).alias("object_value"), "worked_at"
    )


def latest_open_items(m: Model, limit: int = 20) -> DataFrame:
    """Each workspace's open items, those worked on last first."""
    return _best(open_items(m), ["workspace_id"], [F.desc_nulls_last("worked_at"), F.asc("hint_id")], limit).select("workspace_id", "place", "hint_id", "subject", "predicate", "object_value")


def fragments(m: Model) -> DataFrame:
    """(hint_id, workspace_id, kind, content): the passages that facts are stored as."""
    content = fragment_content(F.col("source_quote"), F.col("subject"), F.col("predicate"), F.col("object_value"))
    return m.facts.select("hint_id", "workspace_id", fragment_type(F.col("predicate")).alias("kind"), content.alias("content"))


def reinforced_facts(m: Model, limit: int = 5) -> DataFrame:
    return m.facts.groupBy("workspace_id", "subject", "predicate", "object_value").agg(F.count(F.lit(1)).alias("links"), F.min("hint_id").alias("fact_id")).orderBy(
        F.desc("links"), "fact_id"
    ).limit(limit)


# --- graph -----------------------------------------------------------------------------------------------------------
def degree(m: Model, live: bool = False) -> DataFrame:
    """(workspace_id, name, degree); with ``live`` only edges that have not ended count."""
    edges = m.edges.filter("valid_to is null") if live else m.relations
    ends = edges.select("workspace_id", F.col("source").alias("name")).unionByName(edges.select("workspace_id", F.col("target").alias("name")))
    return ends.groupBy("workspace_id", "name").agg(F.count(F.lit(1)).alias("degree"))


def collapsed_edges(m: Model) -> DataFrame:
    return m.relations.groupBy("workspace_id", "source", "target", "relation_type").agg(F.count(F.lit(1)).alias("weight"))


def hub_nodes(m: Model, limit: int = 25) -> DataFrame:
    """The names with most edges of each workspace."""
    return _best(degree(m), ["workspace_id"], [F.desc("degree"), F.asc("name")], limit).select("workspace_id", "name", "degree")


def hub_edges(m: Model, limit: int = 25) -> DataFrame:
    """Edges both of whose ends are hubs of their workspace."""
    hubs = hub_nodes(m, limit).select("workspace_id", "name")
    inner = m.relations.join(hubs.withColumnRenamed("name", "source"), ["workspace_id", "source"], "left_semi").join(hubs.withColumnRenamed("name", "target"), ["workspace_id", "target"], "left_semi")
    return inner.groupBy("workspace_id", "source", "target", "relation_type").agg(F.count(F.lit(1)).alias("weight"))


def entity_graph(m: Model, limit: int = 100, least: int = 1, types: Sequence[str] | None = None, isolates: bool = False) -> DataFrame:
    """(workspace_id, part, source, target, label, weight): the hub cut of each workspace's graph of live edges.

    Nodes are entities, by the live edges of their names, at least ``least`` (0 with ``isolates``), of the given types
    only, session labels never; edges are those whose ends both survive the cut, repeated ones as one with a weight;
    one row gives the number of entities before the cut.
    """
    own = m.entities.filter(F.col("entity_type") != EXCLUDED_TYPE)
    own = own.filter(F.col("entity_type").isin(list(types))) if types else own
    key = m.entity_names.withColumnRenamed("key", "name")
    live = m.edges.filter("valid_to is null")
    found = [live.withColumn("name", F.lower(F.trim(side))).join(key, ["workspace_id", "name"]).select("hint_id", F.col("entity_id").alias(f"{side}_id")) for side in ("source", "target")]
    counts = found[0].select(F.col("source_id").alias("id")).unionByName(found[1].select(F.col("target_id").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    rated = own.select("workspace_id", "id", "name", "entity_type").join(counts, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).filter(F.col("degree") >= (0 if isolates else least))
    nodes = _best(rated, ["workspace_id"], [F.desc("degree"), F.asc("name"), F.asc("id")], limit)
    kept = nodes.select(F.col("id").alias("n"))
    ends = live.select("hint_id", "workspace_id", "relation_type").join(found[0], "hint_id").join(found[1], "hint_id").join(kept.withColumnRenamed("n", "source_id"), "source_id", "left_semi").join(kept.withColumnRenamed("n", "target_id"), "target_id", "left_semi")
    edges = ends.groupBy("workspace_id", "source_id", "target_id", "relation_type").agg(F.count(F.lit(1)).alias("weight"))
    nothing = F.lit(None).cast("long")
    return (
        nodes.select("workspace_id", F.lit("node").alias("part"), F.col("id").alias("source"), nothing.alias("target"), F.col("entity_type").alias("label"), F.col("degree").alias("weight"))
        .unionByName(edges.select("workspace_id", F.lit("edge").alias("part"), F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relation_type").alias("label"), "weight"))
        .unionByName(own.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("weight")).select("workspace_id", F.lit("total").alias("part"), nothing.alias("source"), nothing.alias("target"), F.lit("entities").alias("label"), "weight"))
    )


def edge_summary(m: Model) -> DataFrame:
    """Per workspace: edges, names, and names without an edge."""
    names = m.facts.select("workspace_id", F.col("subject").alias("name")).distinct()
    joined = names.join(degree(m), ["workspace_id", "name"], "left").groupBy("workspace_id").agg(
        F.count(F.lit(1)).alias("names"), F.sum(F.col("degree").isNull().cast("long")).alias("isolated")
    )
    edges = m.relations.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("edges"))
    return joined.join(edges, "workspace_id", "left").select("workspace_id", "names", "isolated", F.coalesce("edges", F.lit(0)).alias("edges"))


def live_edges(m: Model, now: date = TODAY) -> DataFrame:
    """Per workspace: all edges, those open at a moment (no end, or a later one), and those without an end."""
    open_then = F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(now).cast("timestamp_ntz"))
    one = lambda c: F.sum(c.cast("long"))
    return m.edges.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("edges"), one(open_then).alias("open_then"), one(F.col("valid_to").isNull()).alias("endless"))


def active_fact_counts(m: Model) -> DataFrame:
    """Per workspace and subject: facts, and those that nothing has superseded."""
    return m.active_facts.groupBy("workspace_id", "subject").agg(F.count(F.lit(1)).alias("facts"), F.sum(F.col("superseded_at").isNull().cast("long")).alias("active"))


def relations_both_ways(m: Model, edges: DataFrame | None = None) -> DataFrame:
    """Each relation seen from either end."""
    own = m.relations if edges is None else edges
    out = own.select("workspace_id", F.col("source").alias("anchor"), F.col("target").alias("other"), "relation_type", F.lit("out").alias("direction"), "valid_from")
    into = own.select("workspace_id", F.col("target").alias("anchor"), F.col("source").alias("other"), "relation_type", F.lit("in").alias("direction"), "valid_from")
    return out.unionByName(into)


def neighbors_1hop(m: Model, now: date = TODAY, direction: str = "both", relation_type: str | None = None, limit: int = 10) -> DataFrame:
    """What lies one live edge away from every name: the latest ones, with how many active facts each neighbour has and its latest three.

    ``direction`` is 'in', 'out' or 'both'; ``relation_type`` keeps one type.
    """
    live = m.edges.filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(now).cast("timestamp_ntz")))
    seen = relations_both_ways(m, live)
    seen = seen if direction == "both" else seen.filter(F.col("direction") == direction)
    seen = seen.filter(F.col("relation_type") == relation_type) if relation_type else seen
    latest = seen.groupBy("workspace_id", "anchor", "other", "relation_type", "direction").agg(F.max("valid_from").alias("latest"))
    near = _best(latest, ["workspace_id", "anchor"], [F.desc_nulls_last("latest"), F.asc("other"), F.asc("relation_type"), F.asc("direction")], limit)
    active = m.active_facts.filter("superseded_at is null")
    counts = active.groupBy("workspace_id", F.col("subject").alias("other")).agg(F.count(F.lit(1)).alias("facts"))
    top = _best(active, ["workspace_id", "subject"], [F.desc_nulls_last("valid_from"), F.asc("hint_id")], 3)
    told = top.groupBy("workspace_id", F.col("subject").alias("other")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat_ws(" ", "predicate", F.substring("object_value", 1, 150)).alias("t")))), lambda x: x["t"]), "; ").alias("top_facts")
    )
    return near.join(counts, ["workspace_id", "other"], "left").join(told, ["workspace_id", "other"], "left").select(
        "workspace_id", "anchor", "place", "other", "relation_type", "direction", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("top_facts", F.lit("")).alias("top_facts")
    )


def relation_counts(m: Model) -> DataFrame:
    """How many neighbours of each type and direction every name has."""
    return relations_both_ways(m).select("workspace_id", "anchor", "other", "relation_type", "direction").distinct().groupBy("workspace_id", "anchor", "relation_type", "direction").agg(F.count(F.lit(1)).alias("neighbours"))


# --- workspaces, coverage, briefs ---------------------------------------------------------------------------------
def workspaces_rich(m: Model) -> DataFrame:
    episodes = m.episodes.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("episodes"), F.max("created_at").alias("latest"))
    names = m.facts.groupBy("workspace_id", "subject").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("workspace_id").orderBy(F.desc("n"), "subject")
    top = (
        names.withColumn("place", F.row_number().over(best)).filter("place <= 3").groupBy("workspace_id")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "subject"))), lambda x: x["subject"]), ", ").alias("top"))
    )
    return (
        m.workspaces.join(episodes, F.col("id") == episodes.workspace_id, "left").join(top, F.col("id") == top.workspace_id, "left")
        .select("id", "name", (F.col("status") == "active").alias("is_active"), F.coalesce("episodes", F.lit(0)).alias("episodes"), "latest", "top")
    )


def dashboard_stats(m: Model) -> DataFrame:
    """Per workspace: visible episodes, turns, entities, active facts, and the first and last day, by turns or else by episodes."""
    one = lambda df, name: df.groupBy("workspace_id").agg(F.count(F.lit(1)).alias(name))
    shown = m.episodes.filter(visible(F.col("metadata"))).groupBy("workspace_id").agg(F.count(F.lit(1)).alias("episodes"), F.min("created_at").alias("e_first"), F.max("created_at").alias("e_last"))
    turns = m.turns.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("turns"), F.min("day").alias("t_first"), F.max("day").alias("t_last"))
    out = m.workspaces.select(F.col("id").alias("workspace_id"))
    for part in (shown, turns, one(m.entities, "entities"), one(m.active_facts.filter("superseded_at is null"), "facts")):
        out = out.join(part, "workspace_id", "left")
    return out.na.fill(0, ["episodes", "turns", "entities", "facts"]).select(
        "workspace_id", "episodes", "turns", "entities", "facts", F.coalesce("t_first", F.to_date("e_first")).alias("first_day"), F.coalesce("t_last", F.to_date("e_last")).alias("last_day")
    )


def dashboard(m: Model, today: date = TODAY, days: int = 7, summaries: int = 10, memories: int = 5, top: int = 10) -> DataFrame:
    """(workspace_id, part, place, ref, label, n, day): the lists of every workspace's home page.

    Parts are the summaries of the last days of subjects without a parent, episodes of this day in other years, and the
    names with most active facts, with the degree of their live edges.
    """
    day = F.lit(today)
    tops = m.entities.filter("parent_id is null").select(F.col("id").alias("subject_id"), "name")
    own = m.summaries.filter(F.col("day") >= F.date_sub(day, days)).join(tops, "subject_id")
    recent = _best(own, ["workspace_id"], [F.desc("day"), F.asc("name"), F.asc("subject_id")], summaries).select(
        "workspace_id", F.lit("summary").alias("part"), "place", F.col("subject_id").alias("ref"), F.col("name").alias("label"), F.col("turn_count").alias("n"), "day"
    )
    made = F.to_date("created_at")
    past = m.episodes_where(visible(F.col("metadata")) & (F.month(made) == today.month) & (F.dayofmonth(made) == today.day) & (made < day)).withColumn("day", made)
    then = _best(past, ["workspace_id"], [F.desc("day"), F.asc("id")], memories).select(
        "workspace_id", F.lit("on_this_day").alias("part"), "place", F.col("id").alias("ref"), F.substring(F.coalesce("summary", F.lit("")), 1, 300).alias("label"), F.datediff(day, "day").cast("long").alias("n"), "day"
    )
    facts = m.active_facts.filter("superseded_at is null").groupBy("workspace_id", "subject").agg(F.count(F.lit(1)).alias("n"), F.min("hint_id").alias("ref"))
    rated = facts.join(degree(m, live=True).withColumnRenamed("name", "subject"), ["workspace_id", "subject"], "left")
    named = _best(rated, ["workspace_id"], [F.desc("n"), F.desc(F.coalesce("degree", F.lit(0))), F.asc("subject")], top).select(
        "workspace_id", F.lit("top").alias("part"), "place", "ref", F.concat_ws(" / ", "subject", F.coalesce("degree", F.lit(0)).cast("string")).alias("label"), "n", F.lit(None).cast("date").alias("day")
    )
    return recent.unionByName(then).unionByName(named)


def activity_signals(m: Model, now: datetime = NOW) -> DataFrame:
    """Per workspace: visible episodes and turns of today, of the week, the last activity, how busy that makes it and a line that says so.

    Three episodes or twenty turns today are HOT; otherwise the time since the last activity decides: within 48 hours
    ACTIVE, within seven days QUIET, anything else, or none, DORMANT.  The line names the most recent of today's,
    yesterday's and the week's episodes.
    """
    today, at = F.lit(now.date()), F.lit(now).cast("timestamp_ntz")
    count = lambda c: F.sum(c.cast("long"))
    made = F.to_date("created_at")
    episodes = m.episodes.filter(visible(F.col("metadata")) & (F.col("created_at") <= at)).groupBy("workspace_id").agg(
        count(made == today).alias("episodes_today"), count(made == F.date_sub(today, 1)).alias("episodes_yesterday"), count(made >= F.date_sub(today, 6)).alias("episodes_week"), F.count(F.lit(1)).alias("episodes"), F.max("created_at").alias("e_last")
    )
    turns = m.turns.filter(F.col("said_at") <= at).groupBy("workspace_id").agg(count(F.col("day") == today).alias("turns_today"), count(F.col("day") >= F.date_sub(today, 6)).alias("turns_week"), F.max("said_at").alias("t_last"))
    joined = m.workspaces.select(F.col("id").alias("workspace_id"), "name").join(episodes, "workspace_id", "left").join(turns, "workspace_id", "left").na.fill(
        0, ["episodes", "episodes_today", "episodes_yesterday", "episodes_week", "turns_today", "turns_week"]
    ).withColumn("last_at", F.greatest("e_last", "t_last"))
    since = lambda days: F.col("last_at") >= F.lit(now - timedelta(days=days)).cast("timestamp_ntz")
    tag = F.when((F.col("episodes_today") >= 3) | (F.col("turns_today") >= 20), "HOT").when(since(2), "ACTIVE").when(since(7), "QUIET").otherwise("DORMANT")
    some = F.when(F.col("episodes_today") > 0, F.concat(F.lit("오늘 "), "episodes_today", F.lit("건"))).when(F.col("episodes_yesterday") > 0, F.concat(F.lit("어제 "), "episodes_yesterday", F.lit("건"))).when(F.col("episodes_week") > 0, F.concat(F.lit("7d "), "episodes_week", F.lit("건")))
    return joined.select(
        "workspace_id", "episodes_today", "episodes_yesterday", "episodes_week", "turns_today", "turns_week", "last_at", tag.alias("tag"), F.concat_ws(" · ", F.concat("episodes", F.lit(" ep")), some).alias("line")
    )


def recent_threads(m: Model, today: date = TODAY, days: int = 14, least: int = 3) -> DataFrame:
    """Subjects of the last days by turns, at least three for each workspace where older ones exist."""
    recent = m.daily.filter(F.col("day") <= F.lit(today)).groupBy("workspace_id", "subject_id").agg(
        F.sum(F.when(F.col("day") >= F.date_sub(F.lit(today), days - 1), F.col("turn_count")).otherwise(0)).alias("recent"), F.sum("turn_count").alias("total")
    )
    rank = Window.partitionBy("workspace_id").orderBy(F.desc("recent"), F.desc("total"), "subject_id")
    return recent.withColumn("place", F.row_number().over(rank)).filter((F.col("recent") > 0) | (F.col("place") <= least))


def reco_candidates(m: Model, now: datetime = NOW, per_source: int = 20) -> DataFrame:
    """(workspace_id, kind, what, score, ref, at): candidates for what to do next, from five sources.

    Active facts with an open predicate or a deadline word (the latest ones of each workspace), busy weeks that have gone
    quiet, top subjects without a summary today, and busy weeks without any summary.  A kind's base score rises with how
    pressing the predicate, the deadline and the age of a fact are.
    """
    today = F.lit(now.date())
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    active = m.active_facts.filter("superseded_at is null")
    latest = [F.desc_nulls_last("valid_from"), F.asc("hint_id")]
    age = (F.unix_timestamp(F.lit(now).cast("timestamp_ntz").cast("timestamp")) - F.unix_timestamp(F.col("valid_from").cast("timestamp"))) / 86400.0
    fresh = F.when(age < 1, 15).when(age < 7, 5).when(age > 30, -10).otherwise(0)
    pressing = F.when(F.col("predicate") == "open_question", 25).when(F.col("predicate") == "next_step", 20).when(F.col("predicate").isin("pending", "todo", "goal"), 10).otherwise(0)
    what = F.concat_ws(" ", "subject", "predicate", "object_value")
    fact = lambda df, kind, score: _best(df, ["workspace_id"], latest, per_source).select("workspace_id", F.lit(kind).alias("kind"), what.alias("what"), score.cast("int").alias("score"), F.col("hint_id").alias("ref"), F.col("valid_from").alias("at"))
    opened = fact(active.filter(F.col("predicate").isin([*OPEN_PREDICATES, *STORED_OPEN])), "predicate", 100 + pressing + F.coalesce(fresh, F.lit(0)))
    due = active.filter(text("object_value").rlike("|".join(DEADLINE_WORDS)) | text("subject").rlike("|".join(DEADLINE_WORDS)))
    blob = F.lower(F.concat_ws(" ", "object_value", "subject"))
    soon = F.when(blob.rlike("오늘|today|eod"), 20).when(blob.rlike("내일|tomorrow"), 15).when(blob.rlike("이번주|this week"), 10).otherwise(0)
    deadlines = fact(due, "deadline", 90 + soon)
    signals = activity_signals(m, now)
    nothing = F.lit(None).cast("timestamp_ntz")
    mark = lambda df, kind, score, label, ref: df.select("workspace_id", F.lit(kind).alias("kind"), label.alias("what"), F.lit(score).alias("score"), ref.cast("long").alias("ref"), nothing.alias("at"))
    quiet = mark(signals.filter("episodes_yesterday = 0 and episodes_today = 0 and episodes_week >= 7"), "dormant_active", 60, F.col("episodes_week").cast("string"), F.col("workspace_id"))
    done = m.summaries.filter(F.col("day") == today).select("subject_id").distinct()
    roots = m.entities.filter("parent_id is null and entity_type = 'concept'").select(F.col("id").alias("subject_id"), "name", F.col("workspace_id").alias("w"))
    spoken = m.daily.filter(F.col("day").between(F.date_sub(today, 6), today)).groupBy("subject_id").agg(F.sum("turn_count").alias("turns"))
    busy = signals.filter("episodes_week > 0").orderBy(F.desc("episodes_week"), "workspace_id").limit(1).select(F.col("workspace_id").alias("w"))
    waiting = spoken.join(roots, "subject_id").join(done, "subject_id", "left_anti").join(F.broadcast(busy), "w").select(F.col("w").alias("workspace_id"), "subject_id", "name", "turns")  # one row
    fallback = mark(waiting.orderBy(F.desc("turns"), "subject_id").limit(3), "fallback_top", 40, F.col("name"), F.col("subject_id"))
    told = m.summaries.filter(F.col("day") >= F.date_sub(today, 13)).select("workspace_id").distinct()
    missing = mark(signals.filter("episodes_week >= 5").join(told, "workspace_id", "left_anti"), "summary_missing", 30, F.col("episodes_week").cast("string"), F.col("workspace_id"))
    return opened.unionByName(deadlines).unionByName(quiet).unionByName(fallback).unionByName(missing)


def reco_top3(m: Model, now: datetime = NOW, cap: int = 2, limit: int = 3) -> DataFrame:
    """The best candidates, later facts first: at most two of one workspace first, the others only to fill up."""
    order = [F.desc("score"), F.desc_nulls_last("at"), "kind", "ref"]
    # No more than ``limit`` rows of a workspace can be chosen, so the ranking keeps no more in any task.
    ranked = _best(reco_candidates(m, now).withColumnRenamed("place", "_p"), ["workspace_id"], order, max(cap, limit)).withColumnRenamed("place", "nth")
    return ranked.orderBy((F.col("nth") > cap).cast("int"), *order, "workspace_id").limit(limit).select("workspace_id", "kind", "what", "score", "ref")


def pending_reflects(m: Model) -> DataFrame:
    """Days of a subject with turns but no stored summary."""
    return m.daily.join(m.summaries.select("workspace_id", "subject_id", "day"), ["workspace_id", "subject_id", "day"], "left_anti")


def summaries_range(m: Model, first: date | None = date(2026, 1, 1), last: date | None = date(2026, 3, 31)) -> DataFrame:
    """Stored summaries between two days, either of which may be left open."""
    own = m.summaries if first is None else m.summaries.filter(F.col("day") >= F.lit(first))
    own = own if last is None else own.filter(F.col("day") <= F.lit(last))
    return own.join(m.entities.select(F.col("id").alias("subject_id"), "name"), "subject_id").select(
        "workspace_id", "subject_id", "name", "day", "turn_count"
    )


def data_quality(m: Model, today: date = TODAY) -> DataFrame:
    """Summaries of the last 14 days by workspace, those without any included."""
    recent = m.summaries.filter(F.col("day").between(F.date_sub(F.lit(today), 13), F.lit(today)))
    return m.workspaces.select(F.col("id").alias("workspace_id")).join(recent, "workspace_id", "left").groupBy("workspace_id").agg(F.count("subject_id").alias("summaries"))


def linked_roots(m: Model) -> DataFrame:
    """How many subjects without a parent each workspace has turns about."""
    return m.entities.filter("parent_id is null").join(m.links.select(F.col("subject_id").alias("id")), "id", "left_semi").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("roots"))


def upload_status(m: Model) -> DataFrame:
    turns = m.turns.filter("episode_id is not null").groupBy("episode_id").agg(F.count(F.lit(1)).alias("turns"))
    each = m.episodes.join(turns, F.col("id") == F.col("episode_id"), "left")
    return each.groupBy("workspace_id").agg(
        F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"), F.countDistinct("session_id").alias("sessions"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")
    ).join(linked_roots(m), "workspace_id", "left").na.fill(0, ["roots"])


def unclassified(m: Model) -> DataFrame:
    """Episodes none of whose turns is linked to a subject, by size."""
    size = m.turns.filter("episode_id is not null").groupBy("episode_id").agg(F.count(F.lit(1)).alias("turns"))
    return size.join(m.links.select("episode_id").distinct(), "episode_id", "left_anti")


def link_histogram(m: Model) -> DataFrame:
    """How many subjects have how many turns."""
    return m.links.groupBy("subject_id").agg(F.countDistinct("turn_id").alias("turns")).groupBy("turns").agg(F.count(F.lit(1)).alias("subjects"))


def multi_subject_episodes(m: Model) -> DataFrame:
    subjects = m.links.groupBy("episode_id").agg(F.countDistinct("subject_id").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_set("subject_id")), lambda x: x.cast("string")), ",").alias("subjects"))
    return subjects.filter("n >= 3")


def cardinalities(m: Model) -> DataFrame:
    out = None
    for name in ("workspaces", "episodes", "turns", "entities", "facts", "relations", "links"):
        row = getattr(m, name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


def community_count(m: Model) -> DataFrame:
    return m.entities.groupBy("workspace_id").agg(F.countDistinct("community_id").alias("communities"), F.count(F.lit(1)).alias("entities"))


def keyword_union(m: Model) -> DataFrame:
    """Distinct keywords of each workspace's visible episodes."""
    words = F.explode(F.from_json(F.get_json_object("metadata", "$.keywords"), "array<string>"))
    return m.episodes.filter(visible(F.col("metadata"))).select("workspace_id", words.alias("keyword")).distinct()


def largest_episode(m: Model) -> DataFrame:
    """The episode with most turns of each session; ties go to the smaller id."""
    size = m.turns.filter("episode_id is not null").groupBy("episode_id").agg(F.count(F.lit(1)).alias("turns"))
    joined = size.join(m.episodes.select(F.col("id").alias("episode_id"), "session_id"), "episode_id")
    return joined.groupBy("session_id").agg(F.max(F.struct("turns", (-F.col("episode_id")).alias("neg"))).alias("best")).select("session_id", (-F.col("best.neg")).alias("episode_id"), F.col("best.turns").alias("turns"))


def ledger_page(m: Model, limit: int = 50) -> DataFrame:
    """The latest ingest decisions."""
    from memloom.operators.ingest import ledger

    return ledger(m.episodes).join(m.episodes.select("id", "created_at"), "id").orderBy(F.desc("created_at"), F.desc("id")).limit(limit).select("id", "workspace_id", "decision", "created_at")


def session_briefing(m: Model, today: date = TODAY, pinned: Sequence[str] = ("uses_db", "located_in")) -> DataFrame:
    """(workspace_id, part, place, what): what a session begins with, in every workspace.

    Pinned values (the latest of each pinned predicate), the latest active facts, yesterday's episodes and subjects,
    today's counts, sessions stored but not taken in, the subjects with most turns, and the week's summaries.
    """
    day = F.lit(today)
    part = lambda df, name, order, limit, what: _best(df, ["workspace_id"], order, limit).select("workspace_id", F.lit(name).alias("part"), "place", what.alias("what"))
    active = m.active_facts.filter("superseded_at is null")
    latest = [F.desc_nulls_last("valid_from"), F.asc("hint_id")]
    values = active.filter(F.col("predicate").isin(list(pinned))).groupBy("workspace_id", "predicate").agg(F.min(F.struct((-F.unix_micros(F.col("valid_from").cast("timestamp"))).alias("t"), "hint_id", "object_value")).alias("l"))
    rows = [
        part(values, "pinned", [F.asc("predicate")], len(pinned), F.concat_ws(": ", "predicate", "l.object_value")),
        part(active, "recent_fact", latest, 10, F.concat_ws(" ", "subject", "predicate", "object_value")),
    ]
    before = F.date_sub(day, 1)
    shown = m.episodes_where(visible(F.col("metadata")) & F.to_date("created_at").isin(today, today - timedelta(days=1)))
    rows.append(part(shown.filter(F.to_date("created_at") == before), "yesterday_episode", [F.desc("created_at"), F.desc("id")], 3, F.concat_ws(" ", F.col("id").cast("string"), F.substring(F.coalesce("summary", F.lit("")), 1, 200))))
    named = m.summaries.join(m.entities.select(F.col("id").alias("subject_id"), "name", "parent_id"), "subject_id")
    rows.append(part(named.filter(F.col("day") == before), "yesterday_subject", [F.desc("turn_count"), F.asc("subject_id")], 5, F.col("name")))
    counts = m.workspaces.select(F.col("id").alias("workspace_id")).join(
        shown.filter(F.to_date("created_at") == day).groupBy("workspace_id").agg(F.count(F.lit(1)).alias("e")), "workspace_id", "left"
    ).join(m.turns_where(F.to_date("created_at") == day).groupBy("workspace_id").agg(F.count(F.lit(1)).alias("t")), "workspace_id", "left")
    rows.append(counts.select("workspace_id", F.lit("today").alias("part"), F.lit(1).alias("place"), F.concat(F.lit("episodes="), F.coalesce("e", F.lit(0)), F.lit(" turns="), F.coalesce("t", F.lit(0))).alias("what")))
    waiting = m.episodes_where(F.lower("processing_status") != "done").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n"))
    rows.append(waiting.select("workspace_id", F.lit("pending").alias("part"), F.lit(1).alias("place"), F.col("n").cast("string").alias("what")))
    turns = m.links.groupBy("subject_id").agg(F.count(F.lit(1)).alias("turns")).join(m.entities.filter("parent_id is null").select(F.col("id").alias("subject_id"), "workspace_id", "name"), "subject_id")
    rows.append(part(turns, "subject", [F.desc("turns"), F.asc("subject_id")], 10, F.concat(F.col("name"), F.lit(" "), F.col("turns").cast("string"))))
    rows.append(part(named.filter(F.col("day") >= F.date_sub(day, 7)), "week", [F.desc("day"), F.desc("turn_count"), F.asc("subject_id")], 15, F.concat_ws(" ", F.col("day").cast("string"), "name")))
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def subject_inventory(m: Model) -> DataFrame:
    """Which subjects each session has touched."""
    sessions = m.episodes.select(F.col("id").alias("episode_id"), "session_id")
    return m.links.select("episode_id", "subject_id").distinct().join(sessions, "episode_id").select("session_id", "subject_id").distinct()


def latest_values(m: Model) -> DataFrame:
    """The latest value of each predicate of a workspace's subject."""
    latest = F.max(F.struct("valid_from", "hint_id", "object_value")).alias("l")
    return m.facts.groupBy("workspace_id", "subject", "predicate").agg(latest).select("workspace_id", "subject", "predicate", "l.object_value", "l.hint_id")


def deadline_facts(m: Model, words: Sequence[str] = (*DEADLINE_WORDS, "Tuesday", "last sprint")) -> DataFrame:
    """Facts whose value, subject or quote names a deadline."""
    both = F.concat_ws(" ", "object_value", "subject", "source_quote")
    return m.facts_where(both.rlike("|".join(words))).select(
        "hint_id", F.when(both.rlike("(?i)오늘|today|eod"), 20).when(both.rlike("(?i)내일|tomorrow"), 15).when(both.rlike("(?i)이번주|this week"), 10).otherwise(0).alias("bonus")
    )


def displayable_turns(m: Model) -> DataFrame:
    """(id, workspace_id, text): turns to be shown: cleaned to some text, or never cleaned.

    ``cleaned_text_v2`` and ``cleanup_metadata`` are read where the table has them; elsewhere they are made by the
    sanitizer: text it leaves, and the number of lines it took out (null if none).
    """
    done = m.turns.withColumn("_s", sanitized(F.col("text")))
    text = forgiving(done, "cleaned_text_v2", F.nullif(F.trim("_s.cleaned"), F.lit("")))
    log = forgiving(done, "cleanup_metadata", F.when(F.size("_s.removed") > 0, F.size("_s.removed").cast("string")))
    return done.filter(text.isNotNull() | log.isNull()).select("id", "workspace_id", F.coalesce(text, "text").alias("text"))


def forgiving(df: DataFrame, name: str, otherwise: Column | None = None) -> Column:
    """A column if the table has it, else ``otherwise`` or null: for tables older than the model."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string") if otherwise is None else otherwise


def entity_articles(m: Model) -> DataFrame:
    """Which entities have an article; none where the table has no such column."""
    return m.entities.select("id", "workspace_id", forgiving(m.entities, "wiki_article").isNotNull().alias("has_article"))


def ledger_backfill(m: Model) -> DataFrame:
    """Ledger rows for the stored episodes of active workspaces, from their metadata and the number of their turns."""
    said = lambda key: F.get_json_object("metadata", f"$.{key}")
    turns = m.turns.filter("episode_id is not null").groupBy(F.col("episode_id").alias("id")).agg(F.count(F.lit(1)).alias("turns"))
    active = m.workspaces.filter("status = 'active'").select(F.col("id").alias("workspace_id"))
    path = F.coalesce(said("source_path"), F.lit(""))
    return m.episodes.join(F.broadcast(active) if active.count() <= 1_000_000 else active, "workspace_id", "left_semi").join(turns, "id", "left").select(
        "workspace_id", F.col("id").alias("episode_id"), path.alias("source_path"), normalized_path(path).alias("path_normalized"), said("external_session_id").alias("external_session_id"), F.coalesce(said("ingested_via"), F.lit("legacy")).alias("ingested_via"),
        F.col("created_at").alias("ingested_at"), F.coalesce("turns", F.lit(0)).alias("turns"), F.lit("ingested").alias("status"), F.lit("new").alias("decision"),
    )


def strata_sample(m: Model) -> DataFrame:
    """(workspace_id, stratum, id): one episode of each of five kinds in every workspace, by the order of a hash of its id.

    Kinds are few, some and many turns with a subject, four subjects or more, and none though there are turns.
    """
    turns = m.turns.filter("episode_id is not null").groupBy(F.col("episode_id").alias("id")).agg(F.count(F.lit(1)).alias("turns"))
    subjects = m.links.groupBy(F.col("episode_id").alias("id")).agg(F.countDistinct("subject_id").alias("subjects"))
    sized = m.episodes.select("id", "workspace_id").join(turns, "id", "left").join(subjects, "id", "left").na.fill(0, ["turns", "subjects"])
    strata = {"few": "turns between 3 and 7 and subjects > 0", "some": "turns between 30 and 60 and subjects > 0", "many": "turns > 100 and subjects > 0", "mixed": "subjects >= 4", "none": "subjects = 0 and turns > 5"}
    out = None
    for name, condition in strata.items():
        # A minimum per workspace: no window and no sort.
        one = sized.filter(condition).groupBy("workspace_id").agg(F.min(F.struct(F.md5(F.col("id").cast("string")).alias("h"), "id")).alias("f")).select("workspace_id", F.lit(name).alias("stratum"), "f.id")
        out = one if out is None else out.unionByName(one)
    return out


def entity_name_flags(m: Model) -> DataFrame:
    """Session-label names, name families and same-name pairs of entities."""
    from memloom.operators.classify import session_label

    low = F.lower("name")
    family = F.substring_index(F.regexp_replace(low, "[_.-]", " "), " ", 1)
    named = m.entities.filter("name is not null")
    same = named.groupBy(low.alias("low")).agg(F.count(F.lit(1)).alias("same_name"))
    return named.join(same, low == F.col("low")).select("id", session_label(F.col("name")).alias("is_label"), family.alias("family"), "same_name")


def name_families(m: Model) -> DataFrame:
    """(workspace_id, head_id, id): entities whose name goes on from that of another one, case ignored.

    A name's own prefixes are looked up, so names meet in an equality join; one letter more is enough.
    """
    low = F.lower("name")
    own = m.entities.filter(F.length("name") > 1).select("workspace_id", "id", low.alias("low"))
    heads = m.entities.filter(F.length("name") > 0).select("workspace_id", F.col("id").alias("head_id"), low.alias("prefix"))
    parts = own.select("workspace_id", "id", F.explode(F.transform(F.sequence(F.lit(1), F.length("low") - 1), lambda n: F.substring("low", F.lit(1), n))).alias("prefix"))
    return parts.join(heads, ["workspace_id", "prefix"]).select("workspace_id", "head_id", "id")


def workspace_pages(m: Model, limit: int = 20, hidden: bool = True) -> DataFrame:
    """Workspaces, active ones first (only these without ``hidden``), then by their latest episode, those without any last."""
    latest = m.episodes.groupBy("workspace_id").agg(F.max("created_at").alias("latest"))
    shown = m.workspaces if hidden else m.workspaces.filter("status = 'active'")
    joined = shown.join(latest, F.col("id") == F.col("workspace_id"), "left")
    return joined.orderBy((F.col("status") == "active").desc(), F.desc_nulls_last("latest"), "id").limit(limit).select("id", "status", "latest")
