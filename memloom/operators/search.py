"""Hybrid retrieval: graph walk, vectors and text fused, rescored, diversified and put into context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text as X
from memloom.operators import graph, ranking
from memloom.plans.model import Model

#: Candidates of a fused search, of a topic map, and how many names a topic map shows.
POOL, TOPIC_POOL, TOPIC_ENTITIES = 100, 50, 15


def anchors(names: DataFrame, query: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, name): dictionary names (*by, name) that occur in a query, the longest where one holds another; case is ignored.

    Only the dictionary is scanned, against one literal, so it may be large.
    """
    low = F.lower("name")
    hits = names.select(*by, "name").filter((F.length("name") >= 2) & F.contains(F.lit(query.lower()), low)).distinct()
    wider = hits.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("name").alias("wider"))
    same = F.lit(True)
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    # Both sides are names that occur in one query, so a tenant's are as few as a query is long.
    return hits.join(wider, same & (F.length("wider") > F.length("name")) & F.contains(F.lower("wider"), low), "left_anti")


def seeds(m: Model, query: Sequence[float], k: int = 3) -> DataFrame:
    """(workspace_id, place, name, similarity): the entities of each workspace whose vector is nearest to a query's."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    own = m.table("memory_vectors", "vector_id").filter((F.col("source_type") == "entity") & (F.size("vector") == len(query)))
    near = own.select("workspace_id", F.col("source_id").alias("id"), F.round(ranking.cosine(F.col("vector"), literal), 6).alias("similarity")).filter("similarity is not null and not isnan(similarity)")
    named = near.groupBy("workspace_id", "id").agg(F.max("similarity").alias("similarity")).join(m.entities.select("id", "name"), "id")
    return _best(named, [F.desc("similarity"), F.asc("id")], k).select("workspace_id", "place", "name", "similarity")


def all_seeds(m: Model, text: str, query: Sequence[float], k: int = 3) -> DataFrame:
    """(workspace_id, name, place): names that a query holds, longest first, then its nearest entities, each once."""
    told = _best(anchors(m.entities.select("workspace_id", "name"), text, ["workspace_id"]), [F.desc(F.length("name")), F.asc("name")], 1_000)
    both = told.select("workspace_id", "name", F.lit(0).alias("list"), "place").unionByName(seeds(m, query, k).select("workspace_id", "name", F.lit(1).alias("list"), "place"))
    once = both.groupBy("workspace_id", "name").agg(F.min(F.struct("list", "place")).alias("at"))
    return _best(once, [F.asc("at"), F.asc("name")], 1_000).select("workspace_id", "name", "place")


def graph_ranking(m: Model, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(workspace_id, id, place): facts of the seeds and of what lies within ``depth`` edges, nearest first, then by id."""
    reached = graph.hops(m.relations, seeds, depth, ["workspace_id"]).withColumnRenamed("name", "subject")
    return _best(m.facts.join(reached, ["workspace_id", "subject"]).select("workspace_id", F.col("hint_id").alias("id"), "depth"), [F.asc("depth"), F.asc("id")], POOL).select("workspace_id", "id", "place")


def text_ranking(m: Model, terms: Sequence[str], limit: int = 3 * POOL) -> DataFrame:
    scored = m.facts.select("workspace_id", F.col("hint_id").alias("id"), ranking.term_score(F.concat_ws(" ", "subject", "predicate", "object_value", "source_quote"), terms).alias("score")).filter("score > 0")
    return _best(scored, [F.desc("score"), F.asc("id")], limit).select("workspace_id", "id", "place")


def vector_ranking(vectors: DataFrame, query: Sequence[float], limit: int = 3 * POOL) -> DataFrame:
    """Facts by the cosine of their vector (workspace_id, source_id, vector) to the query's; a fact counts with its best vector."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    best = vectors.filter(F.size("vector") == len(query)).groupBy("workspace_id", F.col("source_id").alias("id")).agg(F.max(F.round(ranking.cosine(F.col("vector"), literal), 6)).alias("score"))
    return _best(best.filter("score is not null and not isnan(score)"), [F.desc("score"), F.asc("id")], limit).select("workspace_id", "id", "place")


def _best(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows of each workspace with their place; ranks are cut before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy("workspace_id").orderBy(*order))).filter(F.col("place") <= limit)


def hybrid_search(m: Model, seeds: DataFrame, terms: Sequence[str], query: Sequence[float] | None = None, limit: int = 20) -> DataFrame:
    """(workspace_id, id, subject, predicate, object_value, rrf_score): each workspace's facts by reciprocal-rank fusion of up to three rankings."""
    lists = {"graph": graph_ranking(m, seeds), "text": text_ranking(m, terms)}
    if query is not None:
        facts = m.table("memory_vectors", "vector_id").filter("source_type = 'fact'")
        lists["vector"] = vector_ranking(facts, query)
    fused = ranking.fused(lists).select("id", F.round("rrf_score", 9).alias("rrf_score"))
    found = fused.join(m.facts, F.col("id") == F.col("hint_id"))
    return _best(found, [F.desc("rrf_score"), F.asc("id")], limit).select("workspace_id", "id", "subject", "predicate", "object_value", "rrf_score")


def search_or_fallback(m: Model, seeds: DataFrame, terms: Sequence[str], least: int = 3, limit: int = 20) -> DataFrame:
    """(workspace_id, id, how): a search's facts; a workspace without seeds or with fewer than ``least`` results gets raw matches too."""
    found = hybrid_search(m, seeds, terms, limit=limit).select("workspace_id", "id", F.lit("search").alias("how"))
    enough = found.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n")).join(seeds.select("workspace_id").distinct(), "workspace_id", "left_semi").filter(F.col("n") >= least)
    raw = _best(m.facts.filter(_holds(terms)).select("workspace_id", F.col("hint_id").alias("id")).join(enough, "workspace_id", "left_anti"), [F.asc("id")], limit)
    return found.unionByName(raw.join(found, ["workspace_id", "id"], "left_anti").select("workspace_id", "id", F.lit("fallback").alias("how")))


def rescored(m: Model, found: DataFrame, today) -> DataFrame:  # noqa: ANN001
    """Search results with importance and decay: quoted facts weigh 0.7, others 0.4."""
    facts = m.facts.select("hint_id", F.col("predicate").alias("p"), "source_quote", "valid_from")
    importance = F.when(F.length("source_quote") >= 10, 0.7).otherwise(0.4)
    age = F.datediff(F.lit(today), F.to_date("valid_from")).cast("double")
    return found.join(facts, F.col("id") == F.col("hint_id")).select("workspace_id", "id", F.round(F.col("rrf_score") * importance * X.decay(age, X.fragment_type(F.col("p"))), 9).alias("score"))


def coverage(m: Model, found: DataFrame, pool: int = POOL) -> DataFrame:
    """(workspace_id, selected, communities, workspace_communities, summary): how much of a workspace a search's facts stand for.

    Communities are those of the entities that the facts are about.  The summary names the first three subjects.
    """
    own = m.fact_entities.join(m.entities.select(F.col("id").alias("entity_id"), "community_id"), "entity_id").filter("community_id is not null")
    seen = found.join(own.select(F.col("hint_id").alias("id"), "community_id"), "id").groupBy("workspace_id").agg(F.countDistinct("community_id").alias("communities"))
    whole = m.entities.filter("community_id is not null").groupBy("workspace_id").agg(F.countDistinct("community_id").alias("workspace_communities"))
    first = found.groupBy("workspace_id", "subject").agg(F.min(F.struct((-F.col("rrf_score")).alias("s"), "id")).alias("at"))
    named = _best(first, [F.asc("at"), F.asc("subject")], 3).groupBy("workspace_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "subject"))), lambda x: x["subject"]), ", ").alias("names"))
    size = found.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("selected"))
    out = size.join(seen, "workspace_id", "left").join(whole, "workspace_id", "left").join(named, "workspace_id", "left").na.fill(0, ["communities", "workspace_communities"])
    part = F.when(F.col("workspace_communities") > 0, F.concat(F.lit("Coverage: "), "communities", F.lit(" of "), "workspace_communities", F.lit(" communities represented.")))
    text = F.concat_ws(" ", F.concat(F.lit("Selected "), "selected", F.lit(f" facts from at most {pool} candidates.")), part, F.concat(F.lit("Primary entities: "), "names", F.lit(".")))
    return out.select("workspace_id", "selected", "communities", "workspace_communities", text.alias("summary"))


def evidence(m: Model, found: DataFrame) -> DataFrame:
    """Per fact: its episode, how many hints say the same, other values of the predicate, and names next to it."""
    triple, keys = ["workspace_id", "subject", "predicate", "object_value"], ["workspace_id", "subject", "predicate"]
    same = m.facts.groupBy(*triple).agg(F.countDistinct("episode_id").alias("episodes"))
    other = m.facts.groupBy(*keys).agg((F.countDistinct("object_value") - 1).alias("other_values"))
    near = m.relations.groupBy("workspace_id", F.col("source").alias("subject")).agg(F.countDistinct("target").alias("related"))
    facts = found.select("id").join(m.facts, F.col("id") == F.col("hint_id")).select("id", *triple, "episode_id")
    return (
        facts.join(same, triple, "left").join(other, keys, "left").join(near, ["workspace_id", "subject"], "left")
        .select("id", "episode_id", F.coalesce("episodes", F.lit(0)).alias("episodes"), F.coalesce("other_values", F.lit(0)).alias("other_values"), F.coalesce("related", F.lit(0)).alias("related"))
    )


def evidence_chain(m: Model, found: DataFrame, terms: Sequence[str], history: int = 5) -> DataFrame:
    """(id, part, place, ref, text): per fact an excerpt of its episode and its other values, the latest first."""
    facts = found.select("id").join(m.facts, F.col("id") == F.col("hint_id")).select("id", "workspace_id", "subject", "predicate", "object_value", "episode_id")
    needed = facts.select(F.col("episode_id").alias("e")).distinct()
    bodies = ranking.excerpts(m.episodes.select("id", "content").join(needed, F.col("id") == F.col("e"), "left_semi"), "id", "content", terms).withColumnRenamed("id", "episode_id")
    said = facts.join(bodies, "episode_id").select("id", F.lit("excerpt").alias("part"), F.lit(1).alias("place"), F.col("episode_id").alias("ref"), F.col("excerpt").alias("text"))
    other = m.facts.select("workspace_id", "subject", "predicate", F.col("object_value").alias("value"), F.col("hint_id").alias("ref"), "valid_from")
    rows = facts.join(other, ["workspace_id", "subject", "predicate"]).filter("ref <> id")
    past = rows.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc_nulls_last("valid_from"), "ref"))).filter(F.col("place") <= history)
    return said.unionByName(past.select("id", F.lit("history").alias("part"), "place", "ref", F.col("value").alias("text")))


def _pool(m: Model, terms: Sequence[str]) -> DataFrame:
    scored = m.facts.withColumn("score", ranking.term_score(F.concat_ws(" ", "subject", "predicate", "object_value", "source_quote"), terms)).filter("score > 0")
    return _best(scored, [F.desc("score"), F.asc("hint_id")], TOPIC_POOL).drop("place")


def topic_map(m: Model, terms: Sequence[str]) -> DataFrame:
    """Subjects of each workspace's best facts: how many, the best score, predicates and span of time."""
    grouped = _pool(m, terms).groupBy("workspace_id", "subject").agg(
        F.count(F.lit(1)).alias("facts"), F.max("score").alias("best"), F.array_join(F.sort_array(F.collect_set("predicate")), ",").alias("predicates"), F.min("valid_from").alias("first_at"), F.max("valid_from").alias("last_at")
    )
    return _best(grouped, [F.desc("best"), F.desc("facts"), F.asc("subject")], TOPIC_ENTITIES)


def topic_edges(m: Model, terms: Sequence[str]) -> DataFrame:
    """(workspace_id, source, target, relation_type, weight): edges without an end between the subjects of a topic map."""
    shown = topic_map(m, terms).select("workspace_id", F.col("subject").alias("n"))
    live = m.edges.filter("valid_to is null")
    for side in ("source", "target"):
        live = live.join(shown.withColumnRenamed("n", side), ["workspace_id", side], "left_semi")
    return live.groupBy("workspace_id", "source", "target", "relation_type").agg(F.count(F.lit(1)).alias("weight"))


def passages(m: Model, query: Sequence[float], source_type: str, k: int = 20) -> DataFrame:
    """(vector_id, source_id, similarity): pure vector search over one kind of stored vector."""
    own = m.table("memory_vectors", "vector_id").filter((F.col("source_type") == source_type) & (F.size("vector") == len(query)))
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = own.select("vector_id", "source_id", F.round(ranking.cosine(F.col("vector"), literal), 6).alias("similarity"))
    return scored.filter("similarity is not null and not isnan(similarity)").orderBy(F.desc("similarity"), "vector_id").limit(k)


def fallback_search(m: Model, words: Sequence[str], limit: int = 50) -> DataFrame:
    """Facts of each workspace in which any word occurs in any of four fields, case ignored."""
    return _best(m.facts_where(_holds(words)), [F.asc("hint_id")], limit).select("workspace_id", "hint_id", "subject", "predicate")


def _holds(words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        for c in ("subject", "predicate", "object_value", "source_quote"):
            hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(word.lower()))
    return hit


def verdicts(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(q_id, hits, verdict): expected words found in an answer; more than half pass, some are weak, none fail."""
    joined = questions.join(answers, "q_id", "left")
    hits = F.size(F.filter("expect", lambda w: F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lower(w))))
    need = F.floor(F.size("expect") / 2) + 1
    return joined.select("q_id", hits.alias("hits"), F.when(hits >= need, "PASS").when(hits > 0, "WEAK").otherwise("FAIL").alias("verdict"))


def daily_hits(m: Model, names: DataFrame, per_name: int = 5) -> DataFrame:
    """(name, day, turn_count): the latest stored summaries of entities with the given names (name)."""
    own = m.entities.select(F.col("id").alias("subject_id"), "name").join(names.select(F.lower("name").alias("asked")).distinct(), F.lower("name") == F.col("asked"))
    newest = Window.partitionBy("name").orderBy(F.desc("day"), "subject_id")
    return m.summaries.join(own, "subject_id").withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= per_name).select("name", "day", "turn_count", "place")


def turn_ids(m: Model, wanted: DataFrame) -> DataFrame:
    """(episode_id, sequence, turn_id) for the wanted (episode_id, sequence); those that don't exist are left out."""
    return wanted.select("episode_id", "sequence").distinct().join(m.turns.select("episode_id", "sequence", F.col("id").alias("turn_id")), ["episode_id", "sequence"])
