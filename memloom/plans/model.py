"""The logical tables of a conversation archive, as DataFrames over the stored ones.

Every reader of ``memloom.plans.reads`` takes a ``Model``.  Redelivered rows are taken once; the other tables follow:

* facts: extracted triples with the time of their episode; ``subject`` is the entity they are about.
* relations: facts whose object is a name (it opens with a capital), as directed edges between the names of a workspace;
  an edge ends (``valid_to``) when the latest fact of its source and type begins.
* links: which turn is about which entity of the subject tree (a few turns of an episode share one), over all entities.
* summaries: stored daily summaries of a subject, one for each second day with turns.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.tables import delivered_once, load

#: Turns of an episode that are about the same entity in the derived link table, and the step from episode to episode.
TURNS_PER_ENTITY, EPISODE_STEP = 4, 7919


def visible(metadata: Column) -> Column:
    """Soft deletion: rows whose metadata says deleted are hidden; null or broken metadata hides nothing."""
    return ~F.get_json_object(metadata, "$.deleted").eqNullSafe("true")


def coerced_relation(name: Column) -> Column:
    """Relation and predicate names in one spelling: lower case, blanks and hyphens as underscores."""
    return F.translate(F.lower(F.trim(name)), "- ", "__")


class Model:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str, key: str) -> DataFrame:
        return delivered_once(load(self.spark, self.folder, name), key)

    @cached_property
    def workspaces(self) -> DataFrame:
        return load(self.spark, self.folder, "workspaces")

    @cached_property
    def episodes(self) -> DataFrame:
        return self.table("episodes", "id")

    @cached_property
    def turns(self) -> DataFrame:
        return self._timed(self.table("turns", "id"))

    def turns_of(self, workspace_id: int) -> DataFrame:
        """Turns of one workspace: redelivered rows are equal, so the filter may come first and reaches the scan."""
        own = load(self.spark, self.folder, "turns").filter(F.col("workspace_id") == workspace_id)
        return self._timed(delivered_once(own, "id"))

    @staticmethod
    def _timed(turns: DataFrame) -> DataFrame:
        at = F.coalesce("ts", "created_at")
        return turns.withColumn("said_at", at).withColumn("day", F.to_date(at))

    @cached_property
    def entities(self) -> DataFrame:
        return self.table("entities", "id")

    @cached_property
    def facts(self) -> DataFrame:
        when = self.episodes.select(F.col("id").alias("e_id"), F.col("created_at").alias("valid_from"))
        return (
            self.table("fact_hints", "hint_id").join(when, F.col("episode_id") == F.col("e_id"), "left")
            .select("hint_id", "workspace_id", "episode_id", "subject", coerced_relation(F.col("predicate")).alias("predicate"), "object_value", "source_quote", "valid_from")
        )

    def facts_where(self, condition: Column, columns: list[str] | None = None) -> DataFrame:
        """Facts that meet a condition on their own columns: it reaches the scan, since redelivered rows are equal."""
        own = delivered_once(load(self.spark, self.folder, "fact_hints").withColumn("predicate", coerced_relation(F.col("predicate"))).filter(condition), "hint_id")
        when = self.episodes.select(F.col("id").alias("e_id"), F.col("created_at").alias("valid_from"))
        return own.join(when, F.col("episode_id") == F.col("e_id"), "left").select(*self.facts.columns)

    def turns_where(self, condition: Column) -> DataFrame:
        """Turns that meet a condition on said_at, day or their own columns, which reaches the scan."""
        return delivered_once(self._timed(load(self.spark, self.folder, "turns")).filter(condition), "id")

    def episodes_where(self, condition: Column) -> DataFrame:
        return delivered_once(load(self.spark, self.folder, "episodes").filter(condition), "id")

    @cached_property
    def active_facts(self) -> DataFrame:
        """Facts with ``superseded_at``: a hint that only repeats a stored triple is superseded when it comes."""
        triple = ["workspace_id", "subject", "predicate", "object_value"]
        first = self.facts.groupBy(*[F.col(c).alias(f"_{c}") for c in triple]).agg(F.min("hint_id").alias("first_id"))
        same = F.lit(True)
        for c in triple:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return self.facts.join(first, same).select(*self.facts.columns, F.when(F.col("hint_id") > F.col("first_id"), F.col("valid_from")).alias("superseded_at"))

    @cached_property
    def relations(self) -> DataFrame:
        return self.facts.filter(F.col("object_value").rlike("^[A-Z]") & (F.col("subject") != F.col("object_value"))).select(
            "hint_id", "workspace_id", F.col("subject").alias("source"), F.col("object_value").alias("target"), F.col("predicate").alias("relation_type"), "valid_from"
        )

    @cached_property
    def edges(self) -> DataFrame:
        """Relations with ``valid_to``: null for the latest of a source and type, else when the latest one begins."""
        latest = self.relations.groupBy("workspace_id", "source", "relation_type").agg(F.max("valid_from").alias("latest"))
        return self.relations.join(latest, ["workspace_id", "source", "relation_type"]).withColumn("valid_to", F.when(F.col("valid_from") < F.col("latest"), F.col("latest"))).drop("latest")

    @cached_property
    def entity_names(self) -> DataFrame:
        """(workspace_id, key, entity_id): names and aliases in lower case, each with the smallest entity of the workspace."""
        names = self.entities.select("workspace_id", F.lower("name").alias("key"), F.col("id").alias("entity_id")).unionByName(
            self.entities.select("workspace_id", F.explode("aliases").alias("key"), F.col("id").alias("entity_id")).withColumn("key", F.lower("key"))
        )
        return names.filter("key is not null").groupBy("workspace_id", "key").agg(F.min("entity_id").alias("entity_id"))

    @cached_property
    def fact_entities(self) -> DataFrame:
        """(hint_id, entity_id): facts whose subject is the name or an alias of an entity of their workspace."""
        return self.facts.select("hint_id", "workspace_id", F.lower(F.trim("subject")).alias("key")).join(self.entity_names, ["workspace_id", "key"]).select("hint_id", "entity_id")

    @cached_property
    def links(self) -> DataFrame:
        """(turn_id, subject_id, workspace_id, episode_id, day)."""
        most = self.entities.agg(F.max("id").alias("most"))
        chosen = (F.col("episode_id") * EPISODE_STEP + F.floor(F.col("sequence") / TURNS_PER_ENTITY)) % F.col("most") + 1
        known = self.entities.select(F.col("id").alias("subject_id"))
        return (
            self.turns.filter("episode_id is not null").crossJoin(F.broadcast(most)).withColumn("subject_id", chosen.cast("long"))  # one row
            .join(known, "subject_id", "left_semi").select(F.col("id").alias("turn_id"), "subject_id", "workspace_id", "episode_id", "day")
        )

    @cached_property
    def daily(self) -> DataFrame:
        """(workspace_id, subject_id, day, turn_count): what could be summarised."""
        return self.links.groupBy("workspace_id", "subject_id", "day").agg(F.count(F.lit(1)).alias("turn_count"))

    @cached_property
    def summaries(self) -> DataFrame:
        return self.daily.filter(F.dayofmonth("day") % 2 == 0)


#: The same tables for a SQL engine: to be put before a query.
MODEL_SQL = f"""
WITH RECURSIVE
 episode AS (SELECT DISTINCT ON (id) * FROM episodes),
 turn AS (SELECT DISTINCT ON (id) *, coalesce(ts, created_at) AS said_at, CAST(coalesce(ts, created_at) AS DATE) AS day FROM turns),
 entity AS (SELECT DISTINCT ON (id) * FROM entities),
 fact AS (SELECT h.hint_id, h.workspace_id, h.episode_id, h.subject, translate(lower(trim(h.predicate)), '- ', '__') AS predicate,
                 h.object_value, h.source_quote, e.created_at AS valid_from
          FROM (SELECT DISTINCT ON (hint_id) * FROM fact_hints) h LEFT JOIN episode e ON h.episode_id = e.id),
 relation AS (SELECT hint_id, workspace_id, subject AS source, object_value AS target, predicate AS relation_type, valid_from
              FROM fact WHERE regexp_matches(object_value, '^[A-Z]') AND subject <> object_value),
 edge AS (SELECT *, CASE WHEN valid_from < max(valid_from) OVER w THEN max(valid_from) OVER w END AS valid_to
          FROM relation WINDOW w AS (PARTITION BY workspace_id, source, relation_type)),
 active AS (SELECT *, CASE WHEN hint_id > min(hint_id) OVER (PARTITION BY workspace_id, subject, predicate, object_value) THEN valid_from END AS superseded_at FROM fact),
 named AS (SELECT workspace_id, key, min(id) AS entity_id FROM (SELECT workspace_id, lower(name) AS key, id FROM entity
           UNION ALL SELECT workspace_id, lower(unnest(aliases)), id FROM entity) WHERE key IS NOT NULL GROUP BY ALL),
 fact_entity AS (SELECT f.hint_id, n.entity_id FROM fact f JOIN named n ON n.workspace_id = f.workspace_id AND n.key = lower(trim(f.subject))),
 link AS (SELECT t.id AS turn_id, e.id AS subject_id, t.workspace_id, t.episode_id, t.day
          FROM turn t JOIN entity e ON e.id = (t.episode_id * {EPISODE_STEP} + t.sequence // {TURNS_PER_ENTITY}) % (SELECT max(id) FROM entity) + 1),
 daily AS (SELECT workspace_id, subject_id, day, count(*) AS turn_count FROM link GROUP BY ALL),
 summary AS (SELECT * FROM daily WHERE day(day) % 2 = 0)
"""
VISIBLE_SQL = "coalesce(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.deleted') END, '') <> 'true'"
