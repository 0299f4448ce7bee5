"""Queries of this subpackage and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from memloom.llm import conversations, languages, leakage, mixing, names, near_duplicates, neighbours, personal, splitting
from memloom.tables import load


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    turns = splitting.split_items(load(spark, folder, "turns", ["id", "text"]), "id", "text")
    episodes = splitting.split_items(load(spark, folder, "episodes", ["id", "content"]), "id", "content")
    tag = lambda df, field: df.selectExpr(f"'{field}' as field", "*")
    return tag(turns, "turns.text").unionByName(tag(episodes, "episodes.content"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    turns = splitting.split_items(load(spark, folder, "turns", ["id", "text"]), "id", "text")
    episodes = splitting.split_items(load(spark, folder, "episodes", ["id", "content"]), "id", "content")
    return splitting.oversized(turns, "turns.text").unionByName(splitting.oversized(episodes, "episodes.content"))


def p1_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """Every item that was cut, put together again: its hash, and whether all its pieces keep to the limit."""
    parts = [splitting.rejoined(splitting.split_items(load(spark, folder, table, ["id", text]), "id", text)).selectExpr(f"'{table}.{text}' as field", "record_id", "sha2(text, 256) as hash", f"longest <= {splitting.LIMIT} as fits", "pieces > 1 as cut") for table, text in (("turns", "text"), ("episodes", "content"))]
    return parts[0].unionByName(parts[1])


_TEXTS = (("turns", "id", "text", "turns.text"), ("episodes", "id", "content", "episodes.content"), ("fact_hints", "hint_id", "source_quote", "fact_hints.source_quote"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = [personal.find(load(spark, folder, table, [key, text]), key, text, field) for table, key, text, field in _TEXTS]
    return reduce(DataFrame.unionByName, found).select("field", "record_id", "pii_type", "start_char")


def p2_masked(spark: SparkSession, folder: str) -> DataFrame:
    masked = [personal.mask(load(spark, folder, table, [key, text]), key, text, field) for table, key, text, field in _TEXTS]
    return reduce(DataFrame.unionByName, masked)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.broken(load(spark, folder, "turns"))


def p3_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.conversations(load(spark, folder, "turns"))


def p3_identified(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of the good conversations that carry an identifier."""
    return conversations.conversations(load(spark, folder, "turns")).filter("episode_id is not null").selectExpr("episode_id", "position", "role", "id", "sha2(text, 256) as text_hash")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(load(spark, folder, "memory_vectors")).select("vector_id", "neighbour_id")


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(load(spark, folder, "memory_vectors"), every=50)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.pairs(names.linked(load(spark, folder, "entity_hints")))


def p6_entities(spark: SparkSession, folder: str) -> DataFrame:
    return names.linked(load(spark, folder, "entity_hints"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    members, pairs = near_duplicates.near_duplicates(load(spark, folder, "episodes", ["id", "content", "summary"]))
    return near_duplicates.all_pairs(members, pairs).selectExpr("field", "id_a as episode_id_a", "id_b as episode_id_b")


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    members, pairs = near_duplicates.near_duplicates(load(spark, folder, "episodes", ["id", "content", "summary"]))
    return near_duplicates.groups(members, pairs)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(load(spark, folder, "documents", ["doc_id", "text"]), load(spark, folder, "eval_items", ["item_id", "text"])).select("doc_id", "item_id")


def p8_matches(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(load(spark, folder, "documents", ["doc_id", "text"]), load(spark, folder, "eval_items", ["item_id", "text"]))


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.without_leaks(load(spark, folder, "documents"), load(spark, folder, "eval_items", ["item_id", "text"])).select("doc_id", "source")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(load(spark, folder, "documents", ["doc_id", "source", "text"]), load(spark, folder, "mix_targets"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(load(spark, folder, "documents", ["doc_id", "source", "text"]), load(spark, folder, "mix_targets"))[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return languages.mislabelled(load(spark, folder, "documents", ["doc_id", "text", "lang"]), load(spark, folder, "lang_samples"))


def p10_languages(spark: SparkSession, folder: str) -> DataFrame:
    return languages.segments(load(spark, folder, "documents", ["doc_id", "text"]), load(spark, folder, "lang_samples"))


def p10_passages(spark: SparkSession, folder: str) -> DataFrame:
    return languages.spans(load(spark, folder, "documents", ["doc_id", "text"]), load(spark, folder, "lang_samples"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_rejoined": p1_rejoined,
    "p2_found": p2_found,
    "p2_masked": p2_masked,
    "p3_found": p3_found,
    "p3_conversations": p3_conversations,
    "p3_identified": p3_identified,
    "p5_found": p5_found,
    "p5_neighbours": p5_neighbours,
    "p6_found": p6_found,
    "p6_entities": p6_entities,
    "p7_found": p7_found,
    "p7_groups": p7_groups,
    "p8_found": p8_found,
    "p8_matches": p8_matches,
    "p8_clean": p8_clean,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_languages": p10_languages,
    "p10_passages": p10_passages,
}

_ROLES = " ".join(
    f"WHEN lower(trim(role, E' \\t\\n\\r')) IN ({', '.join(repr(x) for x in spellings)}) THEN '{name}'"
    for name, spellings in conversations.ROLE_SPELLINGS.items()
)

ORACLES: dict[str, str] = {
    "p1_found": """
        SELECT DISTINCT 'turns.text' AS field, id AS record_id FROM turns WHERE length(text) > 4000
        UNION ALL
        SELECT DISTINCT 'episodes.content', id FROM episodes WHERE length(content) > 4000""",
    "p1_rejoined": """
        SELECT DISTINCT 'turns.text' AS field, id AS record_id, sha256(text) AS hash, true AS fits, true AS cut FROM turns WHERE length(text) > 4000
        UNION ALL
        SELECT DISTINCT 'episodes.content', id, sha256(content), true, true FROM episodes WHERE length(content) > 4000""",
    "p3_identified": f"""
        WITH r AS (SELECT id, episode_id, sequence, text, CASE {_ROLES} END AS role, coalesce(regexp_matches(text, '[^\\s\\p{{Z}}]'), false) AS said
                   FROM turns WHERE episode_id IS NOT NULL AND sequence IS NOT NULL),
             c AS (SELECT DISTINCT episode_id FROM (SELECT episode_id FROM r GROUP BY episode_id, sequence HAVING count(DISTINCT coalesce('t' || text, 'n')) > 1)),
             e AS (SELECT episode_id, min(sequence) AS first FROM r GROUP BY 1
                   HAVING max(sequence) - min(sequence) + 1 = count(DISTINCT sequence) AND NOT bool_or(role IS NULL)
                      AND NOT (max(sequence) FILTER (role = 'user' AND said) IS NULL AND max(sequence) FILTER (role = 'assistant' AND said) IS NULL)
                      AND (max(sequence) FILTER (role = 'user' AND said) IS NULL OR coalesce(max(sequence) FILTER (role = 'assistant' AND said) > max(sequence) FILTER (role = 'user' AND said), false)))
        SELECT r.episode_id, CAST(sequence - first AS BIGINT) AS position, arg_min(role, r.id) AS role, min(r.id) AS id, arg_min(sha256(text), r.id) AS text_hash
        FROM r JOIN e ON e.episode_id = r.episode_id WHERE r.episode_id NOT IN (SELECT episode_id FROM c) GROUP BY ALL""",
    "p3_found": f"""
        WITH r AS (SELECT episode_id, sequence, text, CASE {_ROLES} END AS role,
                          coalesce(regexp_matches(text, '[^\\s\\p{{Z}}]'), false) AS said
                   FROM turns WHERE episode_id IS NOT NULL AND sequence IS NOT NULL),
             s AS (SELECT episode_id, sequence, count(DISTINCT coalesce('t' || text, 'n')) > 1 AS conflict
                   FROM r GROUP BY ALL),
             e AS (SELECT episode_id, max(sequence) - min(sequence) + 1 > count(DISTINCT sequence) AS gap,
                          bool_or(role IS NULL) AS bad_role,
                          max(sequence) FILTER (role = 'user' AND said) AS u,
                          max(sequence) FILTER (role = 'assistant' AND said) AS a
                   FROM r GROUP BY episode_id)
        SELECT episode_id, 'empty' AS problem FROM e WHERE u IS NULL AND a IS NULL
        UNION ALL SELECT episode_id, 'gap' FROM e WHERE gap
        UNION ALL SELECT DISTINCT episode_id, 'conflict' FROM s WHERE conflict
        UNION ALL SELECT episode_id, 'bad_role' FROM e WHERE bad_role
        UNION ALL SELECT episode_id, 'no_reply' FROM e WHERE u IS NOT NULL AND (a IS NULL OR a <= u)""",
}
