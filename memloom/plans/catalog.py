"""Queries of the core and the SQL that gives the same rows on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import embed
from memloom.functions import text as X
from memloom.operators import classify, gaps, graph, hierarchy, ingest, ranking, search
from memloom.plans import reads
from memloom.plans.model import MODEL_SQL, VISIBLE_SQL, Model
from memloom.tables import load

TERMS = ["schema", "queue", "cache"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def _read(name: str, run: Callable[[Model], DataFrame], sql: str | None = None) -> None:
    """Registers a query over the logical tables; ``sql`` follows their definitions."""
    QUERIES[name] = lambda spark, folder: _dates_as_text(run(Model(spark, folder)))
    if sql:
        ORACLES[name] = MODEL_SQL + sql


# --- hierarchy -------------------------------------------------------------------------------------------------------
def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.hierarchy(load(spark, folder, "entities", ["id", "parent_id"]))


QUERIES["p4_found"] = lambda spark, folder: _nodes(spark, folder).selectExpr("id as entity_id", "node_state", "root_id", "depth")
QUERIES["p4_descendants"] = lambda spark, folder: hierarchy.ancestor_pairs(_nodes(spark, folder))
QUERIES["p4_paths"] = lambda spark, folder: hierarchy.paths(_nodes(spark, folder))
_REACH = """
    WITH RECURSIVE n AS (SELECT id, min(parent_id) AS parent_id FROM entities GROUP BY id),
         p AS (SELECT n.id, n.parent_id FROM n JOIN n k ON n.parent_id = k.id),
         reach AS (SELECT id, parent_id AS up FROM p
                   UNION SELECT r.id, p.parent_id FROM reach r JOIN p ON r.up = p.id),
         f AS (SELECT n.id, count(r.up) AS ups, max(CASE WHEN p.id IS NULL THEN r.up END) AS root,
                      coalesce(bool_or(r.up = n.id), false) AS ring, bool_or(p.id IS NULL) AS ends
               FROM n LEFT JOIN reach r ON r.id = n.id LEFT JOIN p ON p.id = r.up GROUP BY n.id)"""
ORACLES["p4_found"] = _REACH + """
        SELECT id AS entity_id,
               CASE WHEN ring THEN 'cycle' WHEN ends THEN 'tree' ELSE 'below_cycle' END AS node_state,
               CASE WHEN ring OR NOT ends THEN -1 WHEN ups = 0 THEN id ELSE root END AS root_id,
               CAST(CASE WHEN ring THEN -1 WHEN ends THEN ups ELSE -2 END AS INTEGER) AS depth FROM f"""
ORACLES["p4_descendants"] = _REACH + """,
         d AS (SELECT id, ups FROM f WHERE ends AND NOT ring)
        SELECT r.up AS ancestor_id, r.id, CAST(d.ups - u.ups AS INTEGER) AS distance
        FROM reach r JOIN d ON r.id = d.id JOIN d u ON r.up = u.id"""
ORACLES["p4_paths"] = _REACH + """,
         d AS (SELECT id, ups FROM f WHERE ends AND NOT ring)
        SELECT d.id, concat_ws('/', (SELECT string_agg(CAST(r.up AS VARCHAR), '/' ORDER BY u.ups) FROM reach r JOIN d u ON r.up = u.id WHERE r.id = d.id),
                         CAST(d.id AS VARCHAR)) AS path FROM d"""

# --- timelines -------------------------------------------------------------------------------------------------------
_read("timeline_page", reads.timeline_page, """
    SELECT id, episode_id, sequence, said_at, (SELECT count(*) FROM turn WHERE workspace_id = 1) AS total,
           (SELECT count(*) FROM turn WHERE workspace_id = 1) > 50 AS has_more
    FROM turn WHERE workspace_id = 1 ORDER BY said_at DESC, id DESC LIMIT 50""")
_read("date_buckets", reads.date_buckets, "SELECT workspace_id, CAST(day AS VARCHAR) AS day, count(*) AS turns FROM turn GROUP BY ALL")
_CLOSURE = """,
    known AS (SELECT e.id, p.id AS parent_id FROM entity e JOIN entity p ON e.parent_id = p.id),
    up AS (SELECT id, parent_id AS anc FROM known UNION SELECT u.id, k.parent_id FROM up u JOIN known k ON u.anc = k.id),
    endless AS (SELECT DISTINCT id FROM up WHERE anc IN (SELECT id FROM up WHERE id = anc)),
    depths AS (SELECT e.id, count(u.anc) AS n FROM entity e LEFT JOIN up u ON u.id = e.id GROUP BY e.id),
    closure AS (SELECT u.anc AS ancestor_id, u.id AS descendant_id, CAST(a.n - b.n AS INTEGER) AS distance
                FROM up u JOIN depths a ON a.id = u.id JOIN depths b ON b.id = u.anc
                WHERE u.id NOT IN (SELECT id FROM endless)
                UNION ALL SELECT id, id, 0 FROM entity)
"""
_read("subject_closure", reads.subject_closure, _CLOSURE + "SELECT * FROM closure")
_read("subject_date_buckets", reads.subject_date_buckets, _CLOSURE + """
    SELECT c.ancestor_id, CAST(l.day AS VARCHAR) AS day, count(DISTINCT l.turn_id) AS turns FROM link l JOIN closure c ON l.subject_id = c.descendant_id GROUP BY ALL""")
_read("subject_feed", reads.subject_feed, _CLOSURE + """
    SELECT ancestor_id, turn_id, CAST(f.day AS VARCHAR) AS day, row_number() OVER (PARTITION BY ancestor_id ORDER BY f.day DESC, turn_id DESC) AS place
    FROM (SELECT DISTINCT c.ancestor_id, l.turn_id, l.day FROM link l JOIN closure c ON l.subject_id = c.descendant_id) f QUALIFY place <= 5""")
_read("on_this_day", reads.on_this_day, """
    SELECT id, workspace_id, CAST(turn.day AS VARCHAR) AS day, substr(text, 1, 200) AS excerpt FROM turn
    WHERE month(turn.day) = 5 AND day(turn.day) = 13 AND turn.day <> DATE '2026-05-13'""")
_read("last_episodes", reads.last_episodes, f"""
    SELECT workspace_id, row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, id DESC) AS place, id,
           substr(coalesce(nullif(human_summary, ''), summary), 1, 150) AS summary
    FROM episode WHERE {VISIBLE_SQL} QUALIFY place <= 3""")
_read("diaries_by_date", reads.diaries_by_date, f"""
    , span AS (SELECT episode_id, min(said_at) AS first_at, count(*) AS n FROM turn WHERE episode_id IS NOT NULL GROUP BY 1)
    SELECT e.id, e.workspace_id, CAST(CAST(coalesce(first_at, e.created_at) AS DATE) AS VARCHAR) AS day, coalesce(n, 0) AS turns
    FROM episode e LEFT JOIN span ON e.id = span.episode_id WHERE {VISIBLE_SQL} AND length(trim(summary)) > 0""")
# --- subjects, entities, facts ---------------------------------------------------------------------------------------
_DEGREE = """, degree AS (SELECT workspace_id, name, count(*) AS degree FROM (SELECT workspace_id, source AS name FROM relation UNION ALL SELECT workspace_id, target FROM relation) GROUP BY ALL)
"""
_read("subject_tree", reads.subject_tree, """
    , n AS (SELECT subject_id, count(DISTINCT turn_id) AS turns FROM link GROUP BY 1)
    SELECT e.id, p.subject_id AS parent_id, e.name, n.turns, p.subject_id IS NULL AS is_root
    FROM entity e JOIN n ON e.id = n.subject_id LEFT JOIN n p ON e.parent_id = p.subject_id""")
_read("subjects_by_turns", reads.subjects_by_turns, """
    SELECT e.id, e.name, p.name AS parent_name, (SELECT count(DISTINCT turn_id) FROM link WHERE subject_id = e.id) AS turns
    FROM entity e LEFT JOIN entity p ON e.parent_id = p.id""")
_read("entity_index", reads.entity_index, _DEGREE + """
    SELECT f.workspace_id, f.subject, count(*) AS facts, max(valid_from) AS latest, coalesce(any_value(d.degree), 0) AS degree,
           CAST(sum(count(*)) OVER (PARTITION BY f.workspace_id) AS BIGINT) AS workspace_facts
    FROM fact f LEFT JOIN degree d ON d.name = f.subject AND d.workspace_id = f.workspace_id GROUP BY f.workspace_id, f.subject""")
_read("entity_groups", reads.entity_groups, """
    SELECT workspace_id, kind, count(*) AS entities, CAST(coalesce(sum(n), 0) AS BIGINT) AS facts, row_number() OVER (PARTITION BY workspace_id ORDER BY coalesce(sum(n), 0) DESC, kind) AS place
    FROM (SELECT workspace_id, coalesce(lower(trim(entity_type)), 'other') AS kind, (SELECT count(*) FROM fact_entity x WHERE x.entity_id = e.id) AS n FROM entity e) WHERE kind <> 'episode_topic' GROUP BY 1, 2""")
_read("top_entities", reads.top_entities, _DEGREE + """
    SELECT f.workspace_id, row_number() OVER (PARTITION BY f.workspace_id ORDER BY count(*) DESC, coalesce(any_value(degree), 0) DESC, subject) AS place, subject, count(*) AS facts, coalesce(any_value(degree), 0) AS degree
    FROM fact f LEFT JOIN degree d ON d.name = subject AND d.workspace_id = f.workspace_id GROUP BY f.workspace_id, subject QUALIFY place <= 10""")
_read("entity_counts", reads.entity_counts, """
    SELECT workspace_id, subject, count(*) AS facts, count(DISTINCT episode_id) AS episodes,
           (SELECT count(*) FROM relation r WHERE r.source = f.subject AND r.workspace_id = f.workspace_id) AS outgoing, (SELECT count(*) FROM relation r WHERE r.target = f.subject AND r.workspace_id = f.workspace_id) AS incoming
    FROM fact f GROUP BY ALL""")
_read("entity_page", reads.entity_page, f"""
    , own AS (SELECT c.workspace_id, p.id AS entity_id, p.name AS above, c.id AS child, c.name FROM entity c JOIN entity p ON c.parent_id = p.id AND c.workspace_id = p.workspace_id),
    n AS (SELECT subject_id, count(*) AS turns FROM link GROUP BY 1),
    ends AS (SELECT r.workspace_id, entity_id, hint_id, valid_from, 'out' AS way, concat_ws(' ', 'out', relation_type, target) AS label FROM relation r JOIN named k ON k.workspace_id = r.workspace_id AND k.key = lower(trim(source))
             UNION ALL SELECT r.workspace_id, entity_id, hint_id, valid_from, 'in', concat_ws(' ', 'in', relation_type, source) FROM relation r JOIN named k ON k.workspace_id = r.workspace_id AND k.key = lower(trim(target))),
    spoken AS (SELECT l.workspace_id, l.subject_id AS entity_id, l.episode_id, min(l.day) AS day FROM link l JOIN entity e ON e.id = l.subject_id AND e.workspace_id = l.workspace_id GROUP BY ALL),
    shown AS (SELECT id, substr(coalesce(nullif(human_summary, ''), summary, ''), 1, 400) AS summary FROM episode WHERE {VISIBLE_SQL})
    SELECT workspace_id, id AS entity_id, 'entity' AS part, CAST(1 AS INTEGER) AS place, id AS ref, concat_ws(' / ', name, entity_type) AS label FROM entity
    UNION ALL SELECT workspace_id, child, 'parent', 1, entity_id, above FROM own
    UNION ALL SELECT o.workspace_id, entity_id, 'child', CAST(row_number() OVER (PARTITION BY o.workspace_id, entity_id ORDER BY coalesce(turns, 0) DESC, child) AS INTEGER), child, name FROM own o LEFT JOIN n ON n.subject_id = child
    UNION ALL SELECT * FROM (SELECT f.workspace_id, entity_id, 'fact', CAST(row_number() OVER (PARTITION BY f.workspace_id, entity_id ORDER BY valid_from DESC NULLS LAST, f.hint_id) AS INTEGER) AS place, f.hint_id, concat_ws(' ', predicate, object_value)
              FROM fact f JOIN fact_entity USING (hint_id) QUALIFY place <= 30)
    UNION ALL SELECT * FROM (SELECT workspace_id, entity_id, 'relation', CAST(row_number() OVER (PARTITION BY workspace_id, entity_id ORDER BY valid_from DESC NULLS LAST, hint_id, way) AS INTEGER) AS place, hint_id, label FROM ends QUALIFY place <= 24)
    UNION ALL SELECT * FROM (SELECT workspace_id, entity_id, 'episode', CAST(row_number() OVER (PARTITION BY workspace_id, entity_id ORDER BY day DESC NULLS LAST, episode_id) AS INTEGER) AS place, episode_id, summary FROM spoken JOIN shown ON id = episode_id QUALIFY place <= 10)""")
_read("entity_degree", reads.degree, _DEGREE + "SELECT * FROM degree")
_read("fact_dedup", reads.fact_dedup, """
    SELECT hint_id, episode_id, min(hint_id) OVER w AS fact_id, CASE WHEN hint_id = min(hint_id) OVER w THEN 'source' ELSE 'reinforcing' END AS role
    FROM fact WINDOW w AS (PARTITION BY workspace_id, subject, predicate, object_value)""")
_read("fact_history", reads.fact_history, """
    SELECT workspace_id, subject, predicate, object_value, hint_id, count(*) OVER (PARTITION BY workspace_id, subject, predicate) AS versions
    FROM fact QUALIFY row_number() OVER (PARTITION BY workspace_id, subject, predicate ORDER BY valid_from DESC NULLS LAST, hint_id DESC) = 1""")
_read("top3_facts", reads.top3_facts, """
    SELECT workspace_id, subject, row_number() OVER (PARTITION BY workspace_id, subject ORDER BY valid_from DESC NULLS LAST, hint_id) AS place, hint_id, predicate, object_value
    FROM fact QUALIFY place <= 3""")
_read("topic_stats", reads.topic_stats, """
    SELECT workspace_id, predicate, count(*) AS facts, count(DISTINCT subject) AS subjects FROM fact GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY count(*) DESC, predicate) <= 10""")
_OPEN = "'open_question', 'next_step', 'pending', 'todo', 'goal', 'blocker', 'decision_pending', 'blocked_by', 'scheduled_for', 'depends_on'"
_OPEN_ITEMS = f"""
    , last AS (SELECT episode_id, max(said_at) AS worked_at FROM turn WHERE episode_id IS NOT NULL GROUP BY 1),
    open AS (SELECT hint_id, workspace_id, subject, predicate, substr(object_value, 1, 120) AS object_value, worked_at
    FROM fact LEFT JOIN last USING (episode_id) WHERE predicate IN ({_OPEN}))"""
_read("open_items", reads.open_items, _OPEN_ITEMS + "SELECT * FROM open")
_read("reinforced_facts", reads.reinforced_facts, """
    SELECT workspace_id, subject, predicate, object_value, count(*) AS links, min(hint_id) AS fact_id FROM fact GROUP BY 1, 2, 3, 4 ORDER BY 5 DESC, 6 LIMIT 5""")
# --- graph -----------------------------------------------------------------------------------------------------------
_read("collapsed_edges", reads.collapsed_edges, "SELECT workspace_id, source, target, relation_type, count(*) AS weight FROM relation GROUP BY ALL")
_HUBS = _DEGREE + ", hub AS (SELECT * FROM degree QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY degree DESC, name) <= 25)\n"
_read("hub_nodes", reads.hub_nodes, _HUBS + "SELECT * FROM hub")
_read("hub_edges", reads.hub_edges, _HUBS + """
    SELECT workspace_id, source, target, relation_type, count(*) AS weight FROM relation
    WHERE (workspace_id, source) IN (SELECT (workspace_id, name) FROM hub) AND (workspace_id, target) IN (SELECT (workspace_id, name) FROM hub) GROUP BY ALL""")
_read("entity_graph", lambda m: reads.entity_graph(m, 20), """
    , ends AS (SELECT g.hint_id, g.workspace_id, g.relation_type, a.entity_id AS source_id, b.entity_id AS target_id FROM edge g
               LEFT JOIN named a ON a.workspace_id = g.workspace_id AND a.key = lower(trim(g.source)) LEFT JOIN named b ON b.workspace_id = g.workspace_id AND b.key = lower(trim(g.target)) WHERE g.valid_to IS NULL),
    deg AS (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM ends UNION ALL SELECT target_id FROM ends) WHERE id IS NOT NULL GROUP BY 1),
    node AS (SELECT e.workspace_id, e.id, e.entity_type, deg.n FROM entity e JOIN deg USING (id) WHERE e.entity_type <> 'episode_topic'
             QUALIFY row_number() OVER (PARTITION BY e.workspace_id ORDER BY deg.n DESC, e.name, e.id) <= 20)
    SELECT workspace_id, 'node' AS part, id AS source, CAST(NULL AS BIGINT) AS target, entity_type AS label, n AS weight FROM node
    UNION ALL SELECT workspace_id, 'edge', source_id, target_id, relation_type, count(*) FROM ends WHERE source_id IN (SELECT id FROM node) AND target_id IN (SELECT id FROM node) GROUP BY ALL
    UNION ALL SELECT workspace_id, 'total', NULL, NULL, 'entities', count(*) FROM entity WHERE entity_type <> 'episode_topic' GROUP BY 1""")
_read("edge_summary", reads.edge_summary, _DEGREE + """
    SELECT n.workspace_id, count(*) AS names, CAST(sum(CASE WHEN d.name IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS isolated,
           (SELECT count(*) FROM relation r WHERE r.workspace_id = n.workspace_id) AS edges
    FROM (SELECT DISTINCT workspace_id, subject FROM fact) n LEFT JOIN degree d ON d.name = n.subject AND d.workspace_id = n.workspace_id GROUP BY n.workspace_id""")
_read("live_edges", reads.live_edges, """
    SELECT workspace_id, count(*) AS edges, count(*) FILTER (valid_to IS NULL OR valid_to > TIMESTAMP '2026-05-13') AS open_then, count(*) FILTER (valid_to IS NULL) AS endless FROM edge GROUP BY 1""")
_read("active_fact_counts", reads.active_fact_counts, "SELECT workspace_id, subject, count(*) AS facts, count(*) FILTER (superseded_at IS NULL) AS active FROM active GROUP BY ALL")
_BOTH = """, both_ways AS (SELECT workspace_id, source AS anchor, target AS other, relation_type, 'out' AS direction, valid_from FROM relation
    UNION ALL SELECT workspace_id, target, source, relation_type, 'in', valid_from FROM relation)\n"""
_read("relations_both_ways", reads.relations_both_ways, _BOTH + "SELECT * FROM both_ways")
_read("relation_counts", reads.relation_counts, _BOTH + "SELECT workspace_id, anchor, relation_type, direction, count(DISTINCT other) AS neighbours FROM both_ways GROUP BY ALL")
_read("neighbors_1hop", reads.neighbors_1hop, """
    , live AS (SELECT * FROM edge WHERE valid_to IS NULL OR valid_to > TIMESTAMP '2026-05-13'),
    seen AS (SELECT workspace_id, source AS anchor, target AS other, relation_type, 'out' AS direction, valid_from FROM live UNION ALL SELECT workspace_id, target, source, relation_type, 'in', valid_from FROM live),
    near AS (SELECT workspace_id, anchor, other, relation_type, direction, row_number() OVER (PARTITION BY workspace_id, anchor ORDER BY max(valid_from) DESC NULLS LAST, other, relation_type, direction) AS place FROM seen GROUP BY workspace_id, anchor, other, relation_type, direction QUALIFY place <= 10),
    act AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, subject ORDER BY valid_from DESC NULLS LAST, hint_id) AS nth FROM active WHERE superseded_at IS NULL),
    told AS (SELECT workspace_id, subject, count(*) AS n, string_agg(concat_ws(' ', predicate, substr(object_value, 1, 150)), '; ' ORDER BY nth) FILTER (nth <= 3) AS t FROM act GROUP BY 1, 2)
    SELECT near.workspace_id, anchor, place, other, relation_type, direction, coalesce(n, 0) AS facts, coalesce(t, '') AS top_facts FROM near LEFT JOIN told ON told.workspace_id = near.workspace_id AND told.subject = other""")


def _anchors(m: Model) -> DataFrame:
    return reads.hub_nodes(m, 5).select("workspace_id", "name")


_BY = ["workspace_id"]
_ANCHORS = _DEGREE + ", anchor AS (SELECT workspace_id, name FROM degree QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY degree DESC, name) <= 5)\n"
_REACHED = """, reached AS (SELECT workspace_id, name, 0 AS depth FROM anchor
    UNION SELECT b.workspace_id, b.other, r.depth + 1 FROM reached r JOIN both_ways b ON b.anchor = r.name AND b.workspace_id = r.workspace_id WHERE r.depth < 2)
"""
_read("bfs_hops", lambda m: graph.hops(m.relations, _anchors(m), 2, _BY), _ANCHORS + _BOTH + _REACHED + "SELECT workspace_id, name, min(depth) AS depth FROM reached GROUP BY ALL")
_read("path_walk", lambda m: graph.walks(m.relations, _anchors(m), 2, _BY), _ANCHORS + """
    , step AS (SELECT DISTINCT workspace_id, source, target FROM relation),
    walk AS (SELECT workspace_id, [name] AS names, 0 AS depth FROM anchor
             UNION ALL SELECT walk.workspace_id, list_append(names, target), depth + 1 FROM walk JOIN step ON step.workspace_id = walk.workspace_id AND source = names[-1] WHERE depth < 2 AND NOT list_contains(names, target))
    SELECT workspace_id, array_to_string(names, '>') AS path, depth FROM walk""")
_read("communities", lambda m: graph.communities(m.relations, by=_BY))
# --- workspaces and briefs -------------------------------------------------------------------------------------------
_read("workspaces_rich", reads.workspaces_rich, """
    , top AS (SELECT workspace_id, string_agg(subject, ', ' ORDER BY n DESC, subject) AS top
              FROM (SELECT workspace_id, subject, count(*) AS n FROM fact GROUP BY 1, 2
                    QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY count(*) DESC, subject) <= 3) GROUP BY 1),
    ep AS (SELECT workspace_id, count(*) AS n, max(created_at) AS latest FROM episode GROUP BY 1)
    SELECT w.id, w.name, status = 'active' AS is_active, coalesce(ep.n, 0) AS episodes, ep.latest, top.top
    FROM workspaces w LEFT JOIN ep ON w.id = ep.workspace_id LEFT JOIN top ON w.id = top.workspace_id""")
_read("dashboard_stats", reads.dashboard_stats, f"""
    , e AS (SELECT workspace_id, count(*) AS n, min(created_at) AS f, max(created_at) AS l FROM episode WHERE {VISIBLE_SQL} GROUP BY 1), t AS (SELECT workspace_id, count(*) AS n, min(day) AS f, max(day) AS l FROM turn GROUP BY 1),
    a AS (SELECT workspace_id, count(*) AS n FROM active WHERE superseded_at IS NULL GROUP BY 1), x AS (SELECT workspace_id, count(*) AS n FROM entity GROUP BY 1)
    SELECT w.id AS workspace_id, coalesce(e.n, 0) AS episodes, coalesce(t.n, 0) AS turns, coalesce(x.n, 0) AS entities, coalesce(a.n, 0) AS facts,
           CAST(coalesce(t.f, CAST(e.f AS DATE)) AS VARCHAR) AS first_day, CAST(coalesce(t.l, CAST(e.l AS DATE)) AS VARCHAR) AS last_day
    FROM workspaces w LEFT JOIN e ON e.workspace_id = w.id LEFT JOIN t ON t.workspace_id = w.id LEFT JOIN a ON a.workspace_id = w.id LEFT JOIN x ON x.workspace_id = w.id""")
_LIVE_DEGREE = ", live_degree AS (SELECT workspace_id, name, count(*) AS degree FROM (SELECT workspace_id, source AS name FROM edge WHERE valid_to IS NULL UNION ALL SELECT workspace_id, target FROM edge WHERE valid_to IS NULL) GROUP BY ALL)\n"
_read("dashboard", reads.dashboard, _LIVE_DEGREE + f"""
    SELECT workspace_id, part, place, ref, label, n, CAST(x.day AS VARCHAR) AS day FROM (
    SELECT s.workspace_id, 'summary' AS part, row_number() OVER (PARTITION BY s.workspace_id ORDER BY s.day DESC, e.name, s.subject_id) AS place, s.subject_id AS ref, e.name AS label, s.turn_count AS n, s.day
    FROM summary s JOIN entity e ON e.id = s.subject_id WHERE e.parent_id IS NULL AND s.day >= DATE '2026-05-06' QUALIFY place <= 10
    UNION ALL SELECT workspace_id, 'on_this_day', row_number() OVER (PARTITION BY workspace_id ORDER BY CAST(created_at AS DATE) DESC, id) AS place, id, substr(coalesce(summary, ''), 1, 300), date_diff('day', CAST(created_at AS DATE), DATE '2026-05-13'), CAST(created_at AS DATE)
    FROM episode WHERE {VISIBLE_SQL} AND month(created_at) = 5 AND day(created_at) = 13 AND CAST(created_at AS DATE) < DATE '2026-05-13' QUALIFY place <= 5
    UNION ALL SELECT a.workspace_id, 'top', row_number() OVER (PARTITION BY a.workspace_id ORDER BY count(*) DESC, coalesce(any_value(degree), 0) DESC, subject) AS place, min(hint_id), concat_ws(' / ', subject, CAST(coalesce(any_value(degree), 0) AS VARCHAR)), count(*), NULL
    FROM active a LEFT JOIN live_degree d ON d.workspace_id = a.workspace_id AND d.name = subject WHERE superseded_at IS NULL GROUP BY a.workspace_id, subject QUALIFY place <= 10) x""")
_SIGNALS = f"""
    , es AS (SELECT workspace_id, count(*) AS n, count(*) FILTER (CAST(created_at AS DATE) = DATE '2026-05-13') AS t, count(*) FILTER (CAST(created_at AS DATE) = DATE '2026-05-12') AS y,
                    count(*) FILTER (CAST(created_at AS DATE) >= DATE '2026-05-07') AS w, max(created_at) AS l FROM episode WHERE {VISIBLE_SQL} AND created_at <= TIMESTAMP '2026-05-13 18:00:00' GROUP BY 1),
    ts AS (SELECT workspace_id, count(*) FILTER (turn.day = DATE '2026-05-13') AS t, count(*) FILTER (turn.day >= DATE '2026-05-07') AS w, max(said_at) AS l FROM turn WHERE said_at <= TIMESTAMP '2026-05-13 18:00:00' GROUP BY 1),
    both_s AS (SELECT w.id AS workspace_id, coalesce(es.n, 0) AS n, coalesce(es.t, 0) AS et, coalesce(es.y, 0) AS ey, coalesce(es.w, 0) AS ew, coalesce(ts.t, 0) AS tt, coalesce(ts.w, 0) AS tw, greatest(es.l, ts.l) AS last_at
               FROM workspaces w LEFT JOIN es ON es.workspace_id = w.id LEFT JOIN ts ON ts.workspace_id = w.id),
    signals AS (SELECT workspace_id, et AS episodes_today, ey AS episodes_yesterday, ew AS episodes_week, tt AS turns_today, tw AS turns_week, last_at,
           CASE WHEN et >= 3 OR tt >= 20 THEN 'HOT' WHEN last_at >= TIMESTAMP '2026-05-11 18:00:00' THEN 'ACTIVE' WHEN last_at >= TIMESTAMP '2026-05-06 18:00:00' THEN 'QUIET' ELSE 'DORMANT' END AS tag,
           concat_ws(' · ', n || ' ep', CASE WHEN et > 0 THEN '오늘 ' || et || '건' WHEN ey > 0 THEN '어제 ' || ey || '건' WHEN ew > 0 THEN '7d ' || ew || '건' END) AS line FROM both_s)
"""
_read("activity_signals", reads.activity_signals, _SIGNALS + "SELECT * FROM signals")
_read("recent_threads", reads.recent_threads, """
    SELECT workspace_id, subject_id, CAST(sum(CASE WHEN day >= DATE '2026-04-30' THEN turn_count ELSE 0 END) AS BIGINT) AS recent, CAST(sum(turn_count) AS BIGINT) AS total,
           row_number() OVER (PARTITION BY workspace_id ORDER BY sum(CASE WHEN day >= DATE '2026-04-30' THEN turn_count ELSE 0 END) DESC, sum(turn_count) DESC, subject_id) AS place
    FROM daily WHERE day <= DATE '2026-05-13' GROUP BY 1, 2 QUALIFY recent > 0 OR place <= 3""")
_PENDING = ", pend AS (SELECT * FROM daily WHERE (workspace_id, subject_id, day) NOT IN (SELECT (workspace_id, subject_id, day) FROM summary))\n"
_DUE = "얼마 안|deadline|이번주|내일|urgent|마감|EOD|this week|오늘까지|금일까지|tomorrow"
_CANDIDATES = _SIGNALS + f"""
    , act AS (SELECT *, concat_ws(' ', subject, predicate, object_value) AS what, lower(concat_ws(' ', object_value, subject)) AS blob, (epoch(TIMESTAMP '2026-05-13 18:00:00') - floor(epoch(valid_from))) / 86400.0 AS age FROM active WHERE superseded_at IS NULL),
    opened AS (SELECT workspace_id, 'predicate' AS kind, what, CAST(100 + CASE WHEN predicate = 'open_question' THEN 25 WHEN predicate = 'next_step' THEN 20 WHEN predicate IN ('pending', 'todo', 'goal') THEN 10 ELSE 0 END
                    + coalesce(CASE WHEN age < 1 THEN 15 WHEN age < 7 THEN 5 WHEN age > 30 THEN -10 ELSE 0 END, 0) AS INTEGER) AS score, hint_id AS ref, valid_from AS "at"
               FROM act WHERE predicate IN ({_OPEN}) QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY valid_from DESC NULLS LAST, hint_id) <= 20),
    due AS (SELECT workspace_id, 'deadline' AS kind, what, CAST(90 + CASE WHEN regexp_matches(blob, '오늘|today|eod') THEN 20 WHEN regexp_matches(blob, '내일|tomorrow') THEN 15 WHEN regexp_matches(blob, '이번주|this week') THEN 10 ELSE 0 END AS INTEGER) AS score, hint_id AS ref, valid_from AS "at"
            FROM act WHERE regexp_matches(coalesce(object_value, ''), '{_DUE}') OR regexp_matches(coalesce(subject, ''), '{_DUE}') QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY valid_from DESC NULLS LAST, hint_id) <= 20),
    busy AS (SELECT workspace_id FROM signals WHERE episodes_week > 0 ORDER BY episodes_week DESC, workspace_id LIMIT 1),
    fall AS (SELECT e.workspace_id, e.name, e.id, sum(d.turn_count) AS turns FROM daily d JOIN entity e ON e.id = d.subject_id WHERE e.parent_id IS NULL AND e.entity_type = 'concept' AND e.workspace_id IN (SELECT workspace_id FROM busy)
             AND d.day BETWEEN DATE '2026-05-07' AND DATE '2026-05-13' AND e.id NOT IN (SELECT subject_id FROM summary WHERE summary.day = DATE '2026-05-13') GROUP BY ALL ORDER BY turns DESC, e.id LIMIT 3),
    cand AS (SELECT * FROM opened UNION ALL SELECT * FROM due
    UNION ALL SELECT workspace_id, 'dormant_active', CAST(episodes_week AS VARCHAR), 60, workspace_id, NULL FROM signals WHERE episodes_yesterday = 0 AND episodes_today = 0 AND episodes_week >= 7
    UNION ALL SELECT workspace_id, 'fallback_top', name, 40, id, NULL FROM fall
    UNION ALL SELECT workspace_id, 'summary_missing', CAST(episodes_week AS VARCHAR), 30, workspace_id, NULL FROM signals WHERE episodes_week >= 5 AND workspace_id NOT IN (SELECT workspace_id FROM summary WHERE summary.day >= DATE '2026-04-30'))
"""
_read("reco_candidates", reads.reco_candidates, _CANDIDATES + "SELECT * FROM cand")
_read("reco_top3", reads.reco_top3, _CANDIDATES + """
    SELECT workspace_id, kind, what, score, ref FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY score DESC, "at" DESC NULLS LAST, kind, ref) AS nth FROM cand)
    ORDER BY nth > 2, score DESC, "at" DESC NULLS LAST, kind, ref, workspace_id LIMIT 3""")
_read("pending_reflects", reads.pending_reflects, _PENDING + "SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM pend")
_read("summaries_range", reads.summaries_range, """
    SELECT workspace_id, subject_id, name, CAST(summary.day AS VARCHAR) AS day, turn_count FROM summary JOIN entity ON entity.id = subject_id WHERE summary.day BETWEEN DATE '2026-01-01' AND DATE '2026-03-31'""".replace("workspace_id, subject_id", "summary.workspace_id, subject_id"))
_read("data_quality", reads.data_quality, """
    SELECT w.id AS workspace_id, count(s.subject_id) AS summaries FROM workspaces w
    LEFT JOIN summary s ON s.workspace_id = w.id AND s.day BETWEEN DATE '2026-04-30' AND DATE '2026-05-13' GROUP BY w.id""")
_ROOTS = ", root AS (SELECT workspace_id, count(*) AS roots FROM entity WHERE parent_id IS NULL AND id IN (SELECT subject_id FROM link) GROUP BY 1)\n"
_read("linked_roots", reads.linked_roots, _ROOTS + "SELECT * FROM root")
_read("upload_status", reads.upload_status, _ROOTS + """
    , n AS (SELECT episode_id, count(*) AS c FROM turn WHERE episode_id IS NOT NULL GROUP BY 1)
    SELECT e.workspace_id, CAST(coalesce(sum(c), 0) AS BIGINT) AS turns, count(DISTINCT session_id) AS sessions, min(created_at) AS first_at, max(created_at) AS last_at, coalesce(any_value(roots), 0) AS roots
    FROM episode e LEFT JOIN n ON id = episode_id LEFT JOIN root r ON r.workspace_id = e.workspace_id GROUP BY e.workspace_id""")
_read("unclassified", reads.unclassified, """
    SELECT episode_id, count(*) AS turns FROM turn WHERE episode_id IS NOT NULL AND episode_id NOT IN (SELECT episode_id FROM link) GROUP BY 1""")
_read("link_histogram", reads.link_histogram, "SELECT turns, count(*) AS subjects FROM (SELECT subject_id, count(DISTINCT turn_id) AS turns FROM link GROUP BY 1) GROUP BY 1")
_read("multi_subject_episodes", reads.multi_subject_episodes, """
    SELECT episode_id, count(*) AS n, string_agg(CAST(subject_id AS VARCHAR), ',' ORDER BY subject_id) AS subjects
    FROM (SELECT DISTINCT episode_id, subject_id FROM link) GROUP BY 1 HAVING count(*) >= 3""")
_read("cardinalities", reads.cardinalities, "\nUNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS n_rows FROM {source}"
    for name, source in (("workspaces", "workspaces"), ("episodes", "episode"), ("turns", "turn"), ("entities", "entity"), ("facts", "fact"), ("relations", "relation"), ("links", "link"))))
_read("community_count", reads.community_count, "SELECT workspace_id, count(DISTINCT community_id) AS communities, count(*) AS entities FROM entity GROUP BY 1")
_read("keyword_union", reads.keyword_union, f"""
    SELECT DISTINCT workspace_id, unnest(CAST(json_extract(metadata, '$.keywords') AS VARCHAR[])) AS keyword FROM episode WHERE json_valid(metadata) AND {VISIBLE_SQL}""")
_read("largest_episode", reads.largest_episode, """
    SELECT session_id, episode_id, turns FROM (SELECT episode_id, count(*) AS turns FROM turn WHERE episode_id IS NOT NULL GROUP BY 1) n JOIN episode e ON e.id = n.episode_id
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turns DESC, episode_id) = 1""")
# --- ingest ----------------------------------------------------------------------------------------------------------
_read("turn_dedupe", lambda m: ingest.dedupe_turns(m.turns).select("id", "episode_id", "sequence"), """
    SELECT id, episode_id, sequence FROM turn QUALIFY row_number() OVER (PARTITION BY episode_id, role, text ORDER BY sequence NULLS FIRST, id) = 1""")
_read("dropped_duplicates", lambda m: ingest.dropped_duplicates(m.turns), """
    SELECT episode_id, count(*) AS kept, CAST(sum(n - 1) AS BIGINT) AS dropped FROM (SELECT episode_id, role, text, count(*) AS n FROM turn GROUP BY ALL) GROUP BY 1""")
_read("content_dedupe", lambda m: ingest.content_dedupe(m.episodes).select("id", "workspace_id", F.sha2("content", 256).alias("hash")), """
    SELECT id, workspace_id, sha256(content) AS hash FROM episode QUALIFY row_number() OVER (PARTITION BY workspace_id, sha256(content) ORDER BY created_at, id) = 1""")
_read("ledger_decision", lambda m: ingest.ledger(m.episodes), """
    SELECT id, workspace_id, session_id, CASE WHEN row_number() OVER (PARTITION BY workspace_id, content_hash ORDER BY created_at, id) > 1 THEN 'duplicate'
           WHEN row_number() OVER (PARTITION BY workspace_id, session_id ORDER BY created_at, id) > 1 THEN 'append_v2' ELSE 'new' END AS decision FROM episode""")
_read("upsert_latest", lambda m: ingest.upsert_latest(
    m.summaries, m.daily.filter(F.dayofmonth("day") >= 15).withColumn("turn_count", F.col("turn_count") + 1), ["workspace_id", "subject_id", "day"]), """
    SELECT workspace_id, subject_id, CAST(daily.day AS VARCHAR) AS day, turn_count + CAST(day(daily.day) >= 15 AS INTEGER) AS turn_count FROM daily WHERE day(daily.day) % 2 = 0 OR day(daily.day) >= 15""")
_read("insert_absent", lambda m: ingest.insert_absent(m.summaries.select("subject_id", "day"), m.daily.select("subject_id", "day"), ["subject_id", "day"])[0], """
    SELECT DISTINCT subject_id, CAST(daily.day AS VARCHAR) AS day FROM daily WHERE (subject_id, daily.day) NOT IN (SELECT (subject_id, day) FROM summary)""")
_read("merged_keywords", lambda m: m.entities.select("id", F.array_join(ingest.merged_keywords(F.col("aliases"), F.array("name_normalized")), "|").alias("names")), """
    SELECT id, array_to_string(list_distinct_ordered, '|') AS names FROM (SELECT id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered
    FROM (SELECT id, list_concat(coalesce(aliases, []), [name_normalized]) AS l FROM entity))""")
_read("resolve_entities", lambda m: ingest.resolve_entities(
    load(m.spark, m.folder, "entity_hints", ["workspace_id", "name"]).filter("name is not null"), m.entities,
    m.entities.select("workspace_id", F.col("id").alias("entity_id"), F.explode("aliases").alias("alias"))), """
    , exact AS (SELECT workspace_id, name_normalized AS key, min(id) AS by_name FROM entity GROUP BY ALL),
    alias AS (SELECT workspace_id, lower(a) AS key, min(id) AS by_alias FROM (SELECT workspace_id, id, unnest(aliases) AS a FROM entity) GROUP BY ALL)
    SELECT h.workspace_id, h.name, coalesce(by_name, by_alias) AS entity_id, CASE WHEN by_name IS NOT NULL THEN 'name' WHEN by_alias IS NOT NULL THEN 'alias' ELSE 'new' END AS how
    FROM (SELECT DISTINCT workspace_id, name FROM entity_hints WHERE name IS NOT NULL) h
    LEFT JOIN exact ON h.workspace_id = exact.workspace_id AND lower(trim(h.name)) = exact.key LEFT JOIN alias ON h.workspace_id = alias.workspace_id AND lower(trim(h.name)) = alias.key""")
_read("chunking", lambda m: ingest.chunks(m.turns.filter("episode_id is not null")), """
    SELECT episode_id, chunk, count(*) AS turns, min(sequence) AS first_sequence, max(sequence) AS last_sequence
    FROM (SELECT *, (row_number() OVER (PARTITION BY episode_id ORDER BY sequence, id) - 1) // 30 AS chunk FROM turn WHERE episode_id IS NOT NULL) GROUP BY 1, 2""")
_PAIRS = """
    , islands AS (SELECT *, sum(CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY sequence, id ROWS UNBOUNDED PRECEDING) AS pair
                FROM turn WHERE episode_id IS NOT NULL),
    pairs AS (SELECT episode_id, CAST(pair AS BIGINT) AS pair, min(sequence) AS first_sequence,
           CAST(sum(CASE WHEN lower(trim(role)) IN ('assistant', 'ai', 'model') THEN 1 WHEN role IS NULL THEN NULL ELSE 0 END) AS BIGINT) AS answers, CAST(sum(length(text)) AS BIGINT) AS chars
    FROM islands WHERE pair > 0 GROUP BY episode_id, pair)"""
_read("pair_islands", lambda m: ingest.message_pairs(m.turns.filter("episode_id is not null")), _PAIRS + "SELECT * FROM pairs")
_read("lookback", lambda m: ingest.lookback(ingest.message_pairs(m.turns.filter("episode_id is not null"))), _PAIRS + """
    SELECT *, coalesce(string_agg(CAST(first_sequence AS VARCHAR), '|') OVER (PARTITION BY episode_id ORDER BY pair ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS context FROM pairs""")
_read("stratified_sample", lambda m: ingest.stratified_sample(m.episodes.select("id", "workspace_id"), "workspace_id", "id", 2), """
    SELECT id, workspace_id, row_number() OVER (PARTITION BY workspace_id ORDER BY md5(CAST(id AS VARCHAR)), id) AS nth FROM episode QUALIFY nth <= 2""")
_read("sample_head_middle_tail", lambda m: ingest.head_middle_tail(m.turns.filter("episode_id is not null")).select("id", "episode_id", "part"), """
    SELECT id, episode_id, CASE WHEN nth <= 3 THEN 'head' WHEN nth > size - 3 THEN 'tail' WHEN nth > floor((size - 3) / 2.0) AND nth <= floor((size - 3) / 2.0) + 3 THEN 'middle' END AS part
    FROM (SELECT id, episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY sequence, id) AS nth, count(*) OVER (PARTITION BY episode_id) AS size FROM turn WHERE episode_id IS NOT NULL)
    WHERE part IS NOT NULL""")
# --- text ------------------------------------------------------------------------------------------------------------
_read("token_estimate", lambda m: m.turns.select("id", X.token_estimate(F.col("text")).alias("tokens")), """
    SELECT id, CAST(length(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '', 'g')) // 4
                 + (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '', 'g'))) // 2 AS BIGINT) AS tokens FROM turn""")
_read("quality_gate", lambda m: m.episodes.select("id", X.low_quality_summary(F.col("summary")).alias("low_quality")), """
    SELECT id, length(s) < 50 OR regexp_full_match(s, '[0-9]+') OR regexp_full_match(s, 'jsonl-agent-[0-9a-f]+') AS low_quality
    FROM (SELECT id, regexp_replace(coalesce(summary, ''), '^\\s+|\\s+$', '', 'g') AS s FROM episode)""")
_DECISION = r"because|since|the reason|the issue is|the problem is|the bug is|the fix is|the root cause|turns out|it turns out|this is why|instead of|rather than|we should|we need to|the correct|actually,?|in fact,?|specifically,?"
_DISCOVERY = r"found|discovered|noticed|realized|identified|confirmed|turned out|the test (failed|passed) because|this file|this function|contains|defines|implements|references|depends on|uses"
_CORRECTION = r"doesn[''’]t|does not|won[''’]t|will not|can[''’]t|cannot|didn[''’]t|failed|broken|incorrect|wrong|missing|instead|however|but\s+actually|on second thought"
_read("signal_boost", lambda m: m.turns.filter("text is not null").select("id", X.signal_boost(F.col("text")).alias("boost")), rf"""
    SELECT id, CAST(regexp_matches(text, '(?i)\b({_DECISION})\b') AS INTEGER) + CAST(regexp_matches(text, '(?i)\b({_DISCOVERY})\b') AS INTEGER) + CAST(regexp_matches(text, '(?i)\b({_CORRECTION})\b') AS INTEGER) AS boost FROM turn WHERE text IS NOT NULL""")
_KIND = """CASE WHEN regexp_matches(lower(predicate), 'prefer|선호|like|dislike|좋아|싫어|sentiment') THEN 'preference' WHEN regexp_matches(lower(predicate), 'decide|chose|결정|선택|switch|change') THEN 'decision'
    WHEN regexp_matches(lower(predicate), 'error|bug|fail|에러|버그|실패') THEN 'error' WHEN regexp_matches(lower(predicate), 'step|process|how_to|방법|절차|procedure') THEN 'procedure'
    WHEN regexp_matches(lower(predicate), 'relates|depends|uses|관계|의존|사용') THEN 'relation' ELSE 'fact' END"""
_read("fragment_types", lambda m: m.facts.select(
    "hint_id", X.fragment_type(F.col("predicate")).alias("kind"), X.relation_type(F.col("predicate")).alias("relation_type"), X.fragment_content(F.col("source_quote"), F.col("subject"), F.col("predicate"), F.col("object_value")).alias("content")), f"""
    SELECT hint_id, {_KIND} AS kind, CASE WHEN predicate IN ('supports', 'contradicts', 'depends_on', 'part_of', 'related_to') THEN predicate ELSE 'related_to' END AS relation_type,
    CASE WHEN length(b) > 500 THEN substr(b, 1, 497) || '...' ELSE b END AS content
    FROM (SELECT *, CASE WHEN length(q) >= 10 THEN q ELSE concat_ws(' ', subject, predicate, object_value) END AS b FROM (SELECT *, regexp_replace(source_quote, '^\\s+|\\s+$', '', 'g') AS q FROM fact))""")
_read("snippets", lambda m: m.episodes.filter(F.locate("schema", F.lower("content")) > 0).select("id", X.snippet(F.col("content"), "schema").alias("snippet")), """
    SELECT id, CASE WHEN s > 1 THEN '...' ELSE '' END || substr(content, s, 400) || CASE WHEN length(content) > s + 399 THEN '...' ELSE '' END AS snippet
    FROM (SELECT id, content, greatest(strpos(lower(content), 'schema') - 100, 1) AS s FROM episode WHERE strpos(lower(content), 'schema') > 0)""")
_SCORE = " + ".join(f"(length(lower(B)) - length(replace(lower(B), '{t}', ''))) // {len(t)}" for t in TERMS)
_read("term_scores", lambda m: ranking.text_search(m.episodes, ["content", "summary"], "id", TERMS, 50), f"""
    SELECT id, CASE WHEN s > c OR (s = c AND s > 0) THEN 'summary' ELSE 'content' END AS field, greatest(c, s) AS score
    FROM (SELECT id, CAST({_SCORE.replace("B", "coalesce(content, '')")} AS BIGINT) AS c, CAST({_SCORE.replace("B", "coalesce(summary, '')")} AS BIGINT) AS s FROM episode)
    WHERE greatest(c, s) > 0 ORDER BY score DESC, id LIMIT 50""")
_PARAGRAPH = " + ".join(f"((length(lower(body)) - length(replace(lower(body), '{t}', ''))) // {len(t)}) * {max(1.0, len(t) / 3)!r}" for t in TERMS)
_read("excerpt_scores", lambda m: ranking.excerpt_paragraphs(m.episodes.filter("content is not null"), "id", "content", TERMS).select("id", "paragraph", F.round("score", 6).alias("score")), f"""
    SELECT id, paragraph, round({_PARAGRAPH}, 6) AS score FROM (SELECT id, CAST(i - 1 AS INTEGER) AS paragraph, parts[i] AS body
    FROM (SELECT id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT id, regexp_split_to_array(content, '\\n\\s*\\n') AS parts FROM episode WHERE content IS NOT NULL)))
    WHERE {_PARAGRAPH} > 0""")
_read("excerpts", lambda m: ranking.excerpts(m.episodes.filter("content is not null"), "id", "content", TERMS))
_TAGS = "ide_opened_file|ide_selection|local-command-caveat|local-command-stdout|command-name|command-message|command-args|system-reminder"
_TOOL_LINE = r"^\s*(\[tool_use:|\[TOOL_USE|\[tool_result\]|\[TOOL_RESULT\]|\[결과\]|\[Read\]|\[Bash\]|\[Write\]|\[Edit\]|\[Grep\]|\[Glob\]|\[TodoWrite\]|\[WebFetch\]|\[WebSearch\]|\d+→|\d+\s{2,}\S.*$|\d+\s*\|.*$|\d+\s*$)"
_NOISE = r"(Unknown skill:.*|Todos have been modified successfully\. Ensure that you continue to use the todo list.*|\[?결과\]?\s*Command running in background with ID:.*|In plan mode, you should:.*?ExitPlanMode.*?approval\.\s*|Your plan has been saved to:\s*\S+\s*)"
# RE2 has no look-ahead and no back-reference: each tag is taken out in turn, and notifications hold no other ones here.
_BARE = "regexp_replace(regexp_replace(text, '(?s)<task-notification>.*?<result>(.*?)</result>.*?</task-notification>\\s*', '\\1' || chr(10), 'g'), '(?s)<task-notification>.*?</task-notification>\\s*', '', 'g')"
for _tag in _TAGS.split("|"):
    _BARE = f"regexp_replace({_BARE}, '(?s)<{_tag}>.*?</{_tag}>\\s*', '', 'g')"
_SANITIZED = rf"""
    , bare AS (SELECT id, text, {_BARE} AS b FROM turn WHERE text IS NOT NULL),
    cut AS (SELECT *, regexp_split_to_array(b, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l0 FROM bare),
    lined AS (SELECT *, CASE WHEN l0[-1] = '' THEN l0[:-2] ELSE l0 END AS l FROM cut),
    told AS (SELECT *, array_to_string(list_filter(l, lambda x: NOT regexp_matches(x, '{_TOOL_LINE}')), chr(10)) AS k, len(list_filter(l, lambda x: regexp_matches(x, '{_TOOL_LINE}'))) AS r, regexp_full_match(trim(b, E' \t\n\r'), '(?s){_NOISE}') AS noise FROM lined),
    sanitized AS (SELECT id, CASE WHEN noise THEN '' WHEN text LIKE '%' || chr(10) AND k <> '' AND NOT k LIKE '%' || chr(10) THEN k || chr(10) ELSE k END AS cleaned, CASE WHEN noise THEN 1 ELSE r END AS removed FROM told)
"""
_read("sanitize", lambda m: m.turns.filter("text is not null").select("id", X.sanitized(F.col("text")).alias("s")).select("id", "s.cleaned", F.size("s.removed").cast("long").alias("removed")), _SANITIZED + "SELECT * FROM sanitized")
_read("displayable_turns", reads.displayable_turns, _SANITIZED + """
    SELECT t.id, t.workspace_id, coalesce(nullif(trim(cleaned, ' '), ''), t.text) AS text FROM turn t LEFT JOIN sanitized s ON s.id = t.id WHERE nullif(trim(cleaned, ' '), '') IS NOT NULL OR coalesce(removed, 0) = 0""")
_HALVES = "CASE kind WHEN 'preference' THEN 120.0 WHEN 'decision' THEN 90.0 WHEN 'procedure' THEN 30.0 ELSE 60.0 END"
_read("decay_rescore", lambda m: m.facts.filter("valid_from is not null").select(
    "hint_id", F.round(X.decay(F.datediff(F.lit(reads.TODAY), F.to_date("valid_from")).cast("double"), X.fragment_type(F.col("predicate"))), 9).alias("weight")), f"""
    SELECT hint_id, round(power(0.5, greatest(date_diff('day', CAST(valid_from AS DATE), DATE '2026-05-13'), 0) / {_HALVES}), 9) AS weight FROM (SELECT hint_id, valid_from, {_KIND} AS kind FROM fact WHERE valid_from IS NOT NULL)""")
_read("minmax_scaled", lambda m: ranking.minmax(m.facts.groupBy("workspace_id", "subject").agg(F.count(F.lit(1)).cast("double").alias("facts")), "facts", "workspace_id", "subject").select(
    "workspace_id", "subject", F.round("scaled", 9).alias("scaled")), """
    , c AS (SELECT workspace_id, subject, CAST(count(*) AS DOUBLE) AS facts FROM fact GROUP BY 1, 2)
    SELECT workspace_id, subject, round(CASE WHEN max(facts) OVER w - min(facts) OVER w < 1e-9 THEN 1.0 - (row_number() OVER (PARTITION BY workspace_id ORDER BY facts DESC, subject) - 1) / CAST(count(*) OVER w AS DOUBLE)
           ELSE (facts - min(facts) OVER w) / (max(facts) OVER w - min(facts) OVER w) END, 9) AS scaled FROM c WINDOW w AS (PARTITION BY workspace_id)""")


# --- vectors and fusion ----------------------------------------------------------------------------------------------
def _query_vector(spark: SparkSession, folder: str) -> list[float]:
    """The vector with the smallest id: one row that stands for a query's embedding."""
    return load(spark, folder, "embeddings").orderBy("vec_id").first().embedding


_SIMILAR = """(WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1)
    SELECT vec_id AS id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))
           * list_dot_product(CAST(q.v AS DOUBLE[]), CAST(q.v AS DOUBLE[]))), 6) AS similarity FROM embeddings, q)"""
QUERIES["cosine_topk"] = lambda spark, folder: ranking.nearest_to(load(spark, folder, "embeddings"), _query_vector(spark, folder), "embedding", "vec_id", 20)
ORACLES["cosine_topk"] = f"SELECT * FROM {_SIMILAR} ORDER BY similarity DESC, id LIMIT 20"


def _rrf(spark: SparkSession, folder: str) -> DataFrame:
    """Fusion of three ranked lists over episodes: terms in content, terms in summary, turns linked."""
    from pyspark.sql import Window

    m = Model(spark, folder)
    place = lambda df: df.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("id", "place")
    by_text = place(ranking.text_search(m.episodes, ["content"], "id", TERMS, 90))
    by_summary = place(ranking.text_search(m.episodes, ["summary"], "id", TERMS, 90))
    linked = m.links.groupBy(F.col("episode_id").alias("id")).agg(F.count(F.lit(1)).alias("score")).orderBy(F.desc("score"), "id").limit(90)
    lists = {"content": by_text, "summary": by_summary, "graph": place(linked)}
    return ranking.fused(lists, weights={"content": 0.5, "summary": 1.0, "graph": 1.0}).select("id", F.round("rrf_score", 9).alias("rrf_score"))


QUERIES["rrf_fusion"] = _rrf
ORACLES["rrf_fusion"] = MODEL_SQL + f"""
    , a AS (SELECT id, CAST({_SCORE.replace("B", "coalesce(content, '')")} AS BIGINT) AS score FROM episode),
    b AS (SELECT id, CAST({_SCORE.replace("B", "coalesce(summary, '')")} AS BIGINT) AS score FROM episode),
    c AS (SELECT episode_id AS id, count(*) AS score FROM link GROUP BY 1),
    ranked AS (SELECT id, 0.5 AS w, row_number() OVER (ORDER BY score DESC, id) AS place FROM a WHERE score > 0
        UNION ALL SELECT id, 1.0, row_number() OVER (ORDER BY score DESC, id) FROM b WHERE score > 0
        UNION ALL SELECT id, 1.0, row_number() OVER (ORDER BY score DESC, id) FROM c)
    SELECT id, round(sum(CAST(w AS DOUBLE) / (60 + place)), 9) AS rrf_score FROM ranked WHERE place <= 90 GROUP BY id"""


def _mmr(spark: SparkSession, folder: str) -> DataFrame:
    """Diverse selections among the vectors, one for each label's pool of the most relevant."""
    from pyspark.sql import Window

    query = F.array(*[F.lit(float(x)) for x in _query_vector(spark, folder)])
    scored = load(spark, folder, "embeddings").select(
        F.col("label").alias("pool"), F.col("vec_id").alias("id"), ranking.cosine(F.col("embedding"), query).alias("relevance"), F.col("embedding").alias("vector"), (F.col("vec_id") % 7).cast("int").alias("community")
    )
    best = Window.partitionBy("pool").orderBy(F.desc("relevance"), "id")
    pools = scored.withColumn("n", F.row_number().over(best)).filter("n <= 100").drop("n")
    return ranking.diverse(pools, "pool")


QUERIES["mmr_select"] = _mmr
# --- gaps ------------------------------------------------------------------------------------------------------------
_read("gap_candidates", lambda m: gaps.candidates(m))
_read("gap_coverage", lambda m: gaps.coverage(m))

# --- further reads ---------------------------------------------------------------------------------------------------
_read("ledger_page", reads.ledger_page, """
    SELECT id, workspace_id, CASE WHEN row_number() OVER (PARTITION BY workspace_id, content_hash ORDER BY created_at, id) > 1 THEN 'duplicate'
           WHEN row_number() OVER (PARTITION BY workspace_id, session_id ORDER BY created_at, id) > 1 THEN 'append_v2' ELSE 'new' END AS decision, created_at
    FROM episode ORDER BY created_at DESC, id DESC LIMIT 50""")
_read("session_briefing", reads.session_briefing, f"""
    , act AS (SELECT * FROM active WHERE superseded_at IS NULL),
    pin AS (SELECT workspace_id, predicate, object_value FROM act WHERE predicate IN ('uses_db', 'located_in') QUALIFY row_number() OVER (PARTITION BY workspace_id, predicate ORDER BY valid_from DESC NULLS LAST, hint_id) = 1),
    shown AS (SELECT * FROM episode WHERE {VISIBLE_SQL}),
    named AS MATERIALIZED (SELECT s.*, e.name FROM summary s JOIN entity e ON e.id = s.subject_id),
    tc AS (SELECT e.workspace_id, e.name, e.id, count(*) AS n FROM link l JOIN entity e ON e.id = l.subject_id WHERE e.parent_id IS NULL GROUP BY ALL)
    SELECT workspace_id, 'pinned' AS part, row_number() OVER (PARTITION BY workspace_id ORDER BY predicate) AS place, concat_ws(': ', predicate, object_value) AS what FROM pin
    UNION ALL SELECT * FROM (SELECT workspace_id, 'recent_fact', row_number() OVER (PARTITION BY workspace_id ORDER BY valid_from DESC NULLS LAST, hint_id) AS place, concat_ws(' ', subject, predicate, object_value) FROM act QUALIFY place <= 10)
    UNION ALL SELECT * FROM (SELECT workspace_id, 'yesterday_episode', row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, id DESC) AS place, concat_ws(' ', CAST(id AS VARCHAR), substr(coalesce(summary, ''), 1, 200)) FROM shown WHERE CAST(created_at AS DATE) = DATE '2026-05-12' QUALIFY place <= 3)
    UNION ALL SELECT * FROM (SELECT workspace_id, 'yesterday_subject', row_number() OVER (PARTITION BY workspace_id ORDER BY turn_count DESC, subject_id) AS place, name FROM named n WHERE n.day = DATE '2026-05-12' QUALIFY place <= 5)
    UNION ALL SELECT w.id, 'today', 1, 'episodes=' || (SELECT count(*) FROM shown s WHERE s.workspace_id = w.id AND CAST(s.created_at AS DATE) = DATE '2026-05-13') || ' turns=' || (SELECT count(*) FROM turn t WHERE t.workspace_id = w.id AND CAST(t.created_at AS DATE) = DATE '2026-05-13') FROM workspaces w
    UNION ALL SELECT workspace_id, 'pending', 1, CAST(count(*) AS VARCHAR) FROM episode WHERE lower(processing_status) <> 'done' GROUP BY 1
    UNION ALL SELECT * FROM (SELECT workspace_id, 'subject', row_number() OVER (PARTITION BY workspace_id ORDER BY n DESC, id) AS place, name || ' ' || n FROM tc QUALIFY place <= 10)
    UNION ALL SELECT * FROM (SELECT workspace_id, 'week', row_number() OVER (PARTITION BY workspace_id ORDER BY n.day DESC, turn_count DESC, subject_id) AS place, concat_ws(' ', CAST(n.day AS VARCHAR), name) FROM named n WHERE n.day >= DATE '2026-05-06' QUALIFY place <= 15)""".replace("named AS MATERIALIZED", "dss AS MATERIALIZED").replace("FROM named n", "FROM dss n"))
_read("subject_inventory", reads.subject_inventory, "SELECT DISTINCT e.session_id, l.subject_id FROM link l JOIN episode e ON e.id = l.episode_id")
_read("latest_values", reads.latest_values, """
    SELECT workspace_id, subject, predicate, object_value, hint_id FROM fact QUALIFY row_number() OVER (PARTITION BY workspace_id, subject, predicate ORDER BY valid_from DESC NULLS LAST, hint_id DESC) = 1""")
_read("deadline_facts", reads.deadline_facts, f"""
    SELECT hint_id, CASE WHEN regexp_matches(b, '(?i)오늘|today|eod') THEN 20 WHEN regexp_matches(b, '(?i)내일|tomorrow') THEN 15 WHEN regexp_matches(b, '(?i)이번주|this week') THEN 10 ELSE 0 END AS bonus
    FROM (SELECT hint_id, concat_ws(' ', object_value, subject, source_quote) AS b FROM fact) WHERE regexp_matches(b, '{_DUE}|Tuesday|last sprint')""")
_read("entity_articles", reads.entity_articles, "SELECT id, workspace_id, false AS has_article FROM entity")
_read("ledger_backfill", reads.ledger_backfill, """
    SELECT e.workspace_id, e.id AS episode_id, coalesce(j->>'$.source_path', '') AS source_path, lower(replace(coalesce(j->>'$.source_path', ''), chr(92), '/')) AS path_normalized, j->>'$.external_session_id' AS external_session_id,
           coalesce(j->>'$.ingested_via', 'legacy') AS ingested_via, e.created_at AS ingested_at, (SELECT count(*) FROM turn t WHERE t.episode_id = e.id) AS turns, 'ingested' AS status, 'new' AS decision
    FROM (SELECT *, CASE WHEN json_valid(metadata) THEN CAST(metadata AS JSON) END AS j FROM episode) e JOIN workspaces w ON w.id = e.workspace_id WHERE w.status = 'active'""")
_STRATA = {"few": "t BETWEEN 3 AND 7 AND s > 0", "some": "t BETWEEN 30 AND 60 AND s > 0", "many": "t > 100 AND s > 0", "mixed": "s >= 4", "none": "s = 0 AND t > 5"}
_read("strata_sample", reads.strata_sample, """
    , sized AS (SELECT e.id, e.workspace_id, (SELECT count(*) FROM turn x WHERE x.episode_id = e.id) AS t, (SELECT count(DISTINCT subject_id) FROM link l WHERE l.episode_id = e.id) AS s FROM episode e)
    """ + "\nUNION ALL ".join(f"SELECT * FROM (SELECT workspace_id, '{k}' AS stratum, id FROM sized WHERE {c} QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY md5(CAST(id AS VARCHAR)), id) = 1)" for k, c in _STRATA.items()))
_read("entity_name_flags", reads.entity_name_flags, r"""
    SELECT id, contains(name, '>') OR contains(name, '+') OR regexp_matches(name, '\d{4}-\d{2}-\d{2}') AS is_label,
           split_part(regexp_replace(lower(name), '[_.-]', ' ', 'g'), ' ', 1) AS family, count(*) OVER (PARTITION BY lower(name)) AS same_name FROM entity WHERE name IS NOT NULL""".replace("\\\\", "\\"))
_read("workspace_pages", reads.workspace_pages, """
    SELECT id, status, (SELECT max(created_at) FROM episode e WHERE e.workspace_id = w.id) AS latest FROM workspaces w ORDER BY status = 'active' DESC, latest DESC NULLS LAST, id LIMIT 20""")
# --- search ----------------------------------------------------------------------------------------------------------
_ANY = " OR ".join(f"contains(lower(coalesce({c}, '')), '{t}')" for t in TERMS for c in ("subject", "predicate", "object_value", "source_quote"))
_FACT_TEXT = "concat_ws(' ', subject, predicate, object_value, source_quote)"
_FACT_SCORE = "CAST(" + _SCORE.replace("B", _FACT_TEXT) + " AS BIGINT)"
_HYBRID = _ANCHORS + _BOTH + _REACHED + f"""
    , near AS (SELECT f.workspace_id, hint_id AS id, min(depth) AS depth FROM fact f JOIN reached r ON name = subject AND r.workspace_id = f.workspace_id GROUP BY ALL),
    worded AS (SELECT workspace_id, hint_id AS id, {_FACT_SCORE} AS score FROM fact),
    ranked AS (SELECT id, 1.0 AS w, row_number() OVER (PARTITION BY workspace_id ORDER BY depth, id) AS place FROM near QUALIFY place <= 100
               UNION ALL SELECT id, 0.5, row_number() OVER (PARTITION BY workspace_id ORDER BY score DESC, id) AS place FROM worded WHERE score > 0 QUALIFY place <= 300),
    hybrid AS (SELECT f.workspace_id, r.id, any_value(f.subject) AS subject, any_value(f.predicate) AS predicate, any_value(f.object_value) AS object_value, round(sum(CAST(w AS DOUBLE) / (60 + place)), 9) AS rrf_score
               FROM ranked r JOIN fact f ON f.hint_id = r.id GROUP BY f.workspace_id, r.id QUALIFY row_number() OVER (PARTITION BY f.workspace_id ORDER BY round(sum(CAST(w AS DOUBLE) / (60 + place)), 9) DESC, r.id) <= 20)
"""
_read("hybrid_search", lambda m: search.hybrid_search(m, _anchors(m), TERMS), _HYBRID + "SELECT * FROM hybrid")
_read("search_evidence", lambda m: search.evidence(m, search.hybrid_search(m, _anchors(m), TERMS)), _HYBRID + """
    SELECT h.id, f.episode_id, (SELECT count(DISTINCT g.episode_id) FROM fact g WHERE g.workspace_id = f.workspace_id AND g.subject = f.subject AND g.predicate = f.predicate AND g.object_value = f.object_value) AS episodes,
           (SELECT count(DISTINCT g.object_value) - 1 FROM fact g WHERE g.workspace_id = f.workspace_id AND g.subject = f.subject AND g.predicate = f.predicate) AS other_values,
           (SELECT count(DISTINCT target) FROM relation r WHERE r.source = f.subject AND r.workspace_id = f.workspace_id) AS related
    FROM hybrid h JOIN fact f ON f.hint_id = h.id""")
_read("search_or_fallback", lambda m: search.search_or_fallback(m, _anchors(m), TERMS), _HYBRID + f"""
    , enough AS (SELECT workspace_id FROM hybrid WHERE workspace_id IN (SELECT workspace_id FROM anchor) GROUP BY 1 HAVING count(*) >= 3),
    raw AS (SELECT workspace_id, hint_id AS id FROM fact WHERE ({_ANY}) AND workspace_id NOT IN (SELECT workspace_id FROM enough) QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY hint_id) <= 20)
    SELECT workspace_id, id, 'search' AS how FROM hybrid UNION ALL SELECT workspace_id, id, 'fallback' FROM raw WHERE id NOT IN (SELECT id FROM hybrid)""")
_read("search_coverage", lambda m: search.coverage(m, search.hybrid_search(m, _anchors(m), TERMS)), _HYBRID + """
    , seen AS (SELECT h.workspace_id, count(DISTINCT community_id) AS n FROM hybrid h JOIN fact_entity x ON x.hint_id = h.id JOIN entity e ON e.id = x.entity_id GROUP BY 1),
    whole AS (SELECT workspace_id, count(DISTINCT community_id) AS n FROM entity WHERE community_id IS NOT NULL GROUP BY 1),
    firsts AS (SELECT workspace_id, subject, min(struct_pack(s := -rrf_score, id := id)) AS spot FROM hybrid GROUP BY 1, 2),
    names AS (SELECT workspace_id, string_agg(subject, ', ' ORDER BY spot) AS t FROM (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY spot, subject) <= 3) GROUP BY 1),
    size AS (SELECT workspace_id, count(*) AS n FROM hybrid GROUP BY 1)
    SELECT size.workspace_id, size.n AS selected, coalesce(seen.n, 0) AS communities, coalesce(whole.n, 0) AS workspace_communities,
           concat_ws(' ', 'Selected ' || size.n || ' facts from at most 100 candidates.', CASE WHEN coalesce(whole.n, 0) > 0 THEN 'Coverage: ' || coalesce(seen.n, 0) || ' of ' || whole.n || ' communities represented.' END, 'Primary entities: ' || t || '.') AS summary
    FROM size LEFT JOIN seen USING (workspace_id) LEFT JOIN whole USING (workspace_id) LEFT JOIN names USING (workspace_id)""")
_read("evidence_chain", lambda m: search.evidence_chain(m, search.hybrid_search(m, _anchors(m), TERMS), TERMS))
_read("search_rescored", lambda m: search.rescored(m, search.hybrid_search(m, _anchors(m), TERMS), reads.TODAY), _HYBRID + f"""
    SELECT workspace_id, id, round(rrf_score * CASE WHEN length(source_quote) >= 10 THEN 0.7 ELSE 0.4 END * power(0.5, greatest(coalesce(date_diff('day', CAST(valid_from AS DATE), DATE '2026-05-13'), 0), 0) / {_HALVES}), 9) AS score
    FROM (SELECT h.workspace_id, h.id, h.rrf_score, f.source_quote, f.valid_from, {_KIND.replace("predicate", "f.predicate")} AS kind FROM hybrid h JOIN fact f ON f.hint_id = h.id)""")
_TOPICS = f"""
    , pool AS (SELECT *, {_FACT_SCORE} AS score FROM fact WHERE {_FACT_SCORE} > 0 QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY score DESC, hint_id) <= 50),
    topic AS (SELECT workspace_id, subject, count(*) AS facts, max(score) AS best, string_agg(DISTINCT predicate, ',' ORDER BY predicate) AS predicates, min(valid_from) AS first_at, max(valid_from) AS last_at,
                     row_number() OVER (PARTITION BY workspace_id ORDER BY max(score) DESC, count(*) DESC, subject) AS place FROM pool GROUP BY workspace_id, subject QUALIFY place <= 15)
"""
_read("topic_map", lambda m: search.topic_map(m, TERMS), _TOPICS + "SELECT * FROM topic")
_read("topic_edges", lambda m: search.topic_edges(m, TERMS), _TOPICS + """
    SELECT workspace_id, source, target, relation_type, count(*) AS weight FROM edge WHERE valid_to IS NULL AND (workspace_id, source) IN (SELECT (workspace_id, subject) FROM topic)
    AND (workspace_id, target) IN (SELECT (workspace_id, subject) FROM topic) GROUP BY ALL""")
_read("fallback_search", lambda m: search.fallback_search(m, TERMS), f"SELECT workspace_id, hint_id, subject, predicate FROM fact WHERE {_ANY} QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY hint_id) <= 50")
_USABLE = "size(vector) = 64 and not exists(vector, x -> x is null or isnan(x)) and exists(vector, x -> x <> 0)"


def _stored_query(m: Model, kind: str = "fact") -> list[float]:
    """A stored vector of a kind, standing for a query's embedding: the usable one with the smallest id."""
    return m.table("memory_vectors", "vector_id").filter((F.col("source_type") == kind) & F.expr(_USABLE)).orderBy("vector_id").first().vector


def _cosines(kind: str) -> str:
    """Usable vectors of a kind with their similarity to that of the smallest id; those of a null or no number are left out."""
    return f"""
    , v AS (SELECT DISTINCT ON (vector_id) * FROM memory_vectors WHERE source_type = '{kind}' AND len(vector) = 64),
    q AS (SELECT CAST(vector AS DOUBLE[]) AS q FROM v WHERE list_bool_and(list_transform(vector, lambda x: x IS NOT NULL AND NOT isnan(x))) AND list_bool_or(list_transform(vector, lambda x: x <> 0)) ORDER BY vector_id LIMIT 1),
    d AS (SELECT v.* EXCLUDE (vector), CAST(vector AS DOUBLE[]) AS x, q FROM v, q WHERE NOT list_contains(list_transform(vector, lambda y: y IS NULL), true)),
    near AS (SELECT *, round(list_dot_product(x, q) / sqrt(list_dot_product(x, x) * list_dot_product(q, q)), 6) AS similarity FROM d WHERE list_dot_product(x, x) <> 0 AND NOT isnan(list_dot_product(x, x)))
"""


_read("passage_search", lambda m: search.passages(m, _stored_query(m), "fact"), _cosines("fact") + "SELECT vector_id, source_id, similarity FROM near ORDER BY similarity DESC, vector_id LIMIT 20")
_SEEDS = _cosines("entity") + """
    , best AS (SELECT near.workspace_id, source_id AS id, max(similarity) AS similarity FROM near GROUP BY ALL),
    seed AS (SELECT b.workspace_id, row_number() OVER (PARTITION BY b.workspace_id ORDER BY similarity DESC, b.id) AS place, name, similarity FROM best b JOIN entity e ON e.id = b.id QUALIFY place <= 3)
"""
_read("entity_seeds", lambda m: search.seeds(m, _stored_query(m, "entity")), _SEEDS + "SELECT * FROM seed")
_ASKED = "What happened to the Thistlepath billing screen, the Harrowfield merge step and the Indigostack message broker 4?"
_read("all_seeds", lambda m: search.all_seeds(m, _ASKED, _stored_query(m, "entity")), _SEEDS + f"""
    , hit AS (SELECT DISTINCT workspace_id, name FROM entity WHERE length(name) >= 2 AND contains(lower('{_ASKED}'), lower(name))),
    lone AS (SELECT * FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit g WHERE g.workspace_id = h.workspace_id AND length(g.name) > length(h.name) AND contains(lower(g.name), lower(h.name)))),
    both_lists AS (SELECT workspace_id, name, 0 AS l, row_number() OVER (PARTITION BY workspace_id ORDER BY length(name) DESC, name) AS p FROM lone UNION ALL SELECT workspace_id, name, 1, place FROM seed)
    SELECT workspace_id, name, row_number() OVER (PARTITION BY workspace_id ORDER BY min(struct_pack(l := l, p := p)), name) AS place FROM both_lists GROUP BY workspace_id, name""")
_read("query_anchors", lambda m: search.anchors(m.entities.select("workspace_id", "name"), _ASKED, ["workspace_id"]), f"""
    , hit AS (SELECT DISTINCT workspace_id, name FROM entity WHERE length(name) >= 2 AND contains(lower('{_ASKED}'), lower(name)))
    SELECT * FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit g WHERE g.workspace_id = h.workspace_id AND length(g.name) > length(h.name) AND contains(lower(g.name), lower(h.name)))""")
_read("hybrid_with_vectors", lambda m: search.hybrid_search(m, _anchors(m), TERMS, _stored_query(m)), _HYBRID.replace("hybrid AS", "unused AS") + _cosines("fact").replace("near AS", "close AS") + """
    , fv AS (SELECT c.workspace_id, source_id AS id, max(similarity) AS score FROM close c GROUP BY ALL),
    three AS (SELECT * FROM ranked UNION ALL SELECT id, 1.0, row_number() OVER (PARTITION BY workspace_id ORDER BY score DESC, id) AS place FROM fv QUALIFY place <= 300)
    SELECT f.workspace_id, r.id, any_value(f.subject) AS subject, any_value(f.predicate) AS predicate, any_value(f.object_value) AS object_value, round(sum(CAST(w AS DOUBLE) / (60 + place)), 9) AS rrf_score
    FROM three r JOIN fact f ON f.hint_id = r.id GROUP BY f.workspace_id, r.id QUALIFY row_number() OVER (PARTITION BY f.workspace_id ORDER BY round(sum(CAST(w AS DOUBLE) / (60 + place)), 9) DESC, r.id) <= 20""")
# --- transcripts and classification ----------------------------------------------------------------------------------
_LABELS = "user|human|assistant|ai|system|tool"
_read("transcript_turns", lambda m: classify.transcript_turns(m.episodes.filter("content is not null"), "id", "content"), rf"""
    , marked AS (SELECT id, regexp_replace(regexp_replace(content, '\r\n?', chr(10), 'g'), '(?im)^(?:#+[ \t]*({_LABELS})[ \t]*$|\[({_LABELS})\][ \t]?|({_LABELS}):[ \t]*)', chr(1) || '\1\2\3' || chr(2), 'g') AS t FROM episode WHERE content IS NOT NULL),
    cut AS (SELECT id, parts, unnest(range(2, len(parts) + 1)) AS i FROM (SELECT id, string_split(t, chr(1)) AS parts FROM marked)),
    part AS (SELECT id, i, split_part(parts[i], chr(2), 1) AS label, split_part(parts[i], chr(2), -1) AS body FROM cut)
    SELECT id, CAST(i - 2 AS INTEGER) AS turn, CASE lower(label) WHEN 'human' THEN 'user' WHEN 'ai' THEN 'assistant' ELSE lower(label) END AS role, regexp_replace(body, '^\s+|\s+$', '', 'g') AS text FROM part""")
_read("transcripts_built", lambda m: classify.transcript(m.turns.filter("episode_id is not null")).select("episode_id", F.sha2("content", 256).alias("content_hash")), """
    SELECT episode_id, sha256(string_agg('[' || lower(trim(role)) || '] ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY sequence, id) FILTER (role IS NOT NULL)) AS content_hash
    FROM turn WHERE episode_id IS NOT NULL GROUP BY 1""")
_TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{c}'" for c, p in classify.TOPIC_RULES) + " ELSE 'Other' END"
_CHAINS = f""", chains AS (SELECT episode_id, {_TOPIC} AS chain FROM (SELECT episode_id, text FROM turn WHERE episode_id IS NOT NULL AND lower(trim(role)) IN ('user', 'human') AND length(trim(text)) > 0
    QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY sequence, id) = 1))\n"""
_read("classified_episodes", lambda m: classify.classified(m.turns), _CHAINS + "SELECT * FROM chains")
_read("chain_links", lambda m: classify.chain_links(classify.classified(m.turns)), _CHAINS + """
    SELECT episode_id, parts[i] AS subject, CASE WHEN i > 1 THEN parts[i - 1] END AS parent, CAST(i - 1 AS INTEGER) AS depth
    FROM (SELECT episode_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT episode_id, string_split(chain, '>') AS parts FROM chains))""")
_read("running_budget", lambda m: classify.running_budget(m.turns.filter("episode_id is not null")).select("id", "episode_id", "used"), """
    SELECT id, episode_id, CAST(sum(coalesce(length(substr(text, 1, 4000)), 0)) OVER (PARTITION BY episode_id ORDER BY sequence, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used
    FROM turn WHERE episode_id IS NOT NULL QUALIFY used <= 800000""")
_read("without_scaffolding", lambda m: m.turns.filter("text is not null").select("id", F.length(classify.without_scaffolding(F.col("text"))).alias("chars")))
_read("daily_hits", lambda m: search.daily_hits(m, m.entities.select("name")), """
    SELECT e.name, CAST(s.day AS VARCHAR) AS day, turn_count, row_number() OVER (PARTITION BY e.name ORDER BY s.day DESC, s.subject_id) AS place
    FROM summary s JOIN entity e ON e.id = s.subject_id QUALIFY place <= 5""")
_read("turn_ids", lambda m: search.turn_ids(m, m.turns.filter("episode_id is not null").select("episode_id", "sequence")), """
    SELECT episode_id, sequence, id AS turn_id FROM turn WHERE episode_id IS NOT NULL""")
_read("vectors_written", lambda m: embed.vectors_of({
    "episode": (m.episodes, "id", "summary"), "fact": (m.facts, "hint_id", "source_quote"), "entity": (m.entities, "id", "name"),
    "fragment": (m.facts.withColumn("fragment", X.fragment_content(F.col("source_quote"), F.col("subject"), F.col("predicate"), F.col("object_value"))), "hint_id", "fragment")}))
_read("conflict_classes", lambda m: m.facts.select("hint_id", X.conflict_class((F.col("hint_id") % 11) / 10.0, (F.col("hint_id") % 13) / 12.0, (F.col("hint_id") % 7) / 6.0).alias("verdict")), """
    SELECT hint_id, CASE WHEN e >= 0.70 THEN CASE WHEN c >= 0.92 THEN 'duplicate' WHEN c >= 0.70 THEN 'refinement' ELSE 'separate' END WHEN k >= 0.85 THEN 'auto_resolve' WHEN k >= 0.70 THEN 'review' ELSE 'separate' END AS verdict
    FROM (SELECT hint_id, (hint_id % 11) / 10.0 AS e, (hint_id % 13) / 12.0 AS k, (hint_id % 7) / 6.0 AS c FROM fact)""")
_read("cross_script_names", lambda m: load(m.spark, m.folder, "entity_hints", ["workspace_id", "name"]).filter("name is not null").distinct().select(
    "workspace_id", "name", X.cross_script(F.col("name"), F.lit("Kim")).alias("crossed"), F.round(X.hybrid_score(F.lit(0.5), F.lit(0.75), X.cross_script(F.col("name"), F.lit("Kim"))), 9).alias("score")), r"""
    SELECT workspace_id, name, h AND NOT l AS crossed, round(CASE WHEN h AND NOT l THEN 0.05 * 0.5 + 0.95 * 0.75 ELSE 0.40 * 0.5 + 0.60 * 0.75 END, 9) AS score
    FROM (SELECT DISTINCT workspace_id, name, regexp_matches(name, '[가-힣ㄱ-ㅣ]') AS h, regexp_matches(name, '[A-Za-z]') AS l FROM entity_hints WHERE name IS NOT NULL)""")
_read("answer_verdicts", lambda m: search.verdicts(m.facts.select(F.col("hint_id").alias("q_id"), F.array("subject", "predicate", "object_value").alias("expect")), m.facts.select(F.col("hint_id").alias("q_id"), F.col("source_quote").alias("answer"))), """
    SELECT hint_id AS q_id, CAST(h AS INTEGER) AS hits, CASE WHEN h >= 2 THEN 'PASS' WHEN h > 0 THEN 'WEAK' ELSE 'FAIL' END AS verdict
    FROM (SELECT hint_id, CAST(contains(a, lower(subject)) AS INT) + CAST(contains(a, lower(predicate)) AS INT) + CAST(contains(a, lower(object_value)) AS INT) AS h FROM (SELECT *, lower(coalesce(source_quote, '')) AS a FROM fact))""")
_read("facts_touched", lambda m: ingest.touched(m.facts.select("hint_id"), m.facts.filter("hint_id % 3 = 0").select("hint_id", F.col("valid_from").alias("read_at"))), """
    SELECT hint_id, CASE WHEN hint_id % 3 = 0 THEN valid_from END AS last_accessed_at FROM fact""")
_read("episodes_patched", lambda m: m.episodes.select("id", ingest.patched(F.col("summary"), F.when(F.col("id") % 3 == 0, F.col("human_summary"))).alias("summary")), """
    SELECT id, CASE WHEN id % 3 <> 0 OR human_summary IS NULL THEN summary WHEN human_summary = '' THEN NULL ELSE human_summary END AS summary FROM episode""")
_read("summaries_kept", lambda m: ingest.upsert_latest(m.summaries.withColumn("label", F.lit("old")), m.daily.filter(F.dayofmonth("day") >= 15).select("workspace_id", "subject_id", "day", (F.col("turn_count") + 1).alias("turn_count"), F.lit("new").alias("label")),
                                                      ["workspace_id", "subject_id", "day"], keep=["turn_count"]), """
    SELECT workspace_id, subject_id, CAST(daily.day AS VARCHAR) AS day, CASE WHEN day(daily.day) % 2 = 0 THEN turn_count ELSE turn_count + 1 END AS turn_count, CASE WHEN day(daily.day) >= 15 THEN 'new' ELSE 'old' END AS label
    FROM daily WHERE day(daily.day) % 2 = 0 OR day(daily.day) >= 15""")
_read("chunk_previews", lambda m: ingest.chunk_previews(m.turns.filter("episode_id is not null")), """
    , numbered AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY sequence, id) AS nth FROM turn WHERE episode_id IS NOT NULL),
    tail AS (SELECT episode_id, (nth - 1) // 30 + 1 AS chunk, string_agg(substr(coalesce(text, ''), 1, 200), chr(10) ORDER BY nth) AS preview FROM numbered WHERE (nth - 1) % 30 >= 27 GROUP BY ALL)
    SELECT c.episode_id, c.chunk, coalesce(t.preview, '') AS preview FROM (SELECT DISTINCT episode_id, (nth - 1) // 30 AS chunk FROM numbered) c LEFT JOIN tail t USING (episode_id, chunk)""")
_read("normalized_paths", lambda m: m.entities.select("id", X.path_stem(F.concat(F.lit("C:\\Work\\"), "name", F.lit(".MD"))).alias("stem")), "SELECT id, lower(name) AS stem FROM entity WHERE name IS NOT NULL AND NOT contains(name, '/') UNION ALL SELECT id, NULL FROM entity WHERE name IS NULL")
_read("name_families", reads.name_families, """
    SELECT e.workspace_id, h.id AS head_id, e.id FROM entity e JOIN entity h ON h.workspace_id = e.workspace_id AND length(h.name) BETWEEN 1 AND length(e.name) - 1 AND starts_with(lower(e.name), lower(h.name))""")
_read("summaries_saved", lambda m: ingest.save_summaries(m.summaries, m.daily.filter(F.dayofmonth("day") >= 15).select("workspace_id", "subject_id", "day", (F.col("turn_count") + 1).alias("turn_count")), F.lit(reads.NOW).cast("timestamp_ntz")), """
    SELECT workspace_id, subject_id, CAST(daily.day AS VARCHAR) AS day, turn_count + CAST(day(daily.day) >= 15 AS INTEGER) AS turn_count, turn_count + CAST(day(daily.day) >= 15 AS INTEGER) AS unique_turn_count,
           CASE WHEN day(daily.day) >= 15 THEN TIMESTAMP '2026-05-13 18:00:00' END AS updated_at FROM daily WHERE day(daily.day) % 2 = 0 OR day(daily.day) >= 15""")
_read("anchors_resolved", lambda m: ingest.resolve_entities(
    m.facts.select("workspace_id", F.col("subject").alias("name")).unionByName(m.entities.select("workspace_id", F.col("id").cast("string").alias("name")).filter("name like '%7'")), m.entities,
    m.entities.select("workspace_id", F.col("id").alias("entity_id"), F.explode("aliases").alias("alias"))), """
    , asked AS (SELECT DISTINCT workspace_id, subject AS name, lower(trim(subject)) AS key FROM fact UNION SELECT workspace_id, CAST(id AS VARCHAR), CAST(id AS VARCHAR) FROM entity WHERE CAST(id AS VARCHAR) LIKE '%7'),
    exact AS (SELECT workspace_id, name_normalized AS key, min(id) AS by_name FROM entity GROUP BY ALL),
    alias AS (SELECT workspace_id, lower(a) AS key, min(id) AS by_alias FROM (SELECT workspace_id, id, unnest(aliases) AS a FROM entity) GROUP BY ALL)
    SELECT q.workspace_id, q.name, coalesce(i.id, by_name, by_alias) AS entity_id, CASE WHEN i.id IS NOT NULL THEN 'id' WHEN by_name IS NOT NULL THEN 'name' WHEN by_alias IS NOT NULL THEN 'alias' ELSE 'new' END AS how
    FROM asked q LEFT JOIN entity i ON i.workspace_id = q.workspace_id AND CAST(i.id AS VARCHAR) = q.key LEFT JOIN exact ON q.workspace_id = exact.workspace_id AND q.key = exact.key
    LEFT JOIN alias ON q.workspace_id = alias.workspace_id AND q.key = alias.key""")
_STOP = "'the', 'a', 'an', 'of', 'in', 'on', 'at', 'to', 'for', 'with', 'and', 'or', 'but', 'is', 'are', 'was', 'were', 'be', 'been', 'has', 'have', 'had', 'do', 'does', 'did', 'will', 'would', 'what', 'which', 'who', 'when', 'where', 'why', 'how'"
_PARTICLE = "의|는|이|가|을|를|에|에서|에게|에서부터|부터|까지|으로|로|와|과|도|만|뿐|이나|나|든지|라도|마저|조차|뿐만|처럼|같이|보다|하고|하고는"
_read("fragment_keywords", lambda m: m.facts.select("hint_id", F.array_join(X.fragment_keywords(F.col("subject"), F.col("predicate"), F.col("object_value"), X.fragment_content(F.col("source_quote"), F.col("subject"), F.col("predicate"), F.col("object_value"))), "|").alias("words")), rf"""
    , body AS (SELECT *, CASE WHEN length(q) >= 10 THEN CASE WHEN length(q) > 500 THEN substr(q, 1, 497) || '...' ELSE q END ELSE concat_ws(' ', subject, predicate, object_value) END AS b
               FROM (SELECT *, regexp_replace(source_quote, '^\s+|\s+$', '', 'g') AS q FROM fact)),
    said AS (SELECT *, list_filter(list_transform(list_filter(regexp_split_to_array(regexp_replace(b, '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+'),
           lambda w: w <> '' AND lower(w) NOT IN ({_STOP})), lambda w: regexp_replace(w, '(?s)^(.{{2,}}?)({_PARTICLE})$', '\1')), lambda w: length(w) >= 2 AND lower(w) NOT IN ({_STOP})) AS k FROM body),
    whole AS (SELECT hint_id, list_filter(list_concat([subject, predicate, object_value], k), lambda w: w IS NOT NULL AND w <> '') AS l FROM said)
    SELECT hint_id, array_to_string(list_filter(l, lambda w, i: list_position(list_transform(l, lambda y: lower(y)), lower(w)) = i)[:20], '|') AS words FROM whole""")
_read("latest_open_items", reads.latest_open_items, _OPEN_ITEMS + """
    SELECT workspace_id, row_number() OVER (PARTITION BY workspace_id ORDER BY worked_at DESC NULLS LAST, hint_id) AS place, hint_id, subject, predicate, object_value FROM open QUALIFY place <= 20""")
_FRAGMENT = ", frag AS (SELECT hint_id AS id, CASE WHEN length(q) >= 10 THEN CASE WHEN length(q) > 500 THEN substr(q, 1, 497) || '...' ELSE q END ELSE concat_ws(' ', subject, predicate, object_value) END AS content FROM (SELECT *, regexp_replace(source_quote, '^\\s+|\\s+$', '', 'g') AS q FROM fact))\n"
_read("fragment_search", lambda m: ranking.text_search(reads.fragments(m), ["content"], "hint_id", TERMS, 50).select("id", "score"), _FRAGMENT + f"""
    SELECT id, score FROM (SELECT id, CAST({_SCORE.replace("B", "coalesce(content, '')")} AS BIGINT) AS score FROM frag) WHERE score > 0 ORDER BY score DESC, id LIMIT 50""")
_read("active_workspaces", lambda m: reads.workspace_pages(m, hidden=False), """
    SELECT id, status, (SELECT max(created_at) FROM episode e WHERE e.workspace_id = w.id) AS latest FROM workspaces w WHERE status = 'active' ORDER BY latest DESC NULLS LAST, id LIMIT 20""")
