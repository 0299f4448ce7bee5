import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from memloom.operators import graph, ingest, ranking

TURN = "id long, episode_id long, sequence int, role string, text string"


def test_dedupe_keeps_lowest_sequence_and_counts(spark):
    rows = [(1, 1, 0, "user", "a"), (2, 1, 3, "user", "a"), (3, 1, 1, "user", None), (4, 1, 2, "user", None), (5, 2, 0, "user", "a")]
    df = spark.createDataFrame(rows, TURN)
    assert sorted(r.id for r in ingest.dedupe_turns(df).collect()) == [1, 3, 5]
    assert {r.episode_id: (r.kept, r.dropped) for r in ingest.dropped_duplicates(df).collect()} == {1: (2, 2), 2: (1, 0)}
    assert ingest.dedupe_turns(df.limit(0)).count() == 0


def test_insert_twice_skips(spark):
    new = spark.createDataFrame([(1, 10), (2, 10), (2, 10)], "turn_id long, subject_id long")
    fresh, counts = ingest.insert_absent(new.limit(0), new, ["turn_id", "subject_id"])
    assert fresh.count() == 2 and counts.first() == (2, 0)
    again, counts = ingest.insert_absent(fresh, new, ["turn_id", "subject_id"])
    assert again.count() == 0 and counts.first() == (0, 2)


def test_upsert_replaces_and_keeps(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, summary string, turn_count int")
    new = spark.createDataFrame([(2, None, 999), (3, "c", 1)], "k int, summary string, turn_count int")
    assert sorted(map(tuple, ingest.upsert_latest(old, new, ["k"]).collect())) == [(1, "a", 5), (2, None, 999), (3, "c", 1)]
    assert sorted(map(tuple, ingest.upsert_latest(old, new, ["k"], keep=["turn_count"]).collect())) == [(1, "a", 5), (2, None, 6), (3, "c", 1)]


def test_ledger_patch_touch_and_resolution(spark):
    day = dt.datetime(2025, 1, 1)
    e = spark.createDataFrame([(1, 1, 7, "h1", day), (2, 1, 7, "h2", day), (3, 1, 8, "h1", day)], "id long, workspace_id long, session_id long, content_hash string, created_at timestamp")
    assert {r.id: r.decision for r in ingest.ledger(e).collect()} == {1: "new", 2: "append_v2", 3: "duplicate"}
    p = spark.createDataFrame([("old", None), ("old", ""), ("old", "new")], "o string, p string")
    assert [r.v for r in p.select(ingest.patched(F.col("o"), F.col("p")).alias("v")).collect()] == ["old", None, "new"]
    f = spark.createDataFrame([(1,), (2,)], "hint_id long")
    log = spark.createDataFrame([(1, day), (1, day + dt.timedelta(1))], "hint_id long, read_at timestamp")
    assert {r.hint_id: r.last_accessed_at for r in ingest.touched(f, log).collect()} == {1: day + dt.timedelta(1), 2: None}
    names = spark.createDataFrame([(1, " Kim "), (1, "JS"), (1, "x")], "workspace_id long, name string")
    known = spark.createDataFrame([(5, 1, "kim")], "id long, workspace_id long, name_normalized string")
    alias = spark.createDataFrame([(1, 6, "js")], "workspace_id long, entity_id long, alias string")
    assert {r.name: (r.entity_id, r.how) for r in ingest.resolve_entities(names, known, alias).collect()} == {" Kim ": (5, "name"), "JS": (6, "alias"), "x": (None, "new")}


def test_pairs_lookback_chunks_samples(spark):
    rows = [(i, 1, i, r, "t") for i, r in enumerate(["system", "user", "assistant", "assistant", "user", "user", "assistant"])]
    df = spark.createDataFrame(rows, TURN)
    pairs = ingest.message_pairs(df)
    assert [(r.pair, r.first_sequence, r.answers) for r in pairs.orderBy("pair").collect()] == [(1, 1, 2), (2, 4, 0), (3, 5, 1)]
    assert [r.context for r in ingest.lookback(pairs).orderBy("pair").collect()] == ["", "1", "1|4"]
    assert [(r.chunk, r.turns) for r in ingest.chunks(df, 3).orderBy("chunk").collect()] == [(0, 3), (1, 3), (2, 1)]
    assert sorted(r.part for r in ingest.head_middle_tail(df, 2).collect()) == ["head", "head", "middle", "middle", "tail", "tail"]
    assert ingest.stratified_sample(df, "role", "id").count() == 3


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "name string")
    assert {r.name: r.depth for r in graph.hops(e, seeds, 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert sorted(r.path for r in graph.walks(e, seeds, 3).collect()) == ["a", "a>b", "a>b>c", "a>b>c>d"]
    labels = {r.name: r.community for r in graph.communities(e).collect()}
    assert labels["x"] in "xy" and labels["a"] not in "xy"


def test_ranking(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, v array<float>")
    assert [r.id for r in ranking.nearest_to(v, [1.0, 0.1], "v", "id", 2).collect()] == [1, 3]
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, place int")
    b = spark.createDataFrame([(2, 1), (1, 2)], "id long, place int")
    got = {r.id: r.rrf_score for r in ranking.fused({"graph": a, "vector": b}).collect()}
    assert abs(got[1] - got[2]) < 1e-12 and abs(got[1] - (1 / 61 + 1 / 62)) < 1e-12
    d = spark.createDataFrame([(1, "Schema schema", None), (2, "none", "schema"), (3, None, None)], "id long, content string, summary string")
    assert [(r.id, r.field, r.score) for r in ranking.text_search(d, ["content", "summary"], "id", ["schema"], 5).collect()] == [(1, "content", 2), (2, "summary", 1)]
    text = spark.createDataFrame([(1, "aa\n\nfoo foo\n\nbb\n\nfoo"), (2, "nothing"), (3, None)], "id long, body string")
    assert {r.id: r.excerpt for r in ranking.excerpts(text, "id", "body", ["foo"]).collect()} == {1: "foo foo\n\n[...]\n\nfoo", 2: "nothing", 3: None}
    same = spark.createDataFrame([("g", 1, 2.0), ("g", 2, 2.0), ("h", 1, 1.0), ("h", 2, 3.0)], "g string, id long, s double")
    assert {(r.g, r.id): r.scaled for r in ranking.minmax(same, "s", "g", "id").collect()} == {("g", 1): 1.0, ("g", 2): 0.5, ("h", 1): 0.0, ("h", 2): 1.0}


def test_diverse_selection_prefers_new_directions(spark):
    vectors = np.array([[1, 0], [1, 0.01], [0, 1.0], [0.7, 0.7]])
    order = ranking.select_diverse([1, 2, 3, 4], np.array([1.0, 0.99, 0.9, 0.5]), vectors, [None] * 4, limit=3)
    assert order[:2] == [0, 2] and len(order) == 3
    assert ranking.select_diverse([], np.zeros(0), np.zeros((0, 2)), []) == []
    rows = [("q", 1, 1.0, [1.0, 0.0], 1), ("q", 2, 0.9, None, 1), ("q", 3, 0.8, [0.0, 1.0], None)]
    df = spark.createDataFrame(rows, "q string, id long, relevance double, vector array<float>, community int")
    assert [(r.id, r.place) for r in ranking.diverse(df, "q").orderBy("place").collect()] == [(1, 1), (3, 2)]


def test_names_mean_something_within_their_workspace_only(spark, tmp_path):
    """Two workspaces share names: degrees, hops, latest values and neighbours stay apart."""
    import datetime as dt

    from memloom.operators import graph
    from memloom.plans import reads
    from memloom.plans.model import Model

    at = dt.datetime(2026, 1, 1)
    hints = [(1, 1, 1, "Aa", "owns", "Bb", "", "q"), (2, 1, 1, "Bb", "owns", "Cc", "", "q"), (3, 2, 2, "Aa", "owns", "Dd", "", "q"), (4, 2, 2, "Aa", "owns", "Ee", "", "q"), (5, 2, 2, "Aa", "owns", "Ee", "", "q"), (5, 2, 2, "Aa", "owns", "Ee", "", "q")]
    spark.createDataFrame(hints, "hint_id long, workspace_id long, episode_id long, subject string, predicate string, object_value string, temporal string, source_quote string").write.parquet(str(tmp_path / "fact_hints.parquet"))
    spark.createDataFrame([(1, 1, 1, "c", "h", "s", None, None, "done", at), (2, 1, 2, "c", "h", "s", None, None, "done", at)], "id long, session_id long, workspace_id long, content string, content_hash string, summary string, human_summary string, metadata string, processing_status string, created_at timestamp_ntz").write.parquet(str(tmp_path / "episodes.parquet"))
    m = Model(spark, str(tmp_path))
    assert {tuple(r) for r in reads.degree(m).collect()} == {(1, "Aa", 1), (1, "Bb", 2), (1, "Cc", 1), (2, "Aa", 3), (2, "Dd", 1), (2, "Ee", 2)}
    anchors = spark.createDataFrame([(1, "Aa")], "workspace_id long, name string")
    assert {tuple(r) for r in graph.hops(m.relations, anchors, 2, ["workspace_id"]).collect()} == {(1, "Aa", 0), (1, "Bb", 1), (1, "Cc", 2)}
    assert {(r.workspace_id, r.object_value) for r in reads.latest_values(m).filter("subject = 'Aa'").collect()} == {(1, "Bb"), (2, "Ee")}
    assert {(r.workspace_id, r.other, r.facts) for r in reads.neighbors_1hop(m).filter("anchor = 'Aa' and direction = 'out'").collect()} == {(1, "Bb", 1), (2, "Dd", 0), (2, "Ee", 0)}
    assert {(r.workspace_id, r.active) for r in reads.active_fact_counts(m).filter("subject = 'Aa'").collect()} == {(1, 1), (2, 2)}
    assert {(r.workspace_id, r.path) for r in graph.walks(m.relations, anchors, 2, ["workspace_id"]).collect()} == {(1, "Aa"), (1, "Aa>Bb"), (1, "Aa>Bb>Cc")}
    assert reads.neighbors_1hop(m, direction="in", relation_type="other").count() == 0


def test_two_passes_of_classification(spark):
    from memloom.operators import classify

    entities = spark.createDataFrame([(10, 1, "Old", "old"), (11, 2, "Old", "old")], "id long, workspace_id long, name string, name_normalized string")
    links = spark.createDataFrame([(1, 10)], "turn_id long, subject_id long")
    existing = spark.createDataFrame([(10, [1, 2, 2])], "subject_id long, turn_ids array<long>")
    new = spark.createDataFrame(
        [(0, 1, "Leaf", None, "New Root ", [3]), (1, 1, "New Root", None, None, [3, 4]), (2, 1, "Under old", None, "OLD", []), (3, 2, "Given", 11, None, [5]), (4, 2, "Lost", None, "New Root", [5])],
        "spec int, workspace_id long, name string, parent_id long, parent_name string, turn_ids array<long>",
    )
    subjects, fresh, counts = classify.classify_turns(entities, links, existing, new)
    assert {(r.name, r.id, r.parent_id) for r in subjects.collect()} == {("New Root", 12, None), ("Leaf", 13, 12), ("Under old", 14, 10), ("Given", 15, 11), ("Lost", 16, None)}
    assert {tuple(r) for r in fresh.select("turn_id", "subject_id").collect()} == {(2, 10), (3, 12), (4, 12), (3, 13), (5, 15), (5, 16)}
    assert counts.first().asDict() == {"linked": 6, "skipped": 1, "created": 5}
    sessions = spark.createDataFrame([(1, "C:\\Work\\Shop\\api", None, None), (2, "/home/x/notebook", "t", "u"), (3, None, "About Queues", ""), (4, None, None, None), (5, "/a/b", "x", "y")], "session_id long, cwd string, title string, text string")
    got = {r.session_id: r.chain for r in classify.by_directory(sessions, {"/shop/": "Shop>API"}, {r"\bqueues?\b": "Ops>Queues"}).collect()}
    assert got == {1: "Shop>API", 2: "notebook", 3: "Ops>Queues", 4: None, 5: None}


def test_created_entities_are_stable(spark):
    from memloom.operators import ingest

    resolved = spark.createDataFrame([(1, "Ann", 4, "name"), (1, "Bob ", None, "new"), (1, "bob", None, "new"), (2, "Bob", None, "new")], "workspace_id long, name string, entity_id long, how string")
    got = {(r.workspace_id, r.name_normalized): r.id for r in ingest.created_entities(resolved).collect()}
    assert set(got) == {(1, "bob"), (2, "bob")} and len(set(got.values())) == 2 and all(i > 0 for i in got.values())
    assert got == {(r.workspace_id, r.name_normalized): r.id for r in ingest.created_entities(resolved.repartition(3)).collect()}
