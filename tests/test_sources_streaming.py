import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from memloom.sources import sessions as S
from memloom.streaming import ingest as stream

CASES = [
    ("claude", [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], lambda t: [m["role"] for m in t["messages"]] == ["user", "assistant"]),
    ("anthropic", [{"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}]}], lambda t: [p["type"] for p in t["messages"][0]["content"]] == ["thinking", "text"]),
    ("claude", [{"role": "assistant", "content": [{"type": "text", "text": "x"}, {"type": "tool_use", "id": "1", "name": "Read", "input": {"path": "a"}}]}], lambda t: t["messages"][0]["tool_calls"][0]["name"] == "Read"),
    ("openai", [{"role": "assistant", "content": None, "tool_calls": [{"id": "1", "function": {"name": "f", "arguments": "{\"a\": 1}"}}]}], lambda t: t["messages"][0]["tool_calls"][0]["arguments"] == {"a": "1"}),
    ("openai", [{"role": "tool", "content": "out"}], lambda t: t["messages"][0]["role"] == "tool_result"),
    ("chatgpt", [{"role": "assistant", "reasoning_content": "why", "content": "so"}], lambda t: any(p["type"] == "text" for p in t["messages"][0]["content"])),
    ("gemini", [{"role": "model", "parts": [{"text": "hi"}]}], lambda t: t["messages"][0]["role"] == "assistant"),
    ("google", {"contents": [{"role": "model", "parts": [{"functionCall": {"name": "g", "args": {"x": 1}}}]}]}, lambda t: t["messages"][0]["tool_calls"][0]["name"] == "g"),
    ("gemini", {"systemInstruction": {"parts": [{"text": "be kind"}]}, "contents": []}, lambda t: "be kind" in t["system_prompt"]),
    ("other", ["just text"], lambda t: len(t["messages"]) == 1),
]


@pytest.mark.parametrize(("provider", "data", "good"), CASES)
def test_canonical(provider, data, good):
    assert good(S.canonical(json.dumps(data)))


def test_transcripts_as_column(spark):
    df = spark.createDataFrame([(1, "no json"), (2, None), (3, json.dumps([{"role": "user", "content": "x"}]))], "id long, raw string")
    got = {r.id: r.transcript for r in S.normalized_transcripts(df).collect()}
    assert got[1].messages[0].content[0].text == "no json" and got[2] is None and got[3].messages[0].role == "user"


def test_session_log(spark, tmp_path):
    lines = [
        {"type": "user", "timestamp": "2025-01-01T00:00:02Z", "sessionId": "s1", "cwd": "/w", "message": {"content": "hello there"}}, "", "broken {", {"type": "ai-title", "title": "T"}, {"type": "summary", "timestamp": "2025-01-01T00:00:02Z"},
        {"type": "assistant", "timestamp": "2025-01-01T00:00:03Z", "message": {"content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "answer"}, {"type": "tool_use", "name": "Bash", "input": {"c": "ls"}}, {"type": "tool_result", "content": "z" * 900}]}},
        {"type": "user", "message": {"content": "no time"}}, {"type": "user", "timestamp": "2025-01-01T00:00:01Z", "message": {"content": "<system-reminder>auto"}},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    rows = S.session_log(spark, str(tmp_path)).orderBy("sequence").collect()
    assert [r.role for r in rows] == ["user", "user", "assistant"] and rows[0].title == "T" and rows[0].session_id == "s1"
    assert "[Bash]" in rows[2].text and "hm" not in rows[2].text and len(rows[2].text) < 500
    kept = S.session_log(spark, str(tmp_path), conservative=True).collect()
    assert len(kept) == 2 and any("characters omitted" in r.text for r in kept)


def test_other_sources(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"session_id": "s", "date_range": ["2025-02-01"], "turns": [{"role": "user", "text": "a"}, {"turn_id": 9, "role": "assistant", "text": "b", "timestamp": "2025-02-02"}]}))
    rows = S.preprocessed_session(spark, str(tmp_path / "p.json")).orderBy("sequence").collect()
    assert [(r.turn_id, r.said_at.day) for r in rows] == [(1, 1), (9, 2)]
    (tmp_path / "e.json").write_text(json.dumps({"episode_id": 1, "workspace_id": 2, "entities": [{"name": "A", "type": " Person"}], "facts": [], "relations": [{"source": "A", "target": "A", "type": "x"}]}))
    entities, facts, relations = S.extracted(spark, str(tmp_path / "e.json"))
    assert entities.first().type == "person" and facts.count() == 0 and relations.count() == 0
    logs = tmp_path / "logs"
    logs.mkdir()
    for name, n in (("s1.jsonl", 10), ("s2.jsonl", 20), ("tiny.jsonl", 1), ("x.txt", 50)):
        (logs / name).write_text("x" * n)
    got = {r.file.rsplit("/", 1)[1]: r.status for r in S.not_ingested(spark, str(logs), S.inline(spark, [("s1",)], "session_id string"), least=5).collect()}
    assert got == {"s1.jsonl": "matched", "s2.jsonl": "not_ingested"}


def test_streams(spark, tmp_path):
    day = dt.datetime(2025, 1, 1)
    rows = [(i % 6, day + dt.timedelta(hours=5 * (i % 6)), "u") for i in range(12)] + [(99, day + dt.timedelta(days=9), "u")]
    spark.createDataFrame(rows, "id long, ts timestamp, role string").repartition(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    source = stream.arriving(spark, str(tmp_path / "in"), schema)
    query = stream.once(source, "id", "ts").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").count() == 7
    query = stream.day_histogram(source, "ts", "role").writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.day, r.n) for r in spark.table("days").collect()} == {(dt.date(2025, 1, 1), 10), (dt.date(2025, 1, 2), 2)}
    query = stream.merge_into(source.select("id", F.lit(1).alias("n")), str(tmp_path / "out"), ["id"], str(tmp_path / "c3"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "v0")).count() == 7


def test_merged_versions_are_repeatable_and_never_start_anew(spark, tmp_path):
    """Of two rows of a key the larger stays; a version whose predecessor is missing or broken is not written."""
    rows = [(1, 5, "a"), (1, 9, "b"), (2, 1, "c")]
    spark.createDataFrame(rows, "id long, n int, s string").repartition(3).write.parquet(str(tmp_path / "in"))
    source = stream.arriving(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    stream.merge_into(source, str(tmp_path / "out"), ["id"], str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out" / "v0")).collect())) == [(1, 9, "b"), (2, 1, "c")]
    for state in ("missing", "broken"):
        for f in (tmp_path / "out").glob("v0/*.parquet"):
            f.unlink() if state == "missing" else f.write_bytes(b"no parquet")
        if state == "missing":
            for f in [*(tmp_path / "out" / "v0").iterdir()]:
                f.unlink()
            (tmp_path / "out" / "v0").rmdir()
        spark.createDataFrame([(3, 1, "d")], "id long, n int, s string").write.mode("append").parquet(str(tmp_path / "in"))
        with pytest.raises(Exception, match="v0|parquet|Parquet|PARQUET"):
            stream.merge_into(source, str(tmp_path / "out"), ["id"], str(tmp_path / "c")).awaitTermination()
        assert not (tmp_path / "out" / "v1").exists()
        (tmp_path / "out" / "v0").mkdir(exist_ok=True)
        (tmp_path / "out" / "v0" / "x.parquet").write_bytes(b"")


def test_replay_resolves_and_counts(spark):
    entities = spark.createDataFrame([(1, 1, "Ann", "person"), (2, 1, "ann ", "human"), (1, 1, " ", "person"), (1, 1, "Bob", "gizmo"), (1, 2, "Ann", "concept"), (1, 1, None, "x")], "episode_id long, workspace_id long, name string, type string")
    facts = spark.createDataFrame([(1, 1, "Ann", "likes", "tea", "q1"), (2, 1, "ANN", "likes", "tea", "q2"), (1, 1, "Zed", "likes", "tea", "q")], "episode_id long, workspace_id long, subject string, predicate string, object string, quote string")
    relations = spark.createDataFrame([(1, 1, "Ann", "Bob", "knows"), (1, 1, "Ann", "Zed", "knows"), (1, 2, "Ann", "Bob", "knows")], "episode_id long, workspace_id long, source string, target string, type string")
    known = spark.createDataFrame([(7, 1, "ann")], "id long, workspace_id long, name_normalized string")
    got, told, ends, counters = S.replayed(entities, facts, relations, known)
    assert {(r.workspace_id, r.key, r.entity_type, r.entity_id, r.how) for r in got.collect()} == {(1, "ann", "person", 7, "known"), (1, "bob", "other", None, "new"), (2, "ann", "concept", None, "new")}
    assert [(r.key, r.episode_id, r.quote, r.episodes) for r in told.collect()] == [("ann", 1, "q1", 2)]
    assert [(r.source_key, r.target_key) for r in ends.collect()] == [("ann", "bob")]
    assert {(r.kind, r.state): r.n for r in counters.collect()} == {("entities", "stored"): 4, ("entities", "failed"): 2, ("facts", "stored"): 2, ("facts", "failed"): 1, ("relations", "stored"): 1, ("relations", "failed"): 2}


def test_append_and_first_row_of_a_file(spark, tmp_path):
    from memloom.operators import ingest

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, day string")
    ingest.append(df, str(tmp_path / "t"), "day")
    ingest.append(df.limit(1), str(tmp_path / "t"), "day")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3 and (tmp_path / "t" / "day=a").is_dir()


def test_session_log_takes_the_first_message_s_session(spark, tmp_path):
    lines = [{"type": "summary", "sessionId": "z0", "cwd": "/z"}, {"type": "user", "timestamp": "2025-01-01T00:00:02Z", "sessionId": "a", "cwd": "/b", "gitBranch": "m", "message": {"content": "hello there"}}, {"type": "assistant", "timestamp": "2025-01-01T00:00:01Z", "sessionId": "z", "cwd": "/a", "gitBranch": "x", "message": {"content": "again"}}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert {(r.session_id, r.cwd, r.git_branch) for r in S.session_log(spark, str(tmp_path)).collect()} == {("a", "/b", "m")}
