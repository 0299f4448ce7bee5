"""Sources: session logs, preprocessed sessions, provider transcripts, extracted facts, directory listings."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How much of a block a session log keeps.
SHORT_BLOCK, LONG_BLOCK = 300, 600
SMALLEST_FILE = 100 * 1024
#: Openings by which an automatic system prompt is told from what a person wrote.
AUTO_PROMPTS = ["<system-reminder>", "caveat: the messages below", "you are an ai", "this session is being continued", "# system prompt"]
_LINE = "type string, timestamp string, sessionId string, cwd string, gitBranch string, entrypoint string, title string, aiTitle string, content string, message struct<role:string,content:string>"
_BLOCKS = "array<struct<type:string,text:string,thinking:string,name:string,input:string,content:string>>"


def _flattened(content: Column, conservative: bool) -> Column:
    """Text of a message: itself, or its blocks one below the other; tool blocks are shortened, thinking is dropped."""
    blocks = F.from_json(content, _BLOCKS)
    most = LONG_BLOCK if conservative else SHORT_BLOCK
    result = lambda c: F.when(
        F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("… ["), (F.length(c) - most).cast("string"), F.lit(" characters omitted]") if conservative else F.lit("]"))
    ).otherwise(c)
    call = lambda b: F.concat(F.lit("["), b["name"], F.lit("] "), F.substring(F.regexp_replace(b["input"], r"\s+", " "), 1, 120 if conservative else SHORT_BLOCK))
    one = lambda b: (
        F.when(b["type"] == "text", b["text"]).when(b["type"] == "tool_use", call(b))
        .when(b["type"] == "tool_result", F.concat(F.lit("[tool_result] "), result(F.coalesce(b["content"], F.lit("")))))
    )
    joined = F.array_join(F.filter(F.transform(blocks, one), lambda x: F.length(x) > 0), "\n")
    return F.when(content.startswith("["), joined).otherwise(content)


def session_log(spark: SparkSession, path: str, conservative: bool = False) -> DataFrame:
    """(file, session_id, cwd, git_branch, title, sequence, role, text, said_at) of JSON-lines session logs.

    Blank and broken lines, lines of other types, and messages without time or text are left out; sequences count from 0
    in the order of time.  ``conservative`` keeps more of tool results and drops automatic prompts, short transitions of
    the assistant and NUL characters.
    """
    # Only the log's own file order is local: each file is a session, so windows are by file.
    # Session, directory and branch are those of the first message in the file; lines are in order within a block of it.
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"), F.from_json("value", _LINE).alias("j")
    ).filter(F.col("j.type").isNotNull())
    message = F.col("j.type").isin("user", "assistant")
    head = lines.groupBy("file").agg(
        F.min(F.when(message, F.struct("at", F.struct("j.sessionId", "j.cwd", "j.gitBranch").alias("h"))))["h"].alias("h"),
        F.max(F.when(F.col("j.type") == "ai-title", F.coalesce("j.title", "j.aiTitle", "j.content"))).alias("title"),
    ).select("file", F.col("h.sessionId").alias("session_id"), F.col("h.cwd").alias("cwd"), F.col("h.gitBranch").alias("git_branch"), "title")
    said = lines.filter(F.col("j.type").isin("user", "assistant")).select(
        "file", F.col("j.type").alias("role"), _flattened(F.col("j.message.content"), conservative).alias("text"), F.to_timestamp("j.timestamp").alias("said_at")
    )
    said = said.filter(F.col("said_at").isNotNull() & (F.length(F.trim("text")) > 0))
    if conservative:
        start = F.lower(F.substring("text", 1, 400))
        auto = F.lit(False)
        for opening in AUTO_PROMPTS:
            auto = auto | start.contains(opening)
        said = said.withColumn("text", F.translate("text", "\x00", "")).filter(~auto & ~((F.col("role") == "assistant") & (F.length("text") <= 80)))
    order = Window.partitionBy("file").orderBy("said_at", "role", "text")
    return said.withColumn("sequence", F.row_number().over(order) - 1).join(head, "file", "left").select(
        "file", "session_id", "cwd", "git_branch", "title", "sequence", "role", "text", "said_at"
    )


def preprocessed_session(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, project, git_branch, sequence, turn_id, role, text, said_at) of preprocessed session files.

    A turn without id takes its place from 1, one without time the first date of the session.
    """
    kind = "session_id string, project string, git_branch string, cwd string, date_range array<string>, entrypoint string, ai_title string, turns array<struct<turn_id:bigint,role:string,text:string,timestamp:string>>"
    rows = spark.read.schema(kind).json(path, multiLine=True).select("session_id", "project", "git_branch", F.get("date_range", F.lit(0)).alias("first"), F.posexplode("turns").alias("sequence", "t"))
    return rows.select(
        "session_id", "project", "git_branch", "sequence", F.coalesce("t.turn_id", F.col("sequence") + 1).alias("turn_id"), "t.role", "t.text",
        F.to_timestamp(F.coalesce("t.timestamp", "first")).alias("said_at"),
    )


def extracted(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, facts, relations) of files with what was extracted from an episode, types in one spelling."""
    kind = "episode_id bigint, workspace_id bigint, entities array<struct<name:string,type:string>>, facts array<struct<subject:string,predicate:string,object:string,quote:string>>, relations array<struct<source:string,target:string,type:string>>"
    rows = spark.read.schema(kind).json(path, multiLine=True)
    part = lambda name: rows.select("episode_id", "workspace_id", F.explode(name).alias("x")).select("episode_id", "workspace_id", "x.*")
    return part("entities").withColumn("type", F.lower(F.trim("type"))), part("facts"), part("relations").filter("source <> target")


#: Entity types of the store; any other name is 'other'.
ENTITY_TYPES = ["person", "organization", "location", "event", "concept", "product", "preference", "procedure", "other", "episode_topic", "theme"]


def replayed(entities: DataFrame, facts: DataFrame, relations: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entities, facts, relations, counters) of ``extracted`` ready to be stored.

    Types become those of the store; names are resolved against the known entities (id, workspace_id, name_normalized) and
    each other; a triple that several episodes state is one fact with the episode that states it first; relations lead
    from entity to entity.  Counters give, for each kind, what was stored and what could not be: no name, or an end that
    names nothing.
    """
    low = lambda c: F.lower(F.trim(F.col(c)))
    named = entities.filter(F.length(F.trim("name")) > 0)
    kind = F.when(F.col("type").isin(ENTITY_TYPES), F.col("type")).otherwise("other")
    asked = named.groupBy("workspace_id", low("name").alias("key")).agg(F.min(F.struct("episode_id", "name", kind.alias("kind"))).alias("f"))
    stored = known.groupBy("workspace_id", F.col("name_normalized").alias("key")).agg(F.min("id").alias("entity_id"))
    resolved = asked.join(stored, ["workspace_id", "key"], "left").select("workspace_id", "key", "f.name", F.col("f.kind").alias("entity_type"), "entity_id", F.when(F.col("entity_id").isNull(), "new").otherwise("known").alias("how"))
    names = resolved.select("workspace_id", "key")
    about = facts.withColumn("key", low("subject")).join(names, ["workspace_id", "key"], "left_semi")
    once = about.groupBy("workspace_id", "key", "predicate", "object").agg(F.min(F.struct("episode_id", "quote")).alias("f"), F.countDistinct("episode_id").alias("episodes"))
    told = once.select("workspace_id", "key", "predicate", "object", "f.episode_id", "f.quote", "episodes")
    ends = relations.withColumn("key", low("source")).join(names, ["workspace_id", "key"], "left_semi").withColumnRenamed("key", "source_key").withColumn("key", low("target")).join(names, ["workspace_id", "key"], "left_semi").withColumnRenamed("key", "target_key")
    one = lambda df, kind, state: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit(state).alias("state"), "n")
    counters = one(named, "entities", "stored").unionByName(one(entities.filter(~(F.length(F.trim("name")) > 0) | F.col("name").isNull()), "entities", "failed"))
    counters = counters.unionByName(one(about, "facts", "stored")).unionByName(one(facts.withColumn("key", low("subject")).join(names, ["workspace_id", "key"], "left_anti"), "facts", "failed"))
    lost = relations.agg(F.count(F.lit(1)).alias("a")).crossJoin(F.broadcast(ends.agg(F.count(F.lit(1)).alias("b"))))  # one row
    counters = counters.unionByName(one(ends, "relations", "stored")).unionByName(lost.select(F.lit("relations").alias("kind"), F.lit("failed").alias("state"), (F.col("a") - F.col("b")).alias("n")))
    return resolved, told, ends, counters


def not_ingested(spark: SparkSession, path: str, ledger: DataFrame, least: int = SMALLEST_FILE) -> DataFrame:
    """(file, bytes, status): session files of at least so many bytes against the sessions of a ledger (session_id).

    Only names and sizes are read, not the files.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(path).select("path", "length").filter(F.col("length") >= least)
    stem = F.regexp_replace(F.element_at(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), -1), r"\.jsonl$", "")
    known = ledger.select(F.col("session_id").cast("string").alias("stem")).distinct().withColumn("known", F.lit(True))
    return files.withColumn("stem", stem).join(known, "stem", "left").select(
        F.col("path").alias("file"), F.col("length").alias("bytes"), F.when(F.col("known"), "matched").otherwise("not_ingested").alias("status")
    )


MESSAGE = "struct<system_prompt:string,messages:array<struct<role:string,content:array<struct<type:string,text:string>>,tool_calls:array<struct<id:string,name:string,arguments:map<string,string>>>>>>"


def _text(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _arguments(value: object) -> dict[str, str]:
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return {"raw": value}
    return {str(k): _text(v) for k, v in value.items()} if isinstance(value, dict) else {}


def _parts(content: object) -> tuple[list[dict], list[dict]]:
    """(content parts, tool calls) of any provider's content."""
    parts: list[dict] = []
    calls: list[dict] = []
    for block in content if isinstance(content, list) else [] if content is None else [content]:
        if isinstance(block, str):
            parts.append({"type": "text", "text": block})
            continue
        if not isinstance(block, dict):
            continue
        kind = block.get("type")
        call = block.get("functionCall")
        if kind == "tool_use" or call:
            use = call or block
            calls.append({"id": _text(use.get("id") or ""), "name": _text(use.get("name") or ""), "arguments": _arguments(use.get("input", use.get("args", {})))})
        elif kind == "thinking":
            parts.append({"type": "thinking", "text": _text(block.get("thinking") or block.get("text") or "")})
        elif kind == "tool_result" or "functionResponse" in block:
            parts.append({"type": "tool_result", "text": _text(block.get("content", block.get("functionResponse", "")))})
        elif "text" in block:
            parts.append({"type": "thinking" if block.get("thought") else "text", "text": _text(block["text"])})
    return parts, calls


def canonical(raw: str | None) -> dict | None:
    """One provider's transcript as system prompt and messages; what is no JSON is one user message; null stays null.

    The provider's own shape is told by the fields it has, so the provider's name need not be right.
    """
    if raw is None:
        return None
    try:
        data = json.loads(raw)
    except ValueError:
        data = [{"role": "user", "content": raw}]
    system = None
    if isinstance(data, dict):
        instruction = data.get("system") or data.get("systemInstruction") or data.get("system_instruction")
        if instruction is not None:
            held = instruction.get("parts", instruction) if isinstance(instruction, dict) else instruction
            system = "\n".join(p["text"] for p in _parts(held)[0]) or None
        rows = next((data[k] for k in ("messages", "contents", "chat_messages", "turns") if isinstance(data.get(k), list)), [data] if "role" in data else [])
    else:
        rows = data if isinstance(data, list) else [{"role": "user", "content": _text(data)}]
    messages = []
    for row in rows:
        if not isinstance(row, dict):
            row = {"role": "user", "content": _text(row)}
        role = str(row.get("role") or row.get("sender") or "user").lower()
        role = {"model": "assistant", "human": "user", "ai": "assistant", "tool": "tool_result", "function": "tool_result", "developer": "system"}.get(role, role)
        parts, calls = _parts(row.get("content", row.get("parts", row.get("text"))))
        if row.get("reasoning_content"):
            parts.insert(0, {"type": "thinking", "text": _text(row["reasoning_content"])})
        for call in row.get("tool_calls") or []:
            function = call.get("function", call)
            calls.append({"id": _text(call.get("id") or ""), "name": _text(function.get("name") or ""), "arguments": _arguments(function.get("arguments", {}))})
        messages.append({"role": role, "content": parts, "tool_calls": calls})
    return {"system_prompt": system, "messages": messages}


def normalized_transcripts(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """The rows with a struct column ``transcript`` that has one shape for all providers."""

    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: None if not isinstance(r, str) else json.dumps(canonical(r), ensure_ascii=False))

    return df.withColumn("transcript", F.from_json(run(F.col(raw_col)), MESSAGE))


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small relation given in the program, to be joined with stored tables."""
    return spark.createDataFrame(rows, schema)
