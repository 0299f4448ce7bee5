"""Rebuilding conversations from message rows.

Rows that carry an episode_id belong to that conversation.  Rows without one are linked to each other by reply links
(the next sequence in the same workspace, said within ``REPLY_WITHIN_S`` seconds) and by quote links (a text that opens
by quoting another row's text with '>'), and the connected components of these links, found by alternating large-star
and small-star joins, are their conversations.  Then conversations are ordered by sequence and checked.

Defined results: a null or unusable role makes the conversation 'bad_role'; a null text is blank and differs from any
text; a row without sequence has no place and is left out; rows equal in conversation, sequence and text count once;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.components import components
from memloom.scratch import Scratch

REPLY_WITHIN_S = 1800
#: Usual spellings of the four roles, lower case, without blanks around them.
ROLE_SPELLINGS = {
    "user": ["user", "human", "usr", "end_user", "enduser", "end-user", "customer", "client", "prompter", "person", "u", "h", "me", "you", "humans", "users"],
    "assistant": ["assistant", "ai", "model", "bot", "assistent", "chatbot", "gpt", "llm", "agent", "ai_assistant", "ai assistant", "a", "chatgpt", "claude", "gemini", "asst"],
    "system": ["system", "developer", "sys", "system_prompt", "system prompt", "instructions", "instruction", "dev"],
    "tool": ["tool", "function", "tool_result", "tool_use", "tool_call", "tool_response", "tool_output", "function_call", "function_response", "tools", "tool result", "tool-result", "plugin", "functions"],
}


def canonical_role(role: Column) -> Column:
    """user, assistant, system or tool; null if the spelling names none of them."""
    bare = F.lower(F.regexp_replace(role, r"(?U)^[\s\[<(*#]+|[\s\]>):*]+$", ""))
    out = F.lit(None).cast("string")
    for name, spellings in ROLE_SPELLINGS.items():
        out = F.when(bare.isin(spellings), F.lit(name)).otherwise(out)
    return out


def _said(text: Column) -> Column:
    return text.isNotNull() & text.rlike(r"(?U)\S")


def _bare(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)\s+", " "))


def orphan_links(orphans: DataFrame) -> DataFrame:
    """Reply and quote links (u, v) among rows that carry no episode_id."""
    when = F.coalesce(F.col("ts"), F.col("created_at"))
    rows = orphans.select("id", "workspace_id", "sequence", when.cast("timestamp").cast("long").alias("at"), "text")
    slot = F.floor(F.col("at") / REPLY_WITHIN_S)
    earlier = rows.select(
        F.col("id").alias("v"), F.col("workspace_id").alias("w"), (F.col("sequence") + 1).alias("s"), F.col("at").alias("before"),
        F.explode(F.array(slot, slot + 1)).alias("slot"),
    )
    later = rows.select("id", "workspace_id", "sequence", "at", slot.alias("here"))
    replies = (
        later.join(
            earlier,
            (F.col("workspace_id") == F.col("w")) & (F.col("sequence") == F.col("s")) & (F.col("here") == F.col("slot"))
            & (F.col("at") >= F.col("before")) & (F.col("at") - F.col("before") <= REPLY_WITHIN_S),
        )
        .groupBy("id", "at").agg(F.max(F.struct("before", F.col("v"))).alias("nearest"))
        .select(F.col("id").alias("u"), "at", F.col("nearest.v").alias("v"))
    )
    # One message has one next one: of several that take it for theirs the earliest keeps it.
    replies = replies.groupBy("v").agg(F.min(F.struct("at", "u")).alias("first")).select(F.col("first.u").alias("u"), "v")
    quoted = F.regexp_replace(F.regexp_extract("text", r"^((?:>[^\n]*\n?)+)", 1), r"(?m)^>[ \t]?", "")
    quoting = rows.filter(F.col("text").startswith(">")).select(
        F.col("id").alias("u"), F.col("workspace_id").alias("w"), F.xxhash64(F.trim(_bare(quoted))).alias("h")
    )
    said = rows.filter(F.col("text").isNotNull()).groupBy("workspace_id", F.xxhash64(F.trim(_bare(F.col("text")))).alias("k")).agg(F.min("id").alias("v"))
    quotes = quoting.join(said, (F.col("w") == F.col("workspace_id")) & (F.col("h") == F.col("k"))).select("u", "v")
    return replies.unionByName(quotes)


def _base(turns: DataFrame) -> DataFrame:
    return turns.select("id", "workspace_id", "episode_id", "sequence", "role", "text", "ts", "created_at").filter(F.col("sequence").isNotNull() & F.col("id").isNotNull())


def _rows(placed: DataFrame) -> DataFrame:
    role = canonical_role(F.col("role"))
    return placed.select("conversation", "episode_id", "sequence", role.alias("role"), role.isNull().alias("bad_role"), "text", "id", "ts")


def identified(turns: DataFrame) -> DataFrame:
    """Rows of the conversations that carry an identifier, as in ``rebuild``; no link is needed for them."""
    return _rows(_base(turns).filter(F.col("episode_id").isNotNull()).withColumn("conversation", F.concat(F.lit("e"), F.col("episode_id").cast("string"))))


def rebuild(turns: DataFrame) -> DataFrame:
    """Rows (conversation, episode_id, sequence, role, bad_role, text, id, ts) of all conversations, unchecked.

    conversation is 'e<episode_id>', or 'm<smallest id>' for a component of rows without identifier.
    """
    orphans = _base(turns).filter(F.col("episode_id").isNull())
    scratch = Scratch(turns.sparkSession, "conversations")
    found = components(orphan_links(orphans), scratch)
    placed = orphans.join(found, F.col("id") == F.col("node"), "left").withColumn("conversation", F.concat(F.lit("m"), F.coalesce("component", "id").cast("string")))
    return identified(turns).unionByName(_rows(placed))


def verdicts(rows: DataFrame) -> DataFrame:
    """(conversation, episode_id, first_sequence, problems array) for every conversation of ``rebuild``."""
    said = _said(F.col("text"))
    # Texts are compared by a 64-bit hash, so that only numbers are shuffled; the first aggregation is combined before it.
    mark = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("text"))
    spots = rows.withColumn("mark", mark).withColumn("said", said).groupBy("conversation", "episode_id", "sequence").agg(
        (F.min("mark") != F.max("mark")).alias("conflict"),
        F.max("bad_role").alias("bad_role"),
        F.max((F.col("role") == "user") & F.col("said")).alias("asked"),
        F.max((F.col("role") == "assistant") & F.col("said")).alias("answered"),
    )
    seq = F.col("sequence").cast("long")
    each = spots.groupBy("conversation", "episode_id").agg(
        F.min(seq).alias("first_sequence"),
        (F.max(seq) - F.min(seq) + 1 > F.count(F.lit(1))).alias("gap"),
        F.max("conflict").alias("conflict"),
        F.max("bad_role").alias("bad_role"),
        F.max(F.when(F.col("asked"), seq)).alias("last_asked"),
        F.max(F.when(F.col("answered"), seq)).alias("last_answered"),
    )
    problem = lambda name, test: F.when(test, F.lit(name))
    return each.select(
        "conversation", "episode_id", "first_sequence",
        F.array_compact(F.array(
            problem("empty", F.col("last_asked").isNull() & F.col("last_answered").isNull()),
            problem("gap", F.col("gap")),
            problem("conflict", F.col("conflict")),
            problem("bad_role", F.col("bad_role")),
            problem("no_reply", F.col("last_asked").isNotNull() & F.coalesce(F.col("last_answered") <= F.col("last_asked"), F.lit(True))),
        )).alias("problems"),
    )


def broken(turns: DataFrame) -> DataFrame:
    """(episode_id, problem) of the conversations to leave out; conversations without identifier are not listed."""
    return verdicts(identified(turns)).select("episode_id", F.explode("problems").alias("problem"))


def conversations(turns: DataFrame) -> DataFrame:
    """The good conversations, one row per message: (conversation, episode_id, position, role, text, id, ts).

    Sequences of a good conversation have no gap, so the position follows from the first sequence and no window over a
    whole conversation is needed.
    """
    rows = rebuild(turns)
    good = verdicts(rows).filter(F.size("problems") == 0).select("conversation", "first_sequence")
    message = F.min(F.struct("id", "role", "text", "ts")).alias("message")
    once = rows.groupBy("conversation", "episode_id", "sequence").agg(message)
    return once.join(good, "conversation").select(
        "conversation", "episode_id", (F.col("sequence") - F.col("first_sequence")).cast("long").alias("position"),
        "message.role", "message.text", "message.id", "message.ts",
    )
