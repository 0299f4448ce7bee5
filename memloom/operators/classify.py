"""Transcripts to turns, scaffolding removal and rule-based classification of episodes to subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text as X
from memloom.operators.gaps import cleaned
from memloom.operators.ingest import insert_absent
from memloom.operators.ordered import running

#: Speaker labels at the start of a line, and the role that each stands for.
SPEAKERS = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "system": "system", "tool": "tool"}
#: Topic words by subject chain, in the order in which they are tried.
TOPIC_RULES = [("Search>Ranking", r"(?i)\b(ranking|search|passage|vector)\b"), ("Ingest>Dedup", r"(?i)\b(import|ingest|duplicate|upload)\b"), ("Ops>Queues", r"(?i)\b(queue|broker|retry|retries|cron|nightly)\b"), ("Product>Screens", r"(?i)\b(screen|page|login|widget|mobile)\b")]


def transcript_turns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, turn, role, text) of transcripts in any of the usual layouts: 'User: ...', '[user] ...', '### user', 'Human:' on its own line.

    A turn runs to the next label; what comes before the first one is left out.
    """
    labels = "|".join(SPEAKERS)
    marked = F.regexp_replace(F.regexp_replace(text_col, "\r\n?", "\n"), rf"(?im)^(?:#+[ \t]*({labels})[ \t]*$|\[({labels})\][ \t]?|({labels}):[ \t]*)", "\u0001$1$2$3\u0002")
    parts = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(marked, "\u0001")).alias("turn", "part")).filter("turn > 0")
    label = F.lower(F.substring_index("part", "\u0002", 1))
    roles = F.create_map(*[F.lit(x) for kv in SPEAKERS.items() for x in kv])
    return parts.select("id", (F.col("turn") - 1).alias("turn"), F.element_at(roles, label).alias("role"), F.regexp_replace(F.substring_index("part", "\u0002", -1), r"^\s+|\s+$", "").alias("text"))


def transcript(turns: DataFrame) -> DataFrame:
    """(episode_id, content): the turns of each episode as '[role] text', blank lines between.

    One episode's text is one value, as in the stored table, so its turns meet in one task.
    """
    line = F.concat(F.lit("["), F.lower(F.trim("role")), F.lit("] "), F.coalesce("text", F.lit("")))
    return turns.groupBy("episode_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sequence", "id", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("content"))


def without_scaffolding(text: Column) -> Column:
    """Thinking blocks, tool breadcrumbs and stock phrases taken out; runs of blank lines become one (``gaps.cleaned``)."""
    return cleaned(F.regexp_replace(text, r"(?s)<thinking>.*?(</thinking>|$)", ""))


def by_directory(sessions: DataFrame, places: dict[str, str], topics: dict[str, str], least: int = 5) -> DataFrame:
    """(session_id, chain): subject chains by working directory, then by words of the title and first text.

    ``places`` maps a part of a path to a chain and ``topics`` a pattern to one; both are tried in order, directories
    first, and the last part of a path of ``least`` letters or more stands for itself.  The rest have no chain.
    """
    path = X.normalized_path(F.coalesce("cwd", F.lit("")))
    said = F.concat_ws(" ", "title", "text")
    base = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    out = F.when(F.length(base) >= least, base)
    for pattern, chain in reversed(topics.items()):
        out = F.when(said.rlike(f"(?i){pattern}"), chain).otherwise(out)
    for part, chain in reversed(places.items()):
        out = F.when(F.contains(path, F.lit(part.lower())), chain).otherwise(out)
    return sessions.select("session_id", out.alias("chain"))


def classify_turns(entities: DataFrame, links: DataFrame, existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(subjects, links to append, counts) of confirmed assignments.

    ``existing`` gives (subject_id, turn_ids); ``new`` gives (spec, workspace_id, name, parent_id, parent_name, turn_ids)
    with a number of its own per row.  Subjects without a parent are created first; those with a parent take the one
    given by id, else the first created of that name, else the smallest known entity of that name, else none.  A pair of
    turn and subject that is already linked is skipped.  New subjects get ids above the known ones, in the order of
    ``spec``, roots first.
    """
    low = lambda c: F.lower(F.trim(F.col(c)))
    root = F.col("parent_id").isNull() & F.col("parent_name").isNull()
    most = entities.agg(F.coalesce(F.max("id"), F.lit(0)).alias("most"))
    # Confirmed by a person and therefore few; numbering them needs one order.
    numbered = new.withColumn("n", F.row_number().over(Window.orderBy((~root).cast("int"), "spec"))).crossJoin(F.broadcast(most)).withColumn("id", F.col("most") + F.col("n"))  # one row
    created = numbered.filter(root).groupBy("workspace_id", low("name").alias("key")).agg(F.max("id").alias("by_new"))
    known = entities.groupBy("workspace_id", F.col("name_normalized").alias("key")).agg(F.min("id").alias("by_name"))
    key = numbered.withColumn("key", low("parent_name")).join(created, ["workspace_id", "key"], "left").join(known, ["workspace_id", "key"], "left")
    subjects = key.select("spec", "id", "workspace_id", "name", F.coalesce("parent_id", "by_new", "by_name").alias("parent_id"), "turn_ids")
    wanted = existing.select("subject_id", F.explode("turn_ids").alias("turn_id")).unionByName(subjects.select(F.col("id").alias("subject_id"), F.explode("turn_ids").alias("turn_id")))
    fresh, counts = insert_absent(links, wanted, ["turn_id", "subject_id"])
    return subjects.drop("turn_ids"), fresh, counts.crossJoin(F.broadcast(subjects.agg(F.count(F.lit(1)).alias("created"))))  # one row


def topic(text: Column) -> Column:
    """The subject chain of the first rule that fits, else 'Other'."""
    out = F.lit("Other")
    for chain, pattern in reversed(TOPIC_RULES):
        out = F.when(text.rlike(pattern), chain).otherwise(out)
    return out


def first_texts(turns: DataFrame) -> DataFrame:
    """(episode_id, text): the first user text of each episode."""
    said = turns.filter(F.lower(F.trim("role")).isin("user", "human") & (F.length(F.trim("text")) > 0))
    return said.groupBy("episode_id").agg(F.min(F.struct("sequence", "id", "text")).alias("first")).select("episode_id", "first.text")


def classified(turns: DataFrame) -> DataFrame:
    """(episode_id, chain) by the first user text."""
    return first_texts(turns.filter("episode_id is not null")).select("episode_id", topic(F.col("text")).alias("chain"))


def chain_links(chains: DataFrame) -> DataFrame:
    """(episode_id, subject, parent, depth): every ancestor of an 'A>B>C' chain, roots without a parent."""
    names = F.transform(F.split("chain", ">"), lambda x: F.trim(x))
    return chains.select("episode_id", F.posexplode(names).alias("depth", "subject"), names.alias("names")).select(
        "episode_id", "subject", F.when(F.col("depth") > 0, F.get("names", F.col("depth") - 1)).alias("parent"), "depth"
    )


def session_label(name: Column) -> Column:
    """Names that are labels of sessions, not of things: chains, sums, or with a date."""
    return name.contains(">") | name.contains("+") | name.rlike(r"\d{4}-\d{2}-\d{2}")


def work_subject(cwd: Column) -> Column:
    """Last part of a working directory, without outer separators."""
    return F.lower(F.element_at(F.split(F.regexp_replace(F.replace(cwd, F.lit("\\"), F.lit("/")), "^/+|/+$", ""), "/"), -1))


def running_budget(turns: DataFrame, each: int = 4_000, total: int = 800_000) -> DataFrame:
    """Turns of each episode, each cut to ``each`` characters, as long as their sum stays within ``total``."""
    cut = turns.withColumn("cut", F.substring("text", 1, each))
    return running(cut, "episode_id", ["sequence", "id"], {"used": F.length("cut")}).filter(F.col("used") <= total)
