"""Ingest pipelines and write operators; tables are versioned by overwriting, never updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text as X
from memloom.operators.ordered import running


def dedupe_turns(turns: DataFrame) -> DataFrame:
    """Of turns equal in episode, role and text the one with the lowest sequence (then id) stays.

    Null texts are equal to each other; an empty table gives no rows.
    """
    # Minima by a 128-bit mark of the text are combined before the shuffle, so texts stay where they are and no group, however
    # many copies it has, is sorted; a mark of two 64-bit hashes stands for the text.
    marks = [F.xxhash64("text").alias("_h"), F.xxhash64(F.lit(7), "text", F.length("text")).alias("_g"), F.col("text").isNull().alias("_n")]
    first = turns.select("episode_id", "role", "id", "sequence", *marks).groupBy("episode_id", "role", "_h", "_g", "_n").agg(F.min(F.struct("sequence", "id")).alias("f"))
    return turns.join(first.select(F.col("f.id").alias("id")), "id", "left_semi")


def dropped_duplicates(turns: DataFrame) -> DataFrame:
    """(episode_id, kept, dropped) of ``dedupe_turns``."""
    each = turns.groupBy("episode_id", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("episode_id").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.col("n") - 1).alias("dropped"))


def content_dedupe(episodes: DataFrame) -> DataFrame:
    """The first episode of each workspace and content hash."""
    first = Window.partitionBy("workspace_id", F.sha2("content", 256)).orderBy("created_at", "id")
    return episodes.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")


def ledger(episodes: DataFrame) -> DataFrame:
    """Ingest decisions: a repeated hash is a duplicate, a known session an appended version, anything else new."""
    # Only the first row of a key differs from the others, so minima are enough and no window holds a hot session.
    first = lambda key, name: episodes.groupBy("workspace_id", key).agg(F.min(F.struct("created_at", "id")).alias("f")).select(F.col("f.id").alias("id"), F.lit(True).alias(name))
    marked = episodes.join(first("content_hash", "first_hash"), "id", "left").join(first("session_id", "first_session"), "id", "left")
    return marked.select(
        "id", "workspace_id", "session_id", F.when(F.col("first_hash").isNull(), "duplicate").when(F.col("first_session").isNull(), "append_v2").otherwise("new").alias("decision")
    )


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, counts (linked, skipped)) of bridge rows; a second insert of the same rows appends nothing."""
    distinct = new.dropDuplicates(keys)
    fresh = distinct.join(existing.select(*keys), keys, "left_anti")
    known = distinct.join(existing.select(*keys), keys, "left_semi")
    counts = fresh.agg(F.count(F.lit(1)).alias("linked")).crossJoin(F.broadcast(known.agg(F.count(F.lit(1)).alias("skipped"))))  # one row
    return fresh, counts


def upsert_latest(existing: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """New rows replace existing ones of the same key; columns in ``keep`` stay as they were. ``new`` has a row per key."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    others = [c for c in existing.columns if c not in keys]
    pick = lambda c: F.min_by if c in keep else F.max_by
    return both.groupBy(*keys).agg(*[pick(c)(F.struct(F.col(c)), "_new")[c].alias(c) for c in others])


def save_summaries(existing: DataFrame, new: DataFrame, at: Column, keys: list[str] = ("workspace_id", "subject_id", "day")) -> DataFrame:
    """Summaries after an upsert: new ones replace those of the same key and carry the time of the change.

    A number of unique turns that is not given is read as the number of turns.
    """
    unique = F.col("unique_turn_count") if "unique_turn_count" in new.columns else F.lit(None).cast("long")
    stamped = new.withColumn("unique_turn_count", F.coalesce(unique, "turn_count")).withColumn("updated_at", at)
    old = existing
    for name, kind in (("unique_turn_count", "long"), ("updated_at", "timestamp_ntz")):
        old = old if name in old.columns else old.withColumn(name, F.lit(None).cast(kind))
    merged = upsert_latest(old, stamped, list(keys))
    return merged.withColumn("unique_turn_count", F.coalesce("unique_turn_count", "turn_count"))


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    """Append rows to a parquet table, in folders by one column if given; batches are the writer's."""
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def patched(old: Column, patch: Column) -> Column:
    """Null keeps, an empty text clears, anything else replaces."""
    return F.when(patch.isNull(), old).when(patch == "", F.lit(None)).otherwise(patch)


def touched(facts: DataFrame, log: DataFrame) -> DataFrame:
    """Facts with the time they were last read, from an append-only access log."""
    last = log.groupBy("hint_id").agg(F.max("read_at").alias("last_accessed_at"))
    return facts.join(last, "hint_id", "left")


def merged_keywords(old: Column, new: Column) -> Column:
    """Ordered union of two lists; null counts as empty."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(old, empty), F.coalesce(new, empty)))


def resolve_entities(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(workspace_id, name, entity_id, how): by id, else by normalised name, else by alias, else to be created (id null)."""
    low = F.lower(F.trim("name"))
    asked = names.select("workspace_id", "name", low.alias("key")).distinct()
    keys = ["workspace_id", "key"]
    own = entities.select("workspace_id", F.col("id").cast("string").alias("key"), F.col("id").alias("by_id"))
    exact = entities.groupBy("workspace_id", F.col("name_normalized").alias("key")).agg(F.min("id").alias("by_name"))
    alias = aliases.groupBy("workspace_id", F.lower("alias").alias("key")).agg(F.min("entity_id").alias("by_alias"))
    return asked.join(own, keys, "left").join(exact, keys, "left").join(alias, keys, "left").select(
        "workspace_id", "name", F.coalesce("by_id", "by_name", "by_alias").alias("entity_id"),
        F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_name").isNotNull(), "name").when(F.col("by_alias").isNotNull(), "alias").otherwise("new").alias("how"),
    )


def created_entities(resolved: DataFrame) -> DataFrame:
    """(id, workspace_id, name, name_normalized) of the names that ``resolve_entities`` found nothing for, one for each spelling in
    lower case.  The id is a hash of workspace and name, so no order over all names is needed and a rerun gives the same."""
    key = F.lower(F.trim("name"))
    new = resolved.filter("how = 'new'").groupBy("workspace_id", key.alias("name_normalized")).agg(F.min("name").alias("name"))
    return new.select(F.shiftrightunsigned(F.xxhash64("workspace_id", "name_normalized"), 1).alias("id"), "workspace_id", "name", "name_normalized")


def clean_turns(turns: DataFrame) -> DataFrame:
    """Turns with sanitized text and how many lines were taken out."""
    out = turns.withColumn("s", X.sanitized(F.col("text")))
    return out.select(*turns.columns, F.col("s.cleaned").alias("cleaned"), F.size("s.removed").alias("removed_lines"))


def chunks(turns: DataFrame, size: int = 30) -> DataFrame:
    """Chunks of so many turns of each episode, with their first and last sequence."""
    numbered = running(turns, "episode_id", ["sequence", "id"], {"nth": F.lit(1)}).withColumn("chunk", F.floor((F.col("nth") - 1) / size).cast("long"))
    return numbered.groupBy("episode_id", "chunk").agg(F.count(F.lit(1)).alias("turns"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"))


def message_pairs(turns: DataFrame) -> DataFrame:
    """A user turn with the assistant turns that follow it: gaps and islands over a running count of user turns."""
    role = F.lower(F.trim("role"))
    return running(turns, "episode_id", ["sequence", "id"], {"pair": role.isin("user", "human")}).filter("pair > 0").groupBy("episode_id", "pair").agg(
        F.min("sequence").alias("first_sequence"), F.sum(role.isin("assistant", "ai", "model").cast("long")).alias("answers"), F.sum(F.length("text")).alias("chars")
    )


def lookback(pairs: DataFrame, rows: int = 2) -> DataFrame:
    """Each pair with the sequences of the previous ones, joined by '|'; see ``lookback_texts`` for the texts."""
    # Pairs are numbered without gaps, so the previous ones are found by their numbers.
    out = pairs
    for back in range(rows, 0, -1):
        earlier = pairs.select(F.col("episode_id").alias("_e"), (F.col("pair") + back).alias("_p"), F.col("first_sequence").cast("string").alias(f"_before{back}"))
        out = out.join(earlier, (F.col("episode_id") == F.col("_e")) & (F.col("pair") == F.col("_p")), "left").drop("_e", "_p")
    before = [f"_before{back}" for back in range(rows, 0, -1)]
    return out.withColumn("context", F.concat_ws("|", *before)).drop(*before)


def lookback_texts(pairs: DataFrame, rows: int = 2, chars: int = 500) -> DataFrame:
    """(episode_id, pair, context): the heads of the texts (episode_id, pair, text) of the pairs before each one, oldest first."""
    out = pairs.select("episode_id", "pair")
    for back in range(rows, 0, -1):
        earlier = pairs.select("episode_id", (F.col("pair") + back).alias("pair"), F.substring("text", 1, chars).alias(f"_before{back}"))
        out = out.join(earlier, ["episode_id", "pair"], "left")
    before = [f"_before{back}" for back in range(rows, 0, -1)]
    return out.select("episode_id", "pair", F.concat_ws("\n\n", *before).alias("context"))


def chunk_previews(turns: DataFrame, size: int = 30, last: int = 3, chars: int = 200) -> DataFrame:
    """(episode_id, chunk, preview): the heads of the last turns of the chunk before, which a chunk begins with."""
    numbered = running(turns, "episode_id", ["sequence", "id"], {"nth": F.lit(1)}).withColumn("chunk", F.floor((F.col("nth") - 1) / size).cast("long"))
    tail = numbered.filter((F.col("nth") - 1) % size >= size - last)
    heads = tail.groupBy("episode_id", (F.col("chunk") + 1).alias("chunk")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("t")))), lambda x: x["t"]), "\n").alias("preview")
    )
    return numbered.select("episode_id", "chunk").distinct().join(heads, ["episode_id", "chunk"], "left").withColumn("preview", F.coalesce("preview", F.lit("")))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int = 1) -> DataFrame:
    """n rows of each stratum in the order of a hash of their key: the same ones every time."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n)


def head_middle_tail(turns: DataFrame, n: int = 3) -> DataFrame:
    """The first, middle and last n turns of each episode; a turn counts once, in the first part that it is in."""
    sizes = turns.groupBy(F.col("episode_id").alias("_e")).agg(F.count(F.lit(1)).alias("size"))
    placed = running(turns, "episode_id", ["sequence", "id"], {"nth": F.lit(1)}).join(sizes, F.col("episode_id").eqNullSafe(F.col("_e"))).drop("_e")
    middle = F.floor((F.col("size") - n) / 2)
    part = F.when(F.col("nth") <= n, "head").when(F.col("nth") > F.col("size") - n, "tail").when((F.col("nth") > middle) & (F.col("nth") <= middle + n), "middle")
    return placed.withColumn("part", part).filter(F.col("part").isNotNull())
