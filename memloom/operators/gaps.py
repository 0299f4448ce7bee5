"""Coverage gaps: which exchanges of an episode are not reflected in its extracted facts.

Exchanges with enough text are scored by how many of the facts' words they hold, how new they are against the facts, how many names and words they have and how strong their wording is; the priorities rank what to extract next.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions import embed
from memloom.functions import text as X
from memloom.operators.ordered import running
from memloom.scratch import Scratch

LEAST_CHARS = 40
LEAST_PAIR_CHARS = 60
LEAST_WORDS = 15
NOVEL_BELOW = 0.60
SUBSTANTIVE_TOKENS = 5
#: Characters of an exchange that are embedded; exchanges or facts compared at once; ways a frequent word is spread.
EMBEDDED_CHARS = 500
BLOCK = 2_048
SPREAD = 8
#: Words of a quote by which turns are found that may hold it.
KEY_WORDS = 3


#: Tool lines and stock phrases that an answer is rid of, in this order.
_TOOL_LINE = re.compile(r"^\[(?:Read|Search|Grep|Glob|Bash|Edit|Write|Agent|Tool sequence|CODE BLOCK|Output|Bash result)[^\]]*\].*$", re.M)
_PHRASES = [
    re.compile(r, re.I | re.M)
    for r in (
        r"^\s*(you['\u2019]re\s+(absolutely\s+)?(right|correct)[!.]?|(great|excellent|perfect|good)\s+(question|point|catch|idea)[!.]?|(perfect|great|excellent|absolutely|exactly|wonderful|amazing|brilliant)[!.]?)\s*$",
        r"^\s*(i\s+see[.!]?|i\s+understand[.!]?|got\s+it[.!]?|makes\s+sense[.!]?|sure[,!.]?( i\s+can\s+help( with\s+that)?[.!]?)?|of\s+course[.!]?|sounds\s+good[.!]?|interesting[.!]?|noted[.!]?)\s*$",
        r"^\s*(i['\u2019]ll\s+use\s+the\s+todowrite[^.\n]*[.]?|let\s+me\s+update\s+the\s+todo[^.\n]*[.]?|let\s+me\s+think\s+(about\s+this\s+)?step\s+by\s+step[.]?|let\s+me\s+(try\s+)?(a\s+different|another)\s+approach[.]?)\s*",
        r"^\s*(now\s+)?(first[,]?\s+|next[,]?\s+|then[,]?\s+)?(i['\u2019]ll|i\s+will|i['\u2019]m\s+going\s+to|let\s+me|let['\u2019]s)\s+(now\s+)?(check|look|search|examine|analyze|start|begin|try|use|run|create|implement|fix|update|add|write|read|find|explore|investigate|understand|think|verify|"
        r"test|help\s+you|walk\s+you|take\s+a\s+look|do\s+this|approach|get|see)\b[^.\n]*[.\n]?",
        r"^\s*(looking\s+at\s+(this|the)[^,.\n]*[,.]?\s+|based\s+on\s+(this|the|what|my)[^,.\n]*[,.]?\s+|from\s+what\s+i\s+can\s+see[,.]?\s+)",
    )
]
_BLANKS = re.compile(r"\n{3,}")


def cleaned_answer(text: str) -> str:
    """An answer without thinking blocks, tool lines and stock phrases."""
    kept, thinking, blank = [], False, False
    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith("[thinking]"):
            thinking, blank = True, False
        elif not thinking:
            kept.append(line)
        elif not bare:
            blank = True
        elif not blank or bare.startswith(("[", "#")):
            blank = False
        elif not re.match(r"\d+\.", bare):
            thinking = False
            kept.append(line)
    text = _BLANKS.sub("\n\n", _TOOL_LINE.sub("", "\n".join(kept))).strip()
    for phrase in _PHRASES:
        text = phrase.sub("", text)
    return _BLANKS.sub("\n\n", text).strip()


def cleaned(text: Column) -> Column:
    """``cleaned_answer`` of a column; it is a walk over lines with a state, which SQL can't express."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cleaned_answer(t) if isinstance(t, str) else None)

    return run.asNondeterministic()(text)  # so that it runs once, not again in every filter and column


def exchanges(turns: DataFrame) -> DataFrame:
    """(episode_id, workspace_id, pair, text, said, words, count, size): a user turn and the cleaned answers after it.

    Blank turns are none. Left out are exchanges whose answers come to nothing once cleaned and those that are too short as a
    whole; a user turn without answers stays.  ``said`` is the whole with speaker labels, ``count`` and ``size`` its words and distinct words.
    """
    role = F.lower(F.trim("role"))
    user = F.coalesce(role.isin("user", "human"), F.lit(False))
    spoken = turns.filter(F.col("text").rlike(r"\S") & F.col("episode_id").isNotNull()).select("id", "workspace_id", "episode_id", "sequence", "role", "text")
    counted = running(spoken, "episode_id", ["sequence", "id"], {"pair": user}).withColumn("asked", user)
    own = lambda asked: F.transform(F.sort_array(F.collect_list(F.when(F.col("asked") == asked, F.struct("sequence", "id", "text")))), lambda x: x["text"])
    joined = counted.filter(F.col("pair") > 0).groupBy("episode_id", "workspace_id", "pair").agg(F.array_join(own(True), "\n").alias("question"), F.array_join(own(False), "\n\n").alias("raw"))
    kept = joined.withColumn("answer", cleaned(F.col("raw"))).filter((F.length("raw") == 0) | (F.length("answer") >= LEAST_CHARS))
    said = F.concat(F.lit("User: "), F.col("question"), F.when(F.length("answer") > 0, F.concat(F.lit("\n\nAssistant: "), F.col("answer"))).otherwise(""))
    # Words are what blanks part, as written in lower case, the speaker labels included.
    words = F.filter(F.split(F.lower("said"), r"(?U)\s+"), lambda w: F.length(w) > 0)
    return (
        kept.withColumn("said", said).filter(F.length("said") >= LEAST_PAIR_CHARS)
        .withColumn("text", F.when(F.length("answer") > 0, F.concat_ws("\n", "question", "answer")).otherwise(F.col("question")))
        .select("episode_id", "workspace_id", "pair", "text", "said", F.array_distinct(words).alias("words"), F.size(words).alias("count"), F.size(F.array_distinct(words)).alias("size"))
    )


def _hits(said: DataFrame, facts: DataFrame) -> DataFrame:
    """(episode_id, pair, hits): how many distinct words of an exchange are keywords of its workspace's facts.

    Words meet keywords in an equality join; a word frequent in one workspace is spread by the exchange it stands in.
    """
    words = said.select("episode_id", "workspace_id", "pair", F.explode("words").alias("word"))
    known = facts.select("workspace_id", F.explode(X.keywords(F.concat_ws(" ", "subject", "predicate", "object_value", "source_quote"))).alias("word")).distinct()
    wide = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return (
        words.withColumn("salt", F.pmod(F.xxhash64("episode_id", "pair"), F.lit(SPREAD))).join(wide, ["workspace_id", "word", "salt"])
        .groupBy("episode_id", "pair").agg(F.count(F.lit(1)).alias("hits"))
    )


def _novelty(said: DataFrame, facts: DataFrame, embedder) -> DataFrame:  # noqa: ANN001
    """(episode_id, pair, nearest): the largest cosine of an exchange's vector to those of its episode's facts.

    Exchanges and facts of one episode are compared in blocks of bounded size, so no episode is held in one task.
    """
    cut = lambda df, key: df.withColumn("block", F.floor(F.col(key) / BLOCK).cast("long"))
    pairs = cut(said.select("episode_id", "pair", embed.embedded(F.substring("said", 1, EMBEDDED_CHARS), embedder).alias("vector")), "pair")
    told = F.coalesce(F.nullif("source_quote", F.lit("")), F.concat_ws(" ", "subject", "predicate", "object_value"))
    own = facts.filter("episode_id is not null")
    sizes = own.groupBy("episode_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("parts"))
    known = own.join(sizes, "episode_id").select("episode_id", F.pmod(F.xxhash64("hint_id"), F.col("parts")).alias("part"), embed.embedded(told, embedder).alias("vector"))
    # Every block of exchanges meets every part of its episode's facts; nearly all episodes have one of each.
    blocks = pairs.select("episode_id", "block").distinct()
    left = pairs.join(sizes, "episode_id").select("episode_id", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "pair", "vector")
    right = known.join(blocks, "episode_id").select(*[(F.col(c) + 0).alias(f"_{c}") for c in ("episode_id", "block", "part")], "vector")

    def nearest(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"episode_id": [], "pair": [], "nearest": []}).astype({"episode_id": "int64", "pair": "int64", "nearest": "float64"})
        most = (np.stack(a["vector"].to_numpy()) @ np.stack(b["vector"].to_numpy()).T).max(axis=1)
        return pd.DataFrame({"episode_id": a["episode_id"], "pair": a["pair"], "nearest": most.astype("float64")})

    keys = ["episode_id", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*[f"_{k}" for k in keys])).applyInPandas(nearest, "episode_id long, pair long, nearest double")
    return found.groupBy("episode_id", "pair").agg(F.max("nearest").alias("nearest"))


def candidates(m, embedder=embed.hashed) -> DataFrame:  # noqa: ANN001
    """(episode_id, pair, density, novelty, priority) of the exchanges that facts say too little about.

    density is the share of an exchange's distinct words that are keywords of its workspace's facts; exchanges without
    any and with fewer than LEAST_WORDS words are left out.  novelty is 1 less the largest cosine to a fact of the
    episode, by the embedder given; those too near a fact are left out, and an episode without facts keeps all with
    novelty 1.
    """
    names = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("\\b[A-Z][a-z]{3,}\\b"), F.lit(0))))
    scratch = Scratch(m.turns.sparkSession, "gaps")
    said = scratch.write(exchanges(m.turns).select("episode_id", "workspace_id", "pair", "size", "said", "words", "count", names.alias("names"), X.signal_boost(F.col("text")).alias("boost")), "exchanges")
    facts = scratch.write(m.facts.select("hint_id", "workspace_id", "episode_id", "subject", "predicate", "object_value", "source_quote"), "facts")
    keys = ["episode_id", "pair"]
    dense = (
        said.join(_hits(said, facts), keys, "left").withColumn("density", F.coalesce("hits", F.lit(0)) / F.col("size"))
        .filter((F.col("density") > 0) | (F.col("size") >= LEAST_WORDS)).drop("words", "hits")
    )
    kept = scratch.write(dense, "dense")
    scored = (
        kept.join(_novelty(kept, facts, embedder), keys, "left").withColumn("novelty", F.round(1.0 - F.coalesce("nearest", F.lit(0.0)), 6))
        .filter(F.col("nearest").isNull() | (F.col("nearest") < NOVEL_BELOW))
    )
    base = (
        0.30 * F.col("novelty") + 0.25 * F.col("density") + 0.15 * F.least(F.col("names") / 5.0, F.lit(1.0)) + 0.10 * F.least(F.col("count") / 50.0, F.lit(1.0)) + 0.20 * F.least(F.col("boost") / 3.0, F.lit(1.0))
    )
    return scored.withColumn("priority", base * F.when(F.col("boost") > 0, 1.0 + F.col("boost") / 3.0).otherwise(1.0)).select("episode_id", "pair", "density", "novelty", "priority")


def coverage(m) -> DataFrame:  # noqa: ANN001
    """(episode_id, turns, substantive, covered, verdict): skip, gap_fill or full_extract.

    A turn is covered if it holds the whole of a quote of its episode.  Quotes are looked for by the hash of their first
    KEY_WORDS words, so a turn meets only the quotes that may stand in it.
    """
    quotes = m.facts.filter("length(source_quote) > 0").select("episode_id", "source_quote").distinct()
    turns = m.turns.filter("episode_id is not null")
    substantive = turns.filter(X.token_estimate(F.col("text")) >= SUBSTANTIVE_TOKENS)
    pieces = lambda c: F.filter(F.split(c, r"(?U)\W+"), lambda w: F.length(w) > 0)
    # Inner words only: the first and last of a quote may be part of a longer word of the turn.
    words = pieces("source_quote")
    long = quotes.filter(F.size(words) >= KEY_WORDS + 2).select("episode_id", "source_quote", F.xxhash64(*[F.get(words, i) for i in range(1, KEY_WORDS + 1)]).alias("key"))
    short = quotes.filter(F.size(words) < KEY_WORDS + 2)
    said = substantive.join(long.select("episode_id").distinct(), "episode_id", "left_semi").select("episode_id", "id", "text", pieces("text").alias("w"))
    # Words beside each other by shifted copies of the list: no index runs over it.
    beside = F.arrays_zip(*[F.slice("w", i, F.greatest(F.size("w"), F.lit(1))).alias(f"w{i}") for i in range(1, KEY_WORDS + 1)])
    marks = F.array_distinct(F.transform(beside, lambda x: F.xxhash64(*[x[f"w{i}"] for i in range(1, KEY_WORDS + 1)])))
    placed = said.select("episode_id", "id", "text", F.explode(marks).alias("key"))
    by_key = placed.join(long, ["episode_id", "key"]).filter(F.contains("text", "source_quote")).select("episode_id", "id")
    by_text = substantive.join(short, "episode_id").filter(F.contains("text", "source_quote")).select("episode_id", "id")
    covered = by_key.unionByName(by_text).distinct()
    each = turns.groupBy("episode_id").agg(F.count(F.lit(1)).alias("turns"))
    some = substantive.groupBy("episode_id").agg(F.count(F.lit(1)).alias("substantive"))
    done = covered.groupBy("episode_id").agg(F.count(F.lit(1)).alias("covered"))
    joined = each.join(some, "episode_id", "left").join(done, "episode_id", "left").na.fill(0, ["substantive", "covered"])
    share = F.when(F.col("substantive") > 0, F.col("covered") / F.col("substantive")).otherwise(1.0)
    return joined.withColumn("verdict", F.when((F.col("turns") < 10) | (share >= 0.95), "skip").when(share < 0.50, "full_extract").otherwise("gap_fill"))
