"""Search and ranking: nearest by cosine, term scores, reciprocal-rank fusion, decay, diversity-aware selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text as X

#: Fusion constant and weights of the three ranked lists.
RRF_K = 60
WEIGHTS = {"graph": 1.0, "vector": 1.0, "text": 0.5}


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double precision; null if a number is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def nearest_to(df: DataFrame, query: Sequence[float], vector_col: str, id_col: str, k: int) -> DataFrame:
    """(id, similarity) of the k rows nearest to one vector, ties to the smaller id; one pass, top-k in each task."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = df.select(F.col(id_col).alias("id"), F.round(cosine(F.col(vector_col), literal), 6).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "id").limit(k)


def term_score(text: Column, terms: Sequence[str]) -> Column:
    """How often the terms occur, case ignored: the full-text score used here (plain term frequency)."""
    out = F.lit(0)
    for term in terms:
        out = out + X.occurrences(F.coalesce(text, F.lit("")), F.lit(term))
    return out.cast("long")


def text_search(df: DataFrame, columns: Sequence[str], id_col: str, terms: Sequence[str], k: int) -> DataFrame:
    """(id, field, score): rows by the better of their fields, ties to the smaller id."""
    best = F.greatest(*[F.struct(term_score(F.col(c), terms).alias("score"), F.lit(c).alias("field")) for c in columns]) if len(columns) > 1 else F.struct(term_score(F.col(columns[0]), terms).alias("score"), F.lit(columns[0]).alias("field"))
    scored = df.select(F.col(id_col).alias("id"), best.alias("b")).filter("b.score > 0")
    return scored.select("id", "b.field", "b.score").orderBy(F.desc("score"), "id").limit(k)


def fused(lists: dict[str, DataFrame], k: int = RRF_K, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (id, place): the sum of weight / (k + place)."""
    parts = None
    for name, ranked in lists.items():
        part = ranked.select("id", (F.lit(float(weights[name])) / (F.lit(float(k)) + F.col("place"))).alias("score"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("id").agg(F.sum("score").alias("rrf_score"))


def rescored(candidates: DataFrame) -> DataFrame:
    """Fusion score times importance times decay by age and type: (id, score)."""
    return candidates.withColumn("score", F.col("rrf_score") * F.col("importance") * X.decay(F.col("age_days"), F.col("kind")))


def minmax(df: DataFrame, score: str, group: str, order: str) -> DataFrame:
    """Scores of each group scaled to 0..1; if all are equal, 1 - (place - 1) / rows by ``order``.

    Bounds are aggregates; only groups of equal scores are put in order.
    """
    ends = df.groupBy(F.col(group).alias("_g")).agg(F.min(score).alias("_low"), F.max(score).alias("_high"), F.count(F.lit(1)).alias("_n"))
    joined = df.join(ends, F.col(group).eqNullSafe(F.col("_g")))
    flat = F.col("_high") - F.col("_low") < 1e-9
    place = F.row_number().over(Window.partitionBy("_g").orderBy(F.desc(score), order))
    level = joined.filter(flat).withColumn("scaled", 1.0 - (place - 1) / F.col("_n"))
    spread = joined.filter(~flat).withColumn("scaled", (F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low")))
    return spread.unionByName(level).drop("_g", "_low", "_high", "_n")


def scaled(relevance: np.ndarray) -> np.ndarray:
    """Relevances of ordered rows on 0..1; rows that are all equal go down in equal steps from 1."""
    if not len(relevance):
        return relevance
    low, high = relevance.min(), relevance.max()
    return 1.0 - np.arange(len(relevance)) / len(relevance) if high - low < 1e-9 else (relevance - low) / (high - low)


def select_diverse(ids: Sequence[int], relevance: np.ndarray, vectors: np.ndarray, communities: Sequence[int | None], *, limit: int = 20, balance: float = 0.6, stop: float = 0.1, least: int = 3, bonus: float = 0.05) -> list[int]:
    """Greedy maximal marginal relevance: places of the chosen rows.

    The most relevant row comes first.  Each further step takes the best of balance * relevance - (1 - balance) *
    (largest cosine to a chosen one, at least 0), plus a bonus for a community not seen yet; ties go to the earlier row.
    Once ``least`` rows are chosen it stops at a row whose relevance part and bonus fall below ``stop`` times the first
    row's relevance part.
    """
    n = len(ids)
    if not n:
        return []
    unit = vectors / np.maximum(1e-12, np.linalg.norm(vectors, axis=1, keepdims=True))
    gain = balance * relevance
    at = int(relevance.argmax())
    first, chosen, free, seen = gain[at], [at], np.ones(n, bool), {communities[at]}
    nearest = np.maximum(0.0, unit @ unit[at])
    free[at] = False
    while free.any() and len(chosen) < min(limit, 20):
        fresh = gain + np.array([bonus if c is not None and c not in seen else 0.0 for c in communities])
        at = int(np.where(free, fresh - (1 - balance) * nearest, -np.inf).argmax())
        if len(chosen) >= least and fresh[at] < stop * first:
            break
        chosen.append(at)
        free[at] = False
        seen.add(communities[at])
        nearest = np.maximum(nearest, unit @ unit[at])
    return chosen


def diverse(candidates: DataFrame, group: str, limit: int = 20) -> DataFrame:
    """(group, id, place) by ``select_diverse`` in each group of candidates (id, relevance, vector, community).

    A group is one query's candidate pool, which the fusion before has already cut to a bounded size.  Candidates
    without a vector are left out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["relevance", "id"], ascending=[False, True])
        community = [None if pd.isna(c) else int(c) for c in pdf["community"]]
        picked = select_diverse(pdf["id"].tolist(), scaled(pdf["relevance"].to_numpy()), np.array(pdf["vector"].tolist(), dtype=float), community, limit=limit)
        return pd.DataFrame({group: pdf[group].iloc[picked].to_numpy(), "id": pdf["id"].iloc[picked].to_numpy(), "place": np.arange(1, len(picked) + 1)})

    kind = f"`{group}` {candidates.schema[group].dataType.simpleString()}, id long, place int"
    return candidates.filter("vector is not null").select(group, "id", "relevance", "vector", "community").groupBy(group).applyInPandas(run, kind)


def excerpt_paragraphs(df: DataFrame, id_col: str, text_col: str, terms: Sequence[str]) -> DataFrame:
    """(id, paragraph, score): paragraphs that hold a term, scored by occurrences weighted with the term's length."""
    parts = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, r"\n\s*\n")).alias("paragraph", "body"))
    score = F.lit(0.0)
    for term in terms:
        score = score + X.occurrences(F.col("body"), F.lit(term)) * F.lit(max(1.0, len(term) / 3))
    return parts.withColumn("score", score).filter("score > 0")


def excerpts(df: DataFrame, id_col: str, text_col: str, terms: Sequence[str], budget: int = 1500) -> DataFrame:
    """(id, excerpt): best paragraphs within a budget, in their own order, gaps marked; the head if no term occurs.

    Paragraphs are taken by score, then in order, while they fit; the first of them also if it alone is too long for what
    is left.  All of it is array expressions on one row, so nothing is shuffled and nothing leaves the JVM.
    """
    gap = "\n\n[...]\n\n"
    parts = F.split(F.col(text_col), r"\n\s*\n")

    def score(body: Column) -> Column:
        out = F.lit(0.0)
        for term in terms:
            out = out + X.occurrences(body, F.lit(term)) * F.lit(max(1.0, len(term) / 3))
        return out

    rated = F.filter(F.transform(parts, lambda p, i: F.struct((-score(p)).alias("worse"), i.alias("at"), F.length(p).alias("size"))), lambda x: x["worse"] < 0)
    start = F.struct(F.lit(budget).alias("left"), F.array().cast("array<int>").alias("taken"))

    def take(state: Column, x: Column) -> Column:
        cost = x["size"] + len(gap)
        fits = (cost <= state["left"]) | ((F.size(state["taken"]) == 0) & (state["left"] > 200))
        return F.when(fits, F.struct((state["left"] - cost).alias("left"), F.concat(state["taken"], F.array(x["at"])).alias("taken"))).otherwise(state)

    def put(state: Column, at: Column) -> Column:
        between = F.when(state["last"] < 0, "").when(at == state["last"] + 1, "\n\n").otherwise(gap)
        return F.struct(F.concat(state["text"], between, F.get(F.col("_parts"), at)).alias("text"), at.alias("last"))

    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_body"), parts.alias("_parts"), F.sort_array(F.aggregate(F.array_sort(rated), start, take)["taken"]).alias("_taken"))
    joined = F.aggregate("_taken", F.struct(F.lit("").alias("text"), F.lit(-1).alias("last")), put)["text"]
    text = F.when(F.col("_body").isNull(), None).when(F.size("_taken") == 0, F.substring("_body", 1, budget)).when(F.length(joined) <= budget, joined).otherwise(F.concat(F.substring(joined, 1, budget - 20), F.lit("...")))
    return chosen.select("id", text.alias("excerpt"))
