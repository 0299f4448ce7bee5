"""Mixing sources to target shares of the total tokens, by Poisson replication.

Each source gets a mean number of uses per record from its target share; a record's own number is the inverse Poisson
distribution at a uniform number hashed from its id, cut at the source's largest allowed number (the mean is solved for
the cut distribution, so the cut costs no share).  Records are repeated by exploding them and the result is ordered by a
hash of id and copy, which shuffles it globally and always the same way.

The total is the largest at which no source needs more than its allowed uses, or the one asked for.  At the largest
total the source that binds it is used ``max_repeats`` times throughout, i.e. taken whole and not drawn; a smaller total
has every source drawn.  ``error`` in the shares is what is left between a share and its target: a share is met to about
1 / sqrt(records used), so a source of which the mix takes fewer than some hundred records may miss it visibly.

Defined results: sources are compared without case and outer blanks; records whose source is null or has no target, and
records without tokens, are not used; a source with a target but no tokens is reported with share 0; null ids are left
out, repeated ids count once; no targets or no records give no rows.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.scratch import Scratch
from memloom.tables import once_by_key

#: Vocabulary of a public tokenizer, as ranks; read on the driver and sent to the tasks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CORRECTIONS = 6
#: A source that is this near its target share is not corrected further.
CLOSE = 0.002
#: Fixed value: the pattern by which this vocabulary's tokenizer cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def with_tokens(documents: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows with their number of tokens; null texts have none."""
    raw = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.value.splitlines())}
        encoding = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if isinstance(t, str) else 0 for t in batch[text_col]]
            yield batch.assign(tokens=pd.Series(counts, index=batch.index, dtype="int64"))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return documents.mapInPandas(run, f"{kind}, tokens long")


def cut_poisson(mean: float, most: int) -> list[float]:
    """Cumulative probabilities of 0 .. most - 1 uses, so that min(Poisson, most) has the given mean."""
    if most <= 0 or mean <= 0:
        return [1.0] * max(0, most)
    if mean >= most * (1 - 1e-9):
        return [0.0] * most

    def cumulative(rate: float) -> list[float]:
        # In logarithms, so that no rate is too large for the first term.
        out, total = [], 0.0
        for k in range(most):
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            out.append(min(total, 1.0))
        return out

    # The mean of min(X, most) is the sum over k < most of P(X > k).
    reached = lambda rate: sum(1 - c for c in cumulative(rate))
    low, high = 0.0, max(1.0, mean)
    while reached(high) < mean:
        low, high = high, 2 * high
    for _ in range(100):
        rate = (low + high) / 2
        low, high = (rate, high) if reached(rate) < mean else (low, rate)
    return cumulative((low + high) / 2)


def mixed(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(records (doc_id, copy, source, tokens, text, place_key), shares); place_key orders the mix."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "mix")
    clean = F.lower(F.trim(F.col("source")))
    goals = targets.select(clean.alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).filter(
        "source is not null and target_share > 0 and max_repeats > 0"
    ).dropDuplicates(["source"])
    base = documents.select(F.col("doc_id").cast("long"), clean.alias("source"), "text").filter("doc_id is not null and source is not null and length(text) > 0")
    counted = scratch.write(with_tokens(once_by_key(base.join(F.broadcast(goals.select("source")), "source", "left_semi"), "doc_id")), "counted")
    # One row for each target: as many as the table of targets has.
    have = counted.filter("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("records"))
    plan = [r.asDict() for r in goals.join(have, "source", "left").collect()]
    usable = [r for r in plan if r["available"]]
    if total is None:
        total = min((r["max_repeats"] * r["available"] / r["target_share"] for r in usable), default=0.0)
    uniform = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    uses = F.size(F.filter("steps", lambda c: c <= uniform))
    means = {r["source"]: r["target_share"] * total / r["available"] for r in usable}

    def table() -> DataFrame:
        rows = [(r["source"], cut_poisson(means[r["source"]], r["max_repeats"])) for r in usable]
        return spark.createDataFrame(rows, "source string, steps array<double>")

    # A record's uniform number stays, so the tokens used rise with the mean: a few corrections take out the chance.  The
    # best means seen are kept; what is left shows in the shares, since records are whole and may be few.
    sizes = counted.filter("tokens > 0").select("doc_id", "source", "tokens")
    best = (math.inf, dict(means))
    for _ in range(CORRECTIONS):
        got = dict(sizes.join(F.broadcast(table()), "source").groupBy("source").agg(F.sum(F.col("tokens") * uses)).collect())
        off, tried = 0.0, dict(means)
        for r in usable:
            goal = r["target_share"] * total
            if means[r["source"]] < r["max_repeats"] * (1 - 1e-9):
                used = got.get(r["source"]) or 0
                off = max(off, abs(used / goal - 1))
                means[r["source"]] = min(means[r["source"]] * (goal / used if used else 2.0), r["max_repeats"] * (1 - 1e-6))
        before = best[0]
        if off < before:
            best = (off, tried)
        if off < CLOSE or off > 0.7 * before:  # near enough, or as near as whole records come
            break
    means = best[1]
    steps = table()
    repeated = (
        counted.filter("tokens > 0").join(F.broadcast(steps), "source").withColumn("uses", uses).filter("uses > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("uses"))))
        .select("doc_id", "copy", "source", "tokens", "text", F.xxhash64("doc_id", "copy", F.lit(seed + 1)).alias("place_key"))
    )
    used = repeated.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("used"), F.max("copy").alias("most_uses"))
    whole = used.agg(F.sum("tokens").alias("whole"))
    shares = (
        goals.join(have, "source", "left").join(used, "source", "left").crossJoin(whole)  # one row
        .select(
            "source", "target_share", "max_repeats", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("used", F.lit(0)).alias("used"),
            F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("share"),
            (F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)) - F.col("target_share")).alias("error"),
        )
    )
    return repeated.orderBy("place_key"), shares
