"""Mixing sources to target shares by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import materialize


def source_key(name: Column) -> Column:
    """Names as compared: outer blanks removed, lower case, inner blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"^[\s ]+|[\s ]+$", "")), r"[\s -]", "_")


BINS = 4096


class Mixture:
    """Result of ``balance``: ``sources`` (one row per listed source), ``rates`` (one row per document of these) and ``rest`` (the other documents, at rate 0)."""

    def __init__(self, sources: DataFrame, rates: DataFrame, rest: DataFrame):
        self.sources, self.rates, self.rest = sources, rates, rest


def balance(
    sizes: DataFrame, targets: DataFrame, tolerance: float = 1e-6, most_steps: int = 60, seed: int = 17
) -> Mixture:
    """Document rates whose token totals meet each source's target, and whole copies.

    ``sizes``: doc_id, source, n_tokens; ``targets``: source, target_weight,
    max_repeats (one row per source, a short fixed table). The mixture is as large
    as all documents together; a source's target is its share of the weights.

    Of all rates that meet the targets and stay within max_repeats those of least
    relative entropy to one copy each are r = min(max_repeats, exp(lambda_s * n / mean_s)):
    the convex dual has one multiplier per source. Newton's steps on it, kept inside
    a bracket, need a few sums per source and step, computed over a table of (source,
    n_tokens, documents) that all partitions share in. A source whose multiplier has
    driven every document to max_repeats, with the sum still below the target, is told
    unreachable by that step and keeps that rate. A source of target 0 gets rate 0.

    Rates become copies by rounding up where a hash of doc_id, as a number from 0 to 1,
    lies below their fraction, moved by a small shift per source that makes the size of
    the copies meet the target; the shift comes from one table of at most 2 * BINS sums
    per source. Reruns agree.
    Documents without a listed source get rate 0 but count in the total. Null
    n_tokens count as 0; null weights as 0, null max_repeats as 1; empty sizes give
    targets of 0 and no unreachable source.
    """
    spark = sizes.sparkSession
    rows = targets.where(F.col("source").isNotNull()).select("source", source_key(F.col("source")).alias("k"), "target_weight", "max_repeats").collect()
    weight = {r["k"]: max(0.0, r["target_weight"] or 0.0) for r in rows}
    cap = {r["k"]: int(1 if r["max_repeats"] is None else max(0, r["max_repeats"])) for r in rows}
    name = {r["k"]: r["source"] for r in rows}
    all_weight = sum(weight.values()) or 1.0

    keyed = sizes.select("doc_id", source_key(F.col("source")).alias("k"), F.coalesce("n_tokens", F.lit(0)).alias("t"))
    # doc_id, key and size of each document: no texts
    keyed = materialize(keyed, "p7sizes")
    per_size = keyed.groupBy("k", "t").agg(F.count("*").alias("c"))
    per_size = materialize(per_size, "p7hist")
    have = {
        r["k"]: (r["docs"], r["tokens"])
        for r in per_size.groupBy("k").agg(F.sum("c").alias("docs"), F.sum(F.col("c") * F.col("t")).alias("tokens"))
        .join(F.broadcast(spark.createDataFrame([(k,) for k in name], "k string")), "k", "left_semi").collect()
    }
    total = per_size.agg(F.sum(F.col("c") * F.col("t"))).first()[0] or 0
    docs = {k: have.get(k, (0, 0))[0] for k in name}
    tokens = {k: have.get(k, (0, 0))[1] for k in name}
    target = {k: total * weight[k] / all_weight for k in name}
    reachable = {k: bool(tokens[k]) or target[k] <= 0 for k in name}
    mean = {k: tokens[k] / docs[k] if docs[k] and tokens[k] else 1.0 for k in name}
    lam = {k: 0.0 for k in name}
    low, high = {k: -math.inf for k in name}, {k: math.inf for k in name}
    open_ = {k for k in name if tokens[k] and target[k] > 0}
    per_size = per_size.persist()

    def with_rate(df: DataFrame, keys) -> DataFrame:
        side = spark.createDataFrame(
            [(k, lam[k], mean[k], float(cap[k]), target[k] <= 0, not reachable[k]) for k in keys],
            "k string, lam double, mean double, cap double, none boolean, full boolean",
        )  # one row per listed source
        free = F.exp(F.least(F.col("lam") * F.col("t") / F.col("mean"), F.lit(700.0)))
        rate = F.when(F.col("none"), F.lit(0.0)).when(F.col("full"), F.col("cap")).otherwise(F.least("cap", free))
        return df.join(F.broadcast(side), "k").withColumn("rate", rate).withColumn("tight", free >= F.col("cap"))

    for _ in range(most_steps):
        if not open_:
            break
        got = (
            with_rate(per_size, sorted(open_))
            .groupBy("k")
            .agg(
                F.sum(F.col("c") * F.col("t") * F.col("rate")).alias("g"),
                F.sum(F.when(~F.col("tight"), F.col("c") * F.col("t") * F.col("t") / F.col("mean") * F.col("rate")).otherwise(0.0)).alias("h"),
                F.count_if(~F.col("tight") & (F.col("t") > 0)).alias("loose"),
            )
            .collect()
        )
        for r in got:
            k, miss = r["k"], r["g"] - target[r["k"]]
            if not r["loose"] and miss < 0:
                reachable[k] = False  # all at their most, and still below
            if not reachable[k] or abs(miss) <= tolerance * target[k]:
                open_.discard(k)
                continue
            if miss < 0:
                low[k] = lam[k]
            else:
                high[k] = lam[k]
            step = lam[k] - miss / r["h"] if r["h"] > 0 else math.nan
            if not (low[k] < step < high[k]) or abs(step - lam[k]) > 20:
                if math.isinf(high[k]):
                    step = max(1.0, 4 * lam[k])
                elif math.isinf(low[k]):
                    step = min(-1.0, 2 * lam[k])
                else:
                    step = (low[k] + high[k]) / 2
            lam[k] = step

    per_size.unpersist()
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    whole = F.floor("rate")
    fraction = F.col("rate") - whole
    rated = with_rate(keyed, sorted(name)).withColumn("bin", F.when(fraction > 0, F.floor((u - fraction) * BINS).cast("int")))
    sums = rated.groupBy("k", "bin").agg(F.sum("t").alias("t"), F.sum(whole * F.col("t")).alias("w")).orderBy("k", "bin").collect()
    shift = {}
    for k in name:
        mine = [r for r in sums if r["k"] == k]
        size, best = sum(r["w"] for r in mine), (None, -BINS - 1)
        for at, more in [(-BINS - 1, 0), *((r["bin"], r["t"]) for r in mine if r["bin"] is not None)]:
            size += more
            miss = abs(size - target[k])
            if best[0] is None or miss < best[0]:
                best = (miss, at)
        shift[k] = best[1]
    last = spark.createDataFrame([(k, b) for k, b in shift.items()], "k string, last int")  # one row per listed source
    rates = rated.join(F.broadcast(last), "k").select(
        "doc_id", "k", F.col("t").alias("n_tokens"), "rate",
        (whole + F.when(F.col("bin") <= F.col("last"), 1).otherwise(0)).cast("long").alias("copies"),
    )
    used = rates.groupBy("k").agg(
        F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens")
    )
    facts = spark.createDataFrame(
        [
            (k, name[k], weight[k] / all_weight, target[k], docs[k], tokens[k], cap[k], cap[k] * tokens[k], reachable[k])
            for k in sorted(name)
        ],
        "k string, source string, target_share double, target_tokens double, documents long, own_tokens long, "
        "max_repeats long, capacity_tokens long, reachable boolean",
    )
    sources = facts.join(used, "k", "left").select(
        *facts.columns[1:], F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens")
    )
    listed = spark.createDataFrame([(k,) for k in sorted(name)], "k string")  # one row per listed source
    rest = keyed.join(F.broadcast(listed), "k", "left_anti").select(
        "doc_id", F.col("k").alias("source"), F.col("t").alias("n_tokens"), F.lit(0.0).alias("rate"), F.lit(0).cast("long").alias("copies")
    )
    return Mixture(sources, rates.select("doc_id", F.col("k").alias("source"), "n_tokens", "rate", "copies"), rest)
