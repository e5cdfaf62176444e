"""Mixing sources: temperature weights, and a schedule of permuted blocks that realises them.

A source with share ``p`` of all tokens gets the weight ``p^a / sum p^a``. The exponent ``a`` is
bisected: the flattest mixture (smallest ``a`` from 0 on) whose entropy is at most the target and
which repeats no source more often than allowed. The upper end is 1, the natural mixture, and is
doubled while the entropy is above the target. Where no exponent keeps both limits (equal shares
have one mixture only), the limit of repeats is kept as far as it can be, the mixture says
``met=False``, and a warning is given. A source's budget is its weight times the total
budget. It is spent in passes over the source, each in an order of its own; the last pass ends with
the document that reaches the budget. The schedule is cut into blocks that hold every source at
its weight, and each block is permuted.

All of it is DataFrame operations. Sources are a table, never collected: a step of the bisection
is one aggregate over a grid of exponents. A source is ordered in buckets of some thousand
documents, so no source, however large, meets in one task.

Edge cases: a null source is a source; empty and null texts count one token, like the end of any
other; equal rows are scheduled each; an empty table gives an empty schedule; with one source the
exponent is 0 and the weight 1. Input columns pass through; own columns start with ``mix_``.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

GRID, ROUNDS = 32, 6
#: Exponents are doubled up to here; sources that no such power tells apart count as equal.
MOST_EXPONENT = 2.0**20
BUCKET_ROWS = 4096
BLOCK_TOKENS = 1 << 20


@dataclass(frozen=True)
class Mixture:
    """``weights``: ``(source, tokens, rows, weight, budget, repeats)``; ``total``: the budget;
    ``met``: whether the limits are kept."""

    exponent: float
    entropy: float
    total: float
    weights: DataFrame
    met: bool = True


def token_count(text: Column | str) -> Column:
    """Words of a text, and one for its end."""
    col = F.trim(F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"\s+", " "))
    return F.when(F.length(col) == 0, F.lit(1)).otherwise(F.size(F.split(col, " ")) + 1).cast("bigint")


def _at(shares: DataFrame, exponents: list[float], full_pass: bool, epochs: float) -> list[dict]:
    """Entropy, and repeats of the most repeated source, at each exponent."""
    tried = shares.withColumn("a", F.explode(F.array(*[F.lit(a) for a in exponents])))
    power = F.pow("part", "a")
    z = F.sum(power)
    entropy = F.log(z) - F.sum(power * F.col("a") * F.log("part")) / z
    most = F.max(power / F.col("share"))
    least = F.min(power / F.col("share"))
    repeats = F.try_divide(most, least) if full_pass else F.lit(epochs) * most / z
    scale = F.try_divide(F.lit(1.0), least) if full_pass else F.lit(epochs) / z
    rows = tried.groupBy("a").agg(
        entropy.alias("entropy"), repeats.alias("repeats"), z.alias("z"), (scale * z).alias("epochs")
    )
    return sorted((r.asDict() for r in rows.collect()), key=lambda r: r["a"])


def _first(at: Callable[[list[float]], list[dict]], low: float, high: float, good: Callable[[dict], bool]) -> tuple[dict, dict]:
    """The smallest exponent of ``low..high`` that is good, as ``high`` is, and the one before it."""
    for _ in range(ROUNDS):
        step = (high - low) / GRID
        tried = at([low + i * step for i in range(GRID)] + [high])
        first = next(i for i, r in enumerate(tried) if i == GRID or good(r))
        before = tried[max(first - 1, 0)]
        if first == 0:
            break
        low, high = before["a"], tried[first]["a"]
    return before, tried[first]


def mixture(
    docs: DataFrame, source: str = "source", tokens: str = "mix_tokens",
    target_entropy: float | None = None, max_repeats: float = 4.0, epochs: float = 1.0,
    full_pass: bool = False,
) -> Mixture:
    """Weights and budgets of the sources.

    ``target_entropy`` is a share (0 to 1) of the largest possible entropy: the mixture gets no
    flatter. ``epochs`` is the total budget in passes over all tokens; with ``full_pass`` the budget
    is instead the smallest that goes through every source at least once, so no document is left out.
    """
    sums = cut(
        docs.groupBy(F.col(source).alias("source"))
        .agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("rows")),
        "mixing-sources",
    )
    facts = sums.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max("tokens").alias("most")).first()
    total, n = facts["t"] or 0, facts["n"]
    share = F.col("tokens") / F.lit(float(max(total, 1)))
    # powers of parts of the largest source stay in range however large the exponent is
    part = F.col("tokens") / F.lit(float(max(facts["most"] or 0, 1)))
    shares = sums.withColumn("share", share).withColumn("part", part)
    limit = math.inf if target_entropy is None or n < 2 else target_entropy * math.log(n)

    def at(exponents: list[float]) -> list[dict]:
        return _at(shares, exponents, full_pass, epochs)

    def low_enough(r: dict) -> bool:
        return r["entropy"] <= limit + 1e-12

    def seldom(r: dict) -> bool:
        return r["repeats"] is not None and r["repeats"] <= max_repeats + 1e-12

    met, found = True, {"a": 0.0, "entropy": 0.0, "z": 1.0, "epochs": epochs}
    if total:
        # up to 1 both the entropy and the repeats fall; above, the repeats rise again
        low, (found,) = 0.0, at([1.0])
        natural = found
        while not low_enough(found) and found["a"] < MOST_EXPONENT:
            low, (found,) = found["a"], at([2 * found["a"]])
        met = low_enough(found) and seldom(natural)
        if not met:
            found = natural
        elif found["a"] == 1:
            found = _first(at, low, 1.0, lambda r: low_enough(r) and seldom(r))[1]
        else:
            found = _first(at, low, found["a"], low_enough)[1]
            met = seldom(found)
            if not met:
                found = _first(at, 1.0, found["a"], lambda r: not seldom(r))[0]
        if not met:
            warnings.warn(
                f"no exponent keeps an entropy of at most {limit} and at most {max_repeats} repeats; "
                f"taken: {found['a']} with {found['entropy']} and {found['repeats']}", stacklevel=2,
            )
    weight = F.pow("part", F.lit(found["a"])) / F.lit(found["z"])
    # so that a whole number of passes is not missed by a rounding error
    budget = F.round(F.col("weight") * F.lit(found["epochs"] * total), 3)
    weights = shares.withColumn("weight", weight).withColumn("budget", budget).select(
        "source", "tokens", "rows", "weight", "budget", (F.col("budget") / F.col("tokens")).alias("repeats")
    )
    return Mixture(found["a"], found["entropy"], found["epochs"] * total, weights, met)


def schedule(
    docs: DataFrame, mixed: Mixture, source: str = "source", tokens: str = "mix_tokens",
    id_cols: tuple[str, ...] = ("doc_id",), seed: int = 7, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """The documents as often as their source's budget wants them, with ``mix_pass`` (from 0),
    ``mix_before`` (tokens of the source spent before), ``mix_block`` and ``mix_order`` (a hash:
    the order within the block). ``id_cols`` tell rows apart; rows that agree in them are
    interchangeable."""
    named = mixed.weights.select(*[F.col(c).alias(f"mix_{c}") for c in ("source", "rows", "tokens", "weight", "budget")])
    named = named.withColumnRenamed("mix_tokens", "mix_size")
    # a budget that rounds to nothing is spent by no row of the first pass
    passes = F.greatest(F.ceil(F.col("mix_budget") / F.col("mix_size")).cast("int"), F.lit(1))
    key = F.xxhash64(F.lit(seed), "mix_pass", *id_cols)
    buckets = F.ceil(F.col("mix_rows") / BUCKET_ROWS).cast("bigint")
    # the order in a pass is that of ``mix_key``; a bucket is a range of keys
    bucket = F.floor((F.col("mix_key") / F.lit(2.0**64) + 0.5) * buckets).cast("bigint")
    rows = (
        docs.join(named, F.col(source).eqNullSafe(F.col("mix_source")))
        .withColumn("mix_pass", F.explode(F.sequence(F.lit(0), passes - 1)))
        .withColumn("mix_key", key)
        .withColumn("mix_bucket", F.least(bucket, buckets - 1))
    )
    # a source in columns without null, so that one exchange serves the windows and the join
    rows = rows.withColumn("mix_known", F.col("mix_source").isNotNull()).withColumn("mix_name", F.coalesce(F.col("mix_source").cast("string"), F.lit("")))
    place = ["mix_known", "mix_name", "mix_pass", "mix_bucket"]
    earlier = Window.partitionBy("mix_known", "mix_name", "mix_pass").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*place).agg(F.sum(tokens).alias("mix_sum"))
        .withColumn("mix_start", F.coalesce(F.sum("mix_sum").over(earlier), F.lit(0)))
        .select(*place, "mix_start")
    )
    own = Window.partitionBy(*place).orderBy("mix_key", *id_cols).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("mix_pass") * F.col("mix_size") + F.col("mix_start") + F.coalesce(F.col("mix_own"), F.lit(0))
    block = F.floor(F.col("mix_before") / (F.col("mix_weight") * F.lit(float(block_tokens)))).cast("bigint")
    return (
        rows.withColumn("mix_own", F.sum(tokens).over(own))
        .join(starts, place)
        .withColumn("mix_before", before.cast("bigint"))
        .filter(F.col("mix_before") < F.col("mix_budget"))
        .withColumn("mix_block", block)
        .withColumn("mix_order", F.xxhash64(F.lit(seed + 1), "mix_pass", *id_cols))
        .select(*docs.columns, "mix_pass", "mix_before", "mix_block", "mix_order")
    )


def permuted(scheduled: DataFrame, columns: list[str]) -> DataFrame:
    """The schedule's documents with whole blocks together and each block in its order."""
    return scheduled.repartition("mix_block").sortWithinPartitions("mix_block", "mix_order").select(*columns)
