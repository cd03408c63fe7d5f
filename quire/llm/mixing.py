"""Problem 8: combine sources so that each makes up its target share of the tokens.

Method: Poisson replication.  Every document draws its number of copies from a Poisson
distribution with its source's mean repetition rate, inverted at a uniform number that
a hash of document and seed gives; documents are exploded by their count and shuffled
over the whole cluster by another hash.

The means are calibrated.  A document's count is a step function of the mean, so the
tokens of a source grow with the mean in known steps; one pass sums them on a fixed grid
of means, whatever the number of documents, and the driver picks from that small table
the mean whose tokens come nearest to the target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.tokens import token_count
from quire.session import cut_lineage, load

SEED = 17
GRID = 64  # means tried per source
FULL = 40.0  # a mean at which every document reaches its cap


def uniform(key: Column, seed: int = SEED) -> Column:
    """Number in [0, 1) from a hash of ``key``: the same in every run and partitioning."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))


def poisson_steps(mean: float, cap: int) -> list[float]:
    """Cumulative probabilities of 0 to cap - 1 events: the quantile is how many a uniform number reaches."""
    term, total, out = math.exp(-mean), 0.0, []
    for k in range(cap):
        total += term
        out.append(min(total, 1.0))
        term *= mean / (k + 1)
    return out


def expected(mean: float, cap: int) -> float:
    """Expected copies if counts above ``cap`` are cut to it."""
    return sum(1 - p for p in poisson_steps(mean, cap))


def mean_for(rate: float, cap: int) -> float:
    """The Poisson mean that gives ``rate`` copies a document after the cap; FULL if only the cap itself does."""
    if rate >= expected(FULL, cap):
        return FULL
    low, high = 0.0, FULL
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if expected(mid, cap) < rate else (low, mid)
    return high


def plan(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> tuple[float, dict[str, float]]:
    """Largest total that no source with documents has to exceed its cap for, and each source's copies a document.

    A source without tokens can't give its share; the others keep their proportions.
    """
    able = {s: t for s, t in targets.items() if tokens.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    if not able:
        return 0.0, {}
    total = min(tokens[s] * cap / share for s, (share, cap) in able.items())
    return total, {s: total * share / tokens[s] for s, (share, _) in able.items()}


def _copies(u: Column, steps: Column, cap: Column) -> Column:
    """Poisson quantile at ``u``, at most ``cap``."""
    return F.least(F.size(F.filter(steps, lambda p: p <= u)), cap)


def replicate(docs: DataFrame, targets: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mixed corpus (doc_id, source, n_tokens, copy, place) and the report of shares.

    ``docs``: (doc_id, source, text); ``targets``: (source, target_share, max_repeats), a
    small fixed table.  Documents of other or null sources, and those without a token, are
    left out.  Repeated rows of a document count once.  ``place`` orders the mix at random.
    The report has a row for every target: (source, target_share, available_tokens,
    n_docs, n_copies, max_used, tokens, actual_share); a source without documents reaches 0.
    """
    spark = docs.sparkSession
    wanted = {r.source: (float(r.target_share), int(r.max_repeats)) for r in targets.collect()}
    own = docs.where(F.col("source").isin(list(wanted)) & F.col("text").isNotNull())
    # Tokens are counted first, so that repeated rows are told by a hash and no text is shuffled.
    sized = own.select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"), F.md5("text").alias("_of")).where("n_tokens > 0").distinct().drop("_of")
    sized = cut_lineage(sized.withColumn("u", uniform(F.col("doc_id"), seed)))
    have = {r.source: int(r.t) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    total, rates = plan(have, wanted)

    def table(means: list[tuple[str, int, float]]) -> DataFrame:
        rows = [(s, i, m, poisson_steps(m, wanted[s][1]), wanted[s][1]) for s, i, m in means]
        return F.broadcast(spark.createDataFrame(rows, "source string, i int, mean double, steps array<double>, cap int"))

    grid = []
    for s, rate in rates.items():
        middle = mean_for(rate, wanted[s][1])
        grid += [(s, i, middle if middle >= FULL else middle * (0.5 + i / (GRID - 1))) for i in range(GRID)]
        grid.append((s, GRID, middle))
    best: dict[str, tuple[float, float]] = {}
    if grid:
        reached = (
            sized.join(table(grid), "source")
            .groupBy("source", "i", "mean")
            .agg(F.sum(F.col("n_tokens") * _copies(F.col("u"), F.col("steps"), F.col("cap"))).alias("t"))
        )
        for r in sorted(reached.collect(), key=lambda r: (r.source, r.i)):  # GRID + 1 rows a source
            off = abs(float(r.t) - total * wanted[r.source][0])
            if r.source not in best or off < best[r.source][0]:
                best[r.source] = (off, r.mean)
    chosen = [(s, 0, m) for s, (_, m) in best.items()] or [(s, 0, 0.0) for s in list(wanted)[:1]]
    counted = sized.join(table(chosen), "source").withColumn("copies", _copies(F.col("u"), F.col("steps"), F.col("cap")))
    mixed = (
        counted.where("copies > 0")
        .select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .withColumn("place", F.xxhash64("doc_id", "copy", F.lit(seed + 1)))
    )
    used = counted.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("copies").alias("n_copies"), F.max("copies").alias("max_used"),
        F.sum("n_tokens").alias("available_tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"),
    )
    everything = F.sum("tokens").over(Window.partitionBy())  # over the few targets
    report = (
        targets.select("source", "target_share")
        .join(used, "source", "left")
        .select(
            "source", "target_share",
            *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("available_tokens", "n_docs", "n_copies", "max_used", "tokens")),
            F.coalesce(F.col("tokens") / F.nullif(everything, F.lit(0)), F.lit(0.0)).alias("actual_share"),
        )
    )
    return mixed, report


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixed corpus in random order: (doc_id, source, n_tokens, copy)."""
    mixed, _ = replicate(load(spark, d, "documents"), load(spark, d, "mix_targets"))
    return mixed.repartitionByRange("place").sortWithinPartitions("place").drop("place")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mix reaches, per source."""
    return replicate(load(spark, d, "documents"), load(spark, d, "mix_targets"))[1]
