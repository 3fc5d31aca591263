"""Attempts, reservations, budgets and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ordered import medians, ordered, scan


def attempt_identity(ordinal: Column, prior: Column | None = None) -> Column:
    """Stable identity of a copied attempt: its ledger id, else start and segment, else origin.

    The origin is the run it was copied from, or the run before (``prior``).  Empty ids count
    as absent.
    """
    def given(value: Column) -> Column:
        return F.when(value != "", value)

    segment = F.coalesce(F.col("segment"), F.lit("unknown"))
    start = F.concat(F.lit("legacy:"), F.format_string("%.9f", F.col("started_at")), F.lit(":"), segment)
    run = given(F.col("source_run_id")) if prior is None else F.coalesce(given(F.col("source_run_id")), given(prior))
    origin = F.concat(run, F.lit(":"), F.coalesce(F.col("source_attempt_index"), ordinal).cast("string"))
    return F.coalesce(given(F.col("ledger_id")), F.when(F.col("started_at").isNotNull(), start), origin,
                      F.concat(F.lit("current:"), ordinal.cast("string")))


def has_no_identity() -> Column:
    """Whether an attempt cannot be told from those of other runs: neither a ledger id nor a start."""
    return (F.coalesce(F.col("ledger_id"), F.lit("")) == "") & F.col("started_at").isNull()


def retained(attempts: DataFrame, order: list[str]) -> DataFrame:
    """The attempts of all runs, each identity once, the first in ``order``; those that :func:`has_no_identity` are left out.

    Feeds :func:`ledger_totals`.  Columns as in the run states, with ``ordinal`` and ``prior_run_id``.
    """
    return unique_attempts(attempts.where(~has_no_identity()).withColumn("identity", attempt_identity(F.col("ordinal"), F.col("prior_run_id"))), "identity", order)


def unique_attempts(attempts: DataFrame, identity: str, order: list[str]) -> DataFrame:
    """The first attempt per identity.  An aggregate, so copies combine before the shuffle."""
    columns = [c for c in attempts.columns if c != identity]
    first = attempts.groupBy(identity).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_v"))
    return first.select(identity, *[F.col(f"_v.{c}").alias(c) for c in columns])


def ledger_totals(unique: DataFrame, seconds: str = "elapsed_seconds", segment: str = "segment") -> DataFrame:
    """Attempts and seconds by segment and overall (segment 'all'); the total is a sum of the parts."""
    parts = unique.groupBy(F.col(segment).alias("segment")).agg(
        F.count(F.lit(1)).alias("attempts"), F.sum(seconds).alias("seconds"))
    total = parts.agg(F.sum("attempts").alias("attempts"), F.sum("seconds").alias("seconds")).withColumn("segment", F.lit("all"))
    return parts.unionByName(total)


def budget_status(unique: DataFrame, capacities: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Capacity, consumption and what is left per (run, segment); inherited attempts do not count.

    ``active`` (run, segment, active_seconds) adds unfinished work.
    """
    used = unique.where(~F.coalesce(F.col("inherited"), F.lit(False))).groupBy("run", "segment").agg(
        F.sum("elapsed_seconds").alias("charged"))
    out = capacities.join(used, ["run", "segment"], "left")
    out = (out.join(active, ["run", "segment"], "left") if active is not None
           else out.withColumn("active_seconds", F.lit(0.0))).fillna(0.0, ["charged", "active_seconds"])
    consumed = F.col("charged") + F.col("active_seconds")
    return out.select("run", "segment", "capacity", consumed.alias("consumed"),
                      F.greatest(F.lit(0.0), F.col("capacity") - consumed).alias("remaining"))


def admit_reservations(requests: DataFrame, order: list[str], ceilings: dict[str, float]) -> DataFrame:
    """Accept reservations in order until the first that would pass a ceiling.

    Adds ``admitted`` and the running ``total_*``.  The order is global, so running totals
    come from an ordered scan rather than one window task.
    """
    rows = ordered(requests, [F.col(c) for c in order])
    summed = scan(rows, [], number="_n", sums={f"total_{c}": F.col(c) for c in ceilings})
    over = F.lit(False)
    for c, most in ceilings.items():
        over = over | (F.col(f"total_{c}") > most)
    first = summed.where(over).agg(F.min("_n")).scalar()
    return summed.withColumn("admitted", F.coalesce(F.col("_n") < first, F.lit(True))).drop("_n", "_slot")


def accounting(reservations: DataFrame, reviews: DataFrame, carried: DataFrame) -> DataFrame:
    """Lifetime charges: live ledgers plus the totals carried from earlier generations."""
    zero = F.lit(0)
    live = reservations.agg(F.sum("bytes").alias("bytes"), F.sum("seconds").alias("seconds"),
                            F.count(F.lit(1)).alias("attempts")).withColumn("decisions", zero).withColumn(
        "review_seconds", F.lit(0.0))
    seen = reviews.agg(F.count(F.lit(1)).alias("decisions"), F.sum("seconds").alias("review_seconds")).withColumn(
        "bytes", zero).withColumn("seconds", F.lit(0.0)).withColumn("attempts", zero)
    names = ["bytes", "seconds", "attempts", "decisions", "review_seconds"]
    rows = live.select(*names).unionByName(seen.select(*names)).unionByName(carried.select(*names))
    return rows.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in names])


def best_row(curves: DataFrame, key: list[str], goals: list[Column], step: str = "step") -> DataFrame:
    """Best curve row by the goals in turn; the earliest step wins a full tie."""
    best = curves.groupBy(*key).agg(F.max_by(F.struct(*[c for c in curves.columns if c not in key]),
                                             F.struct(*goals, -F.col(step))).alias("_v"))
    return best.select(*key, "_v.*")


def transition_gate(curves: DataFrame, step: int = 2000, earlier: int = 1500, had: float = 0.10,
                    below: float = 0.05) -> DataFrame:
    """Runs whose live recall had started and then collapsed (run, step, recall)."""
    at = curves.groupBy("run").agg(
        F.min_by(F.when(F.col("step") == earlier, F.col("recall")), F.when(F.col("step") == earlier, F.col("step"))).alias("before"),
        F.min_by(F.when(F.col("step") == step, F.col("recall")), F.when(F.col("step") == step, F.col("step"))).alias("now"))
    return at.select("run", "before", "now",
                     F.coalesce((F.col("before") >= had) & (F.col("now") < below), F.lit(False)).alias("failed"))


def latency(runs: DataFrame, key: list[str], value: str) -> DataFrame:
    """Minimum, exact median and maximum per group."""
    ends = runs.groupBy(*key).agg(F.count(value).alias("runs"), F.min(value).alias("min"), F.max(value).alias("max"))
    return ends.join(medians(runs, key, value, "median"), key)


def append_curves(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


