"""The question log: statistics, pages, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ["answered", "refused", "error"]
#: Fixed value: rows that retention may keep at most. How exact the sketch is that brackets ranks.
MOST_KEPT, ACCURACY = 20_000, 10_000


def normalised_log(rows: DataFrame) -> DataFrame:
    """A status that isn't known counts as answered."""
    return rows.withColumn("status", F.when(F.col("status").isin(STATUSES), F.col("status")).otherwise("answered"))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def log_stats(rows: DataFrame, now: Column) -> DataFrame:
    """One row: totals, those of today and of the last 7 times 24 hours, by status, from cache, the mean score of answers."""
    count = lambda test: F.count(F.when(test, 1))
    status = F.col("status")
    return rows.agg(
        F.count("*").alias("total"),
        count(F.col("created_at") >= F.date_trunc("day", now)).alias("today"),
        count(F.col("created_at") >= now - F.expr("INTERVAL 7 DAYS")).alias("week"),
        *(count(status == s).alias(s) for s in STATUSES),
        count(F.col("source") == "cache").alias("cached"),
        F.coalesce(F.round(F.avg(F.when(status == "answered", F.col("score"))), 3), F.lit(0.0)).alias("avg_score"),
        (F.count("*") > 50_000).alias("large"),
    )


def page(rows: DataFrame, limit: int, offset: int, status: str | None = None) -> DataFrame:
    """Newest first, ids break ties; limit from 1 to 100. A status that isn't known is no filter."""
    if status in STATUSES:
        rows = rows.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset(max(0, offset)).limit(min(100, max(1, limit)))


def page_envelope(rows: DataFrame, page_number: int, per_page: int) -> DataFrame:
    """(total, pages, page, per_page): a page beyond the last is the last."""
    per = min(100, max(1, per_page))
    counted = rows.agg(F.count("*").alias("total"))
    pages = F.greatest(F.ceil(F.col("total") / per), F.lit(1))
    return counted.select("total", pages.alias("pages"), F.least(F.lit(max(1, page_number)), pages).alias("page"), F.lit(per).alias("per_page"))


def retained(rows: DataFrame, now: Column, keep_days: int = 0, keep_rows: int = 0) -> DataFrame:
    """Rows not older than keep_days, and of those the keep_rows with the largest ids; 0 doesn't limit.

    The boundary id comes from a top-k of keep_rows ids, which settings bound (MOST_KEPT), so no task ranks all rows.
    """
    if keep_rows > MOST_KEPT:
        raise ValueError(f"keep_rows is {MOST_KEPT} at most")
    if keep_days > 0:
        rows = rows.where(F.col("created_at") >= now - F.make_dt_interval(F.lit(keep_days)))
    if keep_rows > 0:
        boundary = rows.select("id").orderBy(F.desc("id")).limit(keep_rows).agg(F.min("id")).scalar()
        rows = rows.where(F.col("id") >= boundary)
    return rows


def nearest_rank(rows: DataFrame, value: str, percents: list[int], by: list[str]) -> DataFrame:
    """The value at rank ceil(p / 100 * n) of each group's n values that aren't null, for each p. NaN is above all numbers.

    A sketch, whose error in ranks is bounded, brackets each; values below a bracket are only counted, and those inside
    it are ordered. So no group is collected or ordered whole.
    """
    slack = 2 / ACCURACY
    marks = [min(1.0, max(0.0, p / 100 + side)) for p in percents for side in (-slack, slack)]
    inexact = rows.schema[value].dataType.typeName() in ("float", "double")
    number = F.nanvl(F.col(value), F.lit(float("inf"))) if inexact else F.col(value)
    none = F.isnan(value) if inexact else F.lit(False)
    kept = rows.where(F.col(value).isNotNull()).select(*by, F.to_json(F.struct(*by)).alias("_g"), number.alias("_v"), none.alias("_nan"))
    groups = kept.groupBy("_g", *by).agg(F.count("*").alias("_n"), F.count(F.when(F.col("_nan"), 1)).alias("_nans"), F.percentile_approx("_v", marks, ACCURACY).alias("_marks"))
    counts = kept.groupBy("_g", "_v").agg(F.count("*").alias("_c")).join(groups.select("_g", "_n", "_marks"), "_g")
    low, high = (lambda k: F.element_at("_marks", 2 * k + 1)), (lambda k: F.element_at("_marks", 2 * k + 2))
    rank = lambda p: F.greatest(F.ceil(F.lit(p) / 100.0 * F.col("_n")), F.lit(1))
    below = counts.groupBy("_g").agg(*(F.coalesce(F.sum(F.when(F.col("_v") < low(k), F.col("_c"))), F.lit(0)).alias(f"_b{k}") for k in range(len(percents))))
    inside = [counts.where(F.col("_v").between(low(k), high(k))).select("_g", F.lit(k).alias("_k"), "_v", "_c", rank(p).alias("_rank")) for k, p in enumerate(percents)]
    before = reduce(lambda c, k: c.when(F.col("_k") == k, F.col(f"_b{k}")), range(1, len(percents)), F.when(F.col("_k") == 0, F.col("_b0")))
    seen = F.sum("_c").over(Window.partitionBy("_g", "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = reduce(DataFrame.unionByName, inside).join(below, "_g").withColumn("_seen", seen + before).where("_seen >= _rank")
    found = placed.groupBy("_g").agg(*(F.min(F.when(F.col("_k") == k, F.col("_v"))).alias(f"p{p}") for k, p in enumerate(percents)))
    # infinity stood for NaN in the sketch: ranks in the last _nans places are NaN
    told = lambda p: F.when(rank(p) > F.col("_n") - F.col("_nans"), F.lit(float("nan"))).otherwise(F.col(f"p{p}")) if inexact else F.col(f"p{p}")
    return groups.join(found, "_g").select(*by, *(told(p).alias(f"p{p}") for p in percents))


def import_legacy(history: DataFrame) -> DataFrame:
    """Old history rows as log rows."""
    return history.select("created_at", F.col("topic").alias("question"), F.lit("").alias("answer"), F.lit("answered").alias("status"), F.lit("ai").alias("source"), F.lit(0.0).alias("score"), "user_id", F.lit("").alias("ip_hash"))


def user_labels(rows: DataFrame, users: DataFrame) -> DataFrame:
    """rows with user_label: the display name, else the id, and nothing for ids that aren't positive."""
    named = rows.join(users.select("user_id", "display_name"), "user_id", "left")
    return named.withColumn("user_label", F.when(F.col("user_id") <= 0, "").otherwise(F.coalesce("display_name", F.col("user_id").cast("string")))).drop("display_name")


def daily_usage(rows: DataFrame, limit: int) -> DataFrame:
    counted = rows.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    return counted.withColumn("over", F.col("n") > limit)


def hourly_window(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.window("created_at", "1 hour").alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "status", "n")


def without_prefixes(options: DataFrame, prefixes: list[str]) -> DataFrame:
    """Options whose name begins with none of the prefixes."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col("name").startswith(p)
    return options.where(~hit)
