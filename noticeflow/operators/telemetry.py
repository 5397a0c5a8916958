"""Runs of sources: totals, telemetry, rotation, probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .snapshot import scratch


def probe_status(error: Column) -> Column:
    """Kind of a failure by its text; null if there is none."""
    low = F.lower(error)
    tls = low.contains("certificate_verify_failed") | (low.contains("ssl") & (low.contains("handshake") | low.contains("tls")))
    return F.when(error.isNull(), F.lit(None)).when(low.contains("timeout") | low.contains("timed out"), "timeout-review").when(tls, "tls-review").otherwise("unreachable")


#: What pages say that ask for a proof of being human.
CHALLENGES = ("botmanager_support@radware.com", "captcha", "enable javascript and cookies", "perfdrive.com")
CHALLENGE_CHARS = 30_000


def probe_outcome(error: Column, http_status: Column, final_url: Column, text: Column, source_status: Column) -> Column:
    """Kind of a probe: of its failure, else a challenge in its address or the beginning of its text, an HTTP error, or that
    the source is reachable (active, if it was)."""
    seen = F.lower(F.concat_ws(" ", final_url, F.substring(text, 1, CHALLENGE_CHARS)))
    challenged = F.exists(F.array(*map(F.lit, CHALLENGES)), lambda m: seen.contains(m))
    return F.coalesce(probe_status(error), F.when(challenged, "access-challenge").when(http_status >= 400, "http-error").when(source_status == "active", "active").otherwise("reachable"))


def completeness(scans: DataFrame) -> DataFrame:
    """(id, source_id, rule) of full scans (id, source_id, pages, seen, records, acts) that must not count: more pages than were seen,
    pages but no record, records but no act that could be read."""
    broken = {"incomplete": F.col("pages") > F.col("seen"), "empty": (F.col("seen") > 0) & (F.col("records") == 0), "unreadable": (F.col("records") > 0) & (F.col("acts") == 0)}
    rules = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in broken.items()]))
    return scans.select("id", "source_id", F.explode(rules).alias("rule"))


def source_telemetry(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: catalogued, attempted, failed (any attempt failed), successful and not attempted sources."""
    tried = runs.where("source_id is not null").groupBy("source_id").agg(F.bool_or(F.col("status") == "failed").alias("failed"))
    counts = tried.agg(F.count("*").alias("attempted"), F.count_if("failed").alias("failed"))
    catalogued = sources.agg(F.count("*").alias("catalogued"))
    return catalogued.hint("broadcast").crossJoin(counts.hint("broadcast")).select("catalogued", "attempted", "failed", (F.col("attempted") - F.col("failed")).alias("successful"), F.greatest(F.col("catalogued") - F.col("attempted"), F.lit(0)).alias("not_attempted"))


def run_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(F.sum("created_count").alias("created"), F.sum("updated_count").alias("updated"), F.sum("skipped_count").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"), F.when(F.count_if(F.col("status") == "failed") > 0, "partial").otherwise("completed").alias("overall"))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds n, the place of each row in the order from 1 on. Rows are dealt into ranges, numbered in each, and moved on by the
    sizes of the ranges before, of which there are as many as partitions; no task has all rows."""
    spark = rows.sparkSession
    path = scratch(spark, "numbered")
    rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    kept = spark.read.parquet(path)
    sizes = kept.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")).alias("__before"))
    local = kept.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return local.join(before.hint("broadcast"), "__part").withColumn("n", F.col("__n") + F.col("__before")).drop("__part", "__n", "__before")


def refresh_order(sources: DataFrame) -> DataFrame:
    """Adds position: never checked first, then the oldest success, then the name."""
    return numbered(sources, F.col("last_success_at").asc_nulls_first(), F.lower("name"), F.col("id")).withColumnRenamed("n", "position")


def rotation_batch(sources: DataFrame, size: int, slot: Column) -> DataFrame:
    """Cyclic slice of the name-ordered sources for a slot, with its order."""
    ordered = numbered(sources, F.lower("name"), F.col("id")).withColumnRenamed("n", "__k").withColumn("__n", F.lit(sources.count()))
    least = F.least(F.lit(max(size, 0)), F.col("__n"))
    start = F.when((least == 0) | (least == F.col("__n")), 0).otherwise(F.pmod(slot * least, F.col("__n")))
    return ordered.withColumn("offset", F.pmod(F.col("__k") - 1 - start, F.col("__n"))).where(F.col("offset") < least).drop("__k", "__n")


def stale_runs(runs: DataFrame, as_of: Column, minutes: int = 30) -> DataFrame:
    """Running since before `minutes`: failed, with a message."""
    stale = (F.col("status") == "running") & (F.col("started_at") < as_of - F.expr(f"INTERVAL {minutes} MINUTES"))
    return runs.withColumns({"error_message": F.when(stale, "Esecuzione interrotta").otherwise(F.col("error_message")), "status": F.when(stale, "failed").otherwise(F.col("status"))})
