"""Queries on the request log: latencies, counters, headers, rate limit, status summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from likeness.functions import text as T
from likeness.operators import metrics as E
from likeness.plans.catalogue import query
from likeness.runtime import table
from likeness.streaming import requests as R

c = F.col


@query("SELECT event_type, n, round(mi, 6) AS min, round(ma, 6) AS max, round(mean, 6) AS mean, round(med, 6) AS median, round(sd, 6) AS std, round(s[CAST(floor(0.95 * (n - 1)) AS BIGINT) + 1], 6) AS p95, round(s[CAST(floor(0.99 * (n - 1)) AS BIGINT) + 1], 6) AS p99 FROM (SELECT event_type, count(*) AS n, min(value) AS mi, max(value) AS ma, avg(value) AS mean, median(value) AS med, stddev_pop(value) AS sd, list(value ORDER BY value) AS s FROM events WHERE value IS NOT NULL GROUP BY event_type)")
def timing_stats(spark, sf):
    out = E.timing_stats(table(spark, sf, "events"), "value", ("event_type",))
    return out.withColumns({k: F.round(k, 6) for k in ("min", "max", "mean", "median", "std", "p95", "p99")})


@query("SELECT event_type AS outcome, count(*) AS n FROM events GROUP BY event_type")
def outcome_counters(spark, sf):
    return R.outcome_counts(table(spark, sf, "events").withColumnRenamed("event_type", "outcome"))


@query("SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events")
def request_quantiles(spark, sf):
    return table(spark, sf, "events").agg(*[F.round(F.percentile("value", F.lit(p)), 6).alias(f"p{round(100 * p)}") for p in (0.5, 0.9, 0.99)])


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'r' || event_id ELSE 'c' || user_id END AS trace FROM events")
def trace_id(spark, sf):
    first = F.when(c("event_id") % 3 == 0, F.concat(F.lit("r"), c("event_id").cast("string"))).otherwise(F.lit("  "))
    return table(spark, sf, "events").select("event_id", T.trace_id(first, F.concat(F.lit("c"), c("user_id").cast("string"))).alias("trace"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '10.0.0.' || (user_id % 256) ELSE 'remote' END AS client FROM events")
def client_key(spark, sf):
    header = F.when(c("event_id") % 2 == 0, F.concat(F.lit(" 10.0.0."), (c("user_id") % 256).cast("string"), F.lit(" , 10.1.1.1")))
    return table(spark, sf, "events").select("event_id", T.client_key(header, F.lit("remote")).alias("client"))


_BUCKET_SQL = """
WITH RECURSIVE log AS (
  SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS client, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS now,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn
  FROM events
), run AS (
  SELECT request_id, client, turn, now AS last, TRUE AS allowed, CAST(1 AS DOUBLE) AS tokens FROM log WHERE turn = 1
  UNION ALL
  SELECT request_id, client, turn, last, full_ >= 1, CASE WHEN full_ >= 1 THEN full_ - 1 ELSE full_ END
  FROM (
    SELECT log.request_id, log.client, log.turn, greatest(run.last, log.now) AS last,
           least(CAST(2 AS DOUBLE), run.tokens + greatest(log.now - run.last, CAST(0 AS DOUBLE)) * CAST(2 AS DOUBLE) / 60) AS full_
    FROM run JOIN log ON log.client = run.client AND log.turn = run.turn + 1
  )
)
SELECT request_id, client, allowed FROM run
"""


@query(_BUCKET_SQL)
def rate_limit(spark, sf):
    """At most two requests a minute and client."""
    e = table(spark, sf, "events").select(c("event_id").alias("request_id"), c("user_id").alias("client"), "ts")
    return R.rate_limited(e, 2.0).select("request_id", "client", "allowed")


@query("SELECT o_orderstatus AS status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderstatus")
def status_summary(spark, sf):
    from pyspark.sql import Window

    out = table(spark, sf, "orders").groupBy(c("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    return out.withColumn("percent", F.round(F.lit(100.0) * c("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))  # a row for each status


@query("SELECT CAST(sum(strlen(html)) AS BIGINT) AS bytes, count(*) AS n FROM pages")
def storage_size(spark, sf):
    return table(spark, sf, "pages").agg(F.sum(F.octet_length("html").cast("long")).alias("bytes"), F.count("*").alias("n"))


@query("SELECT round(count(*) / sum(value), 6) AS per_unit, round(max(value), 6) AS peak, round(avg(value) - min(value), 6) AS above_base FROM events")
def throughput(spark, sf):
    got = E.throughput(table(spark, sf, "events"), "value")
    return got.select(*[F.round(k, 6).alias(k) for k in got.columns])


@query("SELECT event_type, round(avg(value), 6) AS f1 FROM events GROUP BY event_type ORDER BY avg(value) DESC LIMIT 1")
def best_algorithm(spark, sf):
    mean = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("f1"))
    return mean.agg(F.max_by(F.struct("event_type", "f1"), "f1").alias("b")).select("b.event_type", F.round("b.f1", 6).alias("f1"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 7 DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def enrolment_last(spark, sf):
    """The last enrolled row of each key in a log of seven batches."""
    log = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", (c("event_id") % 7).alias("batch"))
    return R.enrolled(log, ("user_id", "event_type"), "event_id")
