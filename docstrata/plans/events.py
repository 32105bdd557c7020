"""Incremental maintenance over the event table: debounce, sessions, windows, queue order and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import table
from ..operators.documents import duration, fiscal_year, iso_dates
from ..registry import query
from ..streaming.counts import streamed_counts
from ..streaming.queue import batched, queued, run_closed

QUIET, CAP = 3600, 21600


@query(f"""WITH e AS (SELECT user_id, event_id, epoch(ts) AS t, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {QUIET} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS burst FROM e)
SELECT user_id, burst, count(*) AS n, CAST(floor(min(t)) AS BIGINT) AS first_s, CAST(floor(max(t)) AS BIGINT) AS last_s FROM s GROUP BY ALL""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of each user, ended by an hour of quiet."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    gap = F.col("t") - F.lag("t").over(w)
    s = e.withColumn("new", F.when(gap.isNull() | (gap > QUIET), 1).otherwise(0)).withColumn("burst", F.sum("new").over(w))
    return s.groupBy("user_id", "burst").agg(F.count("*").alias("n"), F.floor(F.min("t")).alias("first_s"), F.floor(F.max("t")).alias("last_s"))


@query(f"""WITH e AS (SELECT user_id, event_id, event_type, epoch(ts) AS t, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {QUIET} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS burst FROM e),
a AS (SELECT *, CAST(floor((t - min(t) OVER (PARTITION BY user_id, burst)) / {CAP}) AS BIGINT) AS age FROM s)
SELECT user_id, burst, age, count(DISTINCT event_type) AS kinds, count(*) AS n, bool_or(event_type = 'error') AS rescan FROM a GROUP BY ALL""")
def event_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that end after quiet time or at a maximum age, repeated kinds once, with a rescan flag."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    gap = F.col("t") - F.lag("t").over(w)
    s = e.withColumn("new", F.when(gap.isNull() | (gap > QUIET), 1).otherwise(0)).withColumn("burst", F.sum("new").over(w))
    s = s.withColumn("age", F.floor((F.col("t") - F.min("t").over(Window.partitionBy("user_id", "burst"))) / CAP))
    return s.groupBy("user_id", "burst", "age").agg(F.countDistinct("event_type").alias("kinds"), F.count("*").alias("n"), F.bool_or(F.col("event_type") == "error").alias("rescan"))


@query("""SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("day", "ts").cast(e.schema["ts"].dataType).alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


STATE = "CASE event_type WHEN 'error' THEN 'dead' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'queued' END"


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as queue rows: tier and attempts from the payload, state from the kind."""
    k = F.get_json_object("props", "$.k").cast("long")
    state = F.when(F.col("event_type") == "error", "dead").when(F.col("event_type") == "signup", "running").when(F.col("event_type") == "purchase", "done").otherwise("queued")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", (k % 2 + 1).alias("tier"), (k % 8).alias("attempts"), state.alias("state"))


QUEUE = f"q AS (SELECT event_id, user_id, ts, value, k % 2 + 1 AS tier, k % 8 AS attempts, {STATE} AS state FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"


@query(f"""WITH {QUEUE} SELECT tier, count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'dead') AS dead FROM q GROUP BY tier""")
def queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue(spark, sf_dir).groupBy("tier").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("queued", "running", "done", "dead")))


@query(f"""WITH {QUEUE} SELECT user_id, event_id, tier, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier, ts DESC, value, event_id) AS r FROM q WHERE state = 'queued') WHERE r <= 3""")
def queue_claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each worker's queue would hand out next: tier, newest, smallest, id."""
    w = Window.partitionBy("user_id").orderBy("tier", F.desc("ts"), "value", "event_id")
    return queue(spark, sf_dir).where("state = 'queued'").withColumn("place", F.row_number().over(w)).where("place <= 3").select("user_id", "event_id", "tier", "place")


@query(f"""WITH {QUEUE} SELECT event_id, attempts, CAST(least(3600, 5 * pow(2, greatest(0, attempts - 1))) AS BIGINT) AS wait_s, (attempts >= 5) AS dead_letter FROM q WHERE state <> 'done'""")
def queue_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = queue(spark, sf_dir).where("state <> 'done'")
    wait = F.least(F.lit(3600.0), 5 * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.col("attempts") - 1)))
    return q.select("event_id", "attempts", wait.cast("long").alias("wait_s"), (F.col("attempts") >= 5).alias("dead_letter"))


@query(f"""WITH {QUEUE}, d AS (SELECT user_id, epoch(ts) AS t FROM q WHERE state = 'done' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 200),
r AS (SELECT user_id, count(*) AS n, max(t) - min(t) AS wall FROM d GROUP BY user_id), l AS (SELECT user_id, count(*) FILTER (state = 'queued') AS left_n FROM q GROUP BY user_id)
SELECT user_id, left_n, CASE WHEN left_n = 0 THEN 0.0 ELSE round(left_n / nullif(n / nullif(wall, 0), 0), 3) END AS eta_s FROM l LEFT JOIN r USING (user_id)""")
def throughput_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time left from the rate of at most 200 newest finished items; unknown without a rate, none when nothing is left."""
    q = queue(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    done = q.where("state = 'done'").withColumn("r", F.row_number().over(w)).where("r <= 200").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    rate = done.groupBy("user_id").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("wall"))
    left = q.groupBy("user_id").agg(F.count_if(F.col("state") == "queued").alias("left_n"))
    eta = F.when(F.col("left_n") == 0, 0.0).otherwise(F.round(F.col("left_n") / F.nullif(F.col("n") / F.nullif(F.col("wall"), F.lit(0.0)), F.lit(0.0)), 3))
    return left.join(rate, "user_id", "left").select("user_id", "left_n", eta.alias("eta_s"))


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def event_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event of each user, kind and day."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.date_trunc("day", "ts").alias("d")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return first.select("event_id", "user_id", "event_type")


@query("""SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts kept by a stream over the event files."""
    return streamed_counts(spark, f"{sf_dir}/events.parquet")


@query("""WITH e AS (SELECT event_id, user_id + 1 AS n, CAST(ts AS DATE) AS d, CAST(year(ts) AS BIGINT) AS y FROM events)
SELECT event_id, n || CASE WHEN event_id % 2 = 0 THEN ' day' ELSE ' week' END || CASE WHEN n = 1 THEN '' ELSE 's' END AS duration,
CASE WHEN event_id % 3 > 0 THEN 'FY' || y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') END AS fiscal_year, 2 AS n_dates, d AS first_date FROM e""")
def retention_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration, fiscal year and dates read back from a retention note written for every event; the SQL has the values that went in."""
    day, n = F.to_date("ts"), (F.col("user_id") + 1).cast("string")
    label = F.concat(F.lit(" of FY"), F.date_format("ts", "yy"), F.lit("-"), F.date_format(F.add_months("ts", 12), "yy"))
    kept = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("ninety ("), n, F.lit(") days"))).otherwise(F.concat(n, F.lit(" weeks")))
    note = F.concat(F.lit("Logged "), F.date_format("ts", "d MMMM yyyy"), F.when(F.col("event_id") % 3 > 0, label).otherwise(""), F.lit(", kept "), kept, F.lit(" from "), F.date_add(day, 1).cast("string"), F.lit(" and five years at most"))
    e = table(spark, sf_dir, "events").select("event_id", note.alias("t"))
    e = e.select("event_id", duration(F.col("t")).alias("duration"), fiscal_year(F.col("t")).alias("fiscal_year"), iso_dates(F.col("t")).alias("dates"))
    return e.select("event_id", "duration", "fiscal_year", F.size("dates").alias("n_dates"), F.array_min("dates").alias("first_date"))


BATCH_QUIET, BATCH_AGE = 6 * 3600, 24 * 3600


@query(f"""WITH RECURSIVE o AS MATERIALIZED (SELECT user_id, epoch_us(ts) AS t, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
b AS (SELECT user_id, i, t AS first, t AS last, 1 AS batch FROM o WHERE i = 1 UNION ALL
  SELECT o.user_id, o.i, CASE WHEN o.t >= least(b.last + {BATCH_QUIET * 1000000}, b.first + {BATCH_AGE * 1000000}) THEN o.t ELSE b.first END, o.t, b.batch + CASE WHEN o.t >= least(b.last + {BATCH_QUIET * 1000000}, b.first + {BATCH_AGE * 1000000}) THEN 1 ELSE 0 END
  FROM b JOIN o ON o.user_id = b.user_id AND o.i = b.i + 1)
SELECT user_id, make_timestamp(min(b.first)) AS first, make_timestamp(max(t)) AS last, make_timestamp(least(max(t) + {BATCH_QUIET * 1000000}, min(b.first) + {BATCH_AGE * 1000000})) AS released, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds
FROM b JOIN o USING (user_id, i) GROUP BY user_id, batch""")
def released_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in batches released after six hours of quiet or a day after their first, by a stream that keeps open batches in state."""
    columns = [F.col("user_id").alias("key"), F.col("event_type").alias("kind")]
    rows = run_closed(spark, f"{sf_dir}/events.parquet", columns, batched(BATCH_QUIET, BATCH_AGE), "key long, first long, last long, released long, n long, kinds string", "2 days", "batches")
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return rows.select(F.col("key").alias("user_id"), at("first"), at("last"), at("released"), "n", "kinds")


KIND = {"click": "enqueue", "view": "enqueue", "purchase": "done", "error": "fail", "signup": "boost"}
KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KIND.items()) + " END"


@query(f"""WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, kind, size, prio) AS i FROM
  (SELECT user_id, epoch_us(ts) AS t, {KIND_SQL} AS kind, CASE WHEN value < 5 THEN 1 ELSE 2 END AS size, CASE WHEN event_type = 'click' THEN 1 ELSE 2 END AS prio FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)),
q AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS state, 0 AS prio, 0 AS size, 0 AS attempts, CAST(NULL AS BIGINT) AS since FROM o WHERE i = 1 UNION ALL
  SELECT o.user_id, o.i,
    CASE WHEN o.kind = 'enqueue' AND (q.state IS NULL OR o.size <> q.size) THEN 'queued' WHEN q.state = 'queued' AND o.kind = 'done' THEN 'done' WHEN q.state = 'queued' AND o.kind = 'fail' AND q.attempts >= 2 THEN 'dead' ELSE q.state END,
    CASE WHEN o.kind = 'enqueue' AND (q.state IS NULL OR o.size <> q.size OR q.state = 'queued') THEN o.prio WHEN q.state = 'queued' AND o.kind = 'boost' THEN 0 ELSE q.prio END,
    CASE WHEN o.kind = 'enqueue' AND (q.state IS NULL OR o.size <> q.size) THEN o.size ELSE q.size END,
    CASE WHEN o.kind = 'enqueue' AND (q.state IS NULL OR o.size <> q.size) THEN 0 WHEN q.state = 'queued' AND o.kind = 'fail' THEN q.attempts + 1 ELSE q.attempts END,
    CASE WHEN o.kind = 'enqueue' AND (q.state IS NULL OR o.size <> q.size) THEN o.t ELSE q.since END
  FROM q JOIN o ON o.user_id = q.user_id AND o.i = q.i + 1)
SELECT user_id, state, prio, CAST(size AS BIGINT) AS size, attempts, make_timestamp(since) AS since FROM q WHERE state IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def queue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work queue after all events: enqueued, refreshed, reset, boosted, done and failed rows, kept by a stream. (A user stands for a path, a low or high value for its size.)"""
    kind = F.create_map(*(F.lit(x) for kv in KIND.items() for x in kv))
    columns = [F.col("user_id").alias("key"), F.try_element_at(kind, F.col("event_type")).alias("kind"), F.when(F.col("value") < 5, 1).otherwise(2).cast("long").alias("size"), F.when(F.col("event_type") == "click", 1).otherwise(2).alias("prio")]
    schema = "key long, state string, prio int, size long, attempts int, since long, seq long, at long"
    rows = run_closed(spark, f"{sf_dir}/events.parquet", columns, queued(), schema, "2 days", "queue")
    last = rows.groupBy("key").agg(F.max_by(F.struct("state", "prio", "size", "attempts", "since"), F.struct("at", "seq")).alias("r"))
    return last.select(F.col("key").alias("user_id"), "r.state", "r.prio", "r.size", "r.attempts", F.timestamp_micros("r.since").cast("timestamp_ntz").alias("since"))
