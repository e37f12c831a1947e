"""Registered queries over stores of entries, jobs and files, folds, streams and the wider table queries, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs as joblists
from ..operators import keyvalue, state, timers, vectors
from ..operators.metrics import Metrics
from ..operators.tablequery import TableQuery, bound, json_value, listed
from ..session import shared_path
from ..sources import tables
from ..sources.tables import samples, table
from ..streaming import streams
from .catalog import BOUNDS, STEPS, back, counter, gauge, q, query

# --- tables ------------------------------------------------------------------------------------------


@query("SELECT n_name, s_suppkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) RIGHT JOIN nation ON s_nationkey = n_nationkey")
def sql_right_join(spark, d):
    rich = TableQuery.table(table(spark, d, "supplier").where("s_acctbal > 5000"), "s")
    return rich.right_join(table(spark, d, "nation"), "n", "s.s_nationkey = n.n_nationkey").select("n_name", "s_suppkey").rows()


@query("SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal > 9000) FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON c_custkey = s_suppkey")
def sql_full_join(spark, d):
    rich = TableQuery.table(table(spark, d, "customer").where("c_acctbal > 9000"), "c")
    return rich.full_join(table(spark, d, "supplier").where("s_acctbal > 5000"), "s", "c.c_custkey = s.s_suppkey").select("c_custkey", "s_suppkey").rows()


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def sql_cross_join(spark, d):
    return q(spark, d, "nation", "n").cross_join(table(spark, d, "region"), "r").select("n_name", "r_name").rows()


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def sql_anti_join_builder(spark, d):
    return q(spark, d, "customer", "c").anti_join(table(spark, d, "orders").where("o_totalprice > 100000"), "o", "c.c_custkey = o.o_custkey").rows().select("c_custkey")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def sql_keyset_page3_by_date(spark, d):
    """Pages whose cursors hold dates: the third one."""
    o = q(spark, d, "orders", "o").select("o_orderkey", "o_orderdate").order_by("o_orderdate", True).order_by("o_orderkey")
    _, next_ = o.list(50)
    _, next_ = o.list(50, next_)
    return o.page(50, next_)[0]


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 250000")
def sql_json_list(spark, d):
    return q(spark, d, "orders", "o").filter(listed("o_orderpriority", '["1-URGENT", "2-HIGH"]')).filter("o_totalprice > 250000").rows().select("o_orderkey")


@query("""SELECT n_nationkey, '{"region":2,"tags":["a","é"]}' AS said FROM nation WHERE n_regionkey = 2""")
def sql_json_value(spark, d):
    return q(spark, d, "nation", "n").filter("n_regionkey = 2").rows().select("n_nationkey", json_value({"region": 2, "tags": ["a", "é"]}).alias("said"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 100 AND 900")
def sql_bound_text(spark, d):
    """A text with places for values, of which one holds a question mark's neighbour."""
    return bound(spark, "SELECT c_custkey, c_acctbal FROM {c} WHERE c_mktsegment = ? AND c_acctbal BETWEEN ? AND ? AND c_mktsegment <> 'what?'", "BUILDING", 100, 900, c=table(spark, d, "customer"))


@query("""SELECT o_orderkey, cast(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) as decimal(38,2)) AS rows3,
 count(*) OVER (PARTITION BY o_custkey ORDER BY epoch(o_orderdate) RANGE BETWEEN 7776000 PRECEDING AND CURRENT ROW) AS quarter FROM orders""".replace("sum(o_totalprice)", "sum(cast(o_totalprice as decimal(38,2)))"))
def sql_window_frames(spark, d):
    o = table(spark, d, "orders").createOrReplaceTempView("tidemark_orders")
    del o
    return spark.sql("""SELECT o_orderkey, cast(sum(cast(o_totalprice as decimal(28,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) as decimal(38,2)) AS rows3,
 count(*) OVER (PARTITION BY o_custkey ORDER BY unix_seconds(cast(o_orderdate as timestamp)) RANGE BETWEEN 7776000 PRECEDING AND CURRENT ROW) AS quarter FROM tidemark_orders""")


# --- timers, instruments and pages of metrics -----------------------------------------------------------


def durations(spark, d) -> Metrics:
    """Events as durations of a timer, written each hour; purchases know fewer bounds than the others."""
    s = samples(spark, d).select("at", F.col("value").alias("value"), "event_type")
    few = timers.durations(s.where("event_type = 'purchase'"), ["event_type"], "t", BOUNDS[2:], "1 hour")
    all_ = timers.durations(s.where("event_type <> 'purchase'"), ["event_type"], "t", BOUNDS, "1 hour")
    return Metrics(few.unionByName(all_), ("event_type", "le"))


#: A write belongs to the hour it ends; the first write of a series is where its steps begin.
_TIMER = f"""WITH e AS (SELECT event_type, date_trunc('hour', ts)::timestamp + interval 1 hour AS tick, value FROM events),
k AS (SELECT event_type, min(tick) AS first FROM e GROUP BY 1), x AS (SELECT e.event_type, date_trunc('day', tick)::timestamp AS bucket, tick, value, tick > first AS counts FROM e JOIN k USING (event_type))
"""


@query(_TIMER + "SELECT event_type, bucket, cast(count(*) FILTER (counts) as double) AS count, cast(count(*) FILTER (counts) as double) / 86400 AS rate, round(coalesce(sum(value) FILTER (counts), 0), 6) AS sum, max(value) AS max FROM x GROUP BY ALL")
def timer_by_name(spark, d):
    m = durations(spark, d).every("1 day").by("event_type")
    return timers.timer(m, "t").select("event_type", "bucket", "count", "rate", F.round("sum", 6).alias("sum"), "max")


@query(_TIMER + f""", b(le) AS (VALUES {', '.join(f'({b}::double)' for b in BOUNDS[2:])}, (NULL))
SELECT bucket, le, count(*) FILTER (counts AND (le IS NULL OR value <= le)) AS c FROM x, b GROUP BY ALL""")
def timer_heatmap_shared_bounds(spark, d):
    """Bounds that every type's timer has, over all types."""
    return timers.heatmap(durations(spark, d).every("1 day"), "t")


@query(_TIMER + f""", b(le) AS (VALUES {', '.join(f'({b}::double)' for b in BOUNDS[2:])}, ('inf'::double)),
h AS (SELECT bucket, le, count(*) FILTER (counts AND value <= le) AS c, count(*) FILTER (counts) AS n FROM x, b GROUP BY ALL),
g AS (SELECT *, coalesce(lag(le) OVER w, 0.0) AS lower, coalesce(lag(c) OVER w, 0) AS under FROM h WINDOW w AS (PARTITION BY bucket ORDER BY le))
SELECT bucket, cast(lower as double) AS lower, CASE WHEN isinf(le) THEN NULL ELSE le END AS upper, n AS samples FROM g WHERE c * 20 >= n * 19 AND under * 20 < n * 19""")
def timer_p95(spark, d):
    return timers.percentile(durations(spark, d).every("1 day"), "t", "95").drop("estimate")


@query("""WITH s AS (SELECT user_id, min(ts) AS first FROM events GROUP BY 1), k AS (SELECT user_id FROM s ORDER BY first, cast(user_id as varchar) LIMIT 40)
SELECT CASE WHEN user_id IN (SELECT user_id FROM k) THEN cast(user_id as varchar) ELSE '__overflow' END AS "user", count(*) AS measured FROM events GROUP BY 1""")
def instrument_overflow(spark, d):
    """At most forty users' series; the rest is counted together."""
    s = samples(spark, d).select("at", "user", "value")
    return timers.bounded(s, ["user"], 40).groupBy("user").agg(F.count("*").alias("measured"))


@query("""WITH s AS (SELECT event_type, date_trunc('hour', ts)::timestamp + interval 1 hour AS tick, count(*) AS n FROM events WHERE user_id < 40 GROUP BY ALL),
g AS (SELECT *, CASE WHEN coalesce(tick - lag(tick) OVER w >= interval 3 hour, true) THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY event_type ORDER BY tick)),
r AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY tick) AS run FROM g),
t AS (SELECT event_type, tick, new, cast(sum(n) OVER (PARTITION BY event_type, run ORDER BY tick) as bigint) AS value FROM r)
SELECT event_type, tick AS "at", value FROM t UNION ALL SELECT event_type, tick - interval 1 hour, 0 FROM t WHERE new = 1""")
def instrument_totals(spark, d):
    """A counter written each hour, which begins again after three idle hours."""
    s = samples(spark, d).where("cast(user as long) < 40").select("at", "event_type", F.lit(1).cast("long").alias("value"))
    return timers.totals(s, ["event_type"], "1 hour", "3 hours")


@query("SELECT unnest(['event_type', 'user']) AS label")
def metric_label_names(spark, d):
    empty = samples(spark, d).withColumn("zone", F.lit(None).cast("string"))
    return Metrics(empty, ("event_type", "user", "zone")).label_names()


@query("SELECT event_type, count(*) AS samples FROM events WHERE NOT (event_type = 'view' AND starts_with(cast(user_id as varchar), '1')) GROUP BY ALL")
def metric_delete_series(spark, d):
    left = gauge(spark, d).one_of("event_type", "view").prefix("user", "1").deleted()
    return left.groupBy("event_type").agg(F.count("*").alias("samples"))


@query("""SELECT event_type, cast(user_id as varchar) AS "user", ts AS "at", value FROM events WHERE ts >= timestamp '2024-01-03' AND ts < timestamp '2024-01-09' ORDER BY event_type, cast(user_id as varchar), ts LIMIT 100 OFFSET 200""")
def metric_read_page3(spark, d):
    m, after = gauge(spark, d).between("2024-01-03", "2024-01-09"), None
    for _ in range(2):
        page, asked = m.page(100, after)
        rows = page.collect()  # a page, as a client has it
        after = asked.cursor(rows[-1].asDict()) if len(rows) == 100 else after
    return m.page(100, after)[0]


@query(STEPS + f"""SELECT event_type, bucket, {back('sum(step)')} AS increase, count(*) AS samples, bucket + interval 1 day > timestamp '2024-01-09 06:00:00' OR bucket < timestamp '2024-01-03 12:00:00' AS partial
FROM (SELECT *, date_trunc('day', ts)::timestamp AS bucket FROM t WHERE ts >= timestamp '2024-01-05' AND ts < timestamp '2024-01-07') GROUP BY event_type, bucket""")
def metric_bucket_page2(spark, d):
    """The second page of two days each; steps go on across pages."""
    m = counter(spark, d).between("2024-01-03 12:00:00", "2024-01-09 06:00:00").every("1 day").by("event_type")
    _, after = m.bucket_page("increase", buckets=2)
    return m.bucket_page("increase", buckets=2, after=after)[0].drop("resets", "gap")


# --- vectors by clusters ---------------------------------------------------------------------------------


@query("SELECT count(*) AS questions, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def vector_clusters_recall(spark, d):
    """Questions by every hundredth vector: whether clusters give 0.9 of the exact ten, over all questions."""
    table_ = table(spark, d, "embeddings")
    asked = table_.where("vec_id % 100 = 0")
    rows = table_.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector")).where("doc IS NOT NULL AND vector IS NOT NULL")
    kept, hits, best = None, 0, 0
    for questions in vectors.rounds(asked, "vec_id", "embedding"):
        kept = kept or vectors.Clusters.of_table(table_, "vec_id", "embedding")
        some = kept.nearest(questions, 0.95).select("question", "doc", F.lit(1).alias("hit"))
        found = vectors.nearest(rows, questions).join(some, ["question", "doc"], "left").agg(F.count("hit").alias("hits"), F.count("*").alias("best")).first()  # one row
        hits, best = hits + found["hits"], best + found["best"]
    return asked.agg(F.count("*").alias("questions")).withColumn("reached", F.lit(hits >= 0.9 * best))


# --- entries -----------------------------------------------------------------------------------------


def entries(spark, d) -> DataFrame:
    """Documents as entries: a path by source and number, of which every third one expires."""
    t = F.timestamp_add("HOUR", F.col("doc_id"), F.lit("2024-01-01").cast("timestamp_ntz"))
    return table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("value"), F.when(F.col("doc_id") % 3 == 0, t).alias("expires"))


ENTRIES = "WITH e AS (SELECT source || '/' || doc_id AS path, lang AS value, CASE WHEN doc_id % 3 = 0 THEN timestamp '2024-01-01' + to_hours(cast(doc_id as integer)) END AS expires FROM documents)\n"


@query(ENTRIES + "SELECT path, value FROM e WHERE starts_with(path, 'src1/') AND (expires IS NULL OR expires > timestamp '2024-01-10') AND path > 'src1/2' ORDER BY path LIMIT 20")
def kv_scan_branch(spark, d):
    return keyvalue.scan(entries(spark, d), "2024-01-10", "src1", "src1/2", 20).select("path", "value")


@query(ENTRIES + "SELECT count(*) AS entries FROM e WHERE starts_with(path, 'src2/') AND (expires IS NULL OR expires > timestamp '2024-01-10')")
def kv_count_branch(spark, d):
    return keyvalue.count(entries(spark, d), "2024-01-10", "src2")


def log(spark, d) -> DataFrame:
    """Events as a log over paths type/user: purchases set, errors delete, a user's view of long ago clears a branch."""
    e = table(spark, d, "events")
    path = F.concat(F.lit("u/"), F.pmod(F.col("user_id"), F.lit(10)).cast("string"), F.lit("/"), F.col("user_id").cast("string"))
    op = F.when(F.col("event_type") == "error", "delete").when((F.col("event_type") == "view") & (F.col("event_id") % 50 == 0), "clear").otherwise("set")
    ttl = F.when(F.col("event_id") % 2 == 0, F.lit(10 * 86400 * 1_000_000).cast("long"))
    where = F.when(op == "clear", F.regexp_replace(path, "/[0-9]+$", "")).otherwise(path)
    none = F.lit(None).cast("long")
    return e.select(F.struct("ts", "event_id").alias("seq"), F.col("ts").alias("at"), op.alias("op"), where.alias("path"), F.col("event_id").cast("string").alias("value"), ttl.alias("ttl"), none.alias("idle"), none.alias("expected"))


@query("""WITH l AS (SELECT ts, event_id, 'u/' || (user_id % 10) || '/' || user_id AS path, 'u/' || (user_id % 10) AS branch, CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'view' AND event_id % 50 = 0 THEN 'clear' ELSE 'set' END AS op FROM events),
s AS (SELECT path, branch, arg_max(event_id, (ts, event_id)) AS event_id, max((ts, event_id)) AS seq, count(*) AS version FROM l WHERE op = 'set' GROUP BY path, branch)
SELECT s.path, cast(s.event_id as varchar) AS value, version, CASE WHEN s.event_id % 2 = 0 THEN seq[1] + interval 10 day END AS expires FROM s
WHERE NOT EXISTS (SELECT 1 FROM l WHERE op = 'delete' AND l.path = s.path AND (l.ts, l.event_id) > s.seq) AND NOT EXISTS (SELECT 1 FROM l WHERE op = 'clear' AND l.branch = s.branch AND (l.ts, l.event_id) > s.seq)""".replace("seq[1]", "(SELECT ts FROM events e WHERE e.event_id = s.event_id)"))
def kv_state_of_log(spark, d):
    return keyvalue.applied(log(spark, d))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, n, event_id % 7 AS c, us + 864000000000 AS until FROM e WHERE n = 1 UNION ALL
 SELECT e.user_id, e.n, CASE WHEN e.us >= r.until THEN 0 ELSE r.c END + e.event_id % 7, CASE WHEN e.us >= r.until THEN e.us + 864000000000 ELSE r.until END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT cast(user_id as varchar) AS path, cast(arg_max(c, n) as bigint) AS counter, make_timestamp(arg_max(until, n)) AS expires FROM r GROUP BY user_id""")
def kv_counters_with_ttl(spark, d):
    """Counters that live ten days from their creation."""
    e = table(spark, d, "events")
    adds = e.select(F.struct("ts", "event_id").alias("seq"), F.col("ts").alias("at"), F.col("user_id").cast("string").alias("path"), (F.col("event_id") % 7).cast("long").alias("n"))
    return keyvalue.counters(adds, 10 * 86400 * 1_000_000)


@query("SELECT cast(user_id as varchar) AS path, cast(sum(event_id % 7) as bigint) AS counter FROM events GROUP BY user_id")
def kv_counters(spark, d):
    e = table(spark, d, "events")
    return keyvalue.counters(e.select("event_id", F.col("ts").alias("at"), F.col("user_id").cast("string").alias("path"), (F.col("event_id") % 7).cast("long").alias("n"))).drop("expires")


_REQUESTS = "e AS (SELECT user_id, ts, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events)"


@query(f"""WITH RECURSIVE {_REQUESTS}, w AS (SELECT 21600000000 AS i, 2 AS b),
r AS (SELECT user_id, ts, n, us + i AS due, true AS allowed, b - 1 AS left_ FROM e, w WHERE n = 1 UNION ALL
 SELECT user_id, ts, n, CASE WHEN room >= 0 THEN new ELSE due END, room >= 0, greatest(room, 0) // i FROM (
  SELECT e.user_id, e.ts, e.n, r.due, i, greatest(r.due, e.us) + i AS new, e.us + b * i - greatest(r.due, e.us) - i AS room FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1, w))
SELECT user_id, ts, allowed, cast(left_ as bigint) AS "left" FROM r""")
def stream_rate_limit(spark, d):
    """state_rate_limit_gcra as a stream, with a state for each user."""
    return streams.run_once(streams.rate_limited(streams.stream(spark, d, "events"), "user_id", "ts", 6 * 3600 * 1_000_000, 2), "append", "limited")


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, event_id, epoch_us(ts) AS us, CASE WHEN event_type = 'error' THEN 'refund' WHEN event_type = 'view' THEN 'peek' WHEN event_id % 40 = 0 THEN 'reset' ELSE 'use' END AS op, event_id % 3 AS k,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, cast(0 as bigint) AS n, cast(NULL as timestamp) AS ts, cast(NULL as bigint) AS event_id, cast(NULL as bigint) AS s, cast(0 as bigint) AS u, true AS allowed FROM (SELECT DISTINCT user_id FROM e) UNION ALL
 SELECT user_id, n, ts, event_id, CASE WHEN op = 'reset' THEN NULL WHEN op = 'use' AND u + k <= 5 THEN coalesce(s, us) ELSE s END,
  CASE WHEN op = 'reset' THEN 0 WHEN op = 'refund' THEN greatest(0, u - k) WHEN op = 'use' AND u + k <= 5 THEN u + k ELSE u END, CASE WHEN op IN ('use', 'peek') THEN u + k <= 5 ELSE true END
 FROM (SELECT e.user_id, e.n, e.ts, e.event_id, e.us, e.op, e.k, CASE WHEN r.s IS NOT NULL AND e.us < r.s + 259200000000 THEN r.s END AS s, CASE WHEN r.s IS NOT NULL AND e.us < r.s + 259200000000 THEN r.u ELSE 0 END AS u FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, ts, event_id, allowed, 5 - u AS "left" FROM r WHERE n > 0""")
def state_quota_log(spark, d):
    """Uses, refunds, peeks and resets of five in three days."""
    op = F.when(F.col("event_type") == "error", "refund").when(F.col("event_type") == "view", "peek").when(F.col("event_id") % 40 == 0, "reset").otherwise("use")
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", op.alias("op"), (F.col("event_id") % 3).cast("long").alias("n"))
    return state.quota_log(rows, "user_id", ["ts", "event_id"], "ts", [(3 * 86400 * 1_000_000, 5)])


# --- jobs --------------------------------------------------------------------------------------------


def everything(spark, d) -> DataFrame:
    """Orders as jobs: those of an old date failed, every 500th is under a lease."""
    o = table(spark, d, "orders").select(F.concat(F.substr("o_orderpriority", F.lit(1), F.lit(1)), F.lit("/"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderdate").alias("next"), "o_orderkey")
    old = F.col("next") < F.lit("1993-01-01").cast("timestamp_ntz")
    leases = o.where("o_orderkey % 500 = 0").select("id", F.lit("1999-01-01").cast("timestamp_ntz").alias("until"))
    return joblists.all_jobs(o.where(~old).drop("o_orderkey"), o.where(old).select("id"), leases, "1997-01-01")


JOBS = """WITH j AS (SELECT substr(o_orderpriority, 1, 1) || '/' || o_orderkey AS id, CASE WHEN o_orderdate < timestamp '1993-01-01' THEN 'failed' WHEN o_orderkey % 500 = 0 THEN 'running'
 WHEN o_orderdate <= timestamp '1997-01-01' THEN 'waiting' ELSE 'scheduled' END AS state FROM orders)
"""


@query(JOBS + "SELECT id, state FROM j WHERE starts_with(id, '2/') AND state IN ('failed', 'running') AND id > '2/2' ORDER BY id LIMIT 40")
def job_list(spark, d):
    return joblists.listed(everything(spark, d), "2/", ("failed", "running"), "2/2", 40).select("id", "state")


@query(JOBS + "SELECT count(*) FILTER (state = 'scheduled') AS scheduled, count(*) FILTER (state = 'waiting') AS waiting, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'failed') AS failed FROM j")
def job_counts_of_list(spark, d):
    return joblists.counts(everything(spark, d))


@query("""WITH s AS (SELECT o_orderpriority AS grp, count(*) AS c FROM orders WHERE o_orderdate > timestamp '1997-01-01' - interval 2 day AND o_orderdate <= timestamp '1997-01-01' GROUP BY 1),
d AS (SELECT o_orderkey AS id, o_orderdate AS next, o_orderpriority AS grp, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderdate <= timestamp '1996-01-01')
SELECT id, grp FROM d LEFT JOIN s USING (grp) WHERE n + coalesce(c, 0) <= 12""")
def job_group_rate(spark, d):
    """The due jobs that a rate of twelve starts of a group in two days lets begin."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("next"), F.col("o_orderpriority").alias("grp"))
    starts = o.select("grp", F.col("next").alias("at"))
    return joblists.may_start(o.where("next <= timestamp_ntz'1996-01-01'"), starts, "1997-01-01", 12, 2 * 86400).select("id", "grp")


@query("SELECT user_id, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts + interval 330 minute) ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def job_dedupe_by_day(spark, d):
    """One a user and day on India's clock."""
    return joblists.deduped(table(spark, d, "events"), "user_id", ["ts", "event_id"], "ts", unit="day", zone="Asia/Kolkata")


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, ts, event_id, n, true AS runs, ts + interval 36 hour AS until FROM e WHERE n = 1 UNION ALL
 SELECT e.user_id, e.ts, e.event_id, e.n, e.ts >= r.until, CASE WHEN e.ts >= r.until THEN e.ts + interval 36 hour ELSE r.until END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, ts, event_id FROM r WHERE runs""")
def job_dedupe_by_span(spark, d):
    return joblists.deduped(table(spark, d, "events"), "user_id", ["ts", "event_id"], "ts", span="36 hours")


# --- files and streams ---------------------------------------------------------------------------------


def files(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("n_chars").cast("long").alias("size"))


FILES = "WITH f AS (SELECT source || '/' || doc_id || '.txt' AS path, cast(n_chars as bigint) AS size FROM documents)\n"


@query(FILES + "SELECT path, size FROM f WHERE starts_with(path, 'src1/') AND path > 'src1/3' ORDER BY path LIMIT 25")
def blob_page(spark, d):
    """By the bytes of the path: 10.txt comes before 9.txt."""
    return tables.listed(files(spark, d), "src1/", "src1/3", 25)


@query(FILES + "SELECT count(*) AS files, cast(sum(size) as bigint) AS size FROM f WHERE starts_with(path, 'src1')")
def blob_usage_of_prefix(spark, d):
    return tables.usage(files(spark, d), "src1")


@query("SELECT event_id, user_id FROM events WHERE event_id % 2 = 1")
def stream_poll_goes_on(spark, d):
    """Two polls with one cursor: the second gives what came in between, and nothing twice."""
    e, inbox, notes = table(spark, d, "events"), shared_path(spark, "inbox"), shared_path(spark, "cursor")
    source = lambda: spark.readStream.schema(e.schema).parquet(inbox)
    e.where("event_id % 2 = 0").write.parquet(inbox)
    streams.poll(source(), notes)
    e.where("event_id % 2 = 1").write.mode("append").parquet(inbox)
    return streams.poll(source(), notes).select("event_id", "user_id")


@query("SELECT event_id, false AS missed FROM events WHERE ts >= timestamp '2024-01-20' UNION ALL SELECT count(*), true FROM events WHERE ts > timestamp '2024-01-15' AND ts < timestamp '2024-01-20'")
def stream_tail_missed(spark, d):
    """A reader that opened on the 15th while retention had reached the 20th."""
    after, missed = streams.tail(table(spark, d, "events"), "ts", "2024-01-15", "2024-01-20")
    return after.select("event_id", F.lit(False).alias("missed")).unionByName(missed.select(F.col("missed").alias("event_id"), F.lit(True).alias("missed")))
