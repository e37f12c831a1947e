"""The registered queries of the engine's own operators, and DuckDB SQL for those that SQL can express.

Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cron, exact, timegrid
from ..operators import search, state, wordindex
from ..operators.metrics import COUNTER, FRACTIONS, Metrics, grid_index, grid_interval, ingest, interval, merged_grids, replace_range
from ..operators.records import Records, appended, filled, poll
from ..operators.tablequery import TableQuery, either, eq, every, is_in
from ..operators.wordindex import WordIndex
from ..session import ship
from ..sources import formats
from ..sources.tables import records, samples, table
from ..streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]
ASKED = ["the", "than", "eaou", "thinor"]


def query(sql: str | None = None):
    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return put


def gauge(spark, d) -> Metrics:
    return Metrics(samples(spark, d), ("event_type", "user"))


def counter(spark, d) -> Metrics:
    return Metrics(samples(spark, d), ("event_type", "user"), COUNTER)


DAY = "date_trunc('day', ts)::timestamp"


def big(value: str) -> str:
    """A double as a whole number of 2**-60; exact from 2**-8 on."""
    return f"cast(({value}) * pow(2.0::double, 60) as hugeint)"


def back(total: str, times: int = 1, over: str = "1") -> str:
    """total * times / over, a whole number of 2**-60, as the nearest double: by its digits, with ".5" for what a division leaves."""
    if over == "1":
        return f"(cast(cast({total} as varchar) as double) / pow(2.0::double, 60))"
    whole = f"({total}) * {times * 2**20}"
    return f"(cast(cast({whole} // ({over}) as varchar) || CASE WHEN {whole} % ({over}) = 0 THEN '' ELSE '.5' END as double) / pow(2.0::double, 80))"


SUM = back(f"sum({big('value')})")
STEPS = f"""WITH s AS (SELECT event_type, cast(user_id as varchar) AS u, ts, value, lag(value) OVER w AS prev, lag(ts) OVER w AS prev_at, lead(ts) OVER w AS next_at FROM events
 WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts)),
t AS (SELECT *, CASE WHEN prev IS NULL THEN 0::hugeint WHEN value < prev THEN {big('value')} ELSE {big('value')} - {big('prev')} END AS step FROM s)
"""

# --- metrics -----------------------------------------------------------------------------------------


@query(f"SELECT event_type, date_trunc('hour', ts)::timestamp AS bucket, count(*) AS count, {SUM} AS sum, count(*) AS samples, false AS partial FROM events GROUP BY ALL")
def metric_count_1h_by_type(spark, d):
    return gauge(spark, d).every("1 hour").by("event_type").aggregate("count", "sum")


@query(f"SELECT event_type, {DAY} AS bucket, {SUM} AS sum, {back('sum(' + big('value') + ')', 1, 'count(*)')} AS avg, count(*) AS samples, false AS partial FROM events GROUP BY ALL")
def metric_sum_avg_1d_by_type(spark, d):
    return gauge(spark, d).every("1 day").by("event_type").aggregate("sum", "avg")


@query(f"SELECT {DAY} AS bucket, min(value) AS min, max(value) AS max, count(*) AS samples, false AS partial FROM events GROUP BY ALL")
def metric_min_max_1d(spark, d):
    return gauge(spark, d).every("1 day").aggregate("min", "max")


@query(STEPS + f"""SELECT u AS "user", {DAY} AS bucket, {back('sum(step)')} AS increase, count(*) AS samples,
 count(*) FILTER (value < prev) AS resets, false AS partial FROM t WHERE ts >= timestamp '2024-01-05' GROUP BY ALL""")
def metric_increase_1d_by_user(spark, d):
    return counter(spark, d).between("2024-01-05", None).every("1 day").by("user").aggregate("increase").drop("gap")


@query(STEPS + f"SELECT event_type, date_trunc('hour', ts)::timestamp AS bucket, {back('sum(step)', 1, '3600')} AS rate, count(*) AS samples FROM t GROUP BY ALL")
def metric_rate_1h(spark, d):
    return counter(spark, d).every("1 hour").by("event_type").aggregate("rate").select("event_type", "bucket", "rate", "samples")


@query(STEPS + f"""SELECT event_type, b AS bucket, {back('sum(step)', 1000000, 'least(epoch_us(b) + 86400000000, epoch_us(timestamp ' + "'2024-01-09 06:00:00'" + ')) - greatest(epoch_us(b), epoch_us(timestamp ' + "'2024-01-03 12:34:56'" + '))')} AS rate, count(*) AS samples,
 bool_or(coalesce((prev_at < b OR prev_at < timestamp '2024-01-03 12:34:56') AND prev_at < b - interval 1 day, false)) AS gap,
 b < timestamp '2024-01-03 12:34:56' OR b + interval 1 day > timestamp '2024-01-09 06:00:00' AS partial
FROM (SELECT *, (date_trunc('day', ts - interval 5 hour)::timestamp + interval 5 hour)::timestamp AS b FROM t WHERE ts >= timestamp '2024-01-03 12:34:56' AND ts < timestamp '2024-01-09 06:00:00') GROUP BY event_type, b""")
def metric_rate_calendar_days_cut(spark, d):
    """The first and the last day are cut by the range, and rates go by what is left of them."""
    m = counter(spark, d).between("2024-01-03 12:34:56", "2024-01-09 06:00:00").calendar("day", "America/New_York")
    return m.by("event_type").aggregate("rate").drop("resets")


@query(STEPS + f"""SELECT u AS "user", timestamp '2024-01-10' AS bucket, {back('sum(step)', 1000000, '172800000000')} AS rate, {back('sum(step)')} AS increase, count(*) AS samples,
 count(*) FILTER (value < prev) AS resets, bool_or(coalesce(prev_at < timestamp '2024-01-08', false)) AS gap, false AS partial
FROM t WHERE ts >= timestamp '2024-01-10' AND ts < timestamp '2024-01-12' GROUP BY u""")
def metric_rate_whole_range(spark, d):
    return counter(spark, d).between("2024-01-10", "2024-01-12").by("user").aggregate("rate", "increase")


@query(STEPS + f"""SELECT event_type, bucket, {back('sum(CASE WHEN prev IS NULL THEN 0::hugeint ELSE ' + big('value') + ' - ' + big('prev') + ' END)')} AS delta,
 {back('sum(' + big('value') + ') FILTER (prev_at IS NULL OR prev_at < bucket)')} AS first, {back('sum(' + big('value') + ') FILTER (next_at IS NULL OR next_at >= bucket + interval 1 day)')} AS last, count(*) AS samples
FROM (SELECT *, {DAY} AS bucket FROM t) GROUP BY event_type, bucket""")
def metric_delta_first_last_1d(spark, d):
    return gauge(spark, d).every("1 day").by("event_type").aggregate("delta", "first", "last").drop("resets", "gap", "partial")


@query(f"""SELECT event_type, {DAY} AS bucket, {back('coalesce(sum(' + big('value') + ') FILTER (user_id % 5 <> 0), 0::hugeint)')} AS sum, count(*) FILTER (user_id % 5 <> 0) AS samples, count(*) FILTER (user_id % 5 = 0) AS skipped, false AS partial
FROM events GROUP BY ALL HAVING count(*) FILTER (user_id % 5 <> 0) > 0""")
def metric_sum_skips_nan(spark, d):
    """Every fifth user's samples are no numbers: passed over, and counted."""
    s = samples(spark, d).withColumn("value", F.when(F.col("user").cast("long") % 5 == 0, float("nan")).otherwise(F.col("value")))
    return Metrics(s, ("event_type", "user")).skip_nan().every("1 day").by("event_type").aggregate("sum").where("samples > 0")


@query(f"SELECT event_type, {DAY} AS bucket, quantile_disc(value, 0.95) AS value, count(*) AS samples FROM events GROUP BY ALL")
def metric_p95_1d_nearest_rank(spark, d):
    return gauge(spark, d).every("1 day").by("event_type").percentile("95")


@query(f"""WITH h AS (SELECT event_type, {DAY} AS bucket, le, count(*) FILTER (value <= le) AS c, count(*) AS n FROM events, (VALUES (1.0::double),(5.0),(10.0),(25.0),(50.0),(100.0),(250.0),(500.0),('inf'::double)) b(le) GROUP BY ALL),
g AS (SELECT *, coalesce(lag(le) OVER w, 0.0) AS lower, coalesce(lag(c) OVER w, 0) AS under FROM h WINDOW w AS (PARTITION BY event_type, bucket ORDER BY le))
SELECT event_type, bucket, cast(lower as double) AS lower, CASE WHEN isinf(le) THEN NULL ELSE le END AS upper, n AS samples,
 CASE WHEN isinf(le) THEN lower ELSE lower + (le - lower) * ((n * 0.95::double - under) / (c - under)) END AS estimate
FROM g WHERE c * 20 >= n * 19 AND under * 20 < n * 19""")
def metric_histogram_p95_bounds(spark, d):
    m = gauge(spark, d).every("1 day").by("event_type")
    return interval(m.histogram(BOUNDS), ["event_type", "bucket"], "95")


@query(f"""SELECT event_type, {DAY} AS bucket, le, count(*) FILTER (value <= le OR le IS NULL) AS c FROM events,
 (VALUES (1.0::double),(5.0),(10.0),(25.0),(50.0),(100.0),(250.0),(500.0),(NULL)) b(le) GROUP BY ALL""")
def metric_heatmap(spark, d):
    return gauge(spark, d).every("1 day").by("event_type").histogram(BOUNDS)


@query(STEPS + f"""SELECT u AS "user", bucket, {back('sum(step)')} AS increase, count(*) AS samples, count(*) FILTER (value < prev) AS resets,
 bool_or(coalesce(prev_at < bucket - interval 1 day, false)) AS gap, bucket < timestamp '2024-01-04 05:00:00' OR bucket + interval 1 day > timestamp '2024-01-20 12:00:00' AS partial
FROM (SELECT *, {DAY} AS bucket FROM t WHERE ts >= timestamp '2024-01-04 05:00:00' AND ts < timestamp '2024-01-20 12:00:00') GROUP BY u, bucket""")
def metric_gap_partial_flags(spark, d):
    return counter(spark, d).between("2024-01-04 05:00:00", "2024-01-20 12:00:00").every("1 day").by("user").aggregate("increase")


@query(f"""WITH k AS (SELECT event_type, cast(user_id as varchar) AS u, ts, value, lag(ts) OVER w AS older FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts)),
s AS (SELECT *, lag(value) OVER w AS prev FROM k WHERE ts >= timestamp '2024-01-06 12:00:00' WINDOW w AS (PARTITION BY event_type, u ORDER BY ts))
SELECT event_type, {DAY} AS bucket, {back('sum(CASE WHEN prev IS NULL THEN 0::hugeint WHEN value < prev THEN ' + big('value') + ' ELSE ' + big('value') + ' - ' + big('prev') + ' END)')} AS increase, count(*) AS samples,
 bool_or(prev IS NULL AND older IS NOT NULL) OR bool_or({DAY} < timestamp '2024-01-06 12:00:00') AS partial FROM s GROUP BY event_type, {DAY}""")
def metric_increase_past_retention(spark, d):
    """A first step that began at a sample past retention is unknown, and its bucket partial."""
    return counter(spark, d).retain("2024-01-06 12:00:00").every("1 day").by("event_type").aggregate("increase").drop("resets", "gap")


@query("""WITH b AS (SELECT event_type, date_trunc('hour', ts)::timestamp AS bucket, count(*) AS count FROM events WHERE ts >= timestamp '2024-01-02' AND ts < timestamp '2024-01-04' GROUP BY ALL),
g AS (SELECT event_type, bucket::timestamp AS bucket FROM (SELECT DISTINCT event_type FROM b), (SELECT unnest(generate_series(timestamp '2024-01-02', timestamp '2024-01-03 23:00:00', interval 1 hour)) AS bucket))
SELECT g.event_type, g.bucket, b.count, b.count AS samples, CASE WHEN b.count IS NULL THEN NULL ELSE false END AS partial FROM g LEFT JOIN b USING (event_type, bucket)""")
def metric_fill_1h(spark, d):
    m = gauge(spark, d).between("2024-01-02", "2024-01-04").every("1 hour").by("event_type")
    return m.fill(m.aggregate("count"), "2024-01-02", "2024-01-04")


@query(f"""SELECT event_type, (date_trunc('month', ts + interval 330 minute)::timestamp - interval 330 minute)::timestamp AS bucket, {SUM} AS sum, count(*) AS samples, false AS partial FROM events GROUP BY ALL""")
def metric_calendar_month_zone(spark, d):
    return gauge(spark, d).calendar("month", "Asia/Kolkata").by("event_type").aggregate("sum")


@query(f"SELECT date_trunc('week', ts)::timestamp AS bucket, {SUM} AS sum, count(*) AS samples, false AS partial FROM events GROUP BY ALL")
def metric_calendar_week(spark, d):
    return gauge(spark, d).calendar("week").aggregate("sum")


@query("SELECT event_type, cast(user_id as varchar) AS \"user\", max(ts) AS at, arg_max(value, ts) AS value FROM events GROUP BY ALL")
def metric_latest(spark, d):
    return gauge(spark, d).latest()


@query("SELECT event_type, cast(user_id as varchar) AS \"user\", ts AS at, value FROM events WHERE ts >= timestamp '2024-01-03' AND ts < timestamp '2024-01-04'")
def metric_read_range(spark, d):
    return gauge(spark, d).between("2024-01-03", "2024-01-04").read()


@query("SELECT DISTINCT event_type AS value FROM events WHERE starts_with(event_type, 's') ORDER BY 1")
def metric_label_values(spark, d):
    return gauge(spark, d).label_values("event_type", "s")


@query("SELECT count(DISTINCT (event_type, user_id)) AS series, count(*) AS samples, min(ts) AS retained_from, max(ts) AS newest FROM events")
def metric_names(spark, d):
    return gauge(spark, d).names()


@query(f"""SELECT event_type, {DAY} AS bucket, count(*) AS count, count(*) AS samples FROM events WHERE event_type IN ('click', 'view', 'error') AND (user_id IS NULL OR user_id NOT IN (1, 2, 3)) AND starts_with(cast(user_id as varchar), '1') GROUP BY ALL""".replace("AS samples", "AS samples, false AS partial"))
def metric_label_conditions(spark, d):
    return gauge(spark, d).one_of("event_type", "click", "view", "error").none_of("user", "1", "2", "3").prefix("user", "1").every("1 day").by("event_type").aggregate("count")


@query(f"SELECT cast(user_id as varchar) AS \"user\", {DAY} AS bucket, max(value) AS max, count(*) AS samples, false AS partial FROM events WHERE ts >= timestamp '2024-01-10' GROUP BY ALL")
def metric_without_retention(spark, d):
    return gauge(spark, d).retain("2024-01-10").without("event_type").every("1 day").aggregate("max")


@query(f"SELECT event_type, {SUM} AS sum FROM events GROUP BY ALL")
def metric_exact_binary_sum(spark, d):
    """The correctly rounded sum of the doubles themselves."""
    return exact.exact_sum(samples(spark, d), ("event_type",), "value")


@query("SELECT event_type, count(*) AS added FROM events WHERE event_id % 3 <> 0 GROUP BY ALL")
def metric_ingest_idempotent(spark, d):
    s = table(spark, d, "events").select("event_id", F.col("ts").alias("at"), "value", "event_type", F.col("user_id").cast("string").alias("user"))
    held = s.where("event_id % 3 = 0").drop("event_id")
    added, _ = ingest(held, s.drop("event_id"), ["event_type", "user"])
    return added.groupBy("event_type").agg(F.count("*").alias("added"))


@query("SELECT event_type, cast(user_id as varchar) AS \"user\", ts AS at, CASE WHEN event_type = 'view' AND user_id = 7 AND ts >= timestamp '2024-01-05' AND ts < timestamp '2024-01-20' THEN value * 2 ELSE value END AS value FROM events")
def metric_replace_range(spark, d):
    s = samples(spark, d).select("event_type", "user", "at", "value")
    new = s.where("event_type = 'view' AND user = '7' AND at >= timestamp_ntz'2024-01-05' AND at < timestamp_ntz'2024-01-20'").withColumn("value", F.col("value") * 2)
    return replace_range(s, new, {"event_type": "view", "user": "7"}, "2024-01-05", "2024-01-20")


@query("SELECT 'nation_region' AS name, 'gauge' AS kind, n_name AS nation, cast(1790000000000 as bigint) AS at_ms, cast(n_regionkey as double) AS value FROM nation")
def prometheus_parse(spark, d):
    """Nations as an exposition, read back as samples."""
    text = F.concat_ws("\n", F.lit("# TYPE nation_region gauge"), F.concat(F.lit('nation_region{name="'), F.col("n_name"), F.lit('"} '), F.col("n_regionkey"), F.lit(" 1790000000000")))
    found = formats.prometheus(table(spark, d, "nation").select(text.alias("value")), 0)
    return found.select("name", "kind", F.col("labels")["name"].alias("nation"), "at_ms", "value")


def exponential(spark, d):
    """Bins of each type and day: odd users at schema 2, the others at schema 3, as two writers keep them."""
    s = samples(spark, d).withColumn("bucket", timegrid.bucket_start(F.col("at"), "1 day"))
    odd = F.pmod(F.col("user").cast("long"), F.lit(2)) == 1
    schema, index = F.when(odd, 2).otherwise(3), F.when(odd, grid_index(F.abs("value"), 2)).otherwise(grid_index(F.abs("value"), 3))
    return s.groupBy("event_type", "bucket", schema.alias("schema"), index.alias("index")).agg(F.count("*").alias("c"))


_GRID = ", ".join(f"({j}, {f!r}::double)" for j, f in enumerate(FRACTIONS))
BINS = f"""WITH f(j, f) AS (VALUES {_GRID}), o AS (SELECT unnest(generate_series(-40, 40)) AS o),
g AS (SELECT 3 AS schema, cast(o * 8 + j as integer) AS index, f * pow(2.0::double, o + 1) AS upper FROM f, o UNION ALL SELECT 2, cast(o * 4 + j // 2 as integer), f * pow(2.0::double, o + 1) FROM f, o WHERE j % 2 = 0),
b AS (SELECT schema, index, upper, coalesce(lag(upper) OVER (PARTITION BY schema ORDER BY upper), 0.0) AS lower FROM g),
k AS (SELECT user_id % 2 = 1 AS odd, event_type, {DAY} AS bucket, abs(value) AS v FROM events),
c AS (SELECT event_type, bucket, CASE WHEN bool_or(odd) OVER (PARTITION BY event_type, bucket) THEN 2 ELSE 3 END AS schema, v FROM k),
n AS (SELECT event_type, bucket, c.schema, index, coalesce(lower, 0.0) AS lower, coalesce(upper, 0.0) AS upper, count(*) AS c FROM c LEFT JOIN b ON c.schema = b.schema AND v > lower AND v <= upper GROUP BY ALL)
"""


@query(BINS + "SELECT event_type, bucket, schema, index, c FROM n")
def metric_exponential_bins(spark, d):
    return merged_grids(exponential(spark, d), ["event_type", "bucket"])


@query(BINS + """, r AS (SELECT *, sum(c) OVER (PARTITION BY event_type, bucket ORDER BY upper) AS upto, sum(c) OVER (PARTITION BY event_type, bucket) AS total FROM n)
SELECT event_type, bucket, lower, upper, cast(total as bigint) AS samples FROM r WHERE upto * 20 >= total * 19 AND (upto - c) * 20 < total * 19""")
def metric_exponential_p95(spark, d):
    return grid_interval(merged_grids(exponential(spark, d), ["event_type", "bucket"]), ["event_type", "bucket"], "95")


# --- records -----------------------------------------------------------------------------------------

K = "props->>'k'"


def events(spark, d) -> Records:
    return Records(records(spark, d))


@query(f"SELECT event_id AS id, event_type AS name, ts AS at FROM events WHERE {K} IN ('1', '2') AND event_type <> 'view'")
def record_list_where_k(spark, d):
    return events(spark, d).where("k", "1", "2").where_not("name", "view").found().select("id", "name", "at")


@query("SELECT event_id AS id FROM events WHERE event_type ILIKE '%ERR%' OR cast(user_id as varchar) LIKE '%err%'")
def record_search_text(spark, d):
    return events(spark, d).search("Err").found().select("id")


@query("SELECT event_id AS id, event_type AS name FROM events WHERE event_type = 'error' AND ts >= timestamp '2024-01-02' AND ts < timestamp '2024-01-09'")
def record_min_level(spark, d):
    return events(spark, d).min_level(8).between("2024-01-02", "2024-01-09").found().select("id", "name")


@query(f"SELECT {K} AS value, count(*) AS events FROM events WHERE {K} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def record_top_k(spark, d):
    return events(spark, d).top("k")


@query(f"SELECT event_id AS id, cast({K} as bigint) AS k FROM events WHERE {K} IS NOT NULL ORDER BY cast({K} as bigint) DESC, ts, event_id LIMIT 10")
def record_largest_k(spark, d):
    return events(spark, d).largest("k").select("id", F.col("number").cast("long").alias("k"))


@query(f"""SELECT event_type AS name, {DAY} AS span, count(*) AS events, count({K}) AS samples, cast(sum(cast({K} as hugeint)) as double) AS sum, cast(min(cast({K} as bigint)) as double) AS min,
 cast(max(cast({K} as bigint)) as double) AS max, cast(sum(cast({K} as hugeint)) as double) / count({K}) AS avg, cast(sum(cast({K} as hugeint)) as bigint) AS whole, count(DISTINCT user_id) AS distinct_user FROM events GROUP BY ALL""")
def record_aggregate_stats_distinct(spark, d):
    return events(spark, d).aggregate(("name",), "1 day", "k", ("user",)).withColumn("whole", F.col("whole").cast("long"))


@query(f"SELECT event_type AS name, count(*) AS events, count(*) AS samples, {SUM} AS sum, min(value) AS min, max(value) AS max, {back('sum(' + big('value') + ')', 1, 'count(*)')} AS avg FROM events GROUP BY ALL")
def record_stats_of_floats(spark, d):
    """Numbers of a field that are no integers: their sum is that of the doubles, rounded once."""
    r = records(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("id"), "value"), "id")
    r = r.withColumn("fields", F.concat(F.lit('{"v": '), F.col("value").cast("string"), F.lit(', "w": [1, {"x": "\\u0041"}]}')))
    return Records(r).aggregate(("name",), stats="v").drop("whole")


@query("""WITH b AS (SELECT event_type AS name, date_trunc('hour', ts)::timestamp AS span, count(*) AS events FROM events GROUP BY ALL),
g AS (SELECT name, span::timestamp AS span FROM (SELECT DISTINCT name FROM b), (SELECT unnest(generate_series((SELECT min(span) FROM b), (SELECT max(span) FROM b), interval 1 hour)) AS span))
SELECT g.name, g.span, coalesce(b.events, 0) AS events FROM g LEFT JOIN b USING (name, span)""")
def record_aggregate_fill(spark, d):
    return filled(events(spark, d).aggregate(("name",), "1 hour"), ["name"], "1 hour", ["events"])


@query("SELECT event_id AS id, ts AS at FROM events WHERE ts >= (SELECT min(ts) FROM (SELECT ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100))")
def record_page_no_split_ts(spark, d):
    return events(spark, d).list(newest=True, limit=100).select("id", "at")


@query("""SELECT key, CASE json_type(props, '$.' || key) WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean'
 WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' ELSE 'null' END AS kind, count(*) AS events FROM (SELECT props, unnest(json_keys(props)) AS key FROM events) GROUP BY ALL""")
def record_fields(spark, d):
    return events(spark, d).fields()


@query("SELECT DISTINCT unnest(json_keys(props)) AS key FROM events UNION SELECT unnest(json_keys('{\"user\": ' || user_id || '}')) FROM events ORDER BY key")
def record_field_names(spark, d):
    return events(spark, d).field_names()


@query("SELECT 'events' AS stream, count(*) AS events, min(ts) AS retained_from, max(ts) AS newest FROM events")
def record_streams(spark, d):
    return events(spark, d).stream_list()


@query("SELECT event_id AS id FROM events WHERE (ts, event_id) > ((SELECT ts FROM events WHERE event_id = 4000), 4000) ORDER BY ts, event_id LIMIT 60")
def record_list_after(spark, d):
    """The events after one of them, in the order of time and arrival."""
    place = table(spark, d, "events").where("event_id = 4000").select(F.col("ts").cast("string")).first()
    return events(spark, d).after(place[0] if place else "1970-01-01", 4000).found().orderBy("at", "id").select("id").limit(60)


@query("SELECT event_id AS id FROM events WHERE md5(cast(user_id as varchar)) = md5('7')")
def record_trace(spark, d):
    """The events of a trace: here one for each user."""
    r = records(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("id"), F.md5(F.col("user_id").cast("string")).alias("trace_id")), "id")
    return Records(r).trace("8f14e45fceea167a5a36dedd4bea2543").found().select("id")


@query("SELECT event_id AS id, cast(NULL as bigint) AS cursor, cast(NULL as bigint) AS expired FROM (SELECT event_id FROM events WHERE event_id >= 500 ORDER BY event_id LIMIT 70) UNION ALL SELECT NULL, max(event_id), 500 - 1 - 200 FROM (SELECT event_id FROM events WHERE event_id >= 500 ORDER BY event_id LIMIT 70)")
def record_poll(spark, d):
    """A reader at 200 whose stream is kept from 500 on: the next seventy, its next place, and how many it missed."""
    page, after = poll(table(spark, d, "events").withColumn("arrival", F.col("event_id")), 200, 70, 500)
    none = F.lit(None).cast("long")
    return page.select(F.col("event_id").alias("id"), none.alias("cursor"), none.alias("expired")).unionByName(after.select(none.alias("id"), "cursor", "expired"))


@query("SELECT count(*) AS events FROM events WHERE event_type IN ('click', 'view')")
def record_count(spark, d):
    return events(spark, d).names("click", "view").count()


@query(f"SELECT event_type AS name, count(*) AS events FROM events WHERE NOT starts_with({K}, '1') GROUP BY ALL")
def record_delete_where(spark, d):
    return Records(events(spark, d).where_prefix("k", "1").deleted()).aggregate(("name",))


@query("SELECT event_type AS name, count(*) AS events FROM events WHERE event_id % 2 = 1 GROUP BY ALL")
def record_append_dedupe(spark, d):
    r = records(spark, d)
    return Records(appended(r.where("id % 2 = 0"), r.unionByName(r))).aggregate(("name",))


@query("SELECT CASE WHEN event_type = 'error' THEN 8 ELSE 4 END AS level, event_type AS message, count(*) AS events FROM events GROUP BY ALL")
def record_lines_source(spark, d):
    """Events as logfmt lines, read back with their levels."""
    e = table(spark, d, "events")
    line = F.concat(F.lit("level="), F.when(F.col("event_type") == "error", "error").otherwise("info"), F.lit(' msg="'), F.col("event_type"), F.lit('" user='), F.col("user_id"))
    return formats.lines(e.select(line.alias("value"))).groupBy("level", "message").agg(F.count("*").alias("events"))


@query("SELECT conv_id || '/' || turn AS id, role AS name FROM conversations WHERE text ILIKE '%the%' OR role ILIKE '%the%'")
def record_message_search(spark, d):
    """Turns of conversations whose message holds a text."""
    c = table(spark, d, "conversations")
    r = c.select(F.lit(None).cast("timestamp_ntz").alias("at"), F.lit("talk").alias("stream"), F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("role").alias("name"), F.lit(4).alias("level"), F.col("text").alias("message"), F.lit("{}").alias("fields"), F.lit("{}").alias("context"))
    return Records(r).search("the").found().select("id", "name")


@query("""SELECT role AS source, count(*) AS events, cast(sum(CASE WHEN turn % 2 = 0 THEN 3 ELSE 1 END) as bigint) AS lines FROM conversations GROUP BY role""")
def record_joined_lines(spark, d):
    """Turns as lines of a log, every other one with a trace of two lines, joined again."""
    c = table(spark, d, "conversations").select("role", "conv_id", "turn")
    trace = F.array(F.lit("request failed"), F.lit('  File "app.py", line 3, in handle'), F.lit("ValueError: bad input"))
    c = c.select("role", "conv_id", "turn", F.posexplode(F.when(F.col("turn") % 2 == 0, trace).otherwise(F.array(F.lit("ok")))).alias("i", "value"))
    numbered = c.select(F.col("role").alias("source"), (F.row_number().over(Window.partitionBy("role").orderBy("conv_id", "turn", "i")) - 1).cast("long").alias("n"), "value")
    found = formats.joined(numbered)
    return found.groupBy("source").agg(F.count("*").alias("events"), F.sum(F.size(F.split("value", "\n"))).alias("lines"))


# --- tables ------------------------------------------------------------------------------------------


def q(spark, d, name, alias=None) -> TableQuery:
    return TableQuery.table(table(spark, d, name), alias or name)


@query("""SELECT n_name, count(*) AS orders, cast(sum(cast(o_totalprice as decimal(38,2))) as double) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
 WHERE o_orderstatus = 'O' GROUP BY n_name HAVING count(*) > 10""")
def sql_join_filter_group_having(spark, d):
    return (
        q(spark, d, "orders", "o").join(table(spark, d, "customer"), "c", "o.o_custkey = c.c_custkey").join(table(spark, d, "nation"), "n", "c.c_nationkey = n.n_nationkey")
        .filter(eq("o.o_orderstatus", "O")).group_by("n.n_name").select("n_name", "count(*) as orders", "cast(sum(cast(o_totalprice as decimal(38,2))) as double) as total").having("orders > 10").rows()
    )


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def sql_left_join_null_counts(spark, d):
    return q(spark, d, "customer", "c").left_join(table(spark, d, "orders"), "o", "o.o_custkey = c.c_custkey").group_by("c.c_custkey").select("c_custkey", "count(o.o_orderkey) as orders").rows()


@query("SELECT count(*) AS count FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 0)")
def sql_count_groups(spark, d):
    return q(spark, d, "customer", "c").filter("c_acctbal > 0").group_by("c_nationkey").select("count(*) as n").count()


@query("""SELECT c_custkey, i, o_orderkey, o_totalprice FROM (SELECT c_custkey, o_orderkey, o_totalprice, cast(row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) as bigint) AS i
 FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000) WHERE i <= 3""")
def sql_include_top3_orders_per_customer(spark, d):
    kids = q(spark, d, "orders", "o").select("o_orderkey", "o_totalprice").order_by("o_totalprice", True).order_by("o_orderkey").limit(3)
    parents = q(spark, d, "customer", "c").filter("c_acctbal > 5000").include(kids, ("c_custkey", "o_custkey"), "orders")
    return parents.select("c_custkey", F.posexplode("orders").alias("i", "o")).select("c_custkey", (F.col("i") + 1).cast("long").alias("i"), "o.*")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 50")
def sql_keyset_page2(spark, d):
    o = q(spark, d, "orders", "o").select("o_orderkey", "o_totalprice").order_by("o_totalprice", True).order_by("o_orderkey")
    first, _ = o.page(50)
    end = first.orderBy("o_totalprice", F.desc("o_orderkey")).first().asDict()  # the last row of the page, as a client has it
    return o.page(50, o.cursor(end))[0]


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 40")
def sql_order_limit_offset(spark, d):
    return q(spark, d, "orders", "o").select("o_orderkey", "o_totalprice").order_by("o_totalprice").order_by("o_orderkey").offset(40).limit(20).rows()


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 AND o_orderstatus <> 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders""")
def sql_upsert_only_if(spark, d):
    o = table(spark, d, "orders")
    new = o.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return TableQuery.table(o, "old").upsert(new, ["o_orderkey"], "old.o_orderstatus <> 'F'").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' OR c_nationkey IN (1, 2) THEN 0.0::double ELSE c_acctbal END AS c_acctbal FROM customer")
def sql_update_where(spark, d):
    return q(spark, d, "customer", "c").filter(either(eq("c_mktsegment", "BUILDING"), is_in("c_nationkey", [1, 2]))).update(c_acctbal=F.lit(0.0)).select("c_custkey", "c_acctbal")


@query("SELECT count(*) AS left_over FROM customer WHERE NOT (c_acctbal < 0 AND c_nationkey > 3)")
def sql_delete_where(spark, d):
    return q(spark, d, "customer", "c").filter(every(F.col("c_acctbal") < 0, F.col("c_nationkey") > 3)).delete().agg(F.count("*").alias("left_over"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def sql_semi_join(spark, d):
    return q(spark, d, "customer", "c").semi_join(table(spark, d, "orders").where("o_totalprice > 300000"), "o", "c.c_custkey = o.o_custkey").rows().select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def sql_anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT n_name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 INTERSECT SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey EXCEPT SELECT n_name FROM nation WHERE n_regionkey = 0")
def sql_set_operations(spark, d):
    n = table(spark, d, "nation")
    rich = n.join(table(spark, d, "customer").where("c_acctbal > 9000"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name")
    with_supplier = n.join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name")
    return rich.intersect(with_supplier).subtract(n.where("n_regionkey = 0").select("n_name"))


@query("WITH RECURSIVE r(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM r WHERE i < 90) SELECT cast(i as integer) AS i FROM r")
def sql_raw_recursive(spark, d):
    return spark.sql("WITH RECURSIVE r(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM r WHERE i < ?) SELECT i FROM r", args=[90])


@query("""SELECT l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(38,2))) as double) AS quantity, count(*) AS lines FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02' GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def sql_rollup(spark, d):
    return table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'").rollup("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(38,2)")).cast("double").alias("quantity"), F.count("*").alias("lines"))


# --- search ------------------------------------------------------------------------------------------

FIELDS = {"text": 1.0, "source": 2.0}
ASKED_TEXT = "the than, eaou thinor"
#: The analyser in SQL: marks off, words by the signs that may stand within them, letters and numbers alone.
_PARTED = r"regexp_replace(regexp_replace({0}, '(\p{{L}}\p{{M}}*)[.'':·’](\p{{L}})', '\1\2', 'g'), '(\p{{L}}\p{{M}}*)[.'':·’](\p{{L}})', '\1\2', 'g')"
_JOINED = r"regexp_replace(regexp_replace({0}, '(\p{{N}})[.,;''](\p{{N}})', '\1\2', 'g'), '(\p{{N}})[.,;''](\p{{N}})', '\1\2', 'g')"


def terms_of(text: str) -> str:
    parted = _JOINED.format(_PARTED.format(f"strip_accents(lower(coalesce({text}, '')))"))
    return rf"list_filter(list_transform(regexp_extract_all({parted}, '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda x: replace(x, '_', '')), lambda x: x <> '')"


_SAT = "tf * (1.2::double + 1) / (tf + 1.2::double * (1 - 0.75::double + 0.75::double * length / (tokens / n)))"
TERMS = f"""t AS (SELECT doc_id AS doc, 0 AS field, 1.0::double AS weight, {terms_of('text')} AS terms FROM documents UNION ALL SELECT doc_id, 1, 2.0::double, {terms_of('source')} FROM documents),
x AS (SELECT doc, field, weight, len(terms) AS length, unnest(terms) AS term FROM t), p AS (SELECT doc, field, weight, length, term, count(*) AS tf FROM x GROUP BY ALL),
s AS (SELECT field, cast(sum(len(terms)) as double) AS tokens, (SELECT count(*) FROM documents) AS n FROM t GROUP BY field)
"""


def scored_by(asked: list[str], table: str = "p") -> str:
    """(doc, points) of words of a question; stems of words that aren't Cyrillic are the words, but nothing is held by them."""
    some = ", ".join(f"'{w}'" for w in asked)
    return f"""WITH {TERMS}, h AS (SELECT * FROM {table} WHERE term IN ({some})), f AS (SELECT field, term, count(*) AS df FROM h GROUP BY field, term),
b AS (SELECT doc, cast(sum(cast(floor(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * ({_SAT}) * 4294967296.0::double + 0.5) as bigint)) as bigint) AS points FROM h JOIN f USING (field, term) JOIN s USING (field) GROUP BY doc)
"""


SCORED = scored_by(ASKED)


def index(spark, d) -> WordIndex:
    """The documents' index, by their texts and, twice as heavy, their sources. Built once in an application."""
    return wordindex.kept(table(spark, d, "documents"), d, "doc_id", FIELDS)


@query(SCORED + "SELECT doc, points, points / 4294967296.0::double AS score FROM b ORDER BY points DESC, doc LIMIT 10")
def search_bm25_top10(spark, d):
    return search.best(index(spark, d).scored(ASKED_TEXT, correct=False)[0])


@query(scored_by(["the", "src1"]) + "SELECT b.doc AS id, text AS value_text, points / 4294967296.0::double AS score, points / 4294967296.0::double AS text_score, cast(NULL as double) AS similarity FROM b JOIN documents ON doc_id = doc ORDER BY points DESC, id LIMIT 7 OFFSET 5")
def search_hits_of_two_fields(spark, d):
    """A page of hits with their values, by words of either field."""
    page = index(spark, d).search("The src1", limit=7, offset=5).page
    return page.select("id", F.col("value.text").alias("value_text"), "score", "text_score", "similarity")


@query(SCORED + "SELECT doc, points FROM b JOIN documents ON doc = doc_id WHERE lang IN ('en') AND n_chars BETWEEN 500 AND 3000 ORDER BY points DESC, doc LIMIT 10")
def search_bm25_filtered(spark, d):
    return search.best(index(spark, d).scored(ASKED_TEXT, correct=False, where=F.expr("lang IN ('en') AND n_chars BETWEEN 500 AND 3000"))[0]).select("doc", "points")


@query(SCORED + "SELECT least(count(*), 10000) AS count, count(*) > 10000 AS at_least FROM b")
def search_total(spark, d):
    return index(spark, d).search(ASKED_TEXT, correct=False).total()


@query(f"WITH {TERMS} SELECT term, count(DISTINCT doc) AS df FROM p WHERE starts_with(term, 'thin') AND term <> 'thin' GROUP BY term ORDER BY df DESC, term LIMIT 64")
def search_prefix_words(spark, d):
    v = index(spark, d).vocabulary
    return v.where(F.startswith("term", F.lit("thin")) & (F.col("term") != "thin")).orderBy(F.desc("df"), "term").select("term", "df").limit(search.PREFIX_WORDS)


def prefixed_by(asked: list[str], starts: list[str]) -> str:
    """(doc, list, points) of words, of which some also begin longer ones, and m, the sum of the lists' best."""
    some, first = ", ".join(f"'{w}'" for w in asked), "', '".join(starts)
    return f"""WITH {TERMS}, a AS (SELECT unnest(['{first}']) AS ask),
l AS (SELECT field, ask, term FROM (SELECT field, ask, term, row_number() OVER (PARTITION BY field, ask ORDER BY count(*) DESC, term) AS r FROM p JOIN a ON starts_with(term, ask) AND term <> ask GROUP BY field, ask, term) WHERE r <= 64),
h AS (SELECT doc, field, length, term AS list, tf, weight FROM p WHERE term IN ({some}) UNION ALL SELECT doc, field, length, ask || '*', cast(sum(tf) as bigint), any_value(weight) * 0.5::double FROM p JOIN l USING (field, term) GROUP BY doc, field, length, ask),
f AS (SELECT field, list, count(*) AS df FROM h GROUP BY field, list),
o AS (SELECT doc, field, list, cast(floor(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * ({_SAT}) * 4294967296.0::double + 0.5) as bigint) AS points FROM h JOIN f USING (field, list) JOIN s USING (field)),
m AS (SELECT cast(sum(q) as bigint) AS above FROM (SELECT max(points) AS q FROM o GROUP BY field, list))
"""


@query(prefixed_by(["the", "thin"], ["thin"]) + "SELECT doc, cast(sum(points) as bigint) AS points FROM o GROUP BY doc ORDER BY points DESC, doc LIMIT 10")
def search_prefix_last(spark, d):
    """Words, of which the last may still be being typed."""
    return search.best(index(spark, d).scored("the thin", prefix="last", correct=False)[0]).select("doc", "points")


@query(prefixed_by(["the", "thin"], ["the", "thin"]) + "SELECT doc, cast(sum(points) + CASE WHEN count(DISTINCT rtrim(list, '*')) = 2 THEN any_value(above) ELSE 0 END as bigint) AS points FROM o, m GROUP BY doc ORDER BY points DESC, doc LIMIT 10")
def search_prefix_every(spark, d):
    return search.best(index(spark, d).scored("the thin", prefix="every", correct=False)[0]).select("doc", "points")


@query(f"""WITH {TERMS}, v AS (SELECT term, count(DISTINCT doc) AS df, damerau_levenshtein(term, 'thtioned') AS e FROM p GROUP BY term), c AS (SELECT * FROM v WHERE e = 1 AND abs(length(term) - 8) <= 1)
SELECT term, cast(e as integer) AS edits, df FROM c ORDER BY df DESC, term LIMIT 8""")
def search_typo_corrected(spark, d):
    return index(spark, d).corrections("thtioned")


@query(SCORED + "SELECT doc, points FROM b ORDER BY points DESC, doc LIMIT 10")
def search_layouts(spark, d):
    """The question as the same keys give on a Russian layout, read back."""
    return search.best(index(spark, d).scored(" ".join(search.retyped(w, "en", "ru") for w in ASKED), correct=False)[0]).select("doc", "points")


@query(f"""WITH {TERMS}, v AS (SELECT term, count(DISTINCT doc) AS df, damerau_levenshtein(term, 'thtioned') AS e FROM p GROUP BY term),
w AS (SELECT term FROM v WHERE NOT EXISTS (SELECT 1 FROM v WHERE e = 0) AND e = 1 ORDER BY df DESC, term LIMIT 1)
SELECT 'the ' || coalesce((SELECT term FROM w), 'thtioned') AS corrected""")
def search_reads_typos(spark, d):
    """How a question with a word that nothing holds is read."""
    return spark.createDataFrame([(index(spark, d).read("the thtioned")[1],)], "corrected string").select(F.coalesce("corrected", F.lit("the thtioned")).alias("corrected"))


@query(SCORED + """, top AS (SELECT doc, points FROM b ORDER BY points DESC, doc LIMIT 10)
SELECT doc, 'text' AS field, word, count(*) AS places FROM (SELECT doc, unnest(""" + terms_of("text") + """) AS word FROM top JOIN documents ON doc_id = doc) WHERE word IN (""" + ", ".join(f"'{w}'" for w in ASKED) + """) GROUP BY ALL""")
def search_matches(spark, d):
    """How often the best hits hold the words, by the places of their matches."""
    return index(spark, d).search(ASKED_TEXT, correct=False).matches().groupBy("doc", "field", "word").agg(F.count("*").alias("places"))


@query(f"WITH {TERMS} SELECT term, count(DISTINCT doc) AS df FROM p GROUP BY term")
def search_unicode_vocabulary(spark, d):
    """The vocabulary under the full analyser."""
    return index(spark, d).vocabulary.select("term", "df")


@query(scored_by(["the", "src1"], "(SELECT p.* FROM p JOIN documents ON doc = doc_id WHERE doc_id % 7 <> 0)").replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id % 7 <> 0)") + "SELECT doc, points FROM b ORDER BY points DESC, doc LIMIT 10")
def search_after_delete(spark, d):
    """The best hits when every seventh document is deleted: statistics are those of what is left."""
    i = index(spark, d)
    return search.best(i.delete(i.docs.where("doc_id % 7 = 0").select("doc_id")).scored("the src1", correct=False)[0]).select("doc", "points")


@query("""SELECT doc_id AS doc, 2 AS words FROM documents WHERE doc_id % 40 = 3""")
def search_after_set_many(spark, d):
    """Documents set anew are found by their new words, and no longer by others."""
    i = index(spark, d)
    changed = i.docs.where("doc_id % 40 = 3").withColumn("text", F.lit("Quixotic zebras"))
    new = i.set_many(changed, most=None)
    hits = new.postings.join(new.docs.where("doc_id % 40 = 3").select("doc_id"), F.col("doc") == F.col("doc_id")).where("field = 0").groupBy("doc").agg(F.count("*").cast("int").alias("words"))
    return hits.join(new.scored("QUIXOTIC", correct=False)[0].select("doc"), "doc", "left_semi")


def asked_vector(spark, d) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


VECTORS = "v AS (SELECT vec_id AS doc, round(list_cosine_similarity(embedding::double[], (SELECT embedding::double[] FROM embeddings WHERE vec_id = 0)), 9) AS similarity FROM embeddings)"


@query(f"WITH {VECTORS} SELECT doc, similarity FROM v ORDER BY similarity DESC, doc LIMIT 10")
def vector_cosine_top10(spark, d):
    near = search.cosine(table(spark, d, "embeddings"), "vec_id", "embedding", asked_vector(spark, d)).withColumn("similarity", F.round("similarity", 9))
    return near.orderBy(F.desc("similarity"), "doc").limit(10)


@query(f"WITH {VECTORS} SELECT doc FROM v WHERE similarity >= 0.2")
def vector_min_similarity(spark, d):
    return search.cosine(table(spark, d, "embeddings"), "vec_id", "embedding", asked_vector(spark, d)).where(F.round("similarity", 9) >= 0.2).select("doc")


@query(SCORED + f""", {VECTORS}, a AS (SELECT doc, points / 4294967296.0::double AS s FROM b ORDER BY s DESC, doc LIMIT 100), c AS (SELECT doc, similarity AS s FROM v ORDER BY s DESC, doc LIMIT 100),
w AS (SELECT doc, CASE WHEN max(s) OVER () = min(s) OVER () THEN 1.0 ELSE (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) END AS w FROM a),
z AS (SELECT doc, CASE WHEN max(s) OVER () = min(s) OVER () THEN 1.0 ELSE (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) END AS z FROM c)
SELECT doc, round(coalesce(w, 0) * 0.5 + coalesce(z, 0) * 0.5, 7) AS score FROM w FULL JOIN z USING (doc) ORDER BY score DESC, doc LIMIT 10""")
def hybrid_fused_top10(spark, d):
    near = search.cosine(table(spark, d, "embeddings"), "vec_id", "embedding", asked_vector(spark, d)).withColumn("similarity", F.round("similarity", 9))
    return search.best(search.fused(index(spark, d).scored(ASKED_TEXT, correct=False)[0], near).withColumn("score", F.round("score", 7)))


@query(SCORED + f""", {VECTORS}, a AS (SELECT doc, points / 4294967296.0::double AS s FROM b ORDER BY s DESC, doc LIMIT 100)
SELECT doc, coalesce(similarity, -1.0) AS score FROM a LEFT JOIN v USING (doc) ORDER BY score DESC, s DESC, doc LIMIT 20""")
def hybrid_rerank(spark, d):
    near = search.cosine(table(spark, d, "embeddings"), "vec_id", "embedding", asked_vector(spark, d)).withColumn("similarity", F.round("similarity", 9))
    return search.reranked(index(spark, d).scored(ASKED_TEXT, correct=False)[0], near).orderBy(F.desc("score"), F.desc("text_score"), "doc").limit(20).select("doc", "score")


# --- state, changes, streams -----------------------------------------------------------------------------


REQUESTS = "WITH RECURSIVE e AS (SELECT user_id, ts, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events)"


@query(REQUESTS + """, w AS (SELECT 21600000000 AS i, 2 AS b),
r AS (SELECT user_id, ts, n, us + i AS due, true AS allowed, b - 1 AS places, cast(0 as bigint) AS retry_us FROM e, w WHERE n = 1 UNION ALL
 SELECT user_id, ts, n, CASE WHEN room >= 0 THEN new ELSE due END, room >= 0, greatest(room, 0) // i, greatest(0, -room) FROM (
  SELECT e.user_id, e.ts, e.n, r.due, i, greatest(r.due, e.us) + i AS new, e.us + b * i - greatest(r.due, e.us) - i AS room FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1, w))
SELECT user_id, ts, allowed, cast(places as bigint) AS "left", retry_us FROM r""")
def state_rate_limit_gcra(spark, d):
    """Requests of each user, one in six hours with a burst of two."""
    return state.gcra(table(spark, d, "events"), "user_id", "ts", 6 * 3600 * 1_000_000, 2)


@query(REQUESTS + """, r AS (SELECT user_id, cast(0 as bigint) AS n, cast(NULL as timestamp) AS ts, cast(NULL as bigint) AS s, 0 AS u, cast(NULL as bigint) AS s2, 0 AS u2, true AS allowed FROM (SELECT DISTINCT user_id FROM e) UNION ALL
 SELECT user_id, n, ts, CASE WHEN ok THEN coalesce(s, us) ELSE s END, CASE WHEN ok THEN u + 1 ELSE u END, CASE WHEN ok THEN coalesce(s2, us) ELSE s2 END, CASE WHEN ok THEN u2 + 1 ELSE u2 END, ok FROM (SELECT *, u < 3 AND u2 < 10 AS ok FROM (
  SELECT e.user_id, e.n, e.ts, e.us, CASE WHEN e.us < r.s + 86400000000 THEN r.s END AS s, CASE WHEN e.us < r.s + 86400000000 THEN r.u ELSE 0 END AS u,
   CASE WHEN e.us < r.s2 + 604800000000 THEN r.s2 END AS s2, CASE WHEN e.us < r.s2 + 604800000000 THEN r.u2 ELSE 0 END AS u2 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)))
SELECT user_id, ts, allowed, cast(greatest(u, u2) as bigint) AS used FROM r WHERE n > 0""")
def state_quota_windows(spark, d):
    """Three uses a day and ten a week, windows beginning with the first use."""
    day = 86400 * 1_000_000
    return state.quota(table(spark, d, "events"), "user_id", "ts", [(day, 3), (7 * day, 10)])


@query(REQUESTS + """, r AS (SELECT user_id, ts, n, true AS runs, us + 86400000000 AS until FROM e WHERE n = 1 UNION ALL
 SELECT e.user_id, e.ts, e.n, e.us >= r.until, CASE WHEN e.us >= r.until THEN e.us + 86400000000 ELSE r.until END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, ts FROM r WHERE runs""")
def state_once(spark, d):
    """A user's event that runs, at most one in a day."""
    return state.once(table(spark, d, "events"), "user_id", "ts", "1 day")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events WHERE ts <= timestamp '2024-01-20' AND ts + interval 2 day > timestamp '2024-01-20') WHERE n = 1")
def state_ttl_alive(spark, d):
    return state.alive(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "2 days", "2024-01-20 00:00:00").select("user_id", "event_id", "ts")


@query("SELECT event_id, cast(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 as integer) AS ahead FROM events")
def state_ahead(spark, d):
    return state.ahead(table(spark, d, "events"), ["ts", "event_id"], "event_type").select("event_id", "ahead")


def jobs(spark, d) -> DataFrame:
    """Orders as jobs: due on their date, grouped by priority."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("next"), F.col("o_orderpriority").alias("grp"), (F.col("o_orderkey") % 3 + 1).alias("attempt"))


@query("""WITH j AS (SELECT o_orderkey AS id, o_orderdate AS next, o_orderpriority AS grp FROM orders), l AS (SELECT id FROM j WHERE id % 500 = 0),
r AS (SELECT grp, count(*) AS running FROM j JOIN l USING (id) GROUP BY grp),
n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY next, id) AS n FROM j WHERE next <= timestamp '1997-01-01' AND id NOT IN (SELECT id FROM l))
SELECT id, next, grp FROM n LEFT JOIN r USING (grp) WHERE n + coalesce(running, 0) <= 40 ORDER BY next, id LIMIT 100""")
def job_claim(spark, d):
    j = jobs(spark, d)
    leases = j.where("id % 500 = 0").select("id", F.lit("1999-01-01").cast("timestamp_ntz").alias("until"))
    return state.claimable(j, leases, "1997-01-01", 100, 40).select("id", "next", "grp")


@query("""SELECT CASE WHEN o_orderkey % 5 > 2 THEN 'held' WHEN o_orderkey % 5 = 0 THEN 'done' WHEN o_orderkey % 3 = 2 THEN 'failed' ELSE 'waiting' END AS state, count(*) AS jobs,
 max(CASE WHEN o_orderkey % 5 IN (1, 2) AND o_orderkey % 3 < 2 THEN timestamp '1998-01-01' + to_seconds(cast(60 * pow(2, o_orderkey % 3) as integer)) END) AS again FROM orders GROUP BY 1""")
def job_settle(spark, d):
    j = jobs(spark, d)
    said = j.where("id % 5 < 3").select("id", "attempt", (F.col("id") % 5 == 0).alias("ok"))
    out = state.settled(j, said, "1998-01-01", 3, 60, 3600)
    return out.groupBy("state").agg(F.count("*").alias("jobs"), F.max(F.when(F.col("state") == "waiting", F.col("next"))).alias("again"))


@query("""SELECT CASE WHEN o_orderkey % 500 = 0 THEN 'running' WHEN o_orderdate <= timestamp '1997-01-01' THEN 'waiting' ELSE 'scheduled' END AS state, count(*) AS jobs FROM orders GROUP BY 1""")
def job_counts(spark, d):
    held = F.when(F.col("id") % 500 == 0, "running").when(F.col("next") <= F.lit("1997-01-01").cast("timestamp_ntz"), "waiting").otherwise("scheduled")
    return jobs(spark, d).groupBy(held.alias("state")).agg(F.count("*").alias("jobs"))


@query("""SELECT event_id, (CASE WHEN ts < d + interval 190 minute THEN d ELSE d + interval 1 day END + interval 190 minute - interval 330 minute)::timestamp AS next FROM (
 SELECT event_id, ts + interval 330 minute AS ts, date_trunc('day', ts + interval 330 minute)::timestamp AS d FROM events)""")
def schedule_cron_next(spark, d):
    """The next run of a daily job on India's clock after each event."""
    following = cron.next_column("10 3 * * *", "Asia/Kolkata")
    return table(spark, d, "events").select("event_id", following(F.col("ts")).alias("next"))


@query("SELECT user_id, cast(sum(cast(value * 100 as bigint)) as bigint) AS counter FROM events GROUP BY user_id")
def state_counters(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("counter"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'removed' WHEN doc_id % 10 = 2 THEN 'added' ELSE 'changed' END AS change FROM documents WHERE doc_id % 10 IN (1, 2, 3)")
def change_feed_snapshot_diff(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.xxhash64("text").alias("digest"))
    new = docs.where("doc_id % 10 <> 1").withColumn("n_chars", F.when(F.col("doc_id") % 10 == 3, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return state.changes(docs.where("doc_id % 10 <> 2"), new, "doc_id", ["n_chars", "digest"])


@query("SELECT source, count(*) AS files, cast(sum(n_chars) as bigint) AS size FROM documents GROUP BY source")
def blob_usage(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("size"))


@query("SELECT event_type, date_trunc('day', ts)::timestamp AS bucket, count(*) AS events FROM events GROUP BY ALL")
def stream_tumbling_count(spark, d):
    return streams.run_once(streams.tumbling(streams.stream(spark, d, "events"), "ts", "1 day", ["event_type"]), "complete", "tumbling")


@query("SELECT event_id, user_id FROM events")
def stream_dedup(spark, d):
    return streams.run_once(streams.seen_once(streams.stream(spark, d, "events"), ["event_id"], "ts"), "append", "dedup").select("event_id", "user_id")


@query("SELECT event_id, ts < (SELECT max(ts) FROM events WHERE event_id % 2 = 0) - interval 10 day AS late FROM events WHERE event_id % 2 = 1")
def stream_late_rows(spark, d):
    e = table(spark, d, "events")
    fresh, late = streams.late_rows(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), "ts", "10 days")
    return fresh.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))


@query("SELECT cast(date_trunc('day', ts) as timestamp) AS day, count(*) AS events FROM events GROUP BY ALL")
def schedule_occurrences(spark, d):
    """Events by the occurrence of a daily schedule that they follow."""
    e = table(spark, d, "events")
    return e.groupBy(timegrid.bucket_start(F.col("ts"), "1 day").alias("day")).agg(F.count("*").alias("events"))
