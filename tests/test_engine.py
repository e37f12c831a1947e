"""Golden facts and brute-force checks of the engine's own operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import exact, jsontext, timegrid
from tidemark.operators import search, state
from tidemark.operators.metrics import COUNTER, Metrics, interval
from tidemark.operators.records import Records, appended, filled
from tidemark.operators.tablequery import Refused, TableQuery, bound, eq, has, ident, is_in
from tidemark.operators.wordindex import WordIndex
from tidemark.session import ship
from tidemark.sources import formats

T0 = datetime(2024, 1, 1)


def series(spark, rows):
    return spark.createDataFrame([("s", T0 + timedelta(seconds=t), float(v)) for t, v in rows], "s string, at timestamp_ntz, value double")


def test_a_counter_that_rises_by_one_a_second(spark):
    m = Metrics(series(spark, [(15 * i, 15 * i) for i in range(240)]), ("s",), COUNTER)
    by = {r.bucket: r.increase for r in m.every("5 minutes").aggregate("increase").collect()}
    assert [by[k] for k in sorted(by)] == [285.0] + [300.0] * 11
    assert m.between("2024-01-01", "2024-01-01 01:00:00").aggregate("increase").first().increase == 3585.0


def test_a_restart_counts_from_nothing(spark):
    r = Metrics(series(spark, [(0, 100), (60, 150), (120, 200), (180, 20), (240, 70)]), ("s",), COUNTER).between("2024-01-01", None).aggregate("increase").first()
    assert (r.increase, r.resets) == (170.0, 1)


def test_the_step_into_a_range_counts(spark):
    m = Metrics(series(spark, [(0, 1), (60, 4), (120, 9)]), ("s",), COUNTER)
    assert m.between("2024-01-01 00:01:00", None).aggregate("increase").first().increase == 8.0


@pytest.mark.parametrize("n,p,want", [(100, "7", 7), (20, "95", 19), (21, "95", 20), (21, "100", 21), (3, "0.001", 1)])
def test_nearest_ranks(spark, n, p, want):
    assert Metrics(series(spark, [(i, i + 1) for i in range(n)]), ("s",)).between("2024-01-01", None).percentile(p).first().value == want


def test_an_interval_of_a_histogram(spark):
    h = spark.createDataFrame([("a", 5.0, 10), ("a", 10.0, 60), ("a", 25.0, 94), ("a", 50.0, 99), ("a", None, 100)], "g string, le double, c long")
    got = {p: interval(h, ["g"], p).first() for p in ("50", "95", "100")}
    assert (got["50"].lower, got["50"].upper, got["50"].estimate) == (5.0, 10.0, 9.0)
    assert (got["95"].lower, got["95"].upper) == (25.0, 50.0)
    assert (got["100"].lower, got["100"].upper, got["100"].estimate) == (50.0, None, 50.0)


def test_ops_that_a_kind_lacks_are_refused(spark):
    with pytest.raises(ValueError):
        Metrics(series(spark, [(0, 1)]), ("s",), COUNTER).aggregate("avg")
    with pytest.raises(ValueError):
        Metrics(series(spark, [(0, 1)]), ("s",)).between("2024-01-02", "2024-01-01")


def test_a_day_in_berlin_may_have_23_hours(spark):
    df = spark.createDataFrame([(datetime(2026, 3, 29, 12),), (datetime(2026, 3, 28, 22, 59),)], "t timestamp_ntz")
    assert [r[0] for r in df.select(timegrid.calendar_start(F.col("t"), "day", "Europe/Berlin")).collect()] == [datetime(2026, 3, 28, 23), datetime(2026, 3, 27, 23)]


def test_exact_sums():
    assert exact.fraction_sum([1e16, 1.0, -1e16]) == 1.0
    assert exact.fraction_sum([1e308, 1e308, -1e308]) == 1e308


def test_json_by_spelling():
    assert jsontext.members('{"a": 42.0, "b":"42" , "a":[1, 2]}') == {"a": "[1, 2]", "b": '"42"'}
    assert jsontext.members("nonsense") == {} and jsontext.members(None) == {}
    assert [jsontext.kind_of(x) for x in ('"x"', "1", "1.0", "true", "null", "[1]", "{}")] == ["text", "integer", "float", "boolean", "null", "list", "object"]
    assert jsontext.says('{"key": ["Deep", 7]}', "deep") and not jsontext.says('{"key": 1}', "key")


def test_records(spark):
    ship(spark)
    rows = [(T0 + timedelta(minutes=i), "s", i, "n", 8 if i % 10 == 9 else 4, "m", f'{{"ms": {i * 10}}}', "{}") for i in range(60)]
    r = Records(spark.createDataFrame(rows, "at timestamp_ntz, stream string, id long, name string, level int, message string, fields string, context string"))
    assert [x.number for x in r.largest("ms", 3).collect()] == [590, 580, 570]
    assert r.min_level(8).count().first()[0] == 6
    assert r.where("ms", "10", "20").count().first()[0] == 2 and r.where_not("gone", "1").count().first()[0] == 60
    with pytest.raises(ValueError):
        r.deleted()


def test_pages_with_nulls_hold_every_row_once(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, rng.choice([None, 1, 2])) for i in range(20)], "id long, x long")
    for down in (False, True):
        q, after, seen = TableQuery.table(df).order_by("x", down).order_by("id"), None, []
        while True:
            page = [r.asDict() for r in q.page(6, after)[0].collect()]
            seen += [r["id"] for r in page]
            if len(page) < 6:
                break
            after = q.cursor(page[-1])
        assert sorted(seen) == list(range(20)) and len(seen) == 20


def test_table_queries(spark):
    df = spark.createDataFrame([(1, "[1,2]", None), (2, "[]", 5), (3, None, 6)], "id long, tags string, x long")
    t = TableQuery.table(df)
    assert [r.id for r in t.filter(has("tags", 2)).rows().collect()] == [1]
    assert [r.id for r in t.filter(eq("x", None)).rows().collect()] == [1]
    assert t.filter(is_in("id", [])).rows().count() == 0
    with pytest.raises(Refused):
        t.delete()
    with pytest.raises(Refused):
        t.filter("id = 1").limit(1).delete()
    kids = TableQuery.table(spark.createDataFrame([(1, 10), (1, 11), (1, 12)], "pid long, v long"), "k").select("v").order_by("v", True).limit(2)
    got = {r.id: [k.v for k in r.kids] for r in t.include(kids, ("id", "pid"), "kids").collect()}
    assert got == {1: [12, 11], 2: [], 3: []}


def test_the_analyser():
    assert search.words("Can't 3.14 Ёлка Café 東京都") == ["cant", "314", "елка", "cafe", "東京", "京都"]
    assert search.damerau("replicaiton", "replication", 2) == 1 and search.damerau("helo", "help", 1) == 1


def test_fusion_and_rerank(spark):
    text = spark.createDataFrame([(1, 9.0), (2, 5.0), (4, 1.0)], "doc long, score double")
    near = spark.createDataFrame([(3, 1.0), (4, 0.75), (1, 0.5)], "doc long, similarity double")
    assert {r.doc: r.score for r in search.fused(text, near).collect()} == {1: 0.5, 2: 0.25, 3: 0.5, 4: 0.25}
    near = spark.createDataFrame([(2, 0.9), (1, 0.2), (4, 0.2)], "doc long, similarity double")
    got = search.reranked(spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 1.5), (4, 1.0)], "doc long, score double"), near).orderBy(F.desc("score"), F.desc("text_score")).collect()
    assert [(r.score, r.doc) for r in got] == [(0.9, 2), (0.2, 1), (0.2, 4), (-1.0, 3)]


def test_rate_limits_fold_in_order(spark):
    ship(spark)
    df = spark.createDataFrame([("a", T0 + timedelta(milliseconds=t)) for t in (0, 0, 0, 0, 10, 40)], "k string, t timestamp_ntz")
    got = state.gcra(df, "k", "t", 10_000, 3).orderBy("t").collect()
    assert [r.allowed for r in got] == [True, True, True, False, True, True]
    assert got[3].retry_us == 10_000


def test_expositions():
    rows = formats.exposition('# TYPE x counter\nx_total{a="b\\"c"} 3 1000\ny 1.5\n', 7)
    assert rows == [("x_total", "counter", {"a": 'b"c'}, 1000, 3.0), ("y", "gauge", {}, 7, 1.5)]
    with pytest.raises(formats.BadLine, match="line 2"):
        formats.exposition("x 1\n{}\n", 0)
    assert formats.event_of('level=warn msg="hot plate"')["level"] == 6 and formats.event_of('{"level":"error","msg":"no"}')["message"] == "no"


def test_every_query_with_sql_agrees_with_duckdb(spark):
    import duckdb

    from tidemark.plans import catalog

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in "nation customer supplier orders lineitem events documents embeddings conversations".split():
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("metric_count_1h_by_type", "metric_increase_1d_by_user", "metric_fill_1h", "record_aggregate_stats_distinct", "sql_upsert_only_if", "search_bm25_top10", "stream_tumbling_count"):
        df, want = catalog.QUERIES[name](spark, d), con.sql(catalog.ORACLE_SQL[name])
        cols = sorted(df.columns)
        assert cols == sorted(want.columns), name
        at = [want.columns.index(c) for c in cols]
        assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall()), name


# --- schedules, stems, keyboards, grids, joined lines, jobs ------------------------------------------------


def test_cron_against_every_minute():
    from datetime import UTC, datetime, timedelta
    from zoneinfo import ZoneInfo

    from tidemark.functions.cron import Cron

    zone = ZoneInfo("Europe/Berlin")
    for text, months in (("*/17 1-3 * * *", (3, 10)), ("30 2 * * sun", (3, 10)), ("5 0 13 * fri", (2,)), ("@hourly", (10,))):
        cron = Cron(text)
        for month in months:
            at = datetime(2026, month, 24, tzinfo=UTC)
            walls = {}
            for m in range(9 * 24 * 60):  # the first instant of each wall minute
                walls.setdefault((at + timedelta(minutes=m)).astimezone(zone).replace(tzinfo=None), at + timedelta(minutes=m))
            names = [w for w in walls if cron.runs_on(w.date()) and (w.hour, w.minute) in cron.times]
            want = {walls[w] for w in names}
            if month == 3 and any(h == 2 for h, _ in cron.times) and cron.runs_on(datetime(2026, 3, 29).date()):
                want.add(datetime(2026, 3, 29, 1, tzinfo=UTC))  # 02:xx doesn't exist; it runs at 03:00
            end, got, t = at + timedelta(days=8), [], at - timedelta(minutes=1)
            while (t := cron.next(zone, t)) and t < end:
                got.append(t)
            assert got == sorted(w for w in want if w < end), (text, month)
    assert Cron("0 0 29 2 *").next(ZoneInfo("UTC"), datetime(2096, 3, 1, tzinfo=UTC)) == datetime(2104, 2, 29, tzinfo=UTC)
    for bad in ("* * * *", "60 * * * *", "*/0 * * * *", "5-1 * * * *", "x * * * *"):
        with pytest.raises(ValueError):
            Cron(bad)


def test_russian_stems():
    from tidemark.functions.stem import russian

    said = "вавиловка вавиловк важная важн важнейшие важн важничал важнича важность важност вагонами вагон валяется валя вдохновение вдохновен кончившийся конч павшую павш".split()
    assert [russian(w) for w in said[::2]] == said[1::2]
    assert russian("в") == "в" and russian("") == ""


def test_stems_count_less_than_words(spark):
    docs = spark.createDataFrame([(1, "книга", None), (2, "книги", ""), (3, "дом", "x"), (None, "книга", "y")], "id long, text string, title string")
    index = WordIndex.of_table(docs, "id", {"text": 1.0, "title": 3.0})
    assert {r["length"] for r in index.postings.collect()} == {1} and index.count == 3
    found = {r["doc"]: r["score"] for r in index.scored("книга")[0].collect()}
    assert set(found) == {1, 2} and found[1] > found[2] > 0


def test_questions_are_read_otherwise_only_where_nothing_is_found(spark):
    index = WordIndex.of_table(spark.createDataFrame([(1, "python code replication"), (2, "крипто руку hello help")], "id long, text string"), "id", {"text": 1.0})
    assert search.retyped("rhbgnj", "en", "ru") == "крипто" and search.retyped("by;", "en", "ru") == "инж"
    assert index.read("знерщт code") == (["python", "code"], "python code")
    assert index.read("rhbgnj") == (["крипто"], "крипто")
    assert index.read("code qqq") == (["code", "qqq"], None) and index.read("") == ([], None)
    assert index.read("replicaiton helo")[1] == "replication helo"  # a swap is one edit; four letters are not corrected
    assert [(r.term, r.edits) for r in index.corrections("hellp").collect()] == [("hello", 1), ("help", 1)]
    hits = index.search("Hello, PYTHON")
    assert [(r.id, r.value.text[:6]) for r in hits.page.collect()] == [(1, "python"), (2, "крипто")] and hits.total().first()["count"] == 2
    assert {(r.doc, r.start, r.length, r.word) for r in hits.matches().collect()} == {(1, 0, 6, "python"), (2, 22, 5, "hello")}


def test_an_index_changes_by_keys(spark):
    docs = spark.createDataFrame([(i, f"word{i} same") for i in range(6)], "id long, text string")
    index = WordIndex.of_table(docs, "id", {"text": 1.0})
    index = index.set_many(spark.createDataFrame([(2, "fresh same"), (9, "fresh")], "id long, text string")).delete(spark.createDataFrame([(0,)], "id long"))
    ids = lambda text: {r.doc for r in index.scored(text, correct=False)[0].collect()}
    assert ids("fresh") == {2, 9} and ids("word2") == set() and ids("same") == {1, 2, 3, 4, 5} and index.count == 6
    assert index.get(2).first().text == "fresh same"
    near = spark.createDataFrame([(9, 0.5), (4, 0.25)], "doc long, similarity double")
    assert [r.id for r in index.search("same", near=near, vector_weight=1.0).page.collect()] == [9, 4]
    assert index.search("word4", near=near, rerank=True).page.first().id == 4


def test_a_table_is_set_whole(spark, tmp_path, monkeypatch):
    from tidemark.operators import wordindex
    from tidemark.plans import catalog

    monkeypatch.setattr(wordindex, "MOST_SET", 2)
    rows = [(i, f"word{i % 7} same", "en", "src1", 10) for i in range(250)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["search_after_set_many"](spark, str(tmp_path)).collect())
    assert got == [(i, 2) for i in range(3, 250, 40)]
    index = WordIndex.of_table(spark.createDataFrame([(i, "same") for i in range(4)], "id long, text string"), "id", {"text": 1.0})
    with pytest.raises(ValueError):
        index.set_many(spark.createDataFrame([(i, "new") for i in range(1001)], "id long, text string"))


@pytest.mark.parametrize("few", [0, 4, 64])  # rows of a block are cut as a whole, or sorted alone
def test_many_questions_at_once(spark, monkeypatch, few):
    """Vectors with copies and an empty one: exact and by clusters, in rounds and blocks, as one by one."""
    import numpy as np

    from tidemark.operators import vectors

    monkeypatch.setattr(vectors, "ROUND", 7)
    monkeypatch.setattr(vectors, "TOGETHER", 3)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "FEW", few)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:120:2], x[7] = x[3], 0
    ids = rng.permutation(300)
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)] + [(900, None)], "doc int, vector array<float>").repartition(3)
    unit = vectors._unit(x.astype(np.float64))
    best = lambda q: [d for _, d in sorted((-round(float(p), 9), int(i)) for p, i in zip(unit @ vectors._unit(q.astype(np.float64)), ids))[:10]]
    kept, seen = vectors.Clusters.of_table(table, "doc", "vector", 9), 0
    for asked in vectors.rounds(table.where("doc % 10 = 0"), "doc", "vector"):
        for found in (vectors.nearest(table.where("vector IS NOT NULL"), asked), kept.nearest(asked, 1.0)):
            got: dict = {}
            for r in found.orderBy("question", F.desc("points"), "doc").collect():
                got.setdefault(r["question"], []).append(r["doc"])
            assert got == {i: best(q) for i, q in enumerate(asked)}
        seen += len(asked)
    assert seen == 30
    some = kept.nearest(asked, 0.5).join(vectors.nearest(kept.rows, asked), ["question", "doc"], "left_semi").count()
    assert 0 < some <= 10 * len(asked)


def test_words_end_where_unicode_says(spark):
    assert search.words("wait...what e.g. 10,000 l’été x_y") == ["wait", "what", "eg", "10000", "lete", "xy"]


def test_grid_bins_and_bounds(spark):
    from tidemark.operators import metrics

    values = [1.0, 1.05, 0.99, 1.414213562373095, 1.4142135623730951, 5e-324, 2.0**-1022, 1.7976931348623157e308, 3.0, 2.0, 4.0, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(metrics.grid_index(F.col("v"), 3)).collect()]
    assert got[:5] == [0, 1, 0, 4, 5] and got[5:7] == [-8176, -8176] and got[7:] == [8192, 13, 8, 16, None]
    bounds = df.where("v > 0 AND v < 1e300 AND v > 1e-300").select("v", metrics.grid_bound(metrics.grid_index(F.col("v"), 3), F.lit(3)).alias("up"), metrics.grid_bound(metrics.grid_index(F.col("v"), 3) - 1, F.lit(3)).alias("low"))
    assert all(r["low"] < r["v"] <= r["up"] for r in bounds.collect())
    bins = spark.createDataFrame([("a", 3, 1, 2), ("a", 3, 2, 1), ("a", 2, 1, 5), ("a", 1, 9, 0), ("a", 3, None, 4)], "k string, schema int, index int, c long")
    merged = {(r["schema"], r["index"]): r["c"] for r in metrics.merged_grids(bins, ["k"]).collect()}
    assert merged == {(2, 1): 8, (2, None): 4}
    p = {x: metrics.grid_interval(metrics.merged_grids(bins, ["k"]), ["k"], x).first() for x in ("10", "95")}
    assert (p["10"]["lower"], p["10"]["upper"], p["10"]["samples"]) == (0.0, 0.0, 12) and p["95"]["lower"] == 1.0


def test_joined_lines_over_blocks(spark, monkeypatch):
    lines = ["start", "Traceback (most recent call last):", '  File "a", line 1', "ValueError: bad", "next", None, "Caused by: x", *["\tat f"] * 7, "end"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)] + [("t", 0, "  alone")], "source string, n long, value string")
    monkeypatch.setattr(formats, "MOST_JOINED", 5)
    for block in (1, 3, 100):
        monkeypatch.setattr(formats, "BLOCK", block)
        got = {(r["source"], r["n"]): r["value"].split("\n") for r in formats.joined(df).collect()}
        assert got == {("s", 0): lines[:4], ("s", 4): ["next"], ("s", 5): ["", "Caused by: x", *["\tat f"] * 3], ("s", 10): ["\tat f"] * 4, ("s", 14): ["end"], ("t", 0): ["  alone"]}


def test_claims_and_outcomes(spark):
    jobs = spark.createDataFrame([(1, 1, "a", 1), (2, 2, "a", 1), (3, 3, "a", 3), (4, 1, None, 1), (5, 1, None, 2), (6, 9, "b", 1)], "id long, s int, grp string, attempt long").withColumn("next", F.expr("timestamp_ntz'2026-01-01' + make_interval(0, 0, 0, s)")).drop("s")
    leases = spark.createDataFrame([(1, "2026-02-01"), (5, "2026-01-02")], "id long, until string").withColumn("until", F.col("until").cast("timestamp_ntz"))
    take = lambda *a: [r["id"] for r in state.claimable(jobs, leases, "2026-01-05", *a).collect()]
    assert take(10) == [4, 5, 2, 3] and take(10, 2) == [4, 5, 2] and take(10, 1) == [4, 5] and take(2) == [4, 5]
    said = spark.createDataFrame([(1, 1, True), (2, 1, False), (3, 3, False), (4, 7, True)], "id long, attempt long, ok boolean")
    out = {r["id"]: (r["state"], r["attempt"], str(r["next"])) for r in state.settled(jobs, said, "2026-01-05", 3, 60, 90).collect()}
    assert out[1] == ("done", 1, "None") and out[2] == ("waiting", 2, "2026-01-05 00:01:00") and out[3] == ("failed", 3, "None") and out[4][:2] == ("held", 1)


# --- round 2


def records_of(spark, fields):
    rows = [(T0 + timedelta(minutes=i), "s", i, "n", 4, "m", f, "{}") for i, f in enumerate(fields)]
    return Records(spark.createDataFrame(rows, "at timestamp_ntz, stream string, id long, name string, level int, message string, fields string, context string"))


def test_numbers_are_compared_exactly(spark):
    said = ["9007199254740993", "9007199254740992.0", "9007199254740994", "1e30", "1e-12", "0", "-1e300", "18446744073709551615", "1.8446744073709552e19", '"7"', "null"]
    r = records_of(spark, [f'{{"v": {x}}}' for x in said] + ["{}", "no json", '{"v": 3, "v": 5}', '{"w": {"v": 9}, "v": "\\u0041"}', None])
    got = [r.fields.partition(": ")[2].rstrip("}") for r in r.largest("v", 8).collect()]
    assert got[:7] == ["1e30", "1.8446744073709552e19", "18446744073709551615", "9007199254740994", "9007199254740993", "9007199254740992.0", "3, \"v\": 5"]
    values = [x.v for x in r.found().orderBy("id").select(r.value("v").alias("v")).collect()]
    assert values == [*said, None, None, "5", '"\\u0041"', None]


def test_sums_of_records(spark):
    whole = records_of(spark, [f'{{"v": {x}}}' for x in (2**63, 2**63 - 1, -5, 1)]).aggregate(stats="v").first()
    assert (int(whole.whole), whole.sum, whole.samples) == (2**64 - 5, float(2**64 - 5), 4)
    mixed = records_of(spark, ['{"v": 9007199254740993}', '{"v": 0.5}', '{"v": 1e16}', '{"v": -1e16}']).aggregate(stats="v").first()
    assert mixed.whole is None and mixed.sum == 9007199254740994.0
    with pytest.raises(ValueError):
        filled(records_of(spark, ["{}"] * 500).aggregate(every="1 second"), [], "1 second", ["events"])
    r = records_of(spark, ["{}"])
    assert appended(r.events, r.events.unionByName(r.events.withColumn("id", F.lit(None).cast("long")))).count() == 1


def test_exact_sums_of_any_doubles(spark):
    import math
    import struct
    from fractions import Fraction

    rng = random.Random(3)
    rows = []
    for g in range(12):
        values = [rng.choice([1, -1]) * math.ldexp(rng.random(), rng.randint(-1074, 1000 if g % 2 else 3)) for _ in range(60)]
        values += [5e-324, -0.0, 1e308, -1e308, 2.0**-1022, 1.7976931348623157e308, -1.7976931348623157e308, 1e-7]
        rows += [(g, v) for v in values]
    rows += [(99, x * 1e-7) for x in range(1, 11)] + [(98, 1e33), (98, 1.0), (97, None)]
    df = spark.createDataFrame(rows, "g long, v double")
    want = {g: float(sum(Fraction(v) for k, v in rows if k == g and v is not None)) for g, _ in rows if g != 97} | {97: None}
    assert {r.g: r["sum"] for r in exact.exact_sum(df, ("g",), "v").collect()} == want
    parts = df.where("v IS NOT NULL").select("v", exact.split(F.col("v")).alias("x")).collect()
    assert all(Fraction(r.x.m) * Fraction(2) ** r.x.e == Fraction(r.v) and abs(r.x.m) < 2**53 for r in parts) and struct


def test_rates_go_by_what_the_range_leaves(spark):
    m = Metrics(series(spark, [(1800 * i, 1800 * i) for i in range(97)]), ("s",), COUNTER)
    days = m.calendar("day").aggregate("rate", "increase").orderBy("bucket").collect()
    assert [(r.rate, r.increase) for r in days[:2]] == [(84600 / 86400, 84600.0), (1.0, 86400.0)]
    cut = m.between("2024-01-01 10:20:00", "2024-01-01 12:40:00").every("1 hour").aggregate("rate").orderBy("bucket").collect()
    assert [(r.rate, r.partial) for r in cut] == [(1800 / 2400, True), (1.0, False), (3600 / 2400, True)]
    with pytest.raises(ValueError):
        m.aggregate("rate")


def test_gaps_and_partial_buckets(spark):
    m = Metrics(series(spark, [(0, 1), (3600, 2), (3600 * 4, 3), (3600 * 30, 4)]), ("s",), COUNTER)
    assert [r.gap for r in m.every("1 hour").aggregate("increase").orderBy("bucket").collect()] == [False, False, True, True]
    assert [r.gap for r in m.calendar("day").aggregate("increase").orderBy("bucket").collect()] == [False, False]
    assert m.between("2024-01-01 03:00:00", "2024-01-01 05:00:00").aggregate("increase").first().gap is False
    assert m.between("2024-01-02 00:00:00", "2024-01-02 08:00:00").aggregate("increase").first().gap is True
    assert [r.partial for r in m.every("1 day").aggregate("count", now="2024-01-02 12:00:00").orderBy("bucket").collect()] == [False, True]
    assert [r.partial for r in m.retain("2024-01-01 02:00:00").every("1 day").aggregate("increase").orderBy("bucket").collect()] == [True, False]


def test_what_no_aggregate_takes(spark):
    nan, inf = float("nan"), float("inf")
    for rows, kind in (([(0, 1), (1, nan)], "gauge"), ([(0, inf)], "gauge"), ([(0, -1)], COUNTER)):
        with pytest.raises(Exception, match="an aggregate over"):
            Metrics(series(spark, rows), ("s",), kind).every("1 day").aggregate("count", "last" if kind == COUNTER else "sum").collect()
    r = Metrics(series(spark, [(0, 1), (1, nan), (2, 4), (3, nan)]), ("s",)).skip_nan().every("1 day").aggregate("sum", "delta", "first", "last").first()
    assert (r["sum"], r.delta, r["first"], r["last"], r.samples, r.skipped) == (5.0, 3.0, 1.0, 4.0, 2, 2)


def test_cursors_keep_types_and_know_their_query(spark):
    from decimal import Decimal

    rows = [(i, datetime(2024, 1, 1 + i // 3), Decimal(i % 2), None if i % 4 == 0 else i * 0.1) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, at timestamp_ntz, d decimal(10,2), f double")
    for columns in (("at", "id"), ("d", "id"), ("f", "id")):
        q = TableQuery.table(df)
        for c in columns:
            q = q.order_by(c)
        got, next_ = [], None
        while True:
            page, next_ = q.list(5, next_)
            got += [r.id for r in page]
            if next_ is None:
                break
        assert got == [r.id for r in q.rows().collect()]
        _, next_ = q.list(5)
        with pytest.raises(Refused):
            q.filter("id > 3").list(5, next_)
    assert [r.id for r in TableQuery.table(df).order_by("id").each()] == list(range(12)) and TableQuery.table(df).columns().num_rows == 12
    with pytest.raises(Refused):
        bound(spark, "SELECT ? + ?", 1)
    assert spark.sql(f"SELECT 1 AS {ident('a`b')}").columns == ["a`b"]
    with pytest.raises(Refused):
        TableQuery.table(df).cross_join(df, "o", most=11)


def test_entries_renew_expire_and_compare(spark):
    from tidemark.operators import keyvalue

    hour = 3_600_000_000
    log = [  # seq, hour, op, path, value, ttl, idle, expected
        (1, 0, "set", "a/x", "1", None, 2 * hour, None), (2, 1, "read", "a/x", None, None, None, None), (3, 2, "set", "a/x", "2", None, None, 1), (4, 3, "set", "a/x", "3", None, None, 1),
        (5, 0, "set", "b/y", "1", hour, None, 0), (6, 2, "set", "b/y", "2", None, None, 0), (7, 3, "clear", "c", None, None, None, None), (8, 1, "set", "c/z/1", "1", None, None, None),
        (9, 4, "set", "c/z/2", "1", None, None, None), (10, 5, "clear", "c/z/2", None, None, None, None), (11, 0, "set", "d", "1", 9 * hour, 2 * hour, None), (12, 1, "read", "d", None, None, None, None),
    ]
    df = spark.createDataFrame([(s, T0 + timedelta(hours=h), *rest) for s, h, *rest in log], "seq long, at timestamp_ntz, op string, path string, value string, ttl long, idle long, expected long")
    got = {r.path: (r.value, r.version, r.expires) for r in keyvalue.applied(df).collect()}
    assert got == {"a/x": ("2", 2, None), "b/y": ("2", 2, None), "c/z/1": ("1", 1, None), "c/z/2": ("1", 1, None), "d": ("1", 1, T0 + timedelta(hours=3))}
    assert [r.path for r in keyvalue.scan(keyvalue.applied(df), "2024-01-01 04:00:00").collect()] == ["a/x", "b/y", "c/z/1", "c/z/2"]
