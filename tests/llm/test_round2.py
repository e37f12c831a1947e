"""Cases of round 2: copies alone, hot keys, sparse ids, clashing names, empty tables."""

import collections
import random

import pytest

pytest.importorskip("tiktoken")

from pyspark.sql import functions as F  # noqa: E402

from tidemark.llm import common, decontam, jaccard, linedup, quality, wrapper  # noqa: E402

DOCS = "doc_id long, text string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# --- joins under hot keys


def test_groups_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 4)
    rows = [(0, i) for i in range(50)] + [(1, i) for i in range(20)] + [(k, 7) for k in range(2, 30)]
    got = common.with_groups(common.stored(spark.createDataFrame(rows, "k long, v long")), ["k"], F.max("v").alias("most"), where="_c > 1").collect()
    want = collections.Counter((k, v, 49 if k == 0 else 19) for k, v in rows if k < 2)
    assert collections.Counter(tuple(r) for r in got) == want


def test_a_bitmap_tells_most_keys_apart(spark):
    rows = spark.createDataFrame([(i if i else None, "x", i) for i in range(3000)], "key long, _at string, _word long")
    wanted = spark.createDataFrame([(None,), (5,), (17,)], "w long")
    some, other = common.split_by_bitmap(rows, F.col("key"), wanted, F.col("w"))
    some, other = some.collect(), other.collect()
    assert {None, 5, 17} <= {r["key"] for r in some} and len(some) < 50 and len(some) + len(other) == 3000
    assert some[0]["_at"] == "x" and sorted(some[0].asDict()) == ["_at", "_word", "key"]


# --- 8


def test_copies_without_any_near_pair(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(4, a), (2, a), (3, b), (9, "two words"), (8, "TWO  words"), (7, None)]
    got = {r.doc_id: r.component_id for r in jaccard.similar(docs(spark, rows)).collect()}
    assert got == {4: 2, 2: 2, 3: 3, 9: 8, 8: 8, 7: 7}
    assert sorted(r.doc_id for r in jaccard.one_of_each(docs(spark, rows)).collect()) == [2, 3, 7, 8]


def test_one_of_each_keeps_names_and_groups(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, a, 1, 2, 3), (7, a, 1, 2, 3), (5, b, 1, 2, 3), (2, b, 1, 2, 3)]
    table = spark.createDataFrame(rows, DOCS + ", _gone long, _set long, _sid long")
    left = jaccard.one_of_each(table).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(2, b), (5, a)] and left[0].asDict().keys() == {"doc_id", "text", "_gone", "_set", "_sid"}


def test_long_lists_across_components(spark, monkeypatch):
    """Sets with a common rare part, which do not all link: pairs meet in blocks, and none is lost."""
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "TRIES", 1)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for d in range(60):
        words = list(base)
        for i in rng.sample(range(40), rng.choice([1, 2])):
            words[i] = f"x{rng.randint(0, 9)}"
        rows.append((d, " ".join(words)))
    sets = [common.shingle_set(t) for _, t in rows]
    of = list(range(len(rows)))

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(set(s.tolist()) & set(sets[j].tolist()))
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                of[y] = x
    got = {r.doc_id: r.component_id for r in jaccard.similar(docs(spark, rows)).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_long_texts_of_few_shingles(spark, monkeypatch):
    """Words that repeat: a set is small though its text is long, and links with another by its subsets."""
    monkeypatch.setattr(jaccard, "boundary", lambda *a: 9)  # sets of up to 9 shingles are joined by subsets
    rows = [(9, "a b c d e f g h " * 100), (4, "a b c d e f g h " * 90 + "i"), (6, "same " * 500), (5, "same same"), (3, "p q r s " * 40), (7, "p q r s " * 50 + "t"), (8, "a b c d e f g h " * 9 + "j k l")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(docs(spark, rows)).collect()}
    assert got == {9: (8, 4), 4: (9, 4), 6: (1, 6), 5: (1, 5), 3: (4, 3), 7: (5, 3), 8: (11, 8)}
    assert sorted(r.doc_id for r in jaccard.one_of_each(docs(spark, rows)).collect()) == [3, 4, 5, 6, 8]


# --- 5


def test_bands_are_fitted_and_decide(spark):
    """Held out: the even documents labelled good fit the bands, the odd ones are judged."""
    D = "/root/testdata/sf0.1"
    table, labels = common.table(spark, D, "documents"), common.table(spark, D, "labels")
    limits = quality.fit(table.where("doc_id % 2 = 0"), labels)
    rows = quality.judged(table.where("doc_id % 2 = 1"), limits).join(labels, "doc_id").where("NOT base_failed").select("quality", "kept").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.5 * len(bad), (sum(good), len(good), sum(bad), len(bad))


def test_bands_by_brute_force():
    import zstandard

    press = zstandard.ZstdCompressor(level=quality.LEVEL)
    limits = quality.Limits([(9.0, 0.5, 0.7), (11.0, 0.4, 0.6), (13.0, 0.35, 0.5)])
    assert limits(512) == (0.5, 0.7) and limits(1024) == pytest.approx((0.45, 0.65)) and limits(511) is None and limits(2**13 + 1) is None
    rng = random.Random(4)
    for n in (1, 60, 200, 900, 5000):
        text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", str(rng.random())]) for _ in range(n))
        raw = text.encode()
        size = 4096
        while size > 512 and len(raw) < 4 * size:
            size //= 2
        parts = [raw[i : i + size] for i in range(0, len(raw), size)]
        if len(parts) > 1 and len(parts[-1]) < 256:
            parts[-2:] = [parts[-2] + parts[-1]]
        out = 0
        for x in parts:
            low, high = limits(len(x)) or (0.20, 0.66 + 55 / len(x))
            out += not low * len(x) <= len(press.compress(x)) <= high * len(x)
        whole = len(press.compress(raw)) / len(raw)
        assert quality.ratios(raw, press, limits) == (whole, len(parts), out)
        low, high = limits(len(raw)) or quality.band(len(raw))
        got = quality.judge(text, press, limits)
        assert got[-1] == (not got[5] and low <= whole <= high and out <= 0.25 * len(parts))


def test_quality_edges(spark):
    table = spark.createDataFrame([(1, "word " * 60, 5, "x"), (1, "word " * 60, 5, "x"), (2, None, 6, "y"), (None, "", 7, None)], DOCS + ", n_words long, kept string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (9, None)], "doc_id long, quality int")
    assert quality.fit(table, labels) is None and quality.fit(table.limit(0), labels.limit(0)) is None
    got = quality.judged(table).collect()
    assert len(got) == 4 and got[0] == got[1] and not any(r.kept for r in got)
    assert quality.judged(table.limit(0)).count() == 0
    fine = common.table(spark, "/root/testdata/sf0.001", "documents").where("doc_id = 1").first().text
    assert [tuple(r) for r in quality.filtered(spark.createDataFrame([(3, fine, 9, "z")], table.schema)).collect()] == [(3, fine, 9, "z")]


# --- 7

PAGES = "page_id long, url string, html string"


def test_the_wrapper_decides(spark):
    """No tag or class says what is the article: the host's other pages do."""
    page = '<div class="xa"><span>Fine site</span></div><div class="xb"><p><a href=/1>one {0}</a> <a href=/2>two {0}</a></p></div><div class="xc"><h1>Title {0}</h1><p>Text {0} is <a>here</a>.</p><p>More.</p></div><div>Since 1999</div>'
    rows = [(i, f"http://h.org/{i}", page.format(i)) for i in range(5)] + [(9, "http://alone.org/", page.format(9))]
    got = {r.page_id: r.text for r in wrapper.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[3] == "Title 3 Text 3 is here."  # More. and Since 1999 are the same on all pages
    assert got[9].startswith("Fine site one 9 two 9") and got[9].endswith("Since 1999")
    w = None
    for _, _, html in rows[:5]:
        w = wrapper.merged(w, wrapper.wrapper_of(html))
    said = wrapper.regions(w)
    assert wrapper.extract(rows[0][2], wrapper.Region(said)) == got[0]
    assert wrapper.extract(rows[0][2], wrapper.Region([False, [-1], [""], [1], [[]]])) == ""  # a wrapper without places takes nothing


def test_wrappers_align_into_groups():
    w = None
    for html in ("<ul><li>a<li>b</ul><h2>x</h2><p>t", "<h2>x</h2><ul><li>c</ul><p>u", "<p>v<h3>y</h3>"):
        w = wrapper.merged(w, wrapper.wrapper_of(html))
    at = {w.sign[i]: i for i in range(1, len(w.sign))}
    assert w.pages[at["p"]] == w.pages[0] == 3 and w.pages[at["ul"]] == 2 and w.pages[at["h3"]] == 1  # the last two are optional
    assert w.again[at["li"]] and (w.again[at["ul"]] or w.again[at["h2"]]) and not w.again[at["p"]]
    assert wrapper._order([1, 2, 3], [4, 1, 5, 3, 2]) in (([4, 1, 5, 2, 3], {2}), ([4, 1, 5, 2, 3], {3}))
    many = None
    for i in range(100):  # classes that differ on each page are a slot
        name = "".join("abcdefghij"[int(c)] for c in f"{i:03d}")
        many = wrapper.merged(many, wrapper.wrapper_of(f'<div class="c-{name}"><p>text {i}</p></div>'))
    assert len(many.sign) == 3 and many.sign[1] == "div*"
    assert wrapper.extract('<div class="c-abc"><p>text 1</p></div>', wrapper.Region(wrapper.regions(many))) == "text 1"
    back = wrapper.Wrapper.loads(many.dumps())
    assert back.dumps() == many.dumps() and wrapper.merged(back, wrapper.wrapper_of("<div><p>z")).pages[0] == 101


def test_deep_and_long_pages(spark):
    deep = "<div>" * 100_000 + "core" + "</div>" * 100_000
    long = "".join(f"<h2>h{i}</h2><p>p{i}<b>b</b>" for i in range(25_000))
    unclosed = "<b>" * 50_000 + "<p>x" + "</i>" * 50_000 + "<li>y" * 1000
    assert wrapper.extract(deep, None) == "core"
    assert wrapper.extract(long, None).startswith("h0 p0b h1 p1b") and wrapper.extract(unclosed, None).startswith("x y y")
    rows = [(1, "http://d/1", deep), (2, "http://d/2", long), (3, "http://d/3", "<p>short"), (4, None, None), (5, "x", ""), (3, "http://d/3", "<p>short")]
    table = spark.createDataFrame([(*r, "q") for r in rows], PAGES + ", region string")
    got = sorted((r.page_id, r.n_chars) for r in wrapper.extracted(table).collect())
    assert [g for g in got if g[0] != 2] == [(1, 4), (3, 5), (3, 5), (4, 0), (5, 0)]
    assert wrapper.extracted(table.limit(0)).count() == 0


def test_hot_hosts_meet_their_regions(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 3)
    rows = [(i, "http://hot.org/a", f"<main><p>text {i}") for i in range(20)] + [(100 + i, f"http://h{i}.org/", f"<p>own {i}") for i in range(10)]
    for chars in (10**6, 5):  # by broadcast; by copies
        monkeypatch.setattr(wrapper, "BROADCAST_CHARS", chars)
        got = {r.page_id: r.text for r in wrapper.extracted(spark.createDataFrame(rows, PAGES)).collect()}
        assert got == {i: f"text {i}" for i in range(20)} | {100 + i: f"own {i}" for i in range(10)}


# --- 9


def line_rows():
    passage = "\n".join(" ".join(f"w{i}{j}" for j in range(20)) for i in range(3))
    return passage


@pytest.mark.parametrize("ids", [(-(2**63), 2**63 - 1, 5, 7), (10, 2**50, 2**50 + 1, 3), (1, None, 4, 6)])
def test_lines_of_sparse_ids(spark, ids):
    passage = line_rows()
    texts = ["own\n" + passage, passage + "\ntail", passage, "other"]
    table = spark.createDataFrame([(d, t, 1, 2, 3, 4, 5) for d, t in zip(ids, texts)], DOCS + ", _gone long, _d long, _t long, _lines long, _n long")
    got = linedup.dedup_lines(table).collect()
    order = sorted(range(3), key=lambda i: (ids[i] is not None, ids[i] or 0))
    want = {i: texts[i] for i in range(4)}
    for i in order[1:]:
        want[i] = {0: "own", 1: "tail", 2: ""}[i]
    assert {r.doc_id: r.text for r in got} == {ids[i]: t for i, t in want.items()}
    assert got[0].asDict().keys() >= {"_gone", "_d", "_t", "_lines", "_n"} and {r._gone for r in got} == {1}


def test_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 3)
    passage, hot = line_rows(), "the same line stands everywhere in this corpus"
    rows = [(d, f"{hot}\nown {d}\n{hot}\n{hot}" + (f"\n{passage}" if d % 5 == 0 else "")) for d in range(30)]
    got = {r.doc_id: r.text for r in linedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {d: f"{hot}\nown {d}" + (f"\n{hot}\n{hot}" if d % 5 or d == 0 else "") + (f"\n{passage}" if d == 0 else "") for d in range(30)}


def test_long_texts_and_doubles(spark):
    passage = line_rows()
    long = "\n".join(f"line {i} of a long text" for i in range(20_000))
    table = spark.createDataFrame([(1.0, long), (2.0, "x\n" + long), (3.5, passage), (3.5, passage)], "doc_id double, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_deleted) for r in linedup.dedup_lines(table).collect())
    assert got == [(1.0, 20000, 0), (2.0, 20001, 20000), (3.5, 3, 0), (3.5, 3, 0)]


# --- 10


def slow_tiles(item, doc, seed):
    n, m, out = len(item), len(doc), []
    gone_i, gone_j = set(), set()
    while True:
        best = None
        for i in range(n):
            for j in range(m):
                k = 0
                while i + k < n and j + k < m and item[i + k] == doc[j + k] and i + k not in gone_i and j + k not in gone_j:
                    k += 1
                if k >= seed and (best is None or k > best[2]):
                    best = (i, j, k)
        if best is None:
            return out
        out.append(best)
        gone_i.update(range(best[0], best[0] + best[2]))
        gone_j.update(range(best[1], best[1] + best[2]))


@pytest.mark.parametrize("places", [200_000, 0])  # 0: always row by row
def test_tiling_by_brute_force(spark, monkeypatch, places):
    monkeypatch.setattr(decontam, "PLACES", places)
    rng = random.Random(12)
    items = [(i, " ".join(rng.choice("abcdef"[: rng.choice([1, 3, 6])]) for _ in range(rng.randint(1, 24)))) for i in range(25)] + [(3, "a b c d e f"), (None, "f e d c b a"), (40, None), (41, " ")]
    rows = [(d, " ".join(rng.choice("abcdefgh"[: rng.choice([1, 4, 8])]) for _ in range(rng.randint(1, 40)))) for d in range(40)] + [(7, "a b c d e f"), (7, "a b c d e f"), (None, "z A B c d E f z"), (50, None), (51, "")]
    want = collections.Counter()
    for d, t in rows:
        for i, x in items:
            a, b = (x or "").split(), (t or "").lower().split()
            if a:
                seed = min(5, len(a))
                found = slow_tiles(a, b, seed)[: 1 if len(a) < 5 else None]
                if 100 * sum(k for _, _, k in found) >= 75 * len(a):
                    want[d, i, len(a), tuple(found)] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame([(*r, "q", 1) for r in rows], DOCS + ", t string, item long")
    for limit in (decontam.BLOCK_CHARS, 10):  # by broadcast; by a shuffle
        got = collections.Counter((r.doc_id, r.item_id, r.item_words, tuple((x.item_at, x.doc_at, x.words) for x in r.tiles)) for r in decontam.contained(table, bench, limit=limit).collect())
        assert got == want
        left = decontam.decontaminated(table, bench, limit=limit)
        gone = {d for d, *_ in want}
        assert left.columns == table.columns
        assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, t in rows if d not in gone)


def test_equal_words_are_tiled_in_bounded_memory():
    import tracemalloc

    b = decontam.Block([(1, "x " * 500), (2, "a b c d e f g")], 5, 75)
    tracemalloc.start()
    assert [m[:4] for m in b.matches("x " * 20_000 + "y " + "x " * 300)] == [(1, 500, 500, 1)]
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def test_empty_benchmarks(spark):
    table = spark.createDataFrame([(1, "a b c d e f")], DOCS)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contained(table, bench).count() == 0 and decontam.decontaminated(table, bench).count() == 1
    assert decontam.contained(table.limit(0), bench).count() == 0 and decontam.decontaminated(table.limit(0), bench).count() == 0
