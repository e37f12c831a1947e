"""The corpus operators against brute force, round trips and planted cases."""

import collections
import hashlib
import random

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")
import public_tokenizers as P  # noqa: E402

from tidemark.llm import bpe, common, decontam, jaccard, langid, licenses, linedup, pii, quality, urlfilter, wrapper  # noqa: E402

VOC = P.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string"
D = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# --- 1


def test_bpe_is_the_librarys(spark):
    ranks = bpe.load_ranks(VOC)
    own, ref = bpe.Codec(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng, signs = random.Random(1), " \n\t\x1c\x85\xa0　abcé's't1²½٣漢字ñ!?_-\U0001F600'\r"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    texts += ["", "a" * 3000, "ab" * 2000, " " * 900, "x   y  z ", "<|endoftext|>", "é" * 700]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids == np.array(ref.encode_ordinary(text), "<u4").tobytes(), text
        assert own.decode(ids) == text.encode()


def test_bpe_queries(spark):
    rows = [(1, "the end"), (2, None), (3, ""), (1, "the end"), (None, "x" * 5000)]
    got = sorted(bpe.round_trip(docs(spark, rows), VOC, P.PATTERN).collect(), key=str)
    assert len(got) == 5
    for r in got:
        if r.doc_id in (2, 3):
            assert r.n_tokens == 0 and r.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    back = bpe.decode(bpe.encode(docs(spark, rows), VOC, P.PATTERN), VOC, P.PATTERN).collect()
    assert [bytes(r.decoded) for r in back] == [(t or "").encode() for _, t in rows]
    assert bpe.round_trip(docs(spark, []), VOC, P.PATTERN).count() == 0


# --- 2


def test_language_evidence(spark):
    d, p = common.table(spark, D, "documents"), common.table(spark, D, "pages")
    found = langid.identified(p, d, 40).collect()
    assert len(found) == p.count()
    right = sum(r.lang == r.declared for r in found if r.declared)
    assert right >= 0.9 * sum(r.declared is not None for r in found)  # held out: pages are no training rows
    odd = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "http://x.de/fr/", "<p>")], "page_id long, url string, html string")
    assert langid.identified(odd, d, 40).count() == 3
    assert langid.identified(odd, d.limit(0)).first().lang is None


# --- 3


def test_pseudonyms():
    p = pii.Pseudonyms(b"k")
    for size in (1, 2, 10, 97, 1000):
        assert sorted(p.permute(i, size, "t") for i in range(size)) == list(range(size))
    text = "Mail Ann.B7@mail.example.org, card 4111 1111 1111 1111 and not 4111111111111112, 10.0.0.1, +1 (555) 123-4567, 078-05-1120, 2024-02-29, GB82 WEST 1234 5698 7654 32, password=ab12CD"
    new, n, spans = p.replaced(text)
    assert n == {"email": 1, "ip": 1, "card": 1, "iban": 1, "ssn": 1, "phone": 1, "date": 1, "secret": 1}
    assert "4111111111111112" in new and "4111 1111 1111 1111" not in new and "Ann.B7" not in new
    assert p.replaced(new)[1] == n  # a pseudonym is valid in its format
    assert len(new) == len(text) or "." in new
    assert p.replaced("see 10.0.0.1")[0] == "see " + p.of("ip", "10.0.0.1")  # linked across texts
    assert p.replaced(None)[0] is None and p.replaced("")[0] == ""
    assert pii.Pseudonyms(b"other").of("ip", "10.0.0.1") != p.of("ip", "10.0.0.1")


def test_pseudonyms_of_rows(spark):
    rows = [(1, "a 10.1.2.3"), (2, None), (3, "b 10.1.2.3"), (3, "b 10.1.2.3"), (4, "")]
    got = collections.defaultdict(list)
    for r in pii.pseudonymised(docs(spark, rows)).collect():
        got[r.doc_id].append(r)
    assert got[1][0].text[2:] == got[3][0].text[2:] != "10.1.2.3" and got[3][0] == got[3][1] and got[2][0].text is None
    assert (got[1][0].pii_spans[0].start, got[1][0].pii_spans[0].end, got[1][0].n_ip) == (2, 10, 1)


# --- 4


def test_licenses(spark):
    s = licenses.Scanner()
    for spdx, text, _ in licenses.TEMPLATES:
        found = s.scan(f"Some prose.\n{text}\nMore.")
        assert found and found[0][2] == spdx and found[0][3] == "exact", text
    near = s.scan("This work is licenced under the GNU General Public License, version 3.")
    assert near[0][2:4] == ("GPL-3.0", "near") and near[0][5] == ["licensed"]
    assert s.scan("Licensed under CC BY-SA 3.0.")[0][2] is None  # another version is another license
    assert s.scan("I have a driving licence.")[0][3] == "unknown"
    got = licenses.scanned(docs(spark, [(1, "x\nReleased under the MIT License."), (2, None), (3, ""), (4, "plain")])).collect()
    assert [(r.doc_id, r.first_line, r.license) for r in got] == [(1, 1, "MIT")]


# --- 5


def slow_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_bands(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b ", "é", "\n", "\t", "#", " ", "\xa0", "c d "]) for _ in range(rng.randint(0, 300))) for _ in range(200)] + [None, "", " \n "]
    for t in texts:
        assert quality.base_counts(t) == slow_counts(t)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(9)) for _ in range(2000))
    prose = common.table(spark, D, "documents").where("doc_id = 1").first().text
    rows = {r.doc_id: r for r in quality.judged(docs(spark, [(1, noise), (2, prose), (3, None), (4, "w " * 200)])).collect()}
    assert not rows[1].base_failed and not rows[1].kept and rows[2].kept and not rows[3].kept and rows[4].base_failed
    assert [r.doc_id for r in quality.filtered(docs(spark, [(1, noise), (2, prose), (3, None)])).collect()] == [2]


# --- 6


def test_url_verdicts(spark):
    rows = [
        (1, "http://a.com/x", '<link rel="canonical" href="http://b.net/q">'), (2, "http://c.com/y", '<link href="/z" rel=canonical>'),
        (3, "http://c.com/z", '<meta http-equiv="refresh" content="0; url=http://www.example.net/en/1">'), (4, "http://WWW.Example.net/en/1", ""), (5, None, "x"), (6, "nourl", None),
        (7, "HTTP://A.com?x=1#f", ""), (8, "http://example.com/de/1?a", ""), (9, "http://x.example.org/fr/", ""), (10, "http://notnet/", ""), (2, "http://c.com/y", None),
    ]
    got = {r.page_id: r for r in urlfilter.verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: r.verdict for k, r in got.items()} == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "allow", 10: "allow"}
    assert (got[4].rule, got[8].rule, got[1].rule, got[7].host, got[7].path, got[5].host) == ("example.net/en/", "example.com/de/", None, "a.com", "", "")
    chain = spark.createDataFrame([(f"http://s/{i}", f"http://s/{i + 1}") for i in range(40)] + [("http://s/40", "http://z.net/")], "src string, dst string")
    page = spark.createDataFrame([(1, "http://s/0", "")], "page_id long, url string, html string")
    assert urlfilter.verdicts(page, redirects=chain).first().verdict == "block"
    assert urlfilter.verdicts(page.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(9999, 9999)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}


# --- 7


def test_wrappers(spark):
    page = '<html><body><header>H</header><div class="side-bar sidebar">S</div><main><article><h1>T &amp; x</h1><p>a<b>b</b> c<br>d<div class="comments"><p>no</p></div><form>f</form></article></main><footer>F'
    assert wrapper.extract(page, None) == "T & x ab c d"
    assert wrapper.extract('<div id=menu>m</div><p>Hello &lt;b&gt; 1 < 2<p>x<script>var a="</p>"</script>', None) == "Hello <b> 1 < 2 x"
    w = None
    for i in range(4):  # no <article>: what never differs is template
        w = wrapper.merged(w, wrapper.wrapper_of(f"<div><span>Since 1999</span><p>text {i}</p>" + "<ul><li>x</ul>" * (i % 2) + "</div>"))
    assert wrapper.extract("<div><span>Since 1999</span><p>text 9</p></div>", wrapper.Region(wrapper.regions(w))) == "text 9"
    rows = [(1, "http://h/a", "<article>one</article>"), (2, "http://h/b", None), (3, None, ""), (4, "http://h/a", "<article>one"), (4, "http://h/a", "<article>one")]
    got = [(r.page_id, r.text, r.n_chars) for r in wrapper.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got) == [(1, "one", 3), (2, "", 0), (3, "", 0), (4, "one", 3), (4, "one", 3)]


# --- 8


def slow_groups(rows):
    sets = [common.shingle_set(t) for _, t in rows]
    of = list(range(len(rows)))

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                of[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("light", [4096, 2])  # 2: lists are dealt into parts
def test_jaccard_components(spark, light, monkeypatch):
    monkeypatch.setattr(jaccard, "LIGHT", light)
    rng = random.Random(6)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(n)) for n in (3, 6, 8, 9, 12, 16, 20, 40, 90)]
    rows = [(0, None), (1, ""), (2, " \n")]
    for i in range(120):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            words[rng.randrange(len(words))] = "x" + str(rng.randint(0, 30))
        rows.append((i + 3, " ".join(words[: rng.choice([len(words), len(words), len(words) - 1])]).upper()))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(docs(spark, rows)).collect()}
    assert got == slow_groups(rows)


def test_jaccard_keeps_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(60))
    left = jaccard.one_of_each(docs(spark, [(5, text), (2, text + " end"), (9, "other words"), (7, None), (8, "")])).collect()
    assert sorted(r.doc_id for r in left) == [2, 7, 8, 9]
    assert jaccard.similar(docs(spark, [])).count() == 0


# --- 9


def slow_lines(rows, least):
    out, seen = {}, {}
    seqs = [(d, t.split("\n")) for d, t in sorted(rows)]
    for i, (d, lines) in enumerate(seqs):
        gone = out.setdefault(d, set())
        for s in range(len(lines)):
            best = 0
            for j, q in seen.get(lines[s], []):
                k = 0
                while s + k < len(lines) and q + k < len(seqs[j][1]) and lines[s + k] == seqs[j][1][q + k]:
                    k += 1
                best = max(best, k)
            seen.setdefault(lines[s], []).append((i, s))
            if best and sum(len(x.split()) for x in lines[s : s + best]) >= least:
                gone.update(range(s, s + best))
    return out


@pytest.mark.parametrize("least", [1, 6])
def test_line_runs(spark, least):
    rng = random.Random(5)
    rows = [(d, "\n".join(rng.choice(["", "a b", "c d e", "f", "g h i j"]) for _ in range(rng.randint(1, 20)))) for d in range(40)]
    got = {r.doc_id: set(r.deleted_lines) for r in linedup.dedup_lines(docs(spark, rows), least).collect()}
    assert got == slow_lines(rows, least)


def test_line_edges(spark):
    passage = "\n".join(" ".join(f"w{i}{j}" for j in range(20)) for i in range(3))
    rows = [(1, "own\n" + passage), (2, passage + "\ntail"), (None, None), (3, ""), (3, ""), (4, "x\nx")]
    got = {(r.doc_id, r.text) for r in linedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == {(1, "own\n" + passage), (2, "tail"), (None, None), (3, ""), (4, "x\nx")}
    assert linedup.dedup_lines(docs(spark, [])).count() == 0


# --- 10


def test_tiling(spark):
    rng = random.Random(8)
    item = [f"w{i}" for i in range(30)]
    other = [f"q{i}" for i in range(25)]
    reordered = item[20:] + ["z"] * 4 + item[:10] + ["y"] * 3 + item[10:20]
    half = item[:15] + [f"n{i}" for i in range(40)]
    rows = [(1, " ".join(["a"] * 9 + item).upper()), (2, " ".join(reordered)), (3, " ".join(half)), (4, None), (5, ""), (6, " ".join(rng.choice(item) for _ in range(300))), (2, " ".join(reordered))]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(other)), (9, None), (10, "hi you")], "item_id long, text string")
    for limit in (decontam.BLOCK_CHARS, 60):
        got = sorted((r.doc_id, r.item_id, r.marked_words, r.n_tiles) for r in decontam.contained(docs(spark, rows), bench, limit=limit).collect())
        assert got == [(1, 7, 30, 1), (2, 7, 30, 3), (2, 7, 30, 3)]
    assert sorted(r.doc_id for r in decontam.decontaminated(docs(spark, rows), bench).collect()) == [3, 4, 5, 6]


# --- the pipeline


def test_the_pipeline_is_its_stages_by_brute_force(spark):
    import corpus_pipeline
    import zstandard

    rows = [tuple(r) for r in common.table(spark, D, "documents").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in common.table(spark, D, "benchmark").select("item_id", "text").collect()]
    press = zstandard.ZstdCompressor(level=quality.LEVEL)
    limits = quality.fit(common.table(spark, D, "documents"), common.table(spark, D, "labels"))
    rows = [(i, t) for i, t in rows if quality.judge(t, press, limits)[-1]]
    gone = slow_lines(rows, linedup.MIN_WORDS)
    rows = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])) for i, t in rows]
    rows = [(i, t) for i, t in rows if t.split() or not gone[i]]
    group = slow_groups(rows)
    rows = [(i, t) for i, t in rows if group[i][1] == i]
    block = decontam.Block(bench, decontam.SEED, common.PERCENT)
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows if not block.matches(t)}
    assert {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, D).collect()} == want
