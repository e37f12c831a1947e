"""Every operator against brute force or held-out labels, and on nulls, empty and repeated rows, clashing names and empty tables."""

import collections
import random
import re

import numpy as np
import pytest

pytest.importorskip("tiktoken")

import public_tokenizers as P  # noqa: E402

from tidemark.llm import bpe, common, decontam, jaccard, langid, licenses, linedup, pii, quality, urlfilter, wrapper  # noqa: E402

D = "/root/testdata/sf0.001"
VOC = P.path("byte_bpe_multi_50k.tiktoken")


# --- 2


def test_languages_of_held_out_documents(spark):
    """Pages made of labelled documents that fitted nothing; half of them declare a wrong language."""
    table = common.table(spark, "/root/testdata/sf0.01", "documents").where("lang IS NOT NULL AND length(text) > 300")
    fitting, held = table.where("doc_id % 2 = 0"), table.where("doc_id % 2 = 1").select("doc_id", "lang", "text").collect()
    rng = random.Random(7)
    rows = [(r.doc_id, f"http://h{r.doc_id % 9}.org/x/{r.doc_id}", f'<html lang="{rng.choice(["en", "de", "fr", "es"]) if r.doc_id % 4 == 1 else r.lang}"><p>{r.text}</p>') for r in held]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.lang for r in langid.identified(pages, fitting).collect()}
    right = [got[r.doc_id] == r.lang for r in held]
    assert sum(right) >= 0.97 * len(right), (sum(right), len(right))


@pytest.mark.parametrize("heavy", [1000, 3])
def test_fusion_by_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(common, "HEAVY", heavy)
    docs, pages = common.table(spark, D, "documents"), common.table(spark, D, "pages").limit(60)
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()] + [(901, None, None), (902, "", ""), (903, "http://x.de/fr/", "<p>"), (901, None, None)]
    langs, logs = langid.fit(docs, 40)
    n = len(langs)
    seen = []
    for _, url, html in rows:
        t = langid.trigrams(langid.visible(html))
        likely = logs[t].sum(0, dtype=float) / max(1, len(t)) * min(len(t) / langid.PER_PIECE, langid.PIECES) if len(t) else np.zeros(n)
        soft = np.exp(likely - likely.max())
        m = re.match(r"[^:]*://([^/?#]*)([^?#]*)", url or "") if url and "://" in url else None
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        first = re.match(r"/([A-Za-z]{2})(?:/|$)", path)
        top = host.rpartition(".")[2]
        suffix = "/" + first[1].lower() if first and first[1].lower() in langs else "." + top if top else None
        domain = ".".join(host.split(".")[-2:]) if "." in host else ""
        seen.append((likely, soft / soft.sum(), {"declared": langid.declared(html), "suffix": suffix, "top": top, "domain": domain, "host": host}))
    total = sum(s for _, s, _ in seen)
    base = (total + 1) / (total.sum() + n)

    def held(key, i):
        mine = seen[i][2][key]
        c = sum((s for j, (_, s, k) in enumerate(seen) if mine is not None and k[key] == mine), np.zeros(n))
        return np.maximum(c - seen[i][1], 0)

    smooth = lambda c, p: (c + p * langid.SMOOTH) / (c.sum() + langid.SMOOTH)
    want = collections.defaultdict(list)
    for i, (page, _, _) in enumerate(rows):
        prior = smooth(held("host", i), smooth(held("domain", i), smooth(held("top", i), base)))
        score = seen[i][0] + np.log(prior)
        for key in ("declared", "suffix"):
            if seen[i][2][key] is not None:
                score = score + np.log(smooth(held(key, i), base)) - np.log(base)
        p = np.exp(score - score.max())
        want[page].append(p / p.sum())
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in langid.identified(table, docs, 40).collect():
        assert np.allclose(r.posteriors, want[r.page_id][0], atol=1e-6), r.page_id
        assert r.lang == langs[int(np.argmax(r.posteriors))]


# --- 3


def test_a_key_links_and_nothing_else_does(spark):
    rows = spark.createDataFrame([(1, "see 10.1.2.3"), (2, "at 10.1.2.3 a.b.c.d.e.f.g.h.i.j.k@l.m.n.o.p.q.r.s.t.u.example.org")], "doc_id long, text string")
    text = lambda key: [r.text for r in pii.pseudonymised(rows, key).collect()]
    a, b = text(b"one"), text(b"two")
    assert a[0].split()[1] == a[1].split()[1] != b[0].split()[1] and a == text(b"one")
    assert "a.b.c" not in a[1] and a[1].endswith(".org")
    assert text(None) == text(None)  # a driver's own key
    spark.conf.set(pii.KEY_SETTING, "one")
    assert text(None) == a
    spark.conf.unset(pii.KEY_SETTING)


def test_pseudonyms_by_brute_force(spark):
    """Every address and date of a corpus is a bijection's image, wherever it stands."""
    rng, rows = random.Random(5), []
    for i in range(80):
        rows.append((i, " ".join(rng.choice(["word", f"10.{rng.randint(0, 9)}.0.{rng.randint(0, 9)}", f"20{rng.randint(10, 24)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}"]) for _ in range(20))))
    key, image = b"k", {}
    for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), key).collect():
        old, new = rows[r.doc_id][1].split(), r.text.split()
        assert len(old) == len(new) and r.n_ip == sum("." in w for w in old) and r.n_date == sum("-" in w for w in old)
        for x, y in zip(old, new):
            assert image.setdefault(x, y) == y
    assert image.pop("word") == "word" and len(set(image.values())) == len(image)


# --- 4


def test_exact_notices_by_brute_force(spark):
    """Places of exact wordings, found by looking at every word of every text."""
    rng = random.Random(9)
    wordings = [(spdx, licenses.words(t)) for spdx, t, _ in licenses.TEMPLATES]
    rows = []
    for i in range(60):
        parts = [rng.choice(["some plain prose here", "we have a licence to drive", licenses.TEMPLATES[rng.randrange(len(licenses.TEMPLATES))][1]]) for _ in range(rng.randint(0, 6))]
        rows.append((i, rng.choice([" ", "\n", "\n\n"]).join(parts)))
    rows += [(60, None), (61, ""), (0, rows[0][1])]
    want = collections.Counter()
    for i, text in rows:
        here = licenses.words(text or "")
        found = sorted(((len(w), a, spdx) for spdx, w in wordings for a in range(len(here) - len(w) + 1) if here[a : a + len(w)] == w), key=lambda x: (-x[0], x[1]))
        taken = set()
        for size, a, spdx in found:
            if not taken & set(range(a, a + size)):
                taken |= set(range(a, a + size))
                want[i, spdx] += 1
    got = collections.Counter((r.doc_id, r.license) for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.match == "exact")
    assert got == want


# --- all of them


def every(spark, docs, pages, labels, bench):
    """Each operator's result on the tables, by its number."""
    return {
        1: lambda: bpe.round_trip(docs, VOC, P.PATTERN), 2: lambda: langid.identified(pages, docs), 3: lambda: pii.pseudonymised(docs, b"k"), 4: lambda: licenses.scanned(docs),
        5: lambda: quality.judged(docs, quality.fit(docs, labels)), 6: lambda: urlfilter.verdicts(pages), 7: lambda: wrapper.extracted(pages), 8: lambda: jaccard.similar(docs),
        9: lambda: linedup.dedup_lines(docs), 10: lambda: decontam.contained(docs, bench),
    }


CLASH = "_gone long, _c long, _k long, _x long, _n long, host string, region string, n_words long, kept boolean, h long, sid long, item long, t string, bucket int, Text2 string"


def test_nulls_repeats_and_clashing_names(spark):
    prose = common.table(spark, D, "documents").where("doc_id = 1").first().text
    more = (1, 2, 3, 4, 5, "h", "r", 6, True, 7, 8, 9, "t", 10, "z")
    rows = [(1, prose), (1, prose), (2, prose + " more"), (3, None), (None, prose), (None, None), (4, ""), (5, " \n\t "), (6, "x"), (7, "word " * 30_000), (8, "\n" * 3000)]
    docs = spark.createDataFrame([(i, t, "en" if i != 3 else None, *more) for i, t in rows], f"doc_id long, text string, lang string, {CLASH}")
    sites = [(1, "http://h.org/a", f"<article>{prose}</article>"), (1, "http://h.org/a", f"<article>{prose}</article>"), (2, None, None), (None, "http://x.net/", "<p>p"), (3, "", ""), (4, "nonsense", "<" * 5000), (5, "http://h.org/b", "<p>" + "word " * 20_000)]
    pages = spark.createDataFrame([(i, u, h, *(x for k, x in enumerate(more) if k != 5)) for i, u, h in sites], "page_id long, url string, html string, " + CLASH.replace("host string, ", ""))
    labels = spark.createDataFrame([(1, 1, 9), (1, 1, 9), (None, 1, 9), (2, None, 9)], "doc_id long, quality int, size int")
    bench = spark.createDataFrame([(1, "x", 5), (1, "x", 5), (None, None, 5), (2, "", 5), (None, " ".join(prose.split()[:12]), 5)], "item_id long, text string, item long")
    got = {n: f().collect() for n, f in every(spark, docs, pages, labels, bench).items()}
    for n in (1, 3, 5, 8, 9):
        assert len(got[n]) == len(rows), n
    for n in (2, 6, 7):
        assert len(got[n]) == len(sites), n
    assert got[8][0].asDict().keys() == {"doc_id", "n_shingles", "component_id"}
    assert {r.component_id for r in got[8] if r.n_shingles and r.doc_id in (1, 2)} == {1}
    assert sorted(collections.Counter((str(r.doc_id), str(r.item_id)) for r in got[10]).items()) == [(("1", "None"), 2), (("2", "None"), 1), (("6", "1"), 2), (("None", "None"), 1)]
    assert {r.doc_id: r.text for r in got[9]}[7] == rows[9][1] and got[9][0].asDict().keys() >= set(docs.columns)
    for stage in (quality.filtered, jaccard.one_of_each, lambda x: decontam.decontaminated(x, bench), linedup.dedup_lines):
        assert set(docs.columns) <= set(stage(docs).columns) and stage(docs).count() <= len(rows)


def test_empty_tables(spark):
    none = {c: common.table(spark, D, c).limit(0) for c in ("documents", "pages", "labels", "benchmark")}
    for n, f in every(spark, *none.values()).items():
        assert f().count() == 0, n
    assert quality.filtered(none["documents"]).count() == jaccard.one_of_each(none["documents"]).count() == decontam.decontaminated(none["documents"], none["benchmark"]).count() == 0


def test_the_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    table = common.table(spark, D, "documents")
    odd = table.limit(1)
    for c, value in (("text", None), ("doc_id", None), ("text", "")):
        odd = odd.unionByName(table.limit(1).withColumn(c, common.F.lit(value).cast(dict(table.dtypes)[c])))
    rows = table.limit(40).unionByName(table.limit(3)).unionByName(odd)
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        common.table(spark, D, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert got and set(got) <= {r.doc_id for r in rows.select("doc_id").collect()}
    table.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
