"""Cases that the review of round 1 found missing."""

import random
import re
import textwrap

import pytest

pytest.importorskip("tiktoken")

from tidemark.llm import common, jaccard, langid, licenses, pii, quality, urlfilter, wrapper  # noqa: E402

DOCS = "doc_id long, text string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# --- 3


def test_quoted_secrets(spark):
    p = pii.Pseudonyms(b"k")
    hidden = "24be64439e3e49cf"
    for form in ('token = "%s"', "api_key='%s'", '{"token": "%s"}', '"password":"%s", "x": 1', "secret: '%s'", "token   =   %s", 'token = "%s'):
        new, n, _ = p.replaced(form % hidden)
        assert hidden not in new and n["secret"] == 1, form
        assert re.fullmatch(re.escape(form).replace("%s", "([a-z0-9]{16})"), new), form  # all but the value stays
        assert p.replaced(new)[1] == n
    said = p.replaced(f"token={hidden}")[0].removeprefix("token=")
    assert p.replaced(f'token = "{hidden}"')[0] == f'token = "{said}"'  # linked, quoted or not
    new = p.replaced('password: "Zürich 8 o\\"clock\\n!" and more')[0]
    assert re.fullmatch(r'password: "[A-Z]ü[a-z]{4} \d [a-z]\\"[a-z]{5}\\n!" and more', new) and "clock" not in new
    assert p.replaced('password: "", token = ""')[2] == []
    table = common.table(spark, "/root/testdata/sf0.01", "documents")
    planted = re.compile(r'token = "([0-9a-f]+)"')
    before = {r.doc_id: planted.findall(r.text or "") for r in table.collect()}
    found = pii.pseudonymised(table).collect()
    assert sum(map(len, before.values())) == 13
    for r in found:
        assert r.n_secret >= len(before[r.doc_id]) and not any(x in r.text for x in before[r.doc_id])


# --- 4


def test_licenses_of_long_lines():
    s, rng = licenses.Scanner(), random.Random(3)
    prose = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(4000))
    for spdx, text, _ in licenses.TEMPLATES:
        assert [x[:4] for x in s.scan(f"{prose} {text} {prose}")] == [(0, 0, spdx, "exact")], text
    two = "Licensed under the Apache License, Version 2.0. Released under the MIT License."
    assert [x[2:4] for x in s.scan(two)] == [("Apache-2.0", "exact"), ("MIT", "exact")]
    far = s.scan(f"{two} {prose} I have a driving licence. {prose} Licenced under CC BY 4.0. {prose} Licensed under the BSD 3-Clause License, too")
    assert [x[2:4] for x in far] == [("Apache-2.0", "exact"), ("MIT", "exact"), (None, "unknown"), ("CC-BY-4.0", "near"), ("BSD-3-Clause", "exact")]
    assert [x[2:4] for x in s.scan(f"{prose} This work is licenced under the GNU General Public License, version 3. {prose}")] == [("GPL-3.0", "near")]
    assert [x[2] for x in s.scan("This work is licensed under the GNU Lesser General Public License, version 3.")] == ["LGPL-3.0"]


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_notices(mark):
    s = licenses.Scanner()
    for spdx, text, _ in licenses.TEMPLATES:
        if len(text) < 100 or spdx.startswith("Apache"):
            continue
        for width in (30, 70, 80):
            lines = textwrap.wrap(text + " and the terms that follow in this file, which are many and long", width)
            notice = "\n".join(mark + x for x in lines)
            n = len(textwrap.wrap(text, width))
            assert [x[:4] for x in s.scan(f"{notice}\n\nProse.\n\n{notice}")] == [(0, n - 1, spdx, "exact"), (len(lines) + 3, len(lines) + n + 2, spdx, "exact")]
    short = "Released under the MIT License."
    # A line that says it first is no reason to leave a notice out; one of the notice's own lines is.
    mit = "\n".join(textwrap.wrap(next(t for _, t, _ in licenses.TEMPLATES if t.startswith("Permission is hereby")), 60))
    assert [x[:3] for x in s.scan(f"{short}\n\n{mit}")] == [(0, 0, "MIT"), (2, 5, "MIT")]
    assert [x[:3] for x in s.scan(f"We made this.\n{short}\nEnjoy.")] == [(1, 1, "MIT")]


# --- 8


def test_one_of_each_goes_by_set(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    # Of the rows without an id one links; a second doc_id has two texts, and was kept for b's group.
    rows = [(1, a), (None, a + " end"), (None, c), (None, None), (3, b), (3, a + " and"), (5, b + " end"), (5, b + " end"), (6, "few words"), (6, b + " 6"), (7, "")]
    left = jaccard.one_of_each(docs(spark, rows)).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(1, a), (None, c), (None, None), (3, b), (6, "few words"), (7, "")], key=str)
    assert left[0].__fields__ == ["doc_id", "text"]
    assert jaccard.one_of_each(docs(spark, rows[2:4])).count() == 2


# --- 5


def test_parts_of_bad_text(spark):
    zstandard = pytest.importorskip("zstandard")
    press, rng = zstandard.ZstdCompressor(level=quality.LEVEL), random.Random(2)
    signs = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    noise = lambda n: " ".join("".join(rng.choice(signs) for _ in range(9)) for _ in range(n // 10 + 1))[:n]
    rows = [r.text for r in common.table(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").collect()]
    clean = [t for t in rows if t and t.isascii() and quality.base_counts(t)[0] >= 50 and not quality.base_counts(t)[4] * 5 > quality.base_counts(t)[0]]
    prose = "\n".join(clean)
    advert = "Buy the best lamps of town at Miller's today, open until nine. "
    kept = lambda t: quality.judge(t, press)[-1]
    for n in (600, 800, 1500, 3000, 6000, 12000, 60000):
        assert kept(prose[:n])
        assert not kept(noise(n)), n
        if n >= 3000:
            half = n // 2
            assert not kept(prose[:half] + noise(half)), n
            bad = quality.judge(prose[:half] + (advert * 1000)[:half], press)
            assert not bad[-1] and bad[9] > quality.CHUNKS_OUT * bad[8], n  # also by the chunks alone
    assert quality.judge(prose[: 4 * 4096] + noise(3000), press)[8:10] == (5, 1)  # the last chunk counts
    assert quality.chunks(16384 + 200) == [0, 4096, 8192, 12288, 16584] and quality.chunks(700) == [0, 700]
    assert all(map(kept, clean))


# --- 7

PAGES = "page_id long, url string, html string"


def test_copies_of_a_page_make_no_template(spark):
    page = "<div><h1>Title</h1><p>All of the text</p></div>"
    rows = [(1, "http://h/a", page), (2, "http://h/b", page), (2, "http://h/b", page), (3, None, page), (4, "x", page), (5, None, page)]
    rows += [(6, "http://g/a", page + '<div class="ad">x</div>'), (7, "http://g/b", page + '<div class="ad">y</div>'), (8, "http://g/c", page + "<script>1</script>")]
    got = wrapper.extracted(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == 9 and {(r.text, r.n_chars) for r in got} == {("Title All of the text", 21)}
    # Three pages that differ have a template; a page that is nothing else keeps its text.
    rows = [(i, "http://h/", f"<div><b>Since 1999</b><p>one {i}<p>two {i}</div>") for i in range(3)]
    got = wrapper.extracted(spark.createDataFrame(rows, PAGES)).collect()
    assert {r.page_id: r.text for r in got} == {i: f"one {i} two {i}" for i in range(3)}
    w = wrapper.wrapper_of("<div><b>Since 1999</b></div>")
    w.digests = ["a", "b", "c"]
    region = wrapper.Region(wrapper.regions(w))
    assert wrapper.extract("<div><b>Since 1999</b></div>", region) == "Since 1999"


def test_icons_and_compound_classes():
    for icon in ('<svg class="i" />', "<svg/>", "<math/>", "<iframe src='x'/>", '<svg viewBox="0 0 1 1"/><svg><path/></svg>', "<iframe/><p>lost?</p><iframe>raw</iframe>"):
        want = "lost? a b" if "lost" in icon else "a b"
        assert wrapper.extract(f"<div>{icon}<p>a</p><p>b</p></div>", None) == want, icon
    assert wrapper.extract("<svg><title>t</title></svg><script src='x'/>var x;</script><iframe>raw</iframe><p>a", None) == "a"
    for kept in ("content no-sidebar", "has-sidebar", "post-with-comments", "search-result", "page--sidebar", "content-sidebar", "ad-free", "no-comments"):
        assert wrapper.extract(f'<div class="{kept}"><p>a</p></div>', None) == "a", kept
    for gone in ("sidebar", "x ad", "site-footer", "cookie-banner", "ad-slot", "share-buttons", "comments-area", "comment-17", "sidebar_2", "Main-Menu"):
        assert wrapper.extract(f'<div class="{gone}"><p>a</p></div><p>b', None) == "b", gone


# --- 2 and 6


def test_all_languages_are_fitted(spark):
    rows = [(i, f"{x}{x}{x} text {x}", x) for i, x in enumerate(["aa", "bb", "cc", "dd", "ee", "aa", "bb"])]
    langs, logs = langid.fit(spark.createDataFrame(rows, DOCS + ", lang string"))
    assert langs == ["aa", "bb", "cc", "dd", "ee"] and logs.shape == (langid.BUCKETS, 5)


def test_long_tags_are_links(spark):
    html = f'<link data-x="{"y" * 5000}" rel="canonical" href="http://z.net/"><meta property="og:url" content="http://open.net/"'
    page = spark.createDataFrame([(1, "http://s/0", html)], PAGES)
    assert [tuple(r) for r in urlfilter.links(page).collect()] == [("s/0", "z.net/")]
    assert urlfilter.verdicts(page).first().verdict == "block"
