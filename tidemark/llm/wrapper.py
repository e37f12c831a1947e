"""HTML extraction by union-free wrappers (operator 7).

A page is a stream of tokens: opening and closing tags with their class words, and texts. The streams of
one host are aligned one after another into a wrapper, a regular expression without alternatives: equal
tokens meet, texts that differ become slots, an element that comes again becomes a repeated group, one
that only some pages have becomes optional, and tokens that come in another order belong to one repeated
group of optional members. Tags nest, so the expression is kept as a tree and the alignment goes level by
level, along a longest increasing run of the tokens in common; two wrappers align like two pages, and so
each task folds its pages into one wrapper for each host before anything is shuffled. Where elements of
one tag under one parent have more than MOST_SIGNS sets of class words, the classes are a slot themselves:
the elements become one group of that tag. A wrapper thus has the size of a page's layout.

The wrapper of its host says which texts of a page are taken, token by token: each place of the wrapper is
judged, and a page gives the texts at the places that belong to the article. Elements of navigation,
headers, footers, sidebars, forms, scripts, adverts, notices and comments (by tag, role, class and id) hold
none of it. Within the rest, the article is at the places under <article> or <main>, if the wrapper has text
there; else at the places of the body whose texts are slots, that is, differ between pages. Texts that every
page of a host has at one place (of three pages at least, copies of a page counting once) are template: a block
of nothing else is not taken. Blocks whose text is LINK_PERCENT links or more over all pages are lists of links,
and not taken. Both hold outside <article> and <main> only. A page that has no text at the places of its host's article is read at the others; one
that would be left without any text loses neither template nor links. A host with fewer than three pages has
no template to go by.

Character references are decoded; white space within a block becomes one space; blocks are joined by one
space in the order of the page. Null and empty html give an empty text. Repeated rows give the same text
each. A url without host shares the wrapper of the host "". Broken markup closes where its parents end.
Whole pages are read, whatever their length and however deep their tags nest. Extra columns don't matter.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, urlfilter

#: Fixed sets of tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select".split())
#: Elements of other vocabularies, which may close themselves.
FOREIGN = frozenset(("svg", "math"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head nav footer aside form script style noscript template textarea title svg math iframe object select button input menu dialog canvas audio video".split())
ARTICLE = frozenset(("article", "main"))
#: Classes, ids and roles that name what is not the article.
OTHER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share sharing social"
    " sidebar related recommended recommendations comment comments disqus reply replies respond breadcrumb breadcrumbs pagination pager menu nav navbar navigation navigations footer masthead toolbar widget login signup search"
    " contentinfo complementary skip".split()
)
#: Words by which a compound says something about the article ("has-sidebar"), and those that follow a word of OTHER in compounds that mean the same.
ABOUT = frozenset("no not non has have with without hide show open enable allow is one two both left right content layout full".split())
PARTS = frozenset("area bar block box button buttons container form icons inner item items link links list posts section slot unit widget wrap wrapper".split())
#: Elements that a start tag closes, if they are open within the same block.
CLOSES = {
    **dict.fromkeys("p div ul ol dl table section article aside nav header footer main form h1 h2 h3 h4 h5 h6 pre blockquote figure hr address fieldset".split(), ("p",)),
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",),
}
#: What a closing by CLOSES doesn't reach beyond.
SCOPES = frozenset("html body div section article aside nav header footer main table ul ol dl td th form blockquote figure li".split())
#: Elements that those of CLOSES close.
_CLOSED = frozenset(x for closed in CLOSES.values() for x in closed)
#: Different pages of a host from which a text that never differs is template.
TEMPLATE_PAGES = 3
#: Sets of class words of one tag under one parent, beyond which classes tell nothing.
MOST_SIGNS = 24
#: The share of a place's text in links from which it is a list of links.
LINK_PERCENT = 90
#: Characters of a host's regions up to which they may be broadcast, and salts that a heavy host with more is dealt by.
BROADCAST_CHARS, SALTS = 32_000, 64

_TOKEN = re.compile(r"""(?s)<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(?P<close2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""")
_MARK = re.compile(r"""(?is)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"""(?is)(?:^|\s)hidden(?:\s|=|/|\Z)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""")


def names_other(token: str) -> bool:
    """Whether a whole class, id or role names what is not the article: a word of OTHER, or a compound that means one."""
    words = _WORD.findall(token.partition("--")[0])
    if len(words) < 2:
        return bool(words) and words[0] in OTHER
    return ABOUT.isdisjoint(words) and (words[-1] in OTHER or (words[0] in OTHER and PARTS.issuperset(words[1:])))


class Element:
    __slots__ = ("name", "sign", "other", "children")

    def __init__(self, name: str, sign: str, other: bool):
        self.name, self.sign, self.other, self.children = name, sign, other, []


def parse(html: str) -> Element:
    """The tree of a page's token stream; texts are str children, decoded but not trimmed."""
    root = Element("", "", False)
    stack, at, n = [root], 0, len(html)
    open_: Counter = Counter()  # names in the stack
    marks: list[int] = []  # places in the stack that CLOSES asks for

    def cut(i: int) -> None:
        for e in stack[i:]:
            open_[e.name] -= 1
        del stack[i:]
        while marks and marks[-1] >= i:
            marks.pop()

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            stack[-1].children.append(entities.unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(entities.unescape(html[at : m.start()]))
        at = m.end()
        if m["cdata"]:
            stack[-1].children.append(m["cdata"])
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["close"] or m["close2"]:
            if open_[name]:
                i = len(stack) - 1
                while stack[i].name != name:
                    i -= 1
                cut(i)
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in CLOSES:
            for i in reversed(marks):
                if stack[i].name in CLOSES[name]:
                    cut(i)
                    break
                if stack[i].name in SCOPES:
                    break
        words: list[str] = []
        named = False
        if "=" in attrs:
            for x in _MARK.finditer(attrs):
                for token in (x[2] or x[3] or x[4] or "").lower().split():
                    words += _WORD.findall(token)
                    named = named or names_other(token)
        other = name in DROPPED or (name not in ("html", "body", "article", "main") and named) or bool(attrs and _HIDDEN.search(attrs))
        e = Element(name, ".".join([name, *sorted(set(words))]), other)
        stack[-1].children.append(e)
        if name in RAW:
            if attrs.endswith("/"):  # empty; but of elements that HTML doesn't let close themselves, an end tag of their own is heeded
                end = None if name in FOREIGN else re.compile(rf"(?i)<(/?){name}(?=[\s/>])[^>]*>").search(html, at)
                at = end.end() if end and end[1] else at
            else:
                end = re.compile(rf"(?i)</{re.escape(name)}\s*>").search(html, at)
                at = end.end() if end else n
        elif name not in VOID and not attrs.endswith("/"):
            if name in _CLOSED or name in SCOPES:
                marks.append(len(stack))
            open_[name] += 1
            stack.append(e)
    return root


# --- wrappers ---------------------------------------------------------------------------------------


def _name(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _order(old: list[int], new: list[int]) -> tuple[list[int], set[int]]:
    """old with the members of new that it lacks, in place; and the members of both that stand in another order."""
    place = {x: i for i, x in enumerate(old)}
    common = [x for x in new if x in place]
    tops: list[int] = []  # a longest increasing run of places, by the ends of the best runs of each length
    ends: list[int] = []
    link: dict[int, int | None] = {}
    for x in common:
        k = bisect_left(tops, place[x])
        link[x] = ends[k - 1] if k else None
        tops[k : k + 1], ends[k : k + 1] = [place[x]], [x]
    kept, x = set(), ends[-1] if ends else None
    while x is not None:
        kept.add(x)
        x = link[x]
    after: dict[int | None, list[int]] = {}
    last = None
    for x in new:
        if x in kept:
            last = x
        elif x not in place:
            after.setdefault(last, []).append(x)
    out = after.get(None, [])
    for x in old:
        out.append(x)
        out += after.get(x, ())
    return out, set(common) - kept


class Wrapper:
    """The union-free expression of pages, as a tree in lists; node 0 is the page.

    sign: the tag with its class words, or tag and "*" for a group of all its class words. pages: pages that
    have the node (fewer than all: optional). again: a repeated group. loose: made of several elements of one
    page by generalisation. chars, linked: the characters of its own texts, and those in links. same: names of
    the texts that every page has there; other texts are slots. kids: the order of the children.
    """

    FIELDS = ("parent", "sign", "pages", "again", "loose", "chars", "linked", "same")

    def __init__(self) -> None:
        self.digests: list[str] = []  # of different pages, TEMPLATE_PAGES at most
        self.parent, self.sign, self.pages, self.again, self.loose, self.chars, self.linked = [-1], [""], [0], [0], [0], [0], [0]
        self.same: list[set[int]] = [set()]
        self.kids: list[list[int]] = [[]]
        self.at: dict[tuple[int, str], int] = {}
        self.signs: Counter = Counter()  # of (parent, tag)

    def add(self, parent: int, sign: str) -> int:
        i = len(self.parent)
        for field, value in zip(self.FIELDS, (parent, sign, 0, 0, 0, 0, 0, set())):
            getattr(self, field).append(value)
        self.kids.append([])
        self.at[parent, sign] = i
        self.signs[parent, tag_of(sign)] += 1
        return i

    def find(self, parent: int, sign: str) -> int | None:
        i = self.at.get((parent, tag_of(sign) + "*"))
        return self.at.get((parent, sign)) if i is None else i

    def dumps(self) -> str:
        rows = [self.digests, self.kids, *([sorted(x) for x in self.same] if f == "same" else getattr(self, f) for f in self.FIELDS)]
        return json.dumps(rows, separators=(",", ":"))

    @classmethod
    def loads(cls, text: str) -> Wrapper:
        w = cls()
        w.digests, w.kids, *fields = json.loads(text)
        for f, value in zip(cls.FIELDS, fields):
            setattr(w, f, value)
        w.same = [set(x) for x in w.same]
        for i in range(1, len(w.parent)):
            w.at[w.parent[i], w.sign[i]] = i
            w.signs[w.parent[i], tag_of(w.sign[i])] += 1
        return w


def tag_of(sign: str) -> str:
    return sign.partition(".")[0].removesuffix("*")


def wrapper_of(html: str | None) -> Wrapper:
    """The wrapper of one page. What is not the article's by its tags is no part of it."""
    w = Wrapper()
    w.pages[0] = 1
    digest: list[str] = []
    stack = [(iter(parse(html or "").children), 0, False, set())]
    while stack:
        kids, at, link, seen = stack[-1]
        for c in kids:
            if isinstance(c, str):
                if text := " ".join(c.split()):
                    digest.append(text)
                    w.same[at].add(_name(text))
                    w.chars[at] += len(text)
                    w.linked[at] += len(text) * link
                continue
            if c.name in VOID or c.name in RAW:
                continue
            digest.append("<" + c.sign)
            if c.other:
                continue
            i = w.find(at, c.sign)
            if i is None:
                i = w.add(at, c.sign)
                w.kids[at].append(i)
                w.pages[i] = 1
            elif i in seen:
                w.again[i] = 1
            seen.add(i)
            stack.append((iter(c.children), i, link or c.name == "a", set()))
            break
        else:
            digest.append(">")
            stack.pop()
    w.digests = [xxhash.xxh3_128_hexdigest("\0".join(digest).encode("utf-8", "surrogatepass"))]
    return _generalised(w)


def _generalised(w: Wrapper) -> Wrapper:
    """w with one group for the elements of a tag that come with too many sets of class words."""
    while wide := {key for key, n in w.signs.items() if n > MOST_SIGNS}:
        out = Wrapper()
        _put(out, w, wide)
        out.pages[0], out.digests = w.pages[0], w.digests
        w = out
    return w


def _put(a: Wrapper, b: Wrapper, wide: set | tuple = ()) -> None:
    """Aligns b into a, level by level. wide: (parent in b, tag) of groups to be made."""
    at, new, hit = [0] * len(b.parent), len(a.parent), set()
    for j in range(len(b.parent)):
        if j == 0:
            i = 0
        else:
            sign = tag_of(b.sign[j]) + "*" if (b.parent[j], tag_of(b.sign[j])) in wide else b.sign[j]
            i = a.find(at[b.parent[j]], sign)
            if i is None:
                i = a.add(at[b.parent[j]], sign)
        at[j] = i
        if i in hit:
            a.loose[i] = 1
        if i >= new and i not in hit:
            a.same[i] = set(b.same[j])
        elif i not in hit:
            a.same[i] &= b.same[j]
        hit.add(i)
        a.pages[i] += b.pages[j]
        a.again[i] |= b.again[j]
        a.loose[i] |= b.loose[j] | (a.sign[i].endswith("*") and not b.sign[j].endswith("*"))
        a.chars[i] += b.chars[j]
        a.linked[i] += b.linked[j]
    rows: dict[int, dict[int, None]] = {}
    for j, kids in enumerate(b.kids):
        if kids:
            rows.setdefault(at[j], {}).update(dict.fromkeys(at[k] for k in kids))
    for i, row in rows.items():
        if a.kids[i] != (seq := list(row)):
            a.kids[i], moved = _order(a.kids[i], seq)
            for x in moved:
                a.again[x] = 1


def merged(a: Wrapper | None, b: Wrapper) -> Wrapper:
    """The wrapper of the pages of both. a is used up."""
    if a is None:
        return b
    _put(a, b)
    a.digests = sorted({*a.digests, *b.digests})[:TEMPLATE_PAGES]
    return _generalised(a)


# --- regions: what extraction needs of a wrapper --------------------------------------------------------
# [whether the host has article places, parents, signs, takes, template texts]; takes: 2 in the article, 1 outside, 0 never first.


def regions(w: Wrapper) -> list:
    """The judged places of a wrapper: those that hold text, and those above them."""
    n, full = len(w.parent), len(w.digests) >= TEMPLATE_PAGES
    inside, loose = [False] * n, list(w.loose)
    chars, linked = list(w.chars), list(w.linked)
    for i in range(1, n):  # parents stand before their children
        inside[i] = inside[w.parent[i]] or tag_of(w.sign[i]) in ARTICLE
        loose[i] |= loose[w.parent[i]]
    for i in range(n - 1, 0, -1):
        chars[w.parent[i]] += chars[i]
        linked[w.parent[i]] += linked[i]
    links = [full and i > 0 and chars[i] > 0 and 100 * linked[i] >= LINK_PERCENT * chars[i] and not inside[i] and tag_of(w.sign[i]) not in INLINE for i in range(n)]
    at, out = {0: 0}, [any(inside[i] and w.chars[i] for i in range(n)), [-1], [""], [1], [[]]]
    if not loose[0] and full:
        out[4][0] = sorted(w.same[0])
    for i in range(1, n):
        links[i] = links[i] or links[w.parent[i]]
        if not chars[i]:
            continue
        at[i] = len(at)
        mandatory = full and w.pages[i] == w.pages[0] and not loose[i] and not inside[i]
        for x, value in zip(out[1:], (at[w.parent[i]], w.sign[i], 2 if inside[i] else 0 if links[i] else 1, sorted(w.same[i]) if mandatory else [])):
            x.append(value)
    return out


class Region:
    """regions() as extraction looks them up."""

    def __init__(self, said: list):
        self.article, parents, signs, self.takes, same = said
        self.at = {key: i for i, key in enumerate(zip(parents, signs))}
        self.template = [frozenset(x) for x in same]

    def find(self, parent: int, sign: str, name: str) -> int:
        """The place of a child; -1 for one that the wrapper lacks."""
        i = self.at.get((parent, name + "*"))
        return self.at.get((parent, sign), -1) if i is None else i


# --- extraction ---------------------------------------------------------------------------------------


def extract(html: str | None, region: Region | None) -> str:
    """The article's text of a whole page, under its host's wrapper (None: of this page alone)."""
    if not html:
        return ""
    if region is None:
        region = Region(regions(wrapper_of(html)))
    root = parse(html)
    for look in ((2,) if region.article else ()) + (1, 0):
        if text := _texts(root, region, look):
            return text
    return ""


def _texts(root: Element, region: Region, least: int) -> str:
    """The texts of a page at the places that are taken at least so; for 0, template texts too."""
    blocks: list[str] = []
    line: list[str] = []
    own = False  # whether the line holds more than template

    def end() -> None:
        nonlocal own
        if line:
            if own and (text := " ".join("".join(line).split())):
                blocks.append(text)
            line.clear()
            own = False

    stack = [(iter(root.children), 0, False, False)]
    while stack:
        kids, at, inside, edge = stack[-1]
        take = at >= 0 and region.takes[at] >= least  # a place that the wrapper lacks has no text on any page of the host
        template = region.template[at] if take and least else ()
        for c in kids:
            if isinstance(c, str):
                if take:
                    line.append(c)
                    own = own or not template or bool((text := " ".join(c.split())) and _name(text) not in template)
                continue
            block = c.name not in INLINE
            if c.other or (c.name == "header" and not inside):
                end() if block else None
                continue
            if block:
                end()
            if c.name not in VOID:
                stack.append((iter(c.children), region.find(at, c.sign, c.name) if at >= 0 else -1, inside or c.name in ARTICLE, block))
                break
        else:
            if edge:
                end()
            stack.pop()
    end()
    return " ".join(blocks)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    common.prepare(pages.sparkSession)
    # A host of "" stands for none; the key is never null.
    keyed = pages.select("page_id", "url", "html", urlfilter.host_of(F.col("url")).alias("host"))

    def fold(batches):
        known: dict[str, Wrapper] = {}
        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if html:
                    known[host] = merged(known.get(host), wrapper_of(html))
                if len(known) > 5000:  # sent early, merged later
                    yield _rows(known)
                    known = {}
        if known:
            yield _rows(known)

    def _rows(known: dict[str, Wrapper]):
        return pa.RecordBatch.from_arrays([pa.array(list(known)), pa.array([w.dumps() for w in known.values()])], names=["host", "wrapper"])

    def each_host(batches):
        """(host, wrapper) of rows that are sorted by host."""
        at, held = None, None
        for batch in batches:
            for host, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if host != at and held is not None:
                    yield at, held
                    held = None
                at = host
                held = merged(held, Wrapper.loads(w))
        if held is not None:
            yield at, held

    def some(batches):
        for host, w in each_host(batches):
            yield _rows({host: w})

    def judge(batches):
        for host, w in each_host(batches):
            said = json.dumps(regions(w), separators=(",", ":"))
            yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([said]), pa.array([w.pages[0]], pa.int64())], names=["h", "region", "c"])

    partial = keyed.select("host", "html").mapInArrow(common.in_worker()(fold), "host string, wrapper string")
    # A host has a wrapper from each task at most; they are merged in two steps, the first one dealt by their contents.
    partial = partial.repartition("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))).sortWithinPartitions("host", "wrapper").mapInArrow(common.in_worker()(some), "host string, wrapper string")
    judged = common.stored(partial.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(common.in_worker()(judge), "h string, region string, c long"))
    met = _with_regions(keyed, judged).select("page_id", "url", "html", "region")
    types = {f.name: f.dataType.simpleString() for f in met.schema.fields}

    def apply(batches):
        read: dict[str, Region] = {}
        for batch in batches:
            texts = []
            for html, region in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if region is not None and region not in read:
                    if len(read) > 1000:
                        read.clear()
                    read[region] = Region(json.loads(region))
                texts.append(extract(html, read[region] if region is not None else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return met.mapInArrow(common.in_worker()(apply), f"page_id {types['page_id']}, url string, text string, n_chars long")


def _with_regions(keyed: DataFrame, judged: DataFrame) -> DataFrame:
    """keyed with its host's region. Hosts with many pages (fewer than common.HEAVY, of BROADCAST_CHARS at most) meet theirs by
    broadcast, so that their pages stay where they are; the others by a shuffle, a heavy one with a long region by SALTS copies of it."""
    total = judged.agg(F.sum("c")).first()[0] or 0
    hot = F.col("c") * common.HEAVY > total
    brief = F.length("region") <= BROADCAST_CHARS
    sent = judged.where(hot & brief).select("h", "region")
    rest = judged.where(~(hot & brief)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(hot, SALTS - 1).otherwise(0)))).select("h", "region", "salt")
    long = judged.where(hot & ~brief).select(F.col("h").alias("heavy"))
    first = keyed.join(F.broadcast(sent), F.col("host") == F.col("h")).drop("h")
    other = keyed.join(F.broadcast(sent.select("h")), F.col("host") == F.col("h"), "left_anti").join(F.broadcast(long), F.col("host") == F.col("heavy"), "left")
    other = other.withColumn("mine", F.when(F.col("heavy").isNotNull(), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).otherwise(0))
    other = other.join(rest, (F.col("host") == F.col("h")) & (F.col("mine") == F.col("salt")), "left").drop("h", "heavy", "mine", "salt")
    return first.unionByName(other)
