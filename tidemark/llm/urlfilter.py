"""URL filters with redirect equivalence (operator 6), in DataFrame operations only.

Rules name a host (and so its subdomains) and a path prefix; of the rules that fit a url the longest
wins, of equally long ones the one with the longer host, and on equal rules allow comes before block.
Urls without a rule take the decision of their aliases: urls are nodes, redirects and canonical links
are edges, and connected components carry decisions. A component with an explicit allow is allowed;
else, with a block, it is blocked; else it is allowed.

Canonical links and immediate refreshes are read from the pages; further redirects may be given as a
table (src, dst). Relative targets are resolved against the page's scheme and host. A url's node is its
lower-cased host, path and query without fragment, so http and https are one.

A null url, or one without "://", has empty host and path and fits no rule; it has no aliases and is
allowed. Empty and null pages have no links. Repeated rows get the same verdict each. Extra columns
don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Host, path prefix and verdict. A host without dots is a suffix like any other.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: So many rules are a literal of the plan at most; they are a list of the program, so this bound is proven.
MOST_RULES = 10_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Host, path and query, without a fragment; null if there is no "://"."""
    tail = F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^#]*)", 1)
    rooted = _let(tail, lambda t: F.when((t == "") | F.startswith(t, F.lit("?")), F.concat(F.lit("/"), t)).otherwise(t))
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), rooted))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(host, path, verdict) of the rule that wins, or null. Looks up each suffix of the host in a literal map."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; the bound is {MOST_RULES}")
    if not rules:
        return F.lit(None).cast("struct<size:int,of_host:int,allow:int,host:string,path:string,verdict:string>")
    by_host: dict[str, list] = {}
    for h, p, v in rules:
        if v not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks, not {v!r}")
        by_host.setdefault(h.lower(), []).append((p, v))
    entry = lambda h, p, v: F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(len(h)).alias("of_host"), F.lit(int(v == "allow")).alias("allow"), F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict"))
    table = F.create_map(*(x for h, found in by_host.items() for x in (F.lit(h), F.array(*(entry(h, p, v) for p, v in found)))))
    suffixes = _let(F.split(host, r"\."), lambda labels: F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    fitting = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    return F.when(host != "", _let(path, lambda p: F.array_max(F.filter(fitting, lambda r: F.startswith(p, r["path"])))))


def _target(url: Column, href: Column) -> Column:
    """The absolute form of a link of a page."""
    scheme = F.concat(F.regexp_extract(url, "^([^:/?#]*)://", 1), F.lit(":"))
    site = F.concat(scheme, F.lit("//"), host_of(url))
    folder = F.regexp_extract(F.when(path_of(url) == "", "/").otherwise(path_of(url)), "(?s)^(.*/)", 1)
    return (
        F.when((href == "") | href.isNull(), None)
        .when(F.instr(href, "://") > 0, href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")), F.concat(site, href))
        .when(F.startswith(href, F.lit("#")) | href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(site, folder, href))
    )


_QUOTED = r"""\s*=\s*["']?\s*([^"'\s>]+)"""


def links(pages: DataFrame) -> DataFrame:
    """(src, dst): the nodes that canonical links and refreshes of pages (url, html) join."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)(<(?:link|meta)\b[^>]*+(?:>|\z))"), 1)  # an open tag ends with the page, so no start is read twice
    tag = pages.where("url IS NOT NULL AND html IS NOT NULL").select("url", F.explode(F.filter(tags, lambda t: F.endswith(t, F.lit(">")) & t.rlike(r"(?i)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b|http-equiv\s*=\s*[\"']?\s*refresh|property\s*=\s*[\"']?og:url"))).alias("tag"))
    href = (
        F.when(F.col("tag").rlike("(?i)canonical"), F.regexp_extract("tag", r"(?is)\bhref" + _QUOTED, 1))
        .when(F.col("tag").rlike("(?i)refresh"), F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
        .otherwise(F.regexp_extract("tag", r"(?is)\bcontent" + _QUOTED, 1))
    )
    href = F.replace(href, F.lit("&amp;"), F.lit("&"))
    return tag.select(node_of(F.col("url")).alias("src"), node_of(_target(F.col("url"), href)).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def verdicts(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict, by ("rule", "alias" or "default") of every row of pages."""
    common.prepare(pages.sparkSession)
    split = F.struct(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    judged = _let(split, lambda x: F.struct(x["host"].alias("host"), x["path"].alias("path"), x["node"].alias("node"), matched_rule(x["host"], x["path"], rules).alias("r")))
    rows = pages.select("page_id", "url", judged.alias("x")).select("page_id", "url", "x.*")
    edges = links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL"))
    edges = common.stored(edges.where("src <> dst"))
    rule = F.concat(F.col("r.host"), F.col("r.path"))
    own = F.col("r.verdict")
    out = ("page_id", "url", "host", "path", "rule", "verdict", "by")
    if edges.isEmpty():
        return rows.withColumn("rule", rule).withColumn("verdict", F.coalesce(own, F.lit("allow"))).withColumn("by", F.when(own.isNotNull(), "rule").otherwise("default")).select(*out)
    groups = common.stored(common.components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))))
    # A node's own decision follows from its name: the rules apply to targets that are no pages, too.
    decided = groups.withColumn("host", F.regexp_extract("node", "^([^/]*)", 1)).withColumn("path", F.regexp_extract("node", "^[^/]*([^?]*)", 1))
    decided = decided.withColumn("own", matched_rule(F.col("host"), F.col("path"), rules)["verdict"])
    said = decided.groupBy("component").agg(F.max(F.when(F.col("own") == "allow", 1)).alias("a"), F.max(F.when(F.col("own") == "block", 1)).alias("b"))
    said = said.select("component", F.when(F.col("a") == 1, "allow").when(F.col("b") == 1, "block").alias("alias"))
    by_node = groups.join(said.where("alias IS NOT NULL"), "component").select("node", "alias")
    rows = rows.join(by_node, "node", "left")
    return (
        rows.withColumn("rule", rule)
        .withColumn("verdict", F.coalesce(own, F.col("alias"), F.lit("allow")))
        .withColumn("by", F.when(own.isNotNull(), "rule").when(F.col("alias").isNotNull(), "alias").otherwise("default"))
        .select(*out)
    )
