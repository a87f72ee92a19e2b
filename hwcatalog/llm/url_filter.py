"""URL filters over redirect equivalence.

Rules name a host and a path; the longest that fits a url decides. A url that no rule fits takes the
decision of its aliases: redirect and canonical-link edges join urls into components, and a component
with an explicit allow is allowed, one with a block and no allow is blocked. Urls that differ only in the case of
scheme and host, a default port, a fragment or an empty path are one node.
"""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut

AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tags that name another address of the same page (canonical links, refreshes) or the base that such addresses are relative to.
TAG = re.compile(r"<(link|meta|base)(?=[\s/])", re.I)
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
TAG_END = re.compile(r"[\s/]*>")
REFERENCE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);?|[A-Za-z][A-Za-z0-9]*;?)")
#: The address in a refresh's content: all that follows the seconds and ``url=``.
REFRESH = re.compile(r"\s*+(?:[\d.]++(?:\s*+[;,]\s*+|\s++)(?:url\s*+=\s*+)?+|(?:[;,]\s*+)?url\s*+=\s*+)(.+)", re.I | re.S)
#: What is no markup of the page: comments, and scripts and styles with what they hold.
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|template)(?=[\s>/]).*?(?:</\1\s*>|\Z)", re.I | re.S)
ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")


def host_and_path(url):
    """(host, path) columns of a url column: host after the first ``://``, A-Z lower-cased; both empty without ``://`` or for null."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), AZ, az)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return host, path


def node(url):
    """The name of a url column's node: scheme and host in lower case, no default port, no fragment, at least the path ``/``."""
    whole = F.regexp_extract(url, r"(?s)^([^:/?#]+)://([^/?#]*)([^#]*)", 0)
    part = lambda i: F.regexp_extract(url, r"(?s)^([^:/?#]+)://([^/?#]*)([^#]*)", i)
    scheme, rest = F.lower(part(1)), part(3)
    host = F.regexp_replace(F.lower(part(2)), F.when(scheme == "http", ":80$").when(scheme == "https", ":443$").otherwise("(?!)"), F.lit(""))
    return F.when(whole == "", url).otherwise(F.concat(scheme, F.lit("://"), host, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def decoded(value: str) -> str:
    """An attribute's value with its character references decoded; ``&name`` without ``;`` stays before ``=``, as in ``?a=1&copy=2``."""

    def one(m: re.Match) -> str:
        name = m[0][1:]
        if name[0] == "#" or (name in html5 and (name[-1] == ";" or value[m.end() : m.end() + 1] != "=")):
            return unescape(m[0])
        return m[0]

    return REFERENCE.sub(one, value)


def attributes(html: str, at: int) -> dict[str, str]:
    """The attributes of the tag whose name ends at ``at``, the first of equal names; none if the tag doesn't end."""
    out: dict[str, str] = {}
    while m := ATTRIBUTE.match(html, at):
        out.setdefault(m[1].lower(), decoded(m[2] or m[3] or m[4] or ""))
        at = m.end()
    return out if TAG_END.match(html, at) else {}


def resolved(base: str, target: str) -> str | None:
    """A target as an address: absolute ones as they are, others relative to ``base``; None if that gives none."""
    target = target.strip(" \t\n\r\f").translate({9: None, 10: None, 13: None})
    if ABSOLUTE.match(target):
        return target
    try:
        out = urljoin(base, target)
    except ValueError:
        return None
    return out if ABSOLUTE.match(out) else None


def targets(url: str, html: str) -> list[str]:
    """The addresses that a page's canonical links and refreshes name, each once."""
    base, found, html = None, [], HIDDEN.sub("", html)
    for tag in TAG.finditer(html):
        a, name = attributes(html, tag.end()), tag[1].lower()
        if name == "base":
            if base is None and "href" in a:
                base = resolved(url, a["href"])
        elif name == "link":
            if "canonical" in a.get("rel", "").lower().split() and a.get("href", "").strip():
                found.append(a["href"])
        elif a.get("http-equiv", "").strip().lower() == "refresh" and (m := REFRESH.match(a.get("content", ""))):
            t = m[1]
            found.append(t[1:].split(t[0], 1)[0] if t[0] in "\"'" else t)
    return list(dict.fromkeys(v for t in found if (v := resolved(base or url, t))))


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v) between a page's url and the addresses that its canonical link or refresh names, relative ones resolved."""
    marked = pages.where(F.col(url).isNotNull() & F.col(html).rlike(r"(?i)canonical|refresh")).select(F.col(url).cast("string"), F.col(html).cast("string"))

    def run(batches):
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            hits = [(u, v) for u, h in rows for v in targets(u, h) if u != v]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in hits], pa.string()) for i in (0, 1)], names=["u", "v"])

    return marked.mapInArrow(run, "u string, v string")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (key, host, path) with the longest fitting rule: key, rule, action; urls without one are left out.

    A rule (host, path, action) fits its host and all subdomains if the path starts with its path. Each url is looked up by
    the suffixes of its host, an equi-join, so the rule list may be of any size. Of equal rules allow goes first.
    """
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    probes = urls.select("key", "path", F.explode(suffix).alias("h"))
    r = rules.select(F.col("host").alias("h"), F.col("path").alias("rp"), "action")
    hits = probes.join(r, "h").where(F.expr("startswith(path, rp)"))
    rule = F.concat("h", "rp")
    best = hits.groupBy("key").agg(F.max(F.struct(F.length(rule).alias("n"), (F.col("action") == "allow").alias("a"), rule.alias("rule"))).alias("b"))
    return best.select("key", F.col("b.rule").alias("rule"), F.when(F.col("b.a"), "allow").otherwise("block").alias("action"))


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict per row of ``pages`` (page_id, url, html).

    ``rules`` has host, path and action (allow or block); ``edges`` (u, v: urls that redirect or point to each other) are added
    to those found in the pages' html. A url's own rule decides; without one, an explicit allow among its aliases, then
    a block, then ``default``. Other spellings of an address are aliases of it, with or without links. Aliases may be urls that have no page. Null urls and such without ``://`` have empty host and path
    and fit no rule. Repeated rows get equal verdicts. Other columns are ignored.
    """
    found = page_edges(pages)
    if edges is not None:
        found = found.union(edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    comps = connected_components(cut(found.select(node(F.col("u")).alias("u"), node(F.col("v")).alias("v")), "urls"))
    host, path = host_and_path(F.col("url"))
    match = lambda urls: match_rules(urls.distinct().select(F.col("url").alias("key"), host.alias("host"), path.alias("path")), rules)
    ruled = cut(match(rows.select("url").where("url IS NOT NULL")), "ruled")
    # an address that no link leads to is a class of its own, whatever its spellings
    alone = rows.where("url IS NOT NULL").join(ruled.select(F.col("key").alias("url")), "url", "left_anti").select(node(F.col("url")).alias("node")).distinct()
    comps = comps.union(alone.join(comps, "node", "left_anti").select("node", F.col("node").alias("comp")))
    nodes = match(comps.select(F.col("node").alias("url")))
    voted = comps.join(nodes, comps.node == nodes.key, "left").groupBy("comp").agg(F.max((F.col("action") == "allow").cast("int")).alias("a"), F.max((F.col("action") == "block").cast("int")).alias("b"))
    inherited = comps.join(voted, "comp").select(F.col("node").alias("_n"), F.when(F.col("a") == 1, "allow").when(F.col("b") == 1, "block").alias("alias_action"))
    out = rows.join(ruled.withColumnRenamed("key", "_u"), F.col("url") == F.col("_u"), "left").join(inherited, node(F.col("url")) == F.col("_n"), "left")
    return out.select("page_id", host.alias("host"), path.alias("path"), "rule", F.coalesce("action", "alias_action", F.lit(default)).alias("verdict"))
