"""URL filters: rules by host and path, carried to aliases through redirects and canonical links.

Pages that redirect to one another, or name a canonical address, are one class: the connected
components of the graph of addresses. A page that a rule fits keeps the rule's verdict. Any other
page takes its class's: allow if a page of the class is explicitly allowed, else block if one is
blocked, else allow.

Defined results: a null address, or one without ://, has an empty host and path, no rule fits it and
it is allowed; repeated addresses share a class, and rows that repeat an id are judged each for itself;
an empty table gives an empty result; a page without html has no outgoing edge; of a page that names
several targets all count; an allow and a block in one class give allow; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.components import components
from tidewater.session import Scratch

#: The rules (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A whole tag: its text ends at the next bracket, so all tags of a page are found in one pass.
LINK, META = r"(?i)<link\b([^<>]*+)>", r"(?i)<meta\b([^<>]*+)>"
TARGET = r"""(?i)\burl\s*=\s*["']?([^"'\s>;]+)"""


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _node(url: Column) -> Column:
    """An address without its fragment, scheme and host in lower case."""
    at = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(at, r"(?s)^([^/?#]*://[^/?#]*)", 1)
    return F.concat(F.lower(head), F.substring(at, F.length(head) + 1, F.length(at)))


def _resolved(link: Column, url: Column) -> Column:
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    origin = F.regexp_extract(url, r"(?s)^([^/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^([^/?#]*://[^/?#]*/(?:[^?#]*/)?)", 1)
    return (
        F.when(F.instr(link, "://") > 0, link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^([^/?#]*:)//", 1), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder), link))
    )


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, quoted or not; empty if there is none."""
    got = [F.regexp_extract(tag, rf"""(?i)(?:^|[\s"'/]){name}\s*=\s*{form}""", 1) for form in ('"([^"]*)"', "'([^']*)'", r"""([^\s"'>][^\s>]*)""")]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in got], F.lit(""))


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target) addresses of the canonical and redirect edges that pages' html names: of every link tag and every meta tag."""
    tags = lambda pattern: F.coalesce(F.regexp_extract_all(F.col(html_col), F.lit(pattern), F.lit(1)), F.array().cast("array<string>"))
    named = lambda word, found: F.when(F.instr(F.lower(html_col), word) > 0, found).otherwise(F.array().cast("array<string>"))
    canonical = F.filter(tags(LINK), lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    refresh = F.filter(tags(META), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    found = F.concat(named("canonical", F.transform(canonical, lambda t: _attribute(t, "href"))), named("refresh", F.transform(refresh, lambda t: F.regexp_extract(_attribute(t, "content"), TARGET, 1))))
    some = pages.where(F.col(url_col).contains("://")).select(F.col(url_col).alias("source"), F.explode(found).alias("link"))
    return some.where("link <> ''").select("source", _resolved(F.col("link"), F.col("source")).alias("target"))


def judge(pages: DataFrame, edges: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, host, path, rule, verdict. edges(source, target): further redirects; default: none."""
    scratch = Scratch(pages.sparkSession, "url-filter")
    found = links(pages, url_col, html_col)
    found = found if edges is None else found.unionByName(edges.select("source", "target"))
    pairs = found.select(_node(F.col("source")).alias("source"), _node(F.col("target")).alias("target")).where("source <> target").distinct()
    pairs = scratch.keep(pairs, "pairs")
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    judged = urls.withColumn("own", rule(F.col("host"), F.col("path"), rules))
    code = lambda c: F.xxhash64(F.lit("node"), c)
    cc = scratch.keep(components(pairs.select(code("source").alias("u"), code("target").alias("v")), scratch, "round"), "cc")
    scratch.clear("pairs", "cc")
    nodes = pairs.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("code", code("node"))
    nodes = nodes.join(cc.withColumnRenamed("node", "code"), "code", "left").select("node", F.coalesce("component", "code").alias("component"))
    ruled = nodes.withColumn("v", rule(host(F.col("node")), path(F.col("node")), rules)["verdict"]).where("v is not null").groupBy("component").agg(F.max(F.col("v") == "allow").alias("any_allow"))
    known = nodes.join(ruled, "component").select("node", F.when(F.col("any_allow"), "allow").otherwise("block").alias("carried"))
    out = judged.withColumn("node", _node(F.col("url"))).join(known, "node", "left")
    return out.select("id", "host", "path", "own.rule", F.coalesce("own.verdict", "carried", F.lit("allow")).alias("verdict"))
