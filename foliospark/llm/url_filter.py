"""URL filtering with block decisions spread over redirect-equivalent aliases; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import checkpoint, only
from foliospark.llm.components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host and path of what follows the first ://
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Addresses of canonical links and of refresh redirects, in either order of their attributes, and of the base element.
CANONICAL = (r"""(?is)<link\b[^>]*?\brel\s*=\s*["']?canonical\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""", r"""(?is)<link\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)[^>]*?\brel\s*=\s*["']?canonical\b""")
REFRESH = (r"""(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["']?refresh\b[^>]*?\burl\s*=\s*["']?([^"'\s>]+)""", r"""(?is)<meta\b[^>]*?\burl\s*=\s*["']?([^"'\s>]+)[^>]*?\bhttp-equiv\s*=\s*["']?refresh\b""")
#: Such elements up to the next angle bracket, so that an unclosed one is read only as far as the next begins.
TAG = r"(?i)<(?:link|meta)\b[^<>]*"
BASE = r"""(?is)<base\b[^<>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """A decision for a host with all its subdomains, below a path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Host after the first ``://``, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def url_key(url: Column) -> Column:
    """What names a page: host, path and query, without scheme and fragment; null without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def without_dots(path: Column) -> Column:
    """An absolute path without its ``.`` and ``..`` segments."""
    kept = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(part))),
    )
    plain = F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"/\.\.?(/|$)"), plain).otherwise(path)


def resolve(base: Column, target: Column) -> Column:
    """The url a link on page ``base`` leads to; null for a fragment of the page itself and for schemes without ``//``."""
    host = F.regexp_extract(base, _PARTS, 1)
    path = path_of(base)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"(?s)^/?(.*/)?[^/]*$", 1))
    rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    own = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    on_host = lambda p: F.concat(F.lit("x://"), host, p)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(F.lit("x:"), target))
        .when((target == "") | target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(~base.contains("://"), F.lit(None).cast("string"))
        .when(target.startswith("?"), on_host(F.concat(F.when(path == "", F.lit("/")).otherwise(path), target)))
        .when(target.startswith("/"), on_host(F.concat(without_dots(own), rest))).otherwise(on_host(F.concat(without_dots(F.concat(folder, own)), rest)))
    )


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct (name, verdict); null if none does."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Edges (u, v) between url keys: all canonical links and refresh redirects of pages, and ``redirects(source, target)``.

    Targets are resolved against the page's url, or its base element, and redirects against their source.
    """
    of_tag = lambda tag: F.array(*[F.regexp_extract(tag, p, 1) for p in (*CANONICAL, *REFRESH)])
    links = F.filter(F.flatten(F.transform(F.regexp_extract_all("html", F.lit(TAG), F.lit(0)), of_tag)), lambda x: x != "")
    within = F.regexp_extract("html", BASE, 1)
    base = F.when(within == "", F.col("url")).otherwise(F.coalesce(resolve(F.col("url"), within), F.col("url")))
    marked = F.coalesce(F.col("html").rlike(r"(?i)\bcanonical\b|http-equiv"), F.lit(False))
    found = only(pages, "url", "html").where(marked).select("url", base.alias("base"), F.explode(links).alias("to")).select(url_key(F.col("url")).alias("u"), url_key(resolve(F.col("base"), F.col("to"))).alias("v"))
    if redirects is not None:
        found = found.union(only(redirects, "source", "target").select(url_key(F.col("source")).alias("u"), url_key(resolve(F.col("source"), F.col("target"))).alias("v")))
    return found.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...], redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A url with a rule of its own gets that rule's verdict. Any other url is an alias of all urls in its
    component of canonical-link and redirect edges: an explicit allow of one of them allows it; else a block of one of them blocks
    it; else it is allowed. Decisions are made on all nodes of the graph, pages or not. Null urls and
    urls without ``://`` have empty host and path, fit no rule and have no alias, so they are allowed. Repeated rows get equal
    verdicts; null html has no edges. Extra columns are ignored; an empty table gives no rows.

    Only edges are shuffled until the last join; a component with a third of all urls is aggregated map-side first.
    """
    edges = checkpoint(alias_edges(pages, redirects))
    own = only(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), url_key(F.col("url")).alias("key"))
    own = own.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    if edges.isEmpty():
        spread = own.withColumn("alias", F.lit(None).cast("string"))
    else:
        nodes = connected_components(edges)
        url = F.concat(F.lit("x://"), "node")
        ruled = nodes.withColumn("verdict", matching_rule(host_of(url), path_of(url), rules)["verdict"])
        decided = ruled.groupBy("component").agg(F.max(F.when(F.col("verdict") == "allow", F.lit("allow"))).alias("a"), F.max(F.when(F.col("verdict") == "block", F.lit("block"))).alias("b"))
        spread = own.join(nodes.join(decided, "component").select(F.col("node").alias("key"), F.coalesce("a", "b").alias("alias")), "key", "left")
    return spread.select("page_id", "host", "path", F.col("fit.name").alias("rule"), F.coalesce("fit.verdict", "alias", F.lit("allow")).alias("verdict"))
