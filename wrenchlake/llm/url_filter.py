"""URL filters by rule and by redirect equivalence, in DataFrame operations only.

A rule names a host and a path prefix, fits the host and its subdomains, and allows or blocks; the longest fitting rule wins
(by host, then by path; of equal ones an allow rule).  URLs that no rule fits take the verdict of their aliases: redirect and
canonical-link edges join URLs into components, a component with an allowed member is allowed, else one with a blocked member
is blocked, else it is allowed (explicit allow takes precedence).

The pages' own edges are rel=canonical links, meta-refresh targets and og:url entries of the html, resolved against the page's
URL.  URLs are compared without fragment, with scheme and host in lower case.  ``mirrors=True`` also makes URLs equal that
differ in scheme, query, a ``www.`` or ``m.`` label, ``.html`` or a last slash; no redirect or link says so, hence it is off.

Defined results: a null url or one without ``://`` has empty host and path, no rule, no alias, and is allowed; equal urls share
their verdict; an empty path and "/" are one URL, so where a rule fits the second only, the first takes its verdict as an alias,
whatever other pages link to; null html adds no edge; an empty table gives an empty table; rules are checked to be few (``MAX_RULES``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import components, stored

MAX_RULES = 1_000
#: host, path, verdict
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return lowered(F.regexp_extract(rest_of(url), r"(?s)^([^/?#]*)", 1))


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def rest_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def ruled(urls: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds rule and ruling (null where no rule fits) to rows with host and path."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    best = sorted(rules, key=lambda r: (-len(r[0]), -len(r[1]), r[2]))
    rule = verdict = F.lit(None).cast("string")
    for host, path, what in reversed(best):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return urls.withColumn("rule", rule).withColumn("ruling", verdict)


def address(url: Column) -> Column:
    """The URL by which pages and link targets are compared; null without ``://``."""
    scheme = lowered(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    query = F.regexp_extract(rest_of(url), r"(?s)^[^?#]*(\?[^#]*)", 1)
    path = F.coalesce(F.nullif(path_of(url), F.lit("")), F.lit("/"))
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), path, query))


def resolved(target: Column, page: Column) -> Column:
    """A link's target as a full URL; null for an empty one, a bare fragment, and other schemes than hierarchical ones."""
    scheme = F.regexp_extract(page, r"(?s)^(.*?)://", 1)
    top = F.concat(scheme, F.lit("://"), F.regexp_extract(rest_of(page), r"(?s)^([^/?#]*)", 1))
    folder = F.concat(F.regexp_extract(path_of(page), r"(?s)^(.*)/", 1), F.lit("/"))
    tail = F.regexp_extract(target, r"(?s)^[^?#]*(.*)", 1)
    return (
        F.when((target == "") | target.startswith("#") | F.isnull(page) | (F.instr(page, "://") == 0), None)
        .when(F.regexp_like(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), target)
        .when(F.regexp_like(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(top, without_dots(F.regexp_extract(target, r"(?s)^([^?#]*)", 1)), tail))
        .when(target.startswith("?"), F.concat(top, path_of(page), target))
        .otherwise(F.concat(top, without_dots(F.concat(folder, F.regexp_extract(target, r"(?s)^([^?#]*)", 1))), tail))
    )


def without_dots(path: Column) -> Column:
    """A path that starts with a slash, its segments ``.`` and ``..`` resolved."""
    step = lambda acc, s: F.when(s == "..", F.regexp_replace(acc, r"/[^/]*$", "")).when(s == ".", acc).otherwise(F.concat(acc, F.lit("/"), s))
    done = F.aggregate(F.slice(F.split(path, "/"), 2, F.length(path) + 1), F.lit(""), step)
    return F.when(F.regexp_like(path, F.lit(r"/\.\.?$")), F.concat(done, F.lit("/"))).otherwise(done)


def plain_form(url: Column) -> Column:
    """The URL without what mirrors of a page differ in; null without ``://``."""
    host = F.regexp_replace(host_of(url), r"^((www|m)\.)+", "")
    path = F.regexp_replace(path_of(url), r"(\.html?|/)+$", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path))


def page_edges(pages: DataFrame, form=address) -> DataFrame:
    """(a, b): the forms of each URL and of the redirect and canonical targets in its html."""
    tags = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    says = lambda t, pattern: F.regexp_like(t, F.lit("(?is)" + pattern))
    target = F.transform(
        tags,
        lambda t: F.when(says(t, CANONICAL), F.regexp_extract(t, "(?is)" + HREF, 1)).when(says(t, REFRESH), F.regexp_extract(t, "(?is)" + REFRESHED, 1)).when(says(t, OG_URL), F.regexp_extract(t, "(?is)" + CONTENT, 1)).otherwise(""),
    )
    linked = pages.where("url IS NOT NULL").select("url", F.explode(F.filter(target, lambda t: t != "")).alias("t"))
    return linked.select(form(F.col("url")).alias("a"), form(resolved(F.col("t"), F.col("url"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")


CANONICAL, REFRESH, OG_URL = r"^<link\b.*\brel\s*=\s*[\"']?canonical", r"^<meta\b.*http-equiv\s*=\s*[\"']?refresh", r"^<meta\b.*property\s*=\s*[\"']?og:url"
HREF, CONTENT = r"\bhref\s*=\s*[\"']?\s*([^\"'>\s]*)", r"\bcontent\s*=\s*[\"']?\s*([^\"'>\s]*)"
REFRESHED = r"\bcontent\s*=\s*[\"']?\s*[0-9.]*\s*[;,]\s*(?:url\s*=\s*)?[\"']?\s*([^\"'>\s]*)"


def url_verdicts(pages: DataFrame, edges: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES, mirrors: bool = False) -> DataFrame:
    """page_id, host, path, rule and verdict of each page.

    ``edges``: further redirect or canonical links (a, b) as full URLs.  Pages of one form are one node, so a component is the
    set of forms that links join; only those with a link go through the rounds of ``components``.
    """
    form = plain_form if mirrors else address
    links = page_edges(pages, form)
    if edges is not None:
        links = links.union(edges.select(form(F.col("a")), form(F.col("b"))).toDF("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b"))
    url = F.col("url")
    judged = ruled(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), form(url).alias("form")), rules)
    judged = judged.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    links = stored(links.distinct(), "edges")
    # An empty path and "/" are one form, but a rule may fit the second only; all other URLs of one form have one rule.
    mixed = F.col("path").isin("", "/") | F.lit(mirrors)
    if links.isEmpty():
        parts = judged.withColumns({"part": F.col("form"), "shared": mixed})
    else:
        groups = stored(components(links).select(F.col("node").alias("form"), F.col("component").alias("part")), "groups")
        shared = F.col("part").isNotNull() | mixed
        parts = judged.join(groups, "form", "left").withColumns({"part": F.coalesce("part", "form"), "shared": shared})
    # Decisions are combined on the map side, so a hot component is a few rows by the time it is shuffled.
    decisions = stored(
        parts.where("ruling IS NOT NULL AND part IS NOT NULL AND shared").groupBy("part").agg(F.min(F.when(F.col("ruling") == "allow", 0).otherwise(1)).alias("least")),
        "decisions",
    )
    alias = F.when(F.col("least") == 1, F.lit("block")).otherwise(F.lit("allow"))
    return parts.join(decisions, "part", "left").select("page_id", "host", "path", "rule", F.coalesce("ruling", alias).alias("verdict"))


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
