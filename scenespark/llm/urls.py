"""URL filters with redirect equivalence.

Rules match a host and its subdomains and a beginning of the path; the longest wins.
Pages that redirect to, or name as canonical, another URL are aliases of it: connected
components over those links carry block decisions to members that no rule covers. A
member's own rule always stands, and an allow rule of any member keeps the block of
another from spreading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut
from .components import components

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
_COMMENT = r"(?s)<!--.*?(?:-->|$)"
# A tag ends at the first > outside of quotes. An attribute's name stands by itself: data-href is none of these.
_TAG = r"""(?is)<{0}(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_VALUE = r"""(?is)(?<![\w-]){0}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>]+))"""
_TARGET = r"""(?is)^[^;,]*[;,]\s*url\s*=\s*["']?\s*([^"']+)"""
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"

#: (host, path beginning, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _without_dots(p: Column) -> Column:
    """A path that begins with / without its . and .. segments (RFC 3986, 5.2.4)."""
    parts = F.split(F.substring(p, 2, 1 << 30), "/", -1)
    step = lambda out, x: F.when(x == ".", out).when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, x))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def _scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def _site(url: Column) -> Column:
    """A URL's host without a port that its scheme implies."""
    default = F.when(_scheme(url) == "https", r":(?:443)?$").otherwise(r":(?:80)?$")
    return F.regexp_replace(host(url), default, F.lit(""))


def _place(url: Column) -> Column:
    """A URL's path, at least /, without dot segments."""
    p = path(url)
    return F.when(p == "", "/").when(p.contains("/."), _without_dots(p)).otherwise(p)


def _key(url: Column) -> Column:
    """A URL's node: host, path (at least /) and query; scheme, its own port and fragment make no difference. Null where there is no host."""
    return F.when(host(url) != "", F.concat(_site(url), _place(url), F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))))


def _absolute(base: Column, to: Column) -> Column:
    """A link's target by RFC 3986 (dot segments go in _key); null for schemes without a host, such as mailto."""
    to = F.trim(F.replace(to, F.lit("&amp;"), F.lit("&")))
    scheme = F.coalesce(F.nullif(_scheme(base), F.lit("")), F.lit("http"))
    site, folder = F.concat(scheme, F.lit("://"), host(base)), F.regexp_extract(path(base), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(to.rlike(_SCHEME + "//"), to).when(to.rlike(_SCHEME), F.lit(None)).when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(site, to)).when(to.startswith("?"), F.concat(site, path(base), to))
        .when(to.startswith("#") | (to == ""), base).otherwise(F.concat(site, folder, to))
    )


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, of either quoting; empty where it is missing."""
    pattern = _VALUE.replace("{0}", name)
    return F.concat(*[F.coalesce(F.regexp_extract(tag, pattern, i), F.lit("")) for i in (1, 2, 3)])


def alias_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, target) for every canonical link and refresh redirect to another node; a page without url has none.

    Comments are left out. rel is a list of words, of which one is canonical. Relative
    targets start from the page's base element, if it has one, else from its url.
    """
    tags = lambda name: F.regexp_extract_all("h", F.lit(_TAG.replace("{0}", name)), F.lit(0))
    words = lambda t: F.split(F.lower(F.trim(_attribute(t, "rel"))), r"\s+")
    canonical = F.transform(F.filter(tags("link"), lambda t: F.array_contains(words(t), "canonical")), lambda t: _attribute(t, "href"))
    refresh = F.filter(tags("meta"), lambda t: F.lower(F.trim(_attribute(t, "http-equiv"))) == "refresh")
    refresh = F.transform(refresh, lambda t: F.regexp_extract(_attribute(t, "content"), _TARGET, 1))
    found = F.filter(F.concat(canonical, refresh), lambda t: F.trim(t) != "")
    base = F.coalesce(F.get(F.filter(F.transform(tags("base"), lambda t: _attribute(t, "href")), lambda t: F.trim(t) != ""), F.lit(0)), F.lit(""))
    # Most pages have no such tag at all.
    rows = pages.where((host(F.col(url)) != "") & F.col(html).rlike("(?i)<(?:link|meta)")).select(F.col(url).alias("url"), F.regexp_replace(html, _COMMENT, "").alias("h"))
    rows = _fixed(rows.select("url", "h"), base=base, found=found).select("url", "base", F.explode("found").alias("to"))
    start = F.when(F.col("base") == "", F.col("url")).otherwise(F.coalesce(_absolute(F.col("url"), F.col("base")), F.col("url")))
    rows = _fixed(rows, start=start)
    rows = _fixed(rows, target=_absolute(F.col("start"), F.col("to"))).where("target IS NOT NULL")
    rows = _fixed(rows, a=_key(F.col("url")), b=_key(F.col("target")))
    return rows.where("b IS NOT NULL AND a <> b").select("url", "target")


def _fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row. The optimizer copies an expression to each place that uses it, and those of links nest; it does not look into a generator."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__made")
    return df.select("*", made).select(*df.columns, *[F.col("__made")[n].alias(n) for n in columns])


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for each distinct host and path that a rule fits.

    A place meets only the rules of its host and of the domains above it. Equal lengths:
    allow before block, then code point order.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("domain"), F.col("path").alias("start"), "verdict", F.concat("host", "path").alias("rule"))
    deepest = rules.agg(F.max(F.size(F.split("domain", r"\.")))).first()[0] or 0
    labels = F.split("host", r"\.")
    size = F.least(F.size(labels), F.lit(deepest))
    domains = F.transform(F.sequence(F.lit(1), size), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    rows = places.select("host", "path").distinct()
    if not deepest:
        return rows.where("false").select("host", "path", F.lit("").alias("rule"), F.lit("").alias("verdict"))
    rows = rows.select("host", "path", F.explode(domains).alias("domain")).join(rules, "domain").where(F.startswith("path", "start"))
    best = F.min(F.struct((-F.length("rule")).alias("size"), "verdict", "rule"))
    return rows.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame | list | None = None, url: str = "url", html: str | None = "html", default: str = "allow", links: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule and verdict.

    links: (source, target) urls of redirects that are known from elsewhere, such as a
    crawl's log; they count like the pages' own refresh and canonical links, and ends that
    are no page carry decisions on. html None: the pages' own links are not followed. A
    null url or one without :// has an empty host and path and meets no rule, and is
    nobody's alias. Repeated rows get equal results; of rules of equal length allow goes
    before block. Without rules every verdict is the default. Very long pages are read
    whole. An empty table gives an empty table. Columns of pages with the names of the new
    ones are replaced; others stay.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(RULES if rules is None else rules, "host string, path string, verdict string")
    new = ["host", "path", "rule", "verdict"]
    u = F.col(url)
    rows = pages.drop(*[c for c in new if c not in (url, html)]).withColumn("host", host(u)).withColumn("path", path(u))
    ruled = match_rules(rows, rules)
    edges = None if html is None else alias_links(pages, url, html)
    if links is not None:
        given = _fixed(links.select(F.col("source").alias("url"), "target"), a=_key(F.col("url")), b=_key(F.col("target"))).where("a <> b").select("url", "target")
        edges = given if edges is None else edges.unionByName(given)
    if edges is None:
        return rows.join(ruled, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    edges = cut(_fixed(edges.select("url", "target").distinct(), a=_key(F.col("url")), b=_key(F.col("target"))), "url_links")
    comp = cut(components(edges, "a", "b"), "url_components")
    ends = edges.select(F.col("a").alias("node"), F.col("url").alias("u")).unionByName(edges.select(F.col("b").alias("node"), F.col("target").alias("u")))
    # A page is ruled by its url as it stands, and each end by its node as well.
    plain = ends.select("node", host(F.col("u")).alias("host"), path(F.col("u")).alias("path"))
    ends = plain.unionByName(ends.select("node", _site(F.col("u")).alias("host"), _place(F.col("u")).alias("path"))).distinct()
    said = ends.join(match_rules(ends, rules), ["host", "path"]).join(comp, "node")
    said = said.groupBy("component").agg(F.when(F.bool_or(F.col("verdict") == "allow"), "allow").otherwise("block").alias("spread"))
    spread = comp.join(said, "component").select(F.col("node").alias("__key"), "spread")
    rows = rows.withColumn("__key", _key(u)).join(spread, "__key", "left").drop("__key").join(ruled, ["host", "path"], "left")
    return rows.withColumn("verdict", F.coalesce("verdict", "spread", F.lit(default))).drop("spread")
