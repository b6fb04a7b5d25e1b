"""Operator 7: URL filters over redirect equivalence.

A page's own rule decides where one fits. Pages that redirect to each other or name each
other as canonical form a class (distributed connected components); a page that no rule fits
takes the class's decision: allow if a member is explicitly allowed, else block if a member
is blocked, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.plans.graph import components
from skein.sources.scratch import materialize

#: Fixed values of the contract: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: Tags that may name a target, and the value of an attribute in one.
TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
VALUE = r"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
#: Target in the content of an immediate refresh.
REFRESH = r"""(?is)^\s*\d+(?:\.\d*)?\s*[;,]\s*(?:url\s*=\s*)?["']?([^"'\s]+)"""
#: Character references that occur in urls.
ENTITIES = {"&quot;": '"', "&#34;": '"', "&apos;": "'", "&#39;": "'", "&lt;": "<", "&gt;": ">", "&#x2f;": "/", "&#x2F;": "/", "&#47;": "/", "&#38;": "&", "&#x26;": "&", "&amp;": "&"}


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def own_rule(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages(id, host, path)`` with ``rule`` and ``own`` (verdict) of the longest fitting rule; null if none fits.

    A url meets a rule on the host or one of its parent domains, then on the start of its path.
    """
    spots = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    domain = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    rules = rules.select(F.col("host").alias("domain"), F.col("path").alias("start"), F.col("verdict").alias("own"))
    met = spots.select("host", "path", domain.alias("domain")).join(rules, "domain").where(F.expr("startswith(path, start)"))
    rule = F.concat("domain", "start")
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), F.col("own"), rule.alias("rule"))).alias("m"))
    return pages.join(best.select("host", "path", "m.rule", "m.own"), ["host", "path"], "left")


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, however it is quoted; empty if the tag has none."""
    pattern = VALUE.replace("{name}", name)
    found = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    for reference, character in ENTITIES.items():
        found = F.replace(found, F.lit(reference), F.lit(character))
    return F.trim(found)


def resolved(target: Column, base: Column) -> Column:
    """``target`` as a whole url: with the scheme, host or folder of ``base`` where it has none of its own; null if it names no other page."""
    scheme = F.regexp_extract(base, r"^([^/?#]*)://", 1)
    site = F.regexp_extract(base, r"^([^/?#]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[^/?#]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    own, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    whole = F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    # Dot segments: "." goes, ".." takes the segment before it along.
    up = lambda kept, s: F.when(s == ".", kept).when((s == "..") & (F.size(kept) > 1), F.slice(kept, 1, F.size(kept) - 1)).when(s == "..", kept).otherwise(F.concat(kept, F.array(s)))
    plain = F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), up), "/")
    plain = F.when(whole.rlike(r"/\.\.?$"), F.concat(plain, F.lit("/"))).otherwise(plain)
    within = F.when(own == "", F.concat(site, path, rest)).otherwise(F.concat(site, plain, rest))
    return (
        F.when(target.rlike("^[^/?#]*://"), target)
        .when((target == "") | target.startswith("#") | target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (site == ""), None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .otherwise(within)
    )


def links(pages: DataFrame) -> DataFrame:
    """``(a, b)``: url and each url that it redirects to or names as canonical, if its html says so.

    All link and meta tags count, their attributes in any order; relative targets are taken
    from the page's own url.
    """
    marked = pages.where(F.col("html").rlike("(?i)canonical|http-equiv")).select("url", F.explode(F.regexp_extract_all("html", F.lit(TAGS), F.lit(0))).alias("tag"))
    canonical = F.when(F.array_contains(F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+"), "canonical"), _attribute(F.col("tag"), "href"))
    refresh = F.when(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh", F.regexp_extract(_attribute(F.col("tag"), "content"), REFRESH, 1))
    said = marked.select(F.col("url").alias("a"), F.coalesce(canonical, refresh).alias("target")).where("target <> ''")
    return said.select("a", resolved(F.col("target"), F.col("a")).alias("b")).where("b IS NOT NULL")


def judge(pages: DataFrame, rules: DataFrame | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, alias_of`` of each row of ``pages``.

    ``redirects(a, b)`` are more edges between urls, as from a crawl log. ``alias_of`` is the
    smallest url of the page's class (its own if nothing points to or from it). Null urls
    have an empty host and path, no rule and no class; repeated rows give a row each; of equally
    long rules that fit, block wins; html of any length is read whole; other columns are not
    used; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    if rules is None:
        rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    own = {c.lower() for c in pages.columns}
    pages = pages.select("page_id", "url", F.col("html") if "html" in own else F.lit(None).cast("string").alias("html"))
    edges = links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select("a", "b"))
    classes = components(edges)
    host, path = host_path(F.col("url"))
    judged = own_rule(pages.select("page_id", "url", host.alias("host"), path.alias("path")), rules)
    classes = materialize(classes)
    if classes.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"), F.col("url").alias("alias_of"))
    # Targets that are no page have a say too: their own rule counts.
    ends = classes.select(F.col("id").alias("url"), "component")
    nodes = own_rule(ends.select("component", host_path(F.col("url"))[0].alias("host"), host_path(F.col("url"))[1].alias("path")), rules)
    said = nodes.groupBy("component").agg(F.coalesce(F.max(F.col("own") == "allow"), F.lit(False)).alias("ok"), F.coalesce(F.max(F.col("own") == "block"), F.lit(False)).alias("bad"))
    said = said.select("component", F.when(F.col("bad") & ~F.col("ok"), "block").otherwise("allow").alias("said"))
    of = ends.join(said, "component")
    out = judged.join(of, "url", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "said", F.lit("allow")).alias("verdict"), F.coalesce("component", "url").alias("alias_of"))


def oracle() -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return rf"""
WITH RECURSIVE r(rh, rp, v) AS (VALUES {values}),
t AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE regexp_matches(html, '(?i)canonical|http-equiv')),
u AS (SELECT url AS a, replace(CASE WHEN regexp_matches(tag, '(?i)\srel\s*=\s*["'']?canonical') THEN regexp_extract(tag, '(?is)\shref\s*=\s*["'']?([^"''\s>]+)', 1)
  WHEN regexp_matches(tag, '(?i)\shttp-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?is)\scontent\s*=\s*["'']?\s*\d+\s*[;,]\s*url\s*=\s*["'']?([^"''\s>]+)', 1) END, '&amp;', '&') AS b FROM t),
e AS (SELECT a, CASE WHEN b LIKE '//%' THEN regexp_extract(a, '^([^/?#]*):', 1) || ':' || b WHEN b LIKE '/%' THEN regexp_extract(a, '^([^/?#]*://[^/?#]*)', 1) || b ELSE b END AS b FROM u WHERE b LIKE '/%' OR regexp_matches(b, '^[^/?#]*://')),
both_ AS (SELECT a, b FROM e WHERE b <> '' UNION SELECT b, a FROM e WHERE b <> ''),
reach(a, b) AS (SELECT a, a FROM both_ UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a),
urls AS (SELECT url FROM pages UNION SELECT a FROM both_),
s AS (SELECT url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM urls),
hp AS (SELECT url, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
m AS (SELECT url, host, path, rh || rp AS rule, v, row_number() OVER (PARTITION BY url ORDER BY length(rh || rp) DESC NULLS LAST) AS rn
  FROM hp LEFT JOIN r ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp)),
o AS (SELECT * FROM m WHERE rn = 1),
c AS (SELECT reach.a AS url, min(reach.b) AS alias_of, bool_or(o.v = 'allow') AS ok, bool_or(o.v = 'block') AS bad FROM reach JOIN o ON o.url = reach.b GROUP BY 1)
SELECT p.page_id, coalesce(o.host, '') AS host, coalesce(o.path, '') AS path, o.rule,
  coalesce(o.v, CASE WHEN c.bad AND NOT coalesce(c.ok, false) THEN 'block' ELSE 'allow' END) AS verdict, coalesce(c.alias_of, p.url) AS alias_of
FROM pages p LEFT JOIN o ON o.url = p.url LEFT JOIN c ON c.url = p.url"""


def aliases_oracle() -> str:
    """Verdicts where the pages whose paths share their first number are a class, by grouping instead of links."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return rf"""
WITH r(rh, rp, v) AS (VALUES {values}),
s AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, url, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
m AS (SELECT page_id, url, host, path, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS rn
  FROM hp LEFT JOIN r ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp)),
o AS (SELECT *, regexp_extract(path, '([0-9]+)', 1) AS number FROM m WHERE rn = 1),
c AS (SELECT number, min(url) AS alias_of, bool_or(v = 'allow') AS ok, bool_or(v = 'block') AS bad FROM o WHERE number <> '' GROUP BY 1)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
  coalesce(v, CASE WHEN c.bad AND NOT coalesce(c.ok, false) THEN 'block' ELSE 'allow' END) AS verdict, coalesce(c.alias_of, o.url) AS alias_of
FROM o LEFT JOIN c USING (number)"""
