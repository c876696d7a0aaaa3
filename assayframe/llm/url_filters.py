"""URL filters with redirect equivalence.

Rules of (host, path, action) judge URLs; a rule fits its host and all subdomains if
the path starts with the rule's, and the longest fitting rule wins. URLs that no rule
fits take the verdict of their aliases: pages name other URLs for themselves by
canonical links and redirects, connected components over those edges are found by
distributed label rounds, and within a component an explicit allow goes before any
block; without either the URL is allowed.

Defined results: a null URL or one without `://` has an empty host and path, fits no
rule and has no aliases, so it is allowed; repeated rows get the same result each;
null html has no links. With an empty table of rules all URLs are allowed. Other
columns stay unless they bear the name of a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.components import components
from assayframe.llm.expressions import rewritten
from assayframe.session import cut

#: Beyond this number, rules are joined as a table instead of being part of the expression.
INLINE_RULES = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ("host", "path", "rule", "verdict", "decided_by")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The URL as a node of the alias graph: scheme and host in lower case, no fragment, no slash at the path's end."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.regexp_extract(bare, r"^([^:/?#]+://[^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^:/?#]+://[^/?#]*([^?]*)", 1), "/+$", "")
    return F.when(head != "", F.concat(F.translate(head, UPPER, LOWER), path, F.regexp_extract(bare, r"(?s)^[^?]*(\?.*)$", 1)))


def inline_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, action) of the longest fitting rule, or null."""
    out = None
    for h, p, action in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,action:string>") if out is None else out


def with_rules(urls: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """urls (with host and path) with _rule, a struct of rule and action.

    A table of rules is joined on every suffix of the distinct hosts and paths, so its
    size isn't limited; the joined table has few rows a host, one for each suffix with rules.
    """
    if not isinstance(rules, DataFrame):
        rules = list(rules)
        if len(rules) <= INLINE_RULES:
            return urls.withColumn("_rule", inline_rule(F.col("host"), F.col("path"), rules))
        rules = urls.sparkSession.createDataFrame(rules, "host string, path string, action string")
    table = rules.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("action").alias("_action")).distinct()
    labels = F.split("host", r"\.")
    places = urls.select("host", "path").distinct()
    suffixes = places.withColumn("_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    hit = suffixes.join(table, "_host").where(F.col("path").startswith(F.col("_path")))
    full = F.concat("_host", "_path")
    best = hit.groupBy("host", "path").agg(F.max_by(F.struct(full.alias("rule"), F.col("_action").alias("action")), F.struct(F.length(full), full)).alias("_rule"))
    return urls.join(best, ["host", "path"], "left")


def resolved(target: Column, page: Column) -> Column:
    """The URL that target names on a page: whole, or relative to its scheme, host, folder or path. Null for other schemes and bare fragments."""
    site = F.regexp_extract(page, r"^([^:/?#]+://[^/?#]*)", 1)
    path = F.regexp_extract(page, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_replace(path, "[^/]*$", ""), F.lit("")), F.lit("/"))
    own = F.regexp_extract(target, "^[^?#]*", 0)

    def step(kept: Column, name: Column) -> Column:
        return F.when(name == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(name == ".", kept).otherwise(F.concat(kept, F.array(name)))

    names = F.split(F.when(own.startswith("/"), own).otherwise(F.concat(folder, own)), "/")
    clean = F.array_join(F.aggregate(names, F.array().cast("array<string>"), step), "/")
    return (
        F.when(target.rlike(r"^[^:/?#]+://"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(page, r"^([^:/?#]+):", 1), F.lit(":"), target))
        .when(target.startswith("?"), F.concat(site, path, target))
        .when(~target.rlike(r"^(?:#|[A-Za-z][A-Za-z0-9+.-]*:)"), F.concat(site, clean, F.substring(target, F.length(own) + 1, F.length(target))))
    )


# The named character references that XML has too.
REFERENCES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
REFERENCE = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|" + "|".join(REFERENCES) + ");"
TAG = r"""(?i)<(?:link|meta|base)\b(?:[^>"']|"[^"]*"|'[^']*')*>"""
ATTRIBUTE = r"""[^\s"'<>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
COMMENT = r"(?s)<!--.*?(?:-->|\z)"


def _referred(reference: Column) -> Column:
    """The character that a reference stands for; itself where there is none."""
    named = F.coalesce(*(F.when(reference == f"&{name};", F.lit(c)) for name, c in REFERENCES.items()))
    digits = F.regexp_extract(reference, "^&#[xX]?([0-9a-fA-F]+);$", 1)
    code = F.when(reference.rlike("^&#[xX]"), F.conv(digits, 16, 10)).when(reference.startswith("&#"), digits).try_cast("long")
    fits = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.coalesce(named, F.when(fits, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")), reference)


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, references decoded, null if there is none. Values are read as units, so names within them don't count."""
    own = F.get(F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda a: a.rlike(rf"(?i)^{name}\s*=")), F.lit(0))
    bare = F.regexp_replace(own, r"(?s)^[^=]*=\s*", "")
    value = F.when(bare.rlike("^[\"']"), F.substr(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
    return F.nullif(F.trim(F.when(F.instr(value, "&") > 0, rewritten(value, REFERENCE, _referred)).otherwise(value)), F.lit(""))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """a_url, b_url: URLs that a page equates by a canonical link or a redirect (meta refresh), outside comments.

    Relative targets are resolved against the page, or its base element if there is one.
    """
    may = F.col(html).rlike(r"(?i)canonical|http-equiv")
    body = F.when(F.instr(html, "<!--") > 0, F.regexp_replace(html, COMMENT, "")).otherwise(F.col(html))
    tags = pages.where(may).select(F.col(url).alias("_url"), F.regexp_extract_all(body, F.lit(TAG), F.lit(0)).alias("tags"))
    base = F.get(F.filter("tags", lambda t: t.rlike(r"(?i)^<base\b")), F.lit(0))
    found = tags.select("_url", base.alias("base"), F.explode(F.filter("tags", lambda t: t.rlike(r"(?i)canonical|http-equiv"))).alias("tag"))
    read = found.select("_url", _attribute(F.col("base"), "href").alias("base"), "tag", *(_attribute(F.col("tag"), n).alias(k) for n, k in (("rel", "rel"), ("href", "href"), ("http-equiv", "equiv"), ("content", "content"))))
    canonical = F.col("tag").rlike("(?i)^<link") & F.array_contains(F.split(F.lower("rel"), r"\s+"), "canonical")
    refresh = F.col("tag").rlike("(?i)^<meta") & (F.lower("equiv") == "refresh")
    target = F.when(canonical, F.col("href")).when(refresh, F.nullif(F.regexp_extract("content", r"(?i)\burl\s*=\s*[\"']?([^\s\"'>]+)", 1), F.lit("")))
    whole = read.select("_url", F.coalesce(resolved(F.col("base"), F.col("_url")), F.col("_url")).alias("page"), target.alias("target")).where("target is not null")
    return whole.select(F.col("_url").alias("a_url"), resolved(F.col("target"), F.col("page")).alias("b_url"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, url: str = "url", html: str | None = "html", edges: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule, verdict and decided_by (rule, alias or default).

    edges: further aliases as (a, b) URLs, such as a crawler's redirect log.
    """
    judged = with_rules(pages.select(*(F.col(f"`{c}`") for c in pages.columns if c not in RESULTS)).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}), rules)
    links = alias_edges(pages, url, html) if html else None
    if edges is not None:
        given = edges.select(F.col("a").alias("a_url"), F.col("b").alias("b_url"))
        links = given if links is None else links.union(given)
    roots = None
    if links is not None:
        # Few rows beside the pages, and read twice below.
        links = cut(links.where("a_url is not null and b_url is not null"))
        links = cut(links.withColumns({"a": node_of(F.col("a_url")), "b": node_of(F.col("b_url"))}).where("a is not null and b is not null"))
        roots = components(links.select("a", "b"))
    if roots is None or roots.isEmpty():
        decided = judged.withColumn("_said", F.lit(None).cast("string"))
    else:
        members = roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
        # Rules judge the URLs as they are named, not the nodes they fall into.
        named = links.select(F.col("a").alias("node"), F.col("a_url").alias("url")).union(links.select("b", "b_url")).distinct()
        of_urls = with_rules(members.join(named, "node").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}), rules)
        # allow < block: the least of the actions is an allow wherever there is one
        said = of_urls.groupBy("root").agg(F.min("_rule.action").alias("_said")).where("_said is not null")
        by_node = members.join(said, "root").select(F.col("node").alias("_node"), "_said")
        decided = judged.withColumn("_node", node_of(F.col(url))).join(by_node, "_node", "left").drop("_node")
    return decided.withColumns(
        {
            "rule": F.col("_rule.rule"),
            "verdict": F.coalesce(F.col("_rule.action"), F.col("_said"), F.lit("allow")),
            "decided_by": F.when(F.col("_rule").isNotNull(), "rule").when(F.col("_said").isNotNull(), "alias").otherwise("default"),
        }
    ).drop("_rule", "_said")
