"""URL filter with redirect equivalence (operator 1).

Rules name a host (with all its subdomains) and a path prefix; the longest rule that
fits decides. A URL without a rule takes the decision of its aliases: pages tied to it
by canonical links or redirects, in any number of steps. Among aliases an explicit
allow wins over a block; without either the URL is allowed. Components are computed
on 64-bit hashes of the URLs that have an edge; all other pages are judged in place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

MAX_INLINE_RULES = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query; fixed values of its contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct ``(rule, action)`` of the longest fitting rule, else null. Inlined: the plan holds no join."""
    if len(rules) > MAX_INLINE_RULES:
        raise ValueError(f"more than {MAX_INLINE_RULES} inline rules")
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        hit = F.struct(F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return F.lit(None).cast("struct<rule:string,action:string>") if out is None else out


def normal_url(url: Column) -> Column:
    """A URL in the alias graph: scheme and host in lower case, no default port, no fragment."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    site = F.translate(F.regexp_extract(bare, r"(?s)^(.*?://[^/?]*)", 1), UPPER, LOWER)
    site = F.regexp_replace(F.regexp_replace(site, r"^(http://[^:]*):80$", "$1"), r"^(https://[^:]*):443$", "$1")
    return F.concat(site, F.regexp_replace(bare, r"(?s)^.*?://[^/?]*", ""))


def node_of(url: Column) -> Column:
    """A URL's number in the alias graph."""
    return F.xxhash64(normal_url(url))


_HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


def _resolve(base: Column, ref: Column) -> Column:
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*/)", 1)
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), ref))
        .when(ref.startswith("/"), F.concat(site, ref))
        .when(ref.startswith("?") | ref.startswith("#"), F.concat(F.regexp_replace(base, r"(?s)[?#].*$", ""), ref))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), ref))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst)`` URLs: canonical links and refresh redirects of the pages' markup (not in comments or scripts)."""
    html = F.regexp_replace(F.col(html_col), r"(?is)<!--.*?-->|<script\b.*?</script\s*>", " ")
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), 0), lambda t: t.rlike(r"""(?is)\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""))
    links = F.transform(links, lambda t: F.concat(*(F.regexp_extract(t, _HREF, i) for i in (1, 2, 3))))
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), 0), lambda t: t.rlike(r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""))
    metas = F.transform(metas, lambda t: F.regexp_extract(t, r"""(?is)\burl\s*=\s*['"]?([^"'>\s]+)""", 1))
    found = pages.where(F.col(url_col).contains("://") & F.col(html_col).rlike("(?i)canonical|refresh"))
    found = found.select(F.col(url_col).alias("src"), F.explode(F.concat(links, metas)).alias("ref"))
    found = found.withColumn("ref", F.regexp_replace(F.trim("ref"), "&amp;", "&")).where("ref <> ''")
    return found.select("src", _resolve(F.col("src"), F.col("ref")).alias("dst")).where(F.col("dst").contains("://"))


def url_verdicts(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
) -> DataFrame:
    """Per input row ``page_id, host, path, rule, verdict, source``.

    ``redirects``: further ``(src, dst)`` URLs. ``source`` says whether a rule, an alias
    or the default decided. A null URL or one without ``://`` has an empty host and path,
    fits no rule and has no alias: allowed. Of rules of equal length the first by text decides. Texts of any length are searched whole. Dot
    segments and ``base`` are not resolved. Repeated rows are judged each; other columns
    are ignored; an empty table gives no rows.
    """
    pages = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), (F.col(html_col) if html_col else F.lit(None)).cast("string").alias("html")
    )
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("src").cast("string"), F.col("dst").cast("string")))
    edges = written(edges.where("src is not null and dst is not null").withColumns({"a": node_of(F.col("src")), "b": node_of(F.col("dst"))}), "aliases")
    comp = connected_components(edges.select("a", "b"))
    ends = edges.select(F.col("src").alias("url"), F.col("a").alias("node")).unionByName(edges.select(F.col("dst").alias("url"), F.col("b").alias("node"))).distinct()
    said = ends.select("node", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["action"].alias("action")).where("action is not null")
    said = (
        said.join(comp, said["node"] == comp["id"]).groupBy("component")
        .agg(F.max(F.col("action") == "allow").alias("allowed"))
        .select("component", F.when(F.col("allowed"), "allow").otherwise("block").alias("by_alias"))
    )
    # numbers are hashes: a page is an alias only if its URL is one of the graph's, too
    known = ends.select("node", normal_url(F.col("url")).alias("normal")).distinct()
    of_node = comp.join(said, "component").join(known, F.col("id") == F.col("node")).select("id", "normal", "by_alias")
    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("id", F.when(F.col("r").isNull() & F.col("url").contains("://"), node_of(F.col("url"))))
    # only pages without a rule meet the aliases: all others would wait at one null key
    open_ = judged.where("id is not null").withColumn("normal", normal_url(F.col("url"))).join(of_node, ["id", "normal"], "left").drop("normal")
    ruled = judged.where("id is null").withColumn("by_alias", F.lit(None).cast("string"))
    return open_.unionByName(ruled).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.action"), F.col("by_alias"), F.lit("allow")).alias("verdict"),
        F.when(F.col("r").isNotNull(), "rule").when(F.col("by_alias").isNotNull(), "alias").otherwise("default").alias("source"),
    )
