"""URL filters with redirect equivalence, as DataFrame operations.

A rule (action, host, path) fits its host and all subdomains if the URL's path starts with the rule's path; the longest
rule wins (host and path together; at a tie the longer host, then allow). URLs that redirect to, or name as canonical,
one another are aliases: connected components over those edges and over each URL's own canonical form (no fragment,
tracking parameters, user part or default port; http). A URL without a rule takes its component's decision: allow if a
member has an allow rule (explicit allow precedence), else block if a member has a block rule, else the default.

Edges come from canonical links and meta refreshes in the pages' html (both, if a page has both; relative ones are
resolved against the page's URL) and from an optional table of redirects.
Defined results: a null URL or one without `://` has empty host and path, no rule and the default verdict, and is no
alias of anything. Null html has no links. Repeated rows are judged each; an empty table gives no rows. Other columns of
the input are not read. A rule's own verdict is never changed by aliases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.components import components
from vectorloom.llm.shared import materialize, maybe_broadcast

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
# Query parameters that only track.
TRACKING = r"(?i)(?<=[?&])(?:utm_\w+|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid)=[^&]*&?"
#: Up to so many rules are compared one after the other in an expression; more are joined.
EXPRESSION_RULES = 200

Rule = tuple[str, str, str]


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """The URL's own canonical form; null without a host."""
    h = F.regexp_replace(F.regexp_replace(host(url), r"^[^@]*@", ""), r":(?:80|443)?$", "")
    p = path(url)
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, PARTS, 3), TRACKING, ""), r"[?&]+$", "")
    return F.when(h != "", F.concat(F.lit("http://"), h, p, query))


def _ranked(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "allow", r))


def with_rules(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds rule (like net/) and action of the longest rule that fits columns host and path; null without one."""
    if len(rules) <= EXPRESSION_RULES:
        rule = action = F.lit(None).cast("string")
        for act, h, p in reversed(_ranked(rules)):
            fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
            rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
        return urls.withColumn("rule", rule).withColumn("action", action)
    table = maybe_broadcast(urls.sparkSession.createDataFrame([(h, p, h + p, a, -k) for k, (a, h, p) in enumerate(_ranked(rules))], "suffix string, prefix string, rule string, action string, rank int"))
    own = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = own.withColumn("suffix", F.explode(suffixes)).join(table, "suffix").where(F.col("path").startswith(F.col("prefix")))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "action"), "rank").alias("best"))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))


# Named character references of signs that URLs hold.
REFERENCES = {"&amp;": "&", "&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&sol;": "/", "&colon;": ":", "&quest;": "?", "&equals;": "=", "&num;": "#", "&period;": ".", "&percnt;": "%"}


def _decoded(value: Column) -> Column:
    """Character references of ASCII signs replaced: numeric ones, those of REFERENCES, ampersands last."""
    pieces = F.split(value, r"(?=&#[0-9xX])")
    code = lambda x: F.when(x.rlike(r"^&#[xX][0-9a-fA-F]{1,4};"), F.conv(F.regexp_extract(x, r"^&#[xX]([0-9a-fA-F]{1,4});", 1), 16, 10)).otherwise(F.regexp_extract(x, r"^&#([0-9]{1,5});", 1)).try_cast("int")
    one = lambda x: F.when(code(x).between(32, 126), F.concat(F.char(code(x)), F.regexp_replace(x, r"^&#[0-9a-zA-Z]+;", ""))).otherwise(x)
    out = F.when(value.contains("&#"), F.array_join(F.transform(pieces, one), "")).otherwise(value)
    for name, sign in reversed(REFERENCES.items()):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def absolute(found: Column, url: Column) -> Column:
    """A reference as an absolute URL, seen from a page's URL; null if the reference is empty or the page has no host.

    Steps ./ and ../ of a relative path are taken; a scheme without // (like mailto:) is no page and gives null."""
    top = F.concat(F.regexp_extract(url, r"(?s)^(.*?://)", 1), host(url))
    folder = F.regexp_extract(path(url), r"(?s)^(.*/)", 1)
    joined = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), found)
    tail = F.regexp_extract(joined, r"(?s)([?#].*)$", 1)
    steps = F.split(F.regexp_extract(joined, r"(?s)^([^?#]*)", 1), "/")
    last = F.element_at(steps, -1)
    walked = F.aggregate(
        F.slice(steps, 2, F.size(steps) - 1), F.array().cast("array<string>"), lambda at, s: F.when(s == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).when(s == ".", at).otherwise(F.array_append(at, s))
    )
    walked = F.concat(F.lit("/"), F.array_join(walked, "/"), F.when(last.isin(".", "..") & (F.size(walked) > 0), "/").otherwise(""))
    based = host(url) != ""
    return (
        F.when(found == "", None)
        .when(found.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), found)
        .when(found.startswith("//"), F.concat(F.lit("http:"), found))
        .when(found.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(based & found.startswith("/"), F.concat(top, found))
        .when(based & found.startswith("?"), F.concat(top, path(url), found))
        .when(based & found.startswith("#"), url)
        .when(based, F.concat(top, walked, tail))
    )


def declared_links(html: Column, url: Column) -> Column:
    """The absolute URLs of the page's canonical link and of its meta refresh: an array without nulls."""
    plain = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|$)|<(script|style)\b.*?</\1\s*>", " ")
    value = lambda tag, name: F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']?\s*([^\"'>\s]+)", 1)
    link = value(F.regexp_extract(plain, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0), "href")
    fresh = value(F.regexp_extract(plain, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0), "url")
    lower = F.lower(html)
    found = F.when(lower.contains("canonical") | lower.contains("http-equiv"), F.array_compact(F.array(absolute(_decoded(link), url), absolute(_decoded(fresh), url))))
    return F.coalesce(found, F.array().cast("array<string>"))


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, default: str = "allow", id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """id, url, host, path, rule, verdict, root (of its component, null if it has no alias) of every page. redirects: (source, target)."""
    url = F.col(url_col)
    links = declared_links(F.col(html_col), url) if html_col else F.array().cast("array<string>")
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), host(url).alias("host"), path(url).alias("path"), links.alias("links"))
    held = materialize(with_rules(rows, rules), "url-pages")

    own = held.select(F.col("url").alias("u"), canonical(F.col("url")).alias("v"))
    edges = own.unionByName(held.select("url", F.explode("links").alias("link")).select(canonical(F.col("url")).alias("u"), canonical(F.col("link")).alias("v")))
    if redirects is not None:
        source, target = F.col("source"), F.col("target")
        edges = edges.unionByName(redirects.select(canonical(source).alias("u"), canonical(target).alias("v")))
        edges = edges.unionByName(redirects.select(source.alias("u"), canonical(source).alias("v"))).unionByName(redirects.select(target.alias("u"), canonical(target).alias("v")))
    found = materialize(components(edges.where("u is not null and v is not null"), "url-aliases"), "url-roots")
    members = with_rules(found.select("node", "root", host(F.col("node")).alias("host"), path(F.col("node")).alias("path")), rules)
    allow, block = F.max((F.col("action") == "allow").cast("int")), F.max((F.col("action") == "block").cast("int"))
    # Under a key of its own (see least_of), so that the pages of one large component split over tasks.
    decided = members.groupBy("root").agg(F.min("root").alias("of"), F.when(allow == 1, "allow").when(block == 1, "block").alias("decision")).select(F.col("of").alias("root"), "decision").where("decision is not null")

    ruled = held.where("rule is not null").withColumn("root", F.lit(None).cast("string")).withColumn("decision", F.col("action"))
    rest = held.where("rule is null").join(found, F.col("url") == F.col("node"), "left").drop("node").join(decided, "root", "left")
    out = ruled.unionByName(rest, allowMissingColumns=True)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "path", "rule", F.coalesce("decision", F.lit(default)).alias("verdict"), "root")
