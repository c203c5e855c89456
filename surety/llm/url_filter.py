"""URL rules carried over redirect equivalence.

Canonical links and refresh redirects found in a page are edges between addresses (host,
path and query; the scheme and the fragment are none of an address).  Addresses that
edges join, in either direction and over any number of steps, are aliases: connected
components, found in distributed rounds.  A page that a rule fits has the rule's
verdict.  Any other page is blocked if an alias is blocked by rule and none is allowed by
rule: an explicit allow takes precedence; else it is allowed.  The target of a link is an
alias whether or not it is a row of the table; all links of a page count, relative ones
from the page's address or its ``<base>``.  Addresses are compared as text, never by hash.

Defined cases: a null url, or one without ``://``, has empty host and path, no
alias, and is allowed; null html has no links; an empty path is ``/`` in an address; of
entities in links those for ``&``, ``/`` and ``:`` are read; repeated rows are judged
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.llm import shared
from surety.llm.connected import connected_components


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^[^?#]*\?([^#]*)"
TAGS = r"(?i)<(?:link|meta|base)[\s/][^>]*>"
CANONICAL = r"""(?is)^<link.*[\s"'/]rel\s*=\s*(?:"[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"""
REFRESH = r"""(?is)^<meta.*[\s"'/]http-equiv\s*=\s*["']?\s*refresh\b"""
BASE = r"(?i)^<base"
HREF = r"""(?i)[\s"'/]href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
CONTENT = r"""(?i)[\s"'/]content\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""
TARGET = r"(?is)\burl\s*=\s*(.+)$"
ABSOLUTE, SCHEME, DOTS = r"^[A-Za-z][A-Za-z0-9+.-]*://", r"^[A-Za-z][A-Za-z0-9+.-]*:", r"/\.\.?(?:/|$)"
QUOTES = r"""^[\s"']+|[\s"']+$"""
#: What the entities stand for, in the order of replacement.
ENTITIES = ((r"(?i)&#x2f;|&#47;|&sol;", "/"), (r"(?i)&#x3a;|&#58;|&colon;", ":"), (r"(?i)&amp;|&#38;|&#x26;", "&"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, SPLIT, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, QUERY, 1), F.lit(""))


def address(host: Column, path: Column, query: Column) -> Column:
    """Text of an address; null without a host."""
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def without_dots(path: Column) -> Column:
    """``path`` with its ``.`` and ``..`` segments resolved."""
    up = lambda a: F.regexp_replace(a, r"/?[^/]*$", "")
    kept = F.aggregate(F.split(F.substr(path, F.lit(2)), "/", -1), F.lit(""), lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.concat(a, F.lit("/"), x)))
    return F.when(path.rlike(DOTS), F.concat(kept, F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(path)


def resolved(to: Column, host: Column, path: Column, query: Column) -> Column:
    """struct(host, path, query) of the link ``to`` in a document at an address; an empty host where it is no address."""
    whole = F.when(to.startswith("//"), F.concat(F.lit("http:"), to)).when(to.rlike(ABSOLUTE), to)
    bare = F.regexp_extract(to, r"(?s)^[^?#]*", 0)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    below = F.when(bare == "", path).when(bare.startswith("/"), without_dots(bare)).otherwise(without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), bare)))
    own = F.when(to.rlike(SCHEME), "").otherwise(host)
    asked = F.when(to.startswith("#") | (to == ""), query).otherwise(query_of(to))
    return F.struct(F.when(whole.isNotNull(), host_of(whole)).otherwise(own).alias("host"), F.when(whole.isNotNull(), path_of(whole)).otherwise(below).alias("path"), F.when(whole.isNotNull(), query_of(whole)).otherwise(asked).alias("query"))


def first_rule(host: Column, path: Column, rules: Sequence[Rule], value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def _value(tag: Column, attribute: str) -> Column:
    out = F.regexp_replace(F.regexp_extract(tag, attribute, 1), QUOTES, "")
    for entity, letter in ENTITIES:
        out = F.regexp_replace(out, entity, letter)
    return out


def links(pages: DataFrame) -> DataFrame:
    """(key, host, path, query): a row for each link of ``pages(key, host, path, query, html)``, with what it leads to."""
    some = pages.where((F.col("host") != "") & (F.lower("html").contains("canonical") | F.lower("html").contains("refresh")))
    tags = some.select("key", "host", "path", "query", F.regexp_extract_all("html", F.lit(TAGS), F.lit(0)).alias("tags"))
    base = F.coalesce(_value(F.get(F.filter("tags", lambda t: t.rlike(BASE)), F.lit(0)), HREF), F.lit(""))
    tags = tags.withColumn("base", F.when(base != "", resolved(base, F.col("host"), F.col("path"), F.col("query"))))
    tags = tags.withColumn("base", F.when(F.col("base.host") != "", F.col("base")).otherwise(F.struct("host", "path", "query")))
    canonical = F.transform(F.filter("tags", lambda t: t.rlike(CANONICAL)), lambda t: _value(t, HREF))
    refresh = F.transform(F.filter("tags", lambda t: t.rlike(REFRESH)), lambda t: F.regexp_replace(F.regexp_extract(_value(t, CONTENT), TARGET, 1), QUOTES, ""))
    found = tags.select("key", "base", F.explode(F.concat(canonical, refresh)).alias("to")).where("to <> ''")
    return found.select("key", resolved(F.col("to"), F.col("base.host"), F.col("base.path"), F.col("base.query")).alias("to")).select("key", "to.*").where("host <> ''")


def judge(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, and by_alias: whether an alias decided, of each row of ``pages(page_id, url, html)``.

    ``rules`` is a policy list that the caller holds in memory; it becomes one expression.
    """
    url = F.col("url")
    found = pages.select("page_id", "html", host_of(url).alias("host"), path_of(url).alias("path"), query_of(url).alias("query"))
    found = found.withColumn("key", address(F.col("host"), F.col("path"), F.col("query")))
    verdict_of = first_rule(F.col("host"), F.col("path"), rules, lambda r: r.verdict)
    judged = found.select("page_id", "host", "path", "key", first_rule(F.col("host"), F.col("path"), rules, lambda r: r.host + r.path).alias("rule"), verdict_of.alias("ruled"))
    # A target need not be a row of pages: the rules judge it as they judge a page.
    targets = shared.materialise(links(found).select("key", address(F.col("host"), F.col("path"), F.col("query")).alias("to"), verdict_of.alias("ruled")), "targets")
    groups = connected_components(targets.select(F.col("key").alias("a"), F.col("to").alias("b")))
    members = groups.select(F.col("node").alias("key"), "root").unionByName(groups.select(F.col("root").alias("key"), "root").distinct())
    said = judged.where("key is not null").select("key", "ruled").unionByName(targets.select(F.col("to").alias("key"), "ruled")).where("ruled is not null").distinct()
    blocked = said.join(members, "key").groupBy("root").agg(F.max(F.col("ruled") == "block").alias("block"), F.max(F.col("ruled") == "allow").alias("allow")).where("block and not allow")
    by_alias = members.join(blocked.select("root"), "root").select("key", F.lit(True).alias("by_alias"))
    open_ = judged.where("ruled is null and key is not null").join(by_alias, "key", "left")
    done = judged.where("ruled is not null or key is null").withColumn("by_alias", F.lit(False))
    verdict = F.coalesce("ruled", F.when(F.col("by_alias"), "block"), F.lit("allow"))
    return open_.unionByName(done, allowMissingColumns=False).select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("by_alias", F.lit(False)).alias("by_alias"))
