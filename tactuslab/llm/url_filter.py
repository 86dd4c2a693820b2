"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression with literal tokens that every URL it fits must hold. Each rule
is filed under the rarest of them, as counted over all URLs; a URL looks up its own tokens, and
only the rules filed there run their expression. Up to MAX_RULES the index is a literal of the plan,
which every task gets, and all of it is row by row: no shuffle but for the token counts. More rules are a
table filed by token, and different URLs are joined with it by theirs: the same decisions for any number.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tactuslab.llm.common import free, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "[^a-z0-9]+"
#: Rules that an index may hold as a literal; more are joined.
MAX_RULES = 5000
RULE_TABLE = "rule string, verdict string, expression string, tokens array<string>, tier int"


@dataclass(frozen=True)
class UrlRule:
    """What to do with URLs whose host and path, written together, fit expression.

    tokens: runs of a-z and 0-9 that stand whole in every such URL. Of the rules that fit, the
    highest tier decides, in it the longest name, of equally long ones the last in order.
    """

    name: str
    verdict: str
    expression: str
    tokens: tuple[str, ...]
    tier: int = 0


def host_rule(verdict: str, host: str, path: str) -> UrlRule:
    """A host and all its subdomains, with paths that start with path."""
    expression = rf"(?s)^(?:[^/]*\.)?{_quoted(host)}{_quoted(path)}"
    # The last token of the path may go on in the URL, so only what a separator follows counts.
    tokens = _tokens(host) + (_tokens(path[: path.rfind("/") + 1]) if "/" in path else ())
    return UrlRule(host + path, verdict, expression, tokens, 1)


def pattern_rule(verdict: str, pattern: str) -> UrlRule:
    """A pattern over host and path in which * stands for any characters, matched whole."""
    parts = pattern.split("*")
    expression = "(?s)^" + ".*".join(map(_quoted, parts)) + "$"
    tokens: list[str] = []
    for k, part in enumerate(parts):
        inner = part if k == 0 else re.sub("^[A-Za-z0-9]+", "", part)
        tokens += _tokens(inner if k == len(parts) - 1 else re.sub("[A-Za-z0-9]+$", "", inner))
    return UrlRule(pattern, verdict, expression, tuple(tokens), 0)


def _quoted(text: str) -> str:
    return re.sub(r"([.^$|?*+()\[\]{}\\])", r"\\\1", text)


def _tokens(text: str) -> tuple[str, ...]:
    return tuple(t for t in re.split(SEPARATORS, text.translate(str.maketrans(UPPER, LOWER))) if t)


#: The rules of the deployment, and patterns that judge the other URLs.
RULES = (
    host_rule("allow", "org", "/"),
    host_rule("block", "example.org", "/es/"),
    host_rule("block", "example.org", "/en/1"),
    host_rule("allow", "com", "/fr/"),
    host_rule("block", "com", "/de/"),
    pattern_rule("block", "*/wp-login.php*"),
    pattern_rule("block", "*/cgi-bin/*"),
    pattern_rule("block", "ads.*"),
    pattern_rule("block", "*.ads.*"),
    pattern_rule("block", "*/track/*"),
)


ADDED = ("host", "path", "rule", "pattern", "verdict")


def _rule_rank() -> Column:
    """What orders rules of a table as sorted() orders those of a tuple."""
    return F.struct("tier", F.length("rule").alias("length"), "rule")


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null and for a URL without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    no_query = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    host = F.substring_index(no_query, "/", 1)
    return lowered(host), F.substring(no_query, F.length(host) + 1, F.length(no_query))


def url_tokens(site: Column) -> Column:
    return F.array_distinct(F.filter(F.split(lowered(site), SEPARATORS), lambda t: t != ""))


def token_counts(urls: DataFrame, rules: tuple[UrlRule, ...], url: str = "url") -> dict[str, int]:
    """In how many URLs each token of the rules stands: as many rows as the rules have tokens."""
    known = sorted({t for r in rules for t in r.tokens})
    tokens = urls.select(F.explode(url_tokens(F.concat(*host_and_path(F.col(url))))).alias("token"))
    rows = tokens.where(F.col("token").isin(known)).groupBy("token").count().collect() if known else []
    return {t: 0 for t in known} | {r["token"]: r["count"] for r in rows}


def _index(rules: tuple[UrlRule, ...], counts: dict[str, int]) -> Column:
    """Rules in buckets by the hash of the token they are filed under; in bucket 0 those without one."""
    n = max(1, len(rules))
    buckets: list[list[dict]] = [[] for _ in range(n + 1)]
    order = sorted(rules, key=lambda r: (r.tier, len(r.name), r.name))
    for rank, r in enumerate(order):
        token = min(r.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        at = 1 + zlib.crc32(token.encode()) % n if token else 0
        buckets[at].append({"rank": rank, "token": token, "expression": r.expression, "rule": r.name, "verdict": r.verdict, "stated": r.tier > 0})
    kind = "array<array<struct<rank:int,token:string,expression:string,rule:string,verdict:string,stated:boolean>>>"
    return F.from_json(F.lit(json.dumps(buckets)), kind)


def rule_table(spark: SparkSession, rules: Iterable[UrlRule]) -> DataFrame:
    return spark.createDataFrame([(r.name, r.verdict, r.expression, list(r.tokens), r.tier) for r in rules], RULE_TABLE)


def _judged(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """_site and _best of the different sites that a rule fits: rules filed in a table under their rarest token meet the sites that hold it."""
    own = rules.select(_rule_rank().alias("_rank"), "rule", "verdict", "expression", "tokens", (F.col("tier") > 0).alias("stated")).distinct()
    held = saved(sites.select("_site").distinct().withColumn("_token", F.explode(F.array_append(url_tokens(F.col("_site")), F.lit("")))), "url-tokens")
    listed = own.withColumn("_token", F.explode_outer("tokens"))
    counts = held.join(listed.select("_token").distinct(), "_token", "left_semi").groupBy("_token").agg(F.count(F.lit(1)).alias("_n"))
    rarest = F.min_by("_token", F.struct(F.coalesce("_n", F.lit(0)), "_token"))
    filed = listed.join(counts, "_token", "left").groupBy("_rank", "rule", "verdict", "expression", "stated").agg(F.coalesce(rarest, F.lit("")).alias("_token"))
    filed = saved(filed, "filed-rules")  # both sides are written, so that a token that many sites hold can be split
    fits = held.join(filed, "_token").where(F.regexp_like("_site", F.col("expression")))
    return saved(fits.groupBy("_site").agg(F.max(F.struct(F.col("_rank").alias("rank"), "rule", "verdict", "stated")).alias("_best")), "judged")


def filter_urls(urls: DataFrame, rules: tuple[UrlRule, ...] | DataFrame = RULES, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """Add host, path, rule, pattern and verdict to each row. rules is a tuple, or a table with the columns of RULE_TABLE.

    rule is the host rule that decides, else null; pattern the pattern that decides where no rule
    fits. Where neither fits, verdict is otherwise. Null URLs and those without :// have no tokens,
    so only rules without tokens could fit them. Repeated rows each keep their own; columns of
    these names in the input are replaced. An empty table gives an empty one.
    """
    host, path = host_and_path(F.col(url))
    site = F.concat(host, path)
    if isinstance(rules, DataFrame) or len(rules) > MAX_RULES:
        table = rules if isinstance(rules, DataFrame) else rule_table(urls.sparkSession, rules)
        judged = _judged(urls.select(site.alias("_site")), table)
        rows = urls.select(F.struct("*").alias("_row"), host.alias("_host"), path.alias("_path"), site.alias("_site")).join(judged, "_site", "left")
        kept = [c for c in urls.columns if c not in ADDED]
        return rows.select(*[F.col("_row").getField(c).alias(c) for c in kept], F.col("_host").alias("host"), F.col("_path").alias("path"), *_decision(F.col("_best"), otherwise))
    counts = token_counts(urls, rules, url)
    n = max(1, len(rules))
    index = _index(rules, counts)
    bucket = lambda t: (F.crc32(t.cast("binary")) % n + 2).cast("int")
    filed = F.flatten(F.transform(url_tokens(site), lambda t: F.filter(F.element_at(index, bucket(t)), lambda r: r.token == t)))
    fits = F.filter(F.concat(filed, F.element_at(index, F.lit(1))), lambda r: F.regexp_like(site, r.expression))
    (best,) = free(urls, "_best")
    out = urls.drop(*ADDED).select("*", host.alias("host"), path.alias("path"), F.array_max(fits).alias(best))
    return out.select(*[c for c in out.columns if c != best], *_decision(F.col(best), otherwise))


def _decision(b: Column, otherwise: str) -> list[Column]:
    return [F.when(b.stated, b.rule).alias("rule"), F.when(~b.stated, b.rule).alias("pattern"), F.coalesce(b.verdict, F.lit(otherwise)).alias("verdict")]


def oracle_sql(table: str, key: str, rules: tuple[UrlRule, ...] = RULES, otherwise: str = "allow") -> str:
    """The same decision in DuckDB SQL, every rule against every URL."""
    order = sorted(rules, key=lambda r: (r.tier, len(r.name), r.name), reverse=True)
    fit = lambda r: f"regexp_matches(host || path, '{r.expression}')"
    case = lambda of: "".join(f" WHEN {fit(r)} THEN {of(r)}" for r in order)
    lower = f"translate({{}}, '{UPPER}', '{LOWER}')"
    return f"""
WITH rest AS (SELECT {key}, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM {table}),
cut AS (SELECT {key}, split_part(split_part(r, '?', 1), '#', 1) AS q FROM rest),
parts AS (SELECT {key}, {lower.format("split_part(q, '/', 1)")} AS host, substr(q, length(split_part(q, '/', 1)) + 1) AS path FROM cut)
SELECT {key}, host, path, CASE{case(lambda r: f"'{r.name}'" if r.tier else "NULL")} ELSE NULL END AS rule,
  CASE{case(lambda r: f"'{r.verdict}'")} ELSE '{otherwise}' END AS verdict FROM parts"""


__all__ = ["RULES", "UrlRule", "filter_urls", "host_and_path", "host_rule", "oracle_sql", "pattern_rule", "token_counts"]
