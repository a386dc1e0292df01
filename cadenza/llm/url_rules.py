"""URL filtering by pattern rules indexed by their rarest literal token.

A rule is a regular expression over host and path, with the literal tokens that any URL it fits
must contain whole. Token counts over all pages say which of a rule's tokens is rarest; the rule is
filed under that one. A URL looks up each of its own tokens, and only the rules found so run their
expression. The longest fitting list rule decides; without one, the first fitting pattern of the
method does, and else the URL is allowed. A URL without host is blocked: nothing can be fetched.

The method's patterns name pages without running text: forms, baskets, machine interfaces, paged lists, calendars, advertising.
Another list can be given; a rule states its tokens, and pattern_rule refuses tokens that are not whole ones.

Null and malformed URLs have empty host and path. Repeated rows are judged alike; extra columns
stay as they are, and those named like a result are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name

#: Rules in one broadcast index; a longer list is split into indexes of this size, all of which are asked.
RULES_PER_INDEX = 200_000
#: Tokens of rules that are broadcast to be counted.
BROADCAST_TOKENS = 1_000_000
TOKEN = r"[^./]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    #: Of list rules, which win by length over the method's own patterns; 0 for those.
    length: int = 0


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with its subdomains and paths that start with path."""
    whole = path if path.endswith("/") else path[: path.rfind("/") + 1]
    tokens = re.findall(TOKEN, host) + re.findall(TOKEN, whole)
    pattern = rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return Rule(host + path, verdict, pattern, tuple(tokens), len(host + path))


def pattern_rule(verdict: str, pattern: str, *tokens: str) -> Rule:
    """A pattern of the method, for any place of host and path that follows a . or / or the start; tokens are literal ones of whatever it fits."""
    if any(not re.fullmatch(TOKEN, t) for t in tokens):
        raise ValueError(f"not whole tokens: {tokens}")
    return Rule(pattern, verdict, rf"(?:.*[./])?(?:{pattern})(?:[./].*)?$", tokens)


#: The method's own rules: expressions between a separator or end on both sides, and their literal tokens.
PATTERNS = [
    *(pattern_rule("block", t, t) for t in ("login", "signin", "signup", "logout", "cart", "checkout", "adserver", "tracker", "casino", "porn")),
    pattern_rule("block", r"wp-login\.php", "wp-login", "php"),
    pattern_rule("block", r"wp-admin/[^.]+\.php", "wp-admin", "php"),
    pattern_rule("block", r"xmlrpc\.php", "xmlrpc", "php"),
    pattern_rule("block", r"cgi-bin/[^/]+\.(?:cgi|pl)", "cgi-bin"),
    pattern_rule("block", r"(?:tag|category)/[^/]+/page/[0-9]+", "page"),
    pattern_rule("block", r"calendar/[0-9]{4}/[0-9]{1,2}", "calendar"),
    pattern_rule("block", r"user/[^/]+/(?:edit|password)", "user"),
    pattern_rule("block", r"search/[^/]+/[0-9]+", "search"),
    pattern_rule("block", r"ads?[0-9]*\.[^/]+/banner", "banner"),
    pattern_rule("block", r"api/v[0-9]+/[^/]+", "api"),
    pattern_rule("block", r"feed/(?:rss|atom)", "feed"),
]


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; '' without ://."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def token_counts(pages: DataFrame, rules: list[Rule], url: str = "url") -> dict[str, int]:
    """How many pages hold each token of the rules, counted over all pages."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    key = F.concat(host_of(F.col(url)), path_of(F.col(url)))
    tokens = F.array_distinct(F.regexp_extract_all(key, F.lit(f"({TOKEN})"), F.lit(1)))
    # as long as the list of rules, which the driver holds; beyond BROADCAST_TOKENS Spark chooses the join
    names = pages.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    names = F.broadcast(names) if len(wanted) <= BROADCAST_TOKENS else names
    counts = pages.select(F.explode(tokens).alias("token")).join(names, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    return {r.token: r.n for r in counts.collect()}


def by_rarest_token(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """The index; rules without a literal token are filed under '' and looked up by every URL."""
    index = defaultdict(list)
    for r in rules:
        index[min(r.tokens, key=lambda t: (counts.get(t, 0), t), default="")].append(r)
    return dict(index)


class Judge:
    """Looks rules up for one URL at a time. A rule's expression is compiled when a URL first fetches the rule."""

    def __init__(self, index: dict[str, list[Rule]]):
        self.index, self.compiled = index, {}

    def fits(self, rule: Rule, key: str) -> bool:
        if rule not in self.compiled:
            self.compiled[rule] = re.compile(rule.pattern, re.S)
        return self.compiled[rule].match(key) is not None

    def best(self, host: str, path: str) -> Rule | None:
        key, found = host + path, None
        for token in {"", *re.findall(TOKEN, key)}:
            for rule in self.index.get(token, ()):
                if (found is None or (-rule.length, rule.name) < (-found.length, found.name)) and self.fits(rule, key):
                    found = rule
        return found


def judge_urls(pages: DataFrame, list_rules: list[Rule], patterns: list[Rule] = PATTERNS, url: str = "url") -> DataFrame:
    """pages with host, path, rule (name of the deciding list rule or null), pattern (of the method's, or null) and verdict."""
    spark, rules = pages.sparkSession, [*list_rules, *patterns]
    index = by_rarest_token(rules, token_counts(pages, rules, url))
    filed = [(t, r) for t, rs in sorted(index.items()) for r in rs]
    parts = []
    for k in range(0, len(filed), RULES_PER_INDEX):
        part = defaultdict(list)
        for t, r in filed[k : k + RULES_PER_INDEX]:
            part[t].append(r)
        parts.append(spark.sparkContext.broadcast(dict(part)))

    @F.pandas_udf("length int, name string, verdict string")
    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        judges = [Judge(p.value) for p in parts]
        for hosts, paths in batches:
            rows = []
            for host, path in zip(hosts, paths, strict=True):
                found = [r for j in judges if (r := j.best(host, path))] if host else []
                best = min(found, key=lambda r: (-r.length, r.name), default=None)
                rows.append((best.length, best.name, best.verdict) if best else (None, None, None))
            yield pd.DataFrame(rows, columns=["length", "name", "verdict"])

    own = free_name(pages, "url_rule")
    out = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url))).withColumn(own, decide("host", "path"))
    by_list = F.col(f"{own}.length") > 0
    return (
        out.withColumn("rule", F.when(by_list, F.col(f"{own}.name")))
        .withColumn("pattern", F.when(~by_list, F.col(f"{own}.name")))
        .withColumn("verdict", F.coalesce(F.col(f"{own}.verdict"), F.when(F.col("host") == "", "block").otherwise("allow")))
        .drop(own)
    )
