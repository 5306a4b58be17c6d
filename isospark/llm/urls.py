"""URL filters: pattern rules indexed by their rarest literal token.

Every rule has a regular expression over host + path and the literal tokens that
any URL it matches must hold whole. A rule is filed under the one of its tokens
that fewest URLs hold (counted over all URLs). A URL's distinct tokens fetch the
rules filed under them by a join, and only those rules' expressions are run on
it. All of this is DataFrame functions.

Rules with a rule string (host and path prefix) decide first, the longest string
wins; without one, the pattern rules decide (one match blocks); else allow.

Defined cases: a null url, or one without "://", has an empty host and path and
is allowed, as nothing can match. Repeated rows are judged each. Input columns
are chosen by name, others are not looked at; ids may be null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Up to so many rules are broadcast (a few hundred bytes each); more are joined by shuffling.
BROADCAST_RULES = 100_000
#: Token of all URLs, for rules without a whole token of their own.
ANY = "*"


@dataclass(frozen=True)
class Rule:
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    rule: str | None = None


def prefix_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host with its subdomains and a path prefix. Its last token may go on in a URL unless the path ends it."""
    tokens = re.findall("[A-Za-z0-9]+", host + path)
    whole = tokens if not re.search("[A-Za-z0-9]$", host + path) else tokens[:-1]
    return Rule(rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(whole), verdict, host + path)


#: The rules of the contract.
BASE_RULES = (
    prefix_rule("org", "/", "allow"),
    prefix_rule("example.org", "/es/", "block"),
    prefix_rule("example.org", "/en/1", "block"),
    prefix_rule("com", "/fr/", "allow"),
    prefix_rule("com", "/de/", "block"),
)
#: The method's own rules: words of spam hosts, whole between separators.
PATTERN_RULES = tuple(
    Rule(rf"^(?:[^/]*[.-])?{a}-{b}[.-][^/]*", (a, b), "block") for a, b in (("spam", "farm"), ("cheap", "pills"), ("link", "farm"), ("free", "casino"))
) + tuple(Rule(rf"^(?:[^/]*[.-])?{word}(?:[.-][^/]*)?(?:/|$)", (word,), "block") for word in ("casino", "viagra", "xxx"))


def split_url(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """page_id, host, path, key = host and path, tokens of the key."""
    at = F.expr("locate('://', url)")
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumn("rest", F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(""))
    parts = parts.withColumn("raw", F.regexp_extract("rest", "^[^/?#]*", 0))
    parts = parts.select("page_id", ascii_lower(F.col("raw")).alias("host"), F.regexp_extract(F.expr("substring(rest, length(raw) + 1)"), "^[^?#]*", 0).alias("path"))
    return parts.withColumn("key", F.concat("host", "path")).withColumn("tokens", F.array_distinct(F.split("key", "[^A-Za-z0-9]+")))


def index_rules(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(token, pattern, verdict, rule): each rule under its rarest token. One row for each literal token reaches the driver."""
    spark = urls.sparkSession
    literal = sorted({t for r in rules for t in r.tokens})
    wanted = spark.createDataFrame([(t,) for t in literal], "token string")
    held = urls.select(F.explode("tokens").alias("token")).join(F.broadcast(wanted) if len(literal) <= BROADCAST_RULES else wanted, "token")
    counts = {r.token: r["count"] for r in held.groupBy("token").count().collect()}
    filed = [(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=ANY), r.pattern, r.verdict, r.rule) for r in rules]
    return spark.createDataFrame(filed, "token string, pattern string, verdict string, rule string")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of each row."""
    urls = split_url(pages, id_col, url_col)
    index = index_rules(urls, rules)
    if not all(r.tokens for r in rules):
        urls = urls.withColumn("tokens", F.concat("tokens", F.array(F.lit(ANY))))
    fetched = urls.withColumn("row", F.monotonically_increasing_id()).withColumn("token", F.explode_outer("tokens")).drop("tokens")
    fetched = fetched.join(F.broadcast(index) if len(rules) <= BROADCAST_RULES else index, "token", "left")
    fits = F.col("pattern").isNotNull() & F.expr("key rlike pattern")
    longest = F.max(F.when(fits & F.col("rule").isNotNull(), F.struct(F.length("rule"), "rule", "verdict")))
    judged = fetched.groupBy("row", "page_id", "host", "path").agg(longest.alias("best"), F.max(fits & F.col("rule").isNull() & (F.col("verdict") == "block")).alias("spam"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.when(F.col("spam"), "block").otherwise("allow")).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), BASE_RULES + PATTERN_RULES)


def _case(rules, value) -> str:
    return " ".join(f"when regexp_matches(key, '{r.pattern}') then '{value(r)}'" for r in sorted(rules, key=lambda r: -len(r.rule or "")))


ORACLE = {
    "op10_url_filter": rf"""
with a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
b as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') raw from a),
c as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') path from b),
d as (select *, host || path as key from c)
select page_id, host, path, case {_case(BASE_RULES, lambda r: r.rule)} end as rule,
  case {_case(BASE_RULES, lambda r: r.verdict)} {_case(PATTERN_RULES, lambda r: "block")} else 'allow' end as verdict from d"""
}

QUERIES = {"op10_url_filter": op10_url_filter}
