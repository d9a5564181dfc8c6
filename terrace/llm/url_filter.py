"""URL filter: host/path rules first, then pattern rules indexed by their rarest literal token.

Everything is DataFrame functions.  A pattern rule lists the literal tokens that
every URL it matches must contain as whole tokens, so its expression bounds them on
both sides by other characters than letters and digits (:func:`bounded`); over all
URLs the rarest of them is found and the rule is indexed under that one token only.  The tokens of a URL then fetch
candidate rules by an equi-join and only those candidates run their regular
expression.  Rule tables are small and of a checked size, so they are broadcast.

Defined cases: a null URL, or one without ``://``, has empty host and path, no
rule, and verdict ``allow`` unless a pattern matches; rows are independent, so
repeated rows get equal verdicts; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of (verdict, host, path prefix): the longest that fits wins.
HOST_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Pattern rules: (verdict, whole tokens that a matching URL must contain, regular expression on the lower-cased URL).
PATTERN_RULES = (
    ("block", ("spam", "farm"), r"://([^/?#]*\.)?spam-farm\."),
    ("block", ("casino",), r"[/.\-]casino[/.\-]"),
    ("block", ("adserver",), r"://([^/?#]*\.)?adserver\."),
    ("block", ("doubleclick",), r"://([^/?#]*\.)?doubleclick\."),
    ("block", ("ads",), r"/ads/.*banner"),
    ("block", ("wp", "login"), r"/wp-login\.php"),
    ("block", ("phpmyadmin",), r"/phpmyadmin(/|$)"),
    ("block", ("porn",), r"[/.\-]porn[/.\-]"),
)

#: Largest rule table that is broadcast; beyond it Spark joins by token with a shuffle.
BROADCAST_RULES = 100_000

TOKEN_BREAK = "[^a-z0-9]+"

#: What bounds a token in an expression: / or - or an escaped point or their class; on the left also :// with any host labels, on the right also (/|$).
_EDGE = r"[/\-]|\\\.|\[/\.\\-\]"
_BEFORE, _AFTER = rf"(?:{_EDGE}|://\(\[\^/\?#\]\*\\\.\)\?)", rf"(?:{_EDGE}|\(/\|\$\))"


def bounded(token: str, pattern: str) -> bool:
    """Whether the expression has the literal with a bound on both sides, so that every URL it matches has it as a whole token."""
    return re.search(f"{_BEFORE}{re.escape(token)}{_AFTER}", pattern) is not None


def lower_ascii(column: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting host/path rule, null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        rule = F.when(fits, F.lit(f"{name}{prefix}")).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Tokens of the URL, lower-cased as for the expressions."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(url, F.lit(""))), TOKEN_BREAK), lambda t: t != ""))


def indexed_rules(tokens: DataFrame, rules=PATTERN_RULES) -> DataFrame:
    """Rule table with each rule under its rarest literal: token, rule_no, verdict, pattern.  ``tokens`` has one row per URL and token."""
    loose = [(token, pattern) for _, needs, pattern in rules for token in needs if not bounded(token, pattern)]
    if loose:
        raise ValueError(f"literals that their expressions do not bound: {loose}")
    # Literals instead of a local table, which Python workers would read.
    told = [(n, verdict, token, pattern) for n, (verdict, needs, pattern) in enumerate(rules) for token in needs]
    told = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("rule_no", "verdict", "token", "pattern"), t, strict=True)]) for t in told])
    literals = tokens.sparkSession.range(1).select(F.explode(told).alias("t")).select("t.*")
    small = F.broadcast if sum(len(r[1]) for r in rules) <= BROADCAST_RULES else (lambda x: x)
    counts = tokens.join(small(literals.select("token").distinct()), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = literals.join(counts, "token", "left")
    rarest = ranked.groupBy("rule_no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "verdict", "pattern")).alias("r"))
    return small(rarest.select("rule_no", "r.token", "r.verdict", "r.pattern"))


def pattern_verdicts(urls: DataFrame, rules=PATTERN_RULES) -> DataFrame:
    """url, pattern_verdict for the distinct URLs that some pattern rule matches (the first rule in order wins)."""
    distinct = urls.select("url").where(F.col("url").isNotNull()).distinct()
    tokens = distinct.select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
    candidates = tokens.join(indexed_rules(tokens, rules), "token")
    matched = candidates.where(F.expr("rlike(lower(url), pattern)"))
    return matched.groupBy("url").agg(F.min(F.struct("rule_no", "verdict")).getField("verdict").alias("pattern_verdict"))


def judge_urls(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = host_rule(F.col("host"), F.col("path"), host_rules)
    judged = rows.withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("rule_verdict", verdict)
    return judged.join(pattern_verdicts(rows, pattern_rules), "url", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", "pattern_verdict", F.lit("allow")).alias("verdict"),
    )
