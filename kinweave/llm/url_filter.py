"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` (host in lower case) with the
literal tokens that every fitting URL must hold. Of its tokens the one that the
fewest URLs have becomes its index entry. URL tokens fetch candidate rules by an
equi-join, and only these run their expression. The fitting rule with the largest
weight decides, of equal weights the first by name.

* host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
* path: from there up to ``?``, ``#`` or the end;
* both are empty for a null URL or one without ``://``.

Equal URLs are judged once, so a URL that a third of all rows share is one row until
the last join. Null and empty URLs fit no rule and get the default verdict. Repeated
rows are judged each; an empty table or no rules give the default or an empty result;
other columns of the input are carried along.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Rule tables up to this many rows are sent to every executor; larger ones are joined through a shuffle.
SENT = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    weight: int


def host_rule(verdict: str, name: str) -> Rule:
    """``example.net/en/``: the host and its subdomains, paths that start with ``/en/``. Longer names weigh more."""
    host, slash, path = name.partition("/")
    tokens = tuple(t for t in re.split("[^a-z0-9]+", host) if t)
    return Rule(name, f"^([^/]*[.])?{re.escape(host)}{re.escape(slash + path)}", tokens, verdict, 1_000 + len(name))


def word_rule(verdict: str, word: str, weight: int = 10) -> Rule:
    """A word of its own anywhere in the host."""
    return Rule(word, f"^([^/]*[^a-z0-9/])?{word}([^a-z0-9/][^/]*)?(/.*)?$", (word,), verdict, weight)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(target: Column) -> Column:
    """Distinct runs of ASCII letters and digits, in lower case."""
    return F.array_distinct(F.filter(F.split(F.translate(target, UPPER, LOWER), "[^a-z0-9]+"), lambda t: t != ""))


def judge(urls: DataFrame, rules: tuple[Rule, ...] | DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with host, path, fitting_rule (null if none fits) and verdict, under clash-free names.

    ``rules`` may be a table with the fields of ``Rule`` for sets too large for a program text.
    """
    spark = urls.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(
            [(r.name, r.pattern, list(r.tokens), r.verdict, r.weight) for r in rules],
            "name string, pattern string, tokens array<string>, verdict string, weight int",
        )
    small = rules.count() <= SENT
    send = F.broadcast if small else (lambda df: df)
    targets = urls.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url")).distinct() \
        .withColumn("target", F.concat(host_of(F.col("url")), path_of(F.col("url")))).where("target <> ''")
    held = targets.select("url", "target", F.explode(tokens_of(F.col("target"))).alias("token"))
    # How many URLs have each token of the rules; a token that no URL has counts 0 and is the rarest.
    asked = rules.select("name", F.explode("tokens").alias("token"))
    seen = held.join(send(asked.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = asked.join(seen, "token", "left").groupBy("name").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
    entries = rules.join(index, "name").select("name", "pattern", "verdict", "weight", F.col("rarest.token").alias("token"))
    fits = held.join(send(entries), "token").where(F.regexp_like("target", F.col("pattern")))
    best = fits.groupBy("url").agg(F.min(F.struct((-F.col("weight")).alias("weight"), "name", "verdict")).alias("fit"))
    found = best.select(F.col("url").alias("_url"), F.col("fit.name").alias("_rule"), F.col("fit.verdict").alias("_verdict"))
    return urls.join(found, F.col(url_col) == F.col("_url"), "left").select(
        *[urls[c] for c in urls.columns],
        host_of(F.col(url_col)).alias("_host"), path_of(F.col(url_col)).alias("_path"), "_rule",
        F.coalesce("_verdict", F.lit(default)).alias("_verdict"),
    )
