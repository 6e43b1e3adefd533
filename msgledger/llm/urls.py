"""Operator 1: URL filters by host-suffix and path-prefix expressions on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digests that the rules are joined on; the full digest confirms.
PREFIX = 8
#: Rules that are broadcast; a longer list is joined by shuffle.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = "host string, path string, action string"


def rule_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules from pairs such as ("block", "example.net/en/")."""
    rows = []
    for action, text in rules:
        host, _, rest = text.partition("/")
        rows.append((host.translate(str.maketrans(UPPER, LOWER)), "/" + rest, action))
    return spark.createDataFrame(rows, RULES)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; path: from there up to ``?``, ``#`` or end."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    whole = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    slash = F.instr(whole, "/")
    host = F.when(slash > 0, whole.substr(F.lit(1), slash - 1)).otherwise(whole)
    path = F.when(slash > 0, whole.substr(slash, F.length(whole))).otherwise("")
    return F.translate(host, UPPER, LOWER), path


def _suffixes(host: Column, most: int) -> Column:
    """The last 1 to ``most`` labels of the host (as many as it has), joined by dots; for an empty host none."""
    last = F.transform(F.array(F.split(host, "\\.")), lambda labels: F.slice(labels, F.greatest(F.size(labels) - (most - 1), F.lit(1)), F.lit(most)))[0]
    every = F.transform(F.array(last), lambda labels: F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.lit(most)), ".")))[0]
    return F.when(host == "", F.array().cast("array<string>")).otherwise(every)


def _prefixes(path: Column, lengths: Column) -> Column:
    """The path's beginnings of those lengths that rules have."""
    return F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: path.substr(F.lit(1), n))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row of ``pages``; ``rules(host, path, action)``.

    A rule fits its host and all subdomains, if the URL's path starts with the rule's. Of fitting rules the
    longest (host and path together) wins; of equally long ones that with the longer host, then ``block``.
    No fitting rule: ``rule`` is null and the verdict ``default``. A null URL, or one without ``://``, has an
    empty host and path, which no rule fits; neither does a rule whose host is null or empty. Repeated
    rows, null ids and repeated rules are allowed; other columns are not read; an empty table gives no rows.

    Each URL is expanded into its host suffixes, of as many labels as a rule has at most, times the path prefixes of lengths
    that rules have (a list of distinct lengths, bounded by the longest path of a rule). The expressions are joined on the first
    PREFIX hex digits of their digests and confirmed on the rest. Up to BROADCAST_RULES rules are broadcast; with
    more, the join shuffles, where adaptive execution splits frequent hosts. Matches of a row meet on a
    row number, so no host's share of the rows matters.
    """
    digest = _digest(F.col("host"), F.col("path"))
    table = rules.where("host <> ''").select("host", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("action", F.lit(default)).alias("action")).withColumn("digest", digest)
    # of equal expressions "block" counts
    table = table.groupBy("digest").agg(F.first("host").alias("r_host"), F.first("path").alias("r_path"), F.max("action").alias("action"))
    table = table.select(F.substring("digest", 1, PREFIX).alias("r_prefix"), F.col("digest").alias("r_digest"), F.concat("r_host", "r_path").alias("rule"), F.length("r_host").alias("host_length"), "action")
    most = rules.agg(F.max(F.size(F.split("host", "\\.")))).first()[0] or 1
    lengths = sorted(r[0] for r in rules.select(F.length(F.coalesce("path", F.lit(""))).alias("n")).distinct().collect())
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        table = F.broadcast(table)

    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    base = base.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    tries = F.flatten(F.transform(_suffixes(F.col("host"), most), lambda h: F.transform(_prefixes(F.col("path"), F.array(*map(F.lit, lengths)).cast("array<int>")), lambda p: _digest(h, p))))
    # a row's whole expansion stays in its task: matches are narrowed to the best there, before rows meet on their number
    found = base.select("page_id", "host", "path", "row", F.explode_outer(tries).alias("digest")).withColumn("prefix", F.substring("digest", 1, PREFIX))
    hit = found.join(table, (F.col("prefix") == F.col("r_prefix")) & (F.col("digest") == F.col("r_digest")), "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("length"), "host_length", (F.col("action") == "block").alias("blocks"), "rule", "action"))).alias("best")
    out = hit.groupBy("row", "page_id", "host", "path").agg(best)
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
