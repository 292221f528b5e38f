"""Registered domains by a table of public-suffix rules: plain ones, ``*.`` wildcards and ``!`` exceptions.

The list is data, so it is a table, and the longest match is a join: each host gives its tails as the rules that could match them, and of
the rules that exist an exception prevails, else the one with most labels. Hosts are looked up once each, however many rows name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidates(hosts: DataFrame) -> DataFrame:
    """hosts(host) -> host, labels, rule, taken (labels of the suffix if that rule holds), exception."""
    split = hosts.select("host", F.split("host", r"\.").alias("labels")).where(F.size("labels") > 0)
    tails = split.select("host", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("k"))
    tail = lambda k: F.array_join(F.slice("labels", F.size("labels") - k + 1, k), ".")
    k = F.col("k")
    forms = F.array(
        F.struct(tail(k).alias("rule"), k.alias("taken"), F.lit(False).alias("exception")),
        F.struct(F.concat(F.lit("!"), tail(k)).alias("rule"), (k - 1).alias("taken"), F.lit(True).alias("exception")),
        F.when(k > 1, F.struct(F.concat(F.lit("*."), tail(k - 1)).alias("rule"), k.alias("taken"), F.lit(False).alias("exception"))),
    )
    return tails.select("host", "labels", F.inline(F.array_compact(forms)))


def registered_domains(rows: DataFrame, host: str, rules: DataFrame, suffix: str = "suffix", registered: str = "registered") -> DataFrame:
    """rows plus ``suffix`` and ``registered``: the public suffix of a host, and it with the label before it.

    rules(rule): one rule a row, in small letters. Hosts are compared in small letters, without a dot at the end. Both columns are null
    for a host under no rule, for addresses by number and for null; ``registered`` also for a host that is a suffix itself. No default rule for
    unlisted names is added: a row ``*`` in the table is one.
    """
    clean = F.regexp_replace(F.lower(F.col(host)), r"\.$", "")
    named = rows.withColumn("_host", F.when(~clean.rlike(r"^[0-9.]*$") & ~clean.contains(":"), clean))
    tails = candidates(named.select(F.col("_host").alias("host")).where("host is not null and host <> ''").distinct())
    any_label = F.lit("*")  # the default rule, where the table has it, is met by the last label
    tails = tails.unionByName(tails.where((F.col("taken") == 1) & ~F.col("exception")).withColumn("rule", any_label))
    hits = tails.join(rules.select("rule").distinct(), "rule").groupBy("host", "labels").agg(F.max(F.struct("exception", "taken")).alias("best"))
    size = F.col("best.taken")
    last = lambda k: F.array_join(F.slice("labels", F.size("labels") - k + 1, k), ".")
    found = hits.select(F.col("host").alias("_host"), last(size).alias(suffix), F.when(F.size("labels") > size, last(size + 1)).alias(registered))
    return named.join(found, "_host", "left").drop("_host")
