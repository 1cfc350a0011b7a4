"""Robots rules: documents to rule groups, and the evaluation of a token at a path.

Parsing is declarative: lines are exploded with their position, a running count of group starts
gives each line its group, and an aggregation collects a group's agents and rules. A document is one
short text, so its lines are the only thing that is ever put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rule_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``pos``, ``field``, ``value`` of every line with a colon, comments stripped."""
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), r"\r?\n")).alias("pos", "line"))
    bare = F.regexp_replace("line", r"#.*$", "")
    at = F.instr(bare, ":")
    return lines.where(at > 0).select("doc_id", "pos", F.lower(F.trim(F.substring_index(bare, ":", 1))).alias("field"), F.trim(bare.substr(at + 1, F.length(bare))).alias("value"))


def rule_groups(lines: DataFrame) -> DataFrame:
    """``doc_id``, ``group_no``, ``agents``, ``disallow``, ``allow`` (arrays in order).

    User-agent lines that follow each other share a group; any other field ends their run. Rules
    before the first group count for nothing.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    agent = F.col("field") == "user-agent"
    starts = agent & ~F.coalesce(F.lag("field").over(order) == "user-agent", F.lit(False))
    marked = lines.withColumn("starts", starts.cast("int")).withColumn("group_no", F.sum("starts").over(order)).where("group_no > 0")
    pick = lambda f: F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("pos", "value")))), lambda x: x["value"])
    return marked.groupBy("doc_id", "group_no").agg(pick("user-agent").alias("agents"), pick("disallow").alias("disallow"), pick("allow").alias("allow"))


def match_length(rule: Column, path: str) -> Column:
    """Length of the rule's prefix if it matches ``path``, else -1; an empty rule never matches; only a trailing * is a wildcard."""
    bare = F.regexp_replace(rule, r"\*$", "")
    return F.when(rule == "", -1).when(F.lit(path).startswith(bare), F.length(bare)).otherwise(-1)


def longest(rules: Column, path: str) -> Column:
    return F.coalesce(F.array_max(F.transform(rules, lambda r: match_length(r, path))), F.lit(-1))


def access(groups: DataFrame, tokens: DataFrame, docs: DataFrame, path: str = "/") -> DataFrame:
    """``doc_id``, ``token``, ``allowed`` for every document of ``docs`` (column ``doc_id``) and every token.

    The first group that names the token decides, else the first for ``*``; groups of one token aren't
    merged; the longest match wins, ties go to allow; no group or no matching rule allows, so a document without
    any group allows every token. Rules are evaluated once a group; the tokens are one list that a scalar subquery gives.
    """
    by_doc = verdicts(groups, path)
    known = tokens.where("token is not null").agg(F.array_sort(F.collect_set("token"))).scalar()
    every = docs.select("doc_id").distinct().join(by_doc, "doc_id", "left").select("doc_id", "verdicts", F.explode(known).alias("token"))
    return every.select("doc_id", "token", allowed(F.col("verdicts"), F.col("token")).alias("allowed"))


def verdicts(groups: DataFrame, path: str = "/") -> DataFrame:
    """``doc_id``, ``verdicts``: map from each agent named (lower case, ``*`` included) to what its first group says of ``path``."""
    judged = groups.select("doc_id", "group_no", F.transform("agents", F.lower).alias("agents"), ((longest(F.col("disallow"), path) < 0) | (longest(F.col("allow"), path) >= longest(F.col("disallow"), path))).alias("ok"))
    named = judged.select("doc_id", "group_no", "ok", F.explode(F.array_distinct("agents")).alias("agent"))
    first = named.groupBy("doc_id", "agent").agg(F.min_by("ok", "group_no").alias("ok"))
    return first.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("agent", "ok"))).alias("verdicts"))


def allowed(verdicts: Column, token: Column) -> Column:
    """What a map of ``verdicts`` (null: no groups) says of a token."""
    return F.coalesce(F.try_element_at(verdicts, F.lower(token)), F.try_element_at(verdicts, F.lit("*")), F.lit(True))
