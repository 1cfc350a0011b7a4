"""Queries written once as SQL text for Spark, with the same text in DuckDB's dialect as their check.

Tables are named ``@table`` in the text. Spark gets them as DataFrames bound to the statement, so
nothing is registered in the session; Catalyst prunes columns and pushes filters as for any query.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from tidemark.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]

#: Spark's names and DuckDB's for what the texts use.
DIALECT = (
    (r"\barray_size\(", "len("),
    (r"\bregexp_like\(", "regexp_matches("),
    (r"\barray_join\(", "array_to_string("),
    (r"\barray_sort\(", "list_sort("),
    (r"\barray_distinct\(", "list_distinct("),
    (r"\barray_intersect\(", "list_intersect("),
    (r"\bexplode\(", "unnest("),
    (r"\btransform\(", "list_transform("),
    (r"\bfilter\((?!where)", "list_filter("),
    (r"\b(\w) -> ", r"lambda \1: "),
    (r"\bmonth_of\(([^()]+)\)", r"strftime(\1, '%Y-%m')"),
    (r"\bday_of\(([^()]+)\)", r"cast(\1 as date)"),
    (r"\bseconds_of\(([^()]+)\)", r"cast(floor(epoch(\1)) as bigint)"),
    (r"\bsplit\(", "string_split("),
    (r"\bas string\)", "as varchar)"),
    (r"\bcollect_list\(", "list("),
    (r"\bstruct_of\(([^()]+)\)", r"row(\1)"),
    (r"\bempty_list\(\)", "[]"),
)
SPARK = ((r"\bempty_list\(\)", "cast(array() as array<string>)"), (r"\bmonth_of\(([^()]+)\)", r"date_format(\1, 'yyyy-MM')"), (r"\bday_of\(([^()]+)\)", r"cast(\1 as date)"), (r"\bseconds_of\(([^()]+)\)", r"unix_timestamp(\1)"), (r"\bstruct_of\(([^()]+)\)", r"struct(\1)"))


def spark_text(sql: str) -> str:
    for a, b in SPARK:
        sql = re.sub(a, b, sql)
    sql = sql.replace("{", "{{").replace("}", "}}")
    return re.sub(r"@(\w+)", r"{\1}", sql)


def duck_text(sql: str) -> str:
    for a, b in DIALECT:
        sql = re.sub(a, b, sql)
    return re.sub(r"@(\w+)", r"\1", sql)


def query(sql: str, costly: tuple[str, ...] = (), views: Mapping[str, Query] | None = None) -> Query:
    """A registered query of the text ``sql``. ``costly``: tables whose rows cost enough to spread a small one over the cores; ``views``: names that queries of their own define."""
    names = sorted(set(re.findall(r"@(\w+)", sql)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def named(n: str) -> DataFrame:
            if views and n in views:
                return views[n](spark, sf_dir)
            return spread(table(spark, sf_dir, n)) if n in costly else table(spark, sf_dir, n)

        return spark.sql(spark_text(sql), **{n: named(n) for n in names})

    return run


def literal(text: str) -> str:
    """``text`` as a SQL literal of both dialects; what they would read differently is refused."""
    if "\\" in text or any(ord(c) < 32 for c in text):
        raise ValueError("backslashes and control characters are not allowed")
    return "'" + text.replace("'", "''") + "'"
