"""Column functions over dotted names, paths, globs and tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segments(name: Column) -> Column:
    return F.split(name, r"\.")


def prefixes(name: Column) -> Column:
    """All prefixes of a dotted name, itself included, shortest first."""
    s = segments(name)
    return F.transform(F.sequence(F.lit(1), F.size(s)), lambda n: F.array_join(F.slice(s, 1, n), "."))


def last_segment(name: Column) -> Column:
    return F.element_at(segments(name), -1)


def has_token(text: Column, token: Column) -> Column:
    """Whether ``token`` stands in ``text`` as a maximal run of [A-Za-z0-9_]; null if either is."""
    return F.array_contains(F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+)"), F.lit(1)), token)


def glob_regex(pattern: str) -> str:
    """``**`` crosses directories, ``*`` and ``?`` do not."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return f"^{out}$"


def owner_rule_regex(pattern: str) -> str:
    """An ownership file's pattern: anchored if it has a slash before its end, a directory if it ends with one; what it names it holds."""
    body = pattern.strip("/")
    start = "^" if "/" in pattern.rstrip("/") else "^(?:.*/)?"
    inner = glob_regex(body)[1:-1]
    return start + inner + ("/.*$" if pattern.endswith("/") else "(?:/.*)?$" if not body.endswith("*") else "$")


def normal_path(path: Column) -> Column:
    """Without "." steps, with ".." folded."""
    step = lambda done, x: F.when((x == ".") | (x == ""), done).when((x == "..") & (F.size(done) > 0), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), step), "/")


def nearest(wanted: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """(key, nearest): for each distinct ``key``, the name of least edit distance, the first in order among equals.

    Lengths differ by no more than the distance, so names are joined by length: first those of about the key's length, then, of
    keys without a name so near, those of lengths that could still be as near as the best so far.
    """
    keys = wanted.select(F.col(key).alias("_key")).filter("_key IS NOT NULL").distinct().withColumn("_n", F.length("_key"))
    known = names.select(F.col(name).alias("_name")).distinct().withColumn("_n", F.length("_name"))
    longest = known.agg(F.max("_n")).first()[0]
    if longest is None:
        return keys.select(F.col("_key").alias(key), F.lit(None).cast("string").alias("nearest"))

    def best(rows: DataFrame, lengths) -> DataFrame:
        met = rows.select("_key", F.explode(lengths).alias("_n")).join(known, "_n")
        return met.groupBy("_key").agg(F.min(F.struct(F.levenshtein("_key", "_name").alias("d"), F.col("_name"))).alias("b"))

    near = keys.join(best(keys, F.sequence(F.col("_n") - 1, F.col("_n") + 1)), "_key", "left")
    far = near.filter("b IS NULL OR b.d > 1").withColumn("_reach", F.coalesce("b.d", F.greatest("_n", F.lit(longest)))).drop("b")
    rest = best(far, F.filter(F.sequence(F.greatest(F.lit(0), F.col("_n") - F.col("_reach")), F.least(F.lit(longest), F.col("_n") + F.col("_reach"))), lambda n: F.abs(n - F.col("_n")) > 1))
    both = near.select("_key", "b").join(rest.withColumnRenamed("b", "c"), "_key", "left")
    return both.select(F.col("_key").alias(key), F.least("b", "c")["_name"].alias("nearest"))
