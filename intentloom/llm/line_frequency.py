"""Quality rules: cross-document line frequency.

A line that many documents of one host share is furniture, not content. Lines are normalised (lower case,
digits as 0, runs of blanks as one, trimmed) and hashed; for each host the distinct documents
that contain a line are counted, where byte-identical documents are one. A line of more than
``max(MIN_DOCS, min(MAX_SHARE x docs, ROOT x sqrt(docs)))`` of the host's ``docs`` distinct documents is removed from all of them (the limit
is a share of a small host, and grows with the root of a large one), and a
document of which less than ``MIN_KEPT`` of the characters remains is rejected.

All of it are built-in expressions: one aggregation of hashes, then a scan with a join by host. The table of removed lines is
broadcast if its measured size allows; else documents travel to it, those of a host with many documents by several
ways (``SALTED``), each with its copy of the host's lines.

Result: the documents that stay, with all their columns; ``text`` without the removed lines, ``n_chars`` (if
there is one) set to its new length where lines were removed.

Defined results: the host is ``source``, a null one counts as ''; a null or empty text has no lines, stays
as it is and is kept; empty lines are never counted nor removed; copies, repeated rows and
rows without doc_id are treated by their text alone; other columns pass through, whatever their names; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

MIN_DOCS, MAX_SHARE, ROOT, MIN_KEPT = 5, 0.01, 5.0, 0.2
#: hashes (8 bytes each) up to which the table of removed lines is broadcast
BROADCAST_HASHES = 4_000_000
#: documents of a host that go one way; at least a ten-thousandth of all, so there are no more salted hosts than that
SALTED, MOST_SALTED = 100_000, 10_000


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def normalised(text: Column) -> Column:
    """The text's lines, normalised. All but the trimming is done on the whole text at once; a single blank matches nothing, so most texts stay as they are."""
    plain = F.translate(F.lower(text), "123456789", "000000000")
    return F.transform(lines(F.regexp_replace(plain, r"[ \t\r\f]{2,}|[\t\r\f]", " ")), lambda x: F.trim(x))


def line_frequency_rules(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    host = F.coalesce(F.col("source").cast("string"), F.lit(""))
    hashed = F.transform(F.filter(normalised(text), lambda x: x != ""), lambda x: F.xxhash64(x))
    per_text = documents.select(host.alias("host"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("copy"), F.array_distinct(hashed).alias("lines"))
    totals = per_text.select("host", "copy").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    counts = per_text.select("host", "copy", F.explode("lines").alias("line")).distinct().groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > MIN_DOCS)
    limit = F.greatest(F.lit(float(MIN_DOCS)), F.least(MAX_SHARE * F.col("docs"), ROOT * F.sqrt("docs")))
    totals = scratch.materialise(totals, "hosts")
    above = counts.join(totals, "host").filter(F.col("n") > limit)
    furniture = scratch.materialise(above.groupBy("host").agg(F.array_sort(F.collect_list("line")).alias("removed")), "furniture")
    size = furniture.agg(F.sum(F.size("removed"))).first()[0] or 0
    key, removed, kept, salt = (scratch.fresh(documents, n) for n in ("host__", "removed__", "kept__", "salt__"))
    table = furniture.select(F.col("host").alias(key), F.col("removed").alias(removed))
    keyed = documents.withColumn(key, host)
    if size <= BROADCAST_HASHES:
        joined = keyed.join(F.broadcast(table), key, "left")
    else:
        way = max(SALTED, (totals.agg(F.sum("docs")).first()[0] or 0) // MOST_SALTED)
        ways = F.broadcast(totals.filter(F.col("docs") > way).select(F.col("host").alias(key), F.ceil(F.col("docs") / way).alias(salt)))
        table = table.join(ways, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(salt), F.lit(1)) - 1)))
        keyed = keyed.join(ways, key, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(text), F.col(salt)), F.lit(0)))
        joined = keyed.join(table, [key, salt], "left")
    # a removed line is null, which is left out when they are joined
    stays = F.zip_with(lines(text), F.transform(normalised(text), lambda x: F.xxhash64(x)), lambda x, h: F.when(~F.coalesce(F.array_contains(F.col(removed), h), F.lit(False)), x))
    joined = joined.withColumn(kept, F.when(F.col(removed).isNotNull() & text.isNotNull(), F.array_join(stays, "\n")))
    changed = F.col(kept).isNotNull() & (F.col(kept) != text)
    out = joined.filter(~F.coalesce(changed & (F.length(kept) < MIN_KEPT * F.length(text)), F.lit(False)))
    new = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(changed, F.length(kept)).otherwise(F.col("n_chars")).cast(documents.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in documents.columns])


_NORMAL = r"trim(regexp_replace(translate(lower(x), '123456789', '000000000'), '[ \t\r\f]+', ' ', 'g'))"
SQL = f"""
WITH d AS (SELECT *, coalesce(source, '') AS host, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT DISTINCT host, coalesce(text, '') AS t, unnest(list_transform(lines, lambda x: {_NORMAL})) AS k FROM d),
c AS (SELECT host, k, count(*) AS n FROM l WHERE k <> '' GROUP BY host, k),
h AS (SELECT host, count(DISTINCT coalesce(text, '')) AS docs FROM d GROUP BY host),
b AS (SELECT host, list(k) AS ks FROM c JOIN h USING (host) WHERE n > greatest({MIN_DOCS}, least({MAX_SHARE} * docs, {ROOT} * sqrt(docs))) GROUP BY host),
r AS (SELECT d.*, CASE WHEN ks IS NULL THEN text ELSE array_to_string(list_filter(lines, lambda x: NOT list_contains(ks, {_NORMAL})), chr(10)) END AS kept
      FROM d LEFT JOIN b USING (host))
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE kept END AS text, lang, source,
       CASE WHEN text IS NOT NULL AND kept <> text THEN length(kept) ELSE n_chars END AS n_chars
FROM r WHERE text IS NULL OR kept = text OR length(kept) >= {MIN_KEPT} * length(text)
"""
