"""Site-relative line dedup: a line that too large a share of a host's pages carry goes.

The pages that carry a line are counted per host, a page once, and divided by the host's
pages; lines above `ratio` that at least `min_pages` pages carry are boilerplate of that host.
Lines are compared without outer blanks; blank lines are no evidence and stay.

Scale: lines travel as (host, 64-bit hash) and are counted before the shuffle. A host has at
most (lines per page / ratio) boilerplate lines, so what goes back to the pages is one small
row per host. It is broadcast if it is measured to be small, otherwise joined by host, where
adaptive execution splits a hot host's pages.

Edge cases: a page is a row, so repeated rows count each time. A null text is empty, null
hosts are one host. An emptied text stays as an empty row. Other columns, whatever their
names, are kept as they are; n_chars, where there is one, follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwell.llm.common import fresh, materialize, read

RATIO = 0.05
MIN_PAGES = 5
BROADCAST_LINES = 100_000  # 8 bytes each


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, hashes): of each host that has any, the hashes of its boilerplate lines."""
    rows = docs.select(F.col(host).alias("host"), F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: _bare(x) != ""), lambda x: F.xxhash64(_bare(x)))).alias("hashes"))
    totals = rows.groupBy("host").agg(F.count("*").alias("pages")).withColumnRenamed("host", "site")
    counts = rows.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = counts.join(totals, F.col("host").eqNullSafe(F.col("site"))).where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return often.groupBy("host").agg(F.array_sort(F.collect_list("hash")).alias("hashes"))


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with boilerplate lines cut from text, and two columns more: n_lines and n_removed."""
    found = materialize(boilerplate(docs, host, ratio, min_pages), "boilerplate")
    lines = found.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    site, bad, all_lines, kept, hit = (fresh(docs, x) for x in ("site", "bad", "lines", "kept", "hit"))
    found = found.toDF(site, bad)
    if lines <= BROADCAST_LINES:
        found = F.broadcast(found)
    joined = docs.join(found, F.col(host).eqNullSafe(F.col(site)), "left").withColumn(all_lines, _lines(F.col("text")))
    # a page's own boilerplate first, by sets: a line is then not looked for among all of the host's
    joined = joined.withColumn(hit, F.array_intersect(F.transform(all_lines, lambda x: F.xxhash64(_bare(x))), bad))
    joined = joined.withColumn(kept, F.when(F.coalesce(F.size(hit), F.lit(0)) <= 0, F.col(all_lines)).otherwise(F.filter(all_lines, lambda x: (_bare(x) == "") | ~F.array_contains(hit, F.xxhash64(_bare(x))))))
    text = F.concat_ws("\n", kept)
    columns = [text.alias(c) if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return joined.select(*columns, F.size(all_lines).cast("long").alias("n_lines"), (F.size(all_lines) - F.size(kept)).cast("long").alias("n_removed"))


def host_of(url: Column) -> Column:
    """The host of a url, lower case, without user, port and a leading www; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    return drop_boilerplate(docs)


OP3_SQL = f"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS page FROM documents),
lines AS (SELECT page, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs),
bare AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS b FROM lines),
pages AS (SELECT source, count(*) AS pages FROM docs GROUP BY source),
counts AS (SELECT source, b, count(DISTINCT page) AS n FROM bare WHERE b <> '' GROUP BY source, b),
bad AS (SELECT c.source, c.b FROM counts c JOIN pages p ON c.source IS NOT DISTINCT FROM p.source WHERE c.n >= {MIN_PAGES} AND c.n > {RATIO} * p.pages),
marked AS (SELECT bare.*, bad.b IS NOT NULL AS gone FROM bare LEFT JOIN bad ON bare.source IS NOT DISTINCT FROM bad.source AND bare.b = bad.b)
SELECT d.doc_id, d.source, coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (NOT m.gone), '') AS text,
       CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (m.gone) AS BIGINT) AS n_removed
FROM docs d JOIN marked m ON d.page = m.page GROUP BY d.page, d.doc_id, d.source
"""
