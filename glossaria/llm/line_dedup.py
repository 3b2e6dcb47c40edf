"""Boilerplate lines by their frequency within a site.

For every host the pages that contain a line are counted and divided by the
host's pages; lines above ``ratio`` are dropped from all pages of the host. A
line on one page alone repeats nothing and stays, whatever the ratio is. Pages
with identical text are one page here, so a page that was copied many times does
not turn into boilerplate.
Lines are compared without the spaces around them; blank lines stay.

Only hashes of lines are shuffled. The lines to drop are at most
``lines per page / ratio`` for each host; they form one array per host, which
joins the documents by host. Spark broadcasts that table where its files are
below the session's threshold and splits hot hosts in the shuffled join else.

Null text stays null (no lines); empty text has one blank line. A null host is
a host. Repeated rows are one page and all come back. Other columns pass
through; a column named like an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaria.llm.common import let
from glossaria.sources.shared import materialize


def lines_of(text: str) -> Column:
    return F.split(F.col(text), "\n")


def line_hashes(text: str) -> Column:
    """Hashes of the distinct lines that are not blank."""
    full = F.filter(F.transform(lines_of(text), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.transform(full, lambda x: F.xxhash64(x)))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.05) -> DataFrame:
    """Columns ``host`` and ``lines``: hashes of the boilerplate lines of each host that has any."""
    page = docs.select(F.col(host).alias("host"), F.xxhash64(text, F.reverse(text)).alias("page"), line_hashes(text).alias("hashes"))
    total = page.where(F.col("hashes").isNotNull()).select("host", "page").distinct()
    total = total.groupBy(F.col("host").alias("of_host")).agg(F.count(F.lit(1)).alias("pages"))
    seen = page.select("host", "page", F.explode("hashes").alias("line")).distinct()
    seen = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    over = seen.join(total, F.col("host").eqNullSafe(F.col("of_host"))).where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return over.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.05) -> DataFrame:
    """All rows with the boilerplate lines taken out of ``text``, and ``n_lines``, ``n_dropped``."""
    table = materialize(boilerplate(docs, host, text, ratio), "boilerplate")
    table = table.select(F.col("host").alias("__host"), F.col("lines").alias("__lines"))
    docs = docs.drop("n_lines", "n_dropped", "__host", "__lines", "__cut")
    columns = [F.col("__cut.text").alias(text) if c == text else F.col(c) for c in docs.columns]

    def cut(lines: Column) -> Column:
        kept = F.filter(lines, lambda x: ~F.array_contains("__lines", F.xxhash64(F.trim(x))) | (F.trim(x) == ""))
        kept = F.when(F.col("__lines").isNull(), lines).otherwise(kept)
        return let(
            kept,
            lambda k: F.struct(
                F.array_join(k, "\n").alias("text"),
                F.size(lines).cast("bigint").alias("n_lines"),
                (F.size(lines) - F.size(k)).cast("bigint").alias("n_dropped"),
            ),
        )

    joined = docs.join(table, F.col(host).eqNullSafe(F.col("__host")), "left")
    joined = joined.withColumn("__cut", F.when(F.col(text).isNotNull(), let(lines_of(text), cut)))
    counts = [F.coalesce(F.col(f"__cut.{c}"), F.lit(0)).cast("bigint").alias(c) for c in ("n_lines", "n_dropped")]
    return joined.select(*columns, *counts)


ORACLE_SQL = """
with page as (
  select distinct source, text from documents where text is not null),
total as (select source, count(*) as pages from page group by source),
line as (
  select source, line, count(*) as n from (
    select distinct source, text, trim(unnest(string_split(text, chr(10)))) as line from page)
  where line <> '' group by source, line),
drops as (
  select line.source, line.line from line join total on line.source is not distinct from total.source
  where n > 1 and n > cast(0.05 as double) * pages),
numbered as (
  select doc_id, source, text, string_split(text, chr(10)) as lines from documents),
marked as (
  select doc_id, i, lines[i] as line, d.line is not null as dropped
  from (select doc_id, source, lines, unnest(range(1, len(lines) + 1)) as i from numbered) n
  left join drops d on d.source is not distinct from n.source and d.line = trim(n.lines[n.i]))
select doc_id, coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '') as text,
  cast(count(*) as bigint) as n_lines, cast(count(*) filter (where dropped) as bigint) as n_dropped
from marked group by doc_id
"""
