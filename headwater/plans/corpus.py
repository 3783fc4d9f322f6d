"""A plain markdown corpus made from stored headings, the same in Spark and in SQL.

Every heading of a record becomes an ATX heading and a body; every third body begins with a fenced
comment that looks like a heading, and bodies grow up to several hundred pieces.  It lets SQL say
what structural operators have to find without parsing anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAP = "```\n# not a heading\n```\n\n"
WORDS = "alpha beta gamma delta "


def derived(records: DataFrame) -> DataFrame:
    """(record_id, source, meta, titles, levels, content) of the records with stored headings."""
    rows = records.where(F.size("headings") > 0)
    titles = F.transform("headings", lambda h, i: F.concat(F.lit("Part "), (i + 1).cast("string"), F.lit(" "), F.trim(F.regexp_replace(h["text"], "[^A-Za-z ]", ""))))
    rows = rows.select("record_id", "source", "meta", F.transform(titles, lambda t: F.trim(t)).alias("titles"), F.transform("headings", lambda h: h["level"]).alias("levels"))
    part = F.transform(
        "titles",
        lambda t, i: F.concat(
            F.repeat(F.lit("#"), F.get("levels", i)), F.lit(" "), t, F.lit("\n\n"), F.when(i % 3 == 2, F.lit(TRAP)).otherwise(F.lit("")), F.lit("Body of "), t, F.lit(": "), F.repeat(F.lit(WORDS), (F.col("record_id") % 7 * (i + 1) * 5).cast("int")), F.lit("end.")
        ),
    )
    return rows.withColumn("content", F.array_join(part, "\n\n"))


#: The same in DuckDB: a common table expression d(record_id, source, meta, titles, levels, content).
SQL = """
    with base as (
        select record_id, source, meta, [h.level for h in headings] as levels,
               list_transform(headings, lambda h, i: trim(concat('Part ', i, ' ', trim(regexp_replace(h.text, '[^A-Za-z ]', '', 'g'))))) as titles
        from raw_documents where len(headings) > 0
    ), d as (
        select *, array_to_string(list_transform(titles, lambda t, i: concat(
            repeat('#', levels[i]), ' ', t, chr(10), chr(10), case when (i - 1) % 3 = 2 then concat('```', chr(10), '# not a heading', chr(10), '```', chr(10), chr(10)) else '' end,
            'Body of ', t, ': ', repeat('alpha beta gamma delta ', cast(record_id % 7 * i * 5 as int)), 'end.')), concat(chr(10), chr(10))) as content
        from base
    )
"""
