"""URL filter by dated lists: an as-of join of captures with list entries.

Dated entries (a pattern of a category is listed, or taken off) become validity intervals. A pattern is a domain, which covers
its subdomains, or a host with the first segment of a path. Every capture is judged by the entries that were active on the day
it was fetched. Captures are first reduced to distinct (host, segment, day); a host that holds a third of all captures is
then no more than a row per segment and day, and the verdicts go back to the captures by a salted join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import table
from sensorloom.operators.ordered import salted_join

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"


def url_parts(captures: DataFrame, url_column: str = "url") -> DataFrame:
    """Add ``host`` (lower case; null where there is none) and ``segment`` (the path's first, or empty)."""
    url = F.coalesce(F.col(url_column), F.lit(""))
    return captures.withColumn("host", F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))).withColumn("segment", F.regexp_extract(url, SEGMENT, 1))


def patterns_of(host: Column, segment: Column) -> Column:
    """The patterns that cover a URL: its host's suffixes of two labels or more (one if it has no more), and host/segment."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(segment == "", suffixes).otherwise(F.array_append(suffixes, F.concat(host, F.lit("/"), segment)))


def validity(entries: DataFrame) -> DataFrame:
    """``pattern, category, since, until`` from dated entries ``pattern, category, day, listed``; until is open (null) for the last.

    An entry holds from its day until the next one of its pattern and category; of several on a day, listing wins. Entries with
    a null in any column are left out.
    """
    days = entries.dropna(subset=["pattern", "category", "day", "listed"]).groupBy("pattern", "category", "day").agg(F.max("listed").alias("listed"))
    after = Window.partitionBy("pattern", "category").orderBy("day")
    return days.withColumn("until", F.lead("day").over(after)).where("listed").select("pattern", "category", F.col("day").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, id_column: str = "page_id", url_column: str = "url", day_column: str = "day") -> DataFrame:
    """One row per capture: ``page_id, host, day, blocked, n_active, pattern, category, since``.

    ``n_active`` counts the (pattern, category) pairs active on the capture's day; of them the longest pattern, then the first
    category, is named. Captures without a host or a day, and all captures if the list is empty, are not blocked.
    """
    rows = url_parts(captures.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(day_column).alias("day")))
    rows = rows.select("page_id", "host", "segment", "day")
    keys = ["host", "segment", "day"]
    asked = rows.where("host IS NOT NULL AND day IS NOT NULL").select(*keys).distinct()
    asked = asked.withColumn("pattern", F.explode(patterns_of(F.col("host"), F.col("segment"))))
    listed = validity(entries)
    active = (asked.pattern == listed.pattern) & (asked.day >= listed.since) & (listed.until.isNull() | (asked.day < listed.until))
    hits = asked.join(listed, active).select(*keys, listed.pattern, "category", "since")
    named = F.struct((-F.length("pattern")).alias("l"), "pattern", "category", "since")
    verdicts = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_active"), F.min(named).alias("first"))
    out = salted_join(rows, verdicts, keys)
    return out.select("page_id", "host", "day", F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0)).alias("n_active"),
                      F.col("first.pattern").alias("pattern"), F.col("first.category").alias("category"), F.col("first.since").alias("since"))


def captures_of(pages: DataFrame) -> DataFrame:
    """The table has no fetch dates: page numbers deal the captures over the days of a year."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("day"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list from the pages' own URLs: a quarter of all patterns is listed, of these some are taken off and listed again."""
    parts = url_parts(pages).where("host IS NOT NULL").select("host", "segment").distinct()
    rows = parts.select(F.explode(patterns_of(F.col("host"), F.col("segment"))).alias("pattern")).distinct()
    h = F.conv(F.substring(F.md5("pattern"), 1, 7), 16, 10).cast("long")
    rows = rows.select("pattern", h.alias("h")).where("h % 4 = 0").withColumn("n", F.floor(F.col("h") / 4))
    category = F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), (F.col("n") % 3 + 1).cast("int"))
    first, stay = F.col("n") % 300, F.floor(F.col("n") / 300) % 90 + 20
    dated = [F.struct(first.alias("at"), F.lit(True).alias("listed")),
             F.when(F.col("n") % 2 == 0, F.struct((first + stay).alias("at"), F.lit(False).alias("listed"))),
             F.when(F.col("n") % 6 == 0, F.struct((first + stay + 15).alias("at"), F.lit(True).alias("listed")))]
    rows = rows.select("pattern", category.alias("category"), F.explode(F.array(*dated)).alias("e")).where("e IS NOT NULL")
    return rows.select("pattern", "category", F.date_add(F.lit("2024-01-01").cast("date"), F.col("e.at").cast("int")).alias("day"), "e.listed")


def op7_temporal_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(captures_of(pages), entries_of(pages))


SQL = rf"""
WITH p AS (SELECT page_id, nullif(lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)), '') AS host, regexp_extract(coalesce(url, ''), '{SEGMENT}', 1) AS segment,
             DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS day FROM pages),
l AS (SELECT *, string_split(host, '.') AS labels FROM (SELECT DISTINCT host, segment, day FROM p WHERE host IS NOT NULL)),
a AS (SELECT host, segment, day, array_to_string(labels[CAST(i AS INTEGER):], '.') AS pattern FROM l, unnest(range(1, greatest(2, len(labels)))) AS u(i)
      UNION ALL SELECT host, segment, day, host || '/' || segment FROM l WHERE segment <> ''),
h AS (SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 7) AS BIGINT) AS h FROM (SELECT DISTINCT pattern FROM a)),
n AS (SELECT pattern, h // 4 AS n, ['adult', 'malware', 'spam'][CAST(h // 4 % 3 + 1 AS INTEGER)] AS category, h // 4 % 300 AS first, h // 4 // 300 % 90 + 20 AS stay
      FROM h WHERE h % 4 = 0),
e AS (SELECT pattern, category, first AS no, true AS listed FROM n UNION ALL SELECT pattern, category, first + stay, false FROM n WHERE n % 2 = 0
      UNION ALL SELECT pattern, category, first + stay + 15, true FROM n WHERE n % 6 = 0),
d AS (SELECT pattern, category, DATE '2024-01-01' + CAST(no AS INTEGER) AS since, listed,
        lead(DATE '2024-01-01' + CAST(no AS INTEGER)) OVER (PARTITION BY pattern, category ORDER BY no) AS until FROM e),
v AS (SELECT host, segment, day, count(*) AS n_active, min({{'l': -length(a.pattern), 'p': a.pattern, 'c': category, 's': since}}) AS first
      FROM a JOIN d ON a.pattern = d.pattern AND listed AND day >= since AND (until IS NULL OR day < until) GROUP BY host, segment, day)
SELECT page_id, p.host, p.day, n_active IS NOT NULL AS blocked, coalesce(n_active, 0) AS n_active, first.p AS pattern, first.c AS category, first.s AS since
FROM p LEFT JOIN v ON p.host = v.host AND p.segment = v.segment AND p.day = v.day"""
