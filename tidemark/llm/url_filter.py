"""URL filters: captures against dated host lists, as of the time they were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sent

#: Captures of a host meet only list entries of their own year.
SLICE = "year"


def validity(entries: DataFrame, horizon) -> DataFrame:
    """entry_host, listed_from, listed_to, category: when each host was on the list.

    entries: host, listed_on (date), action ('add' or 'remove'), category. An entry holds until the next of its host;
    the last holds to horizon. Of entries of one host and day a removal wins, then the least category.
    """
    day = Window.partitionBy("entry_host", "listed_on").orderBy((F.col("action") == "remove").desc(), "category")
    on = Window.partitionBy("entry_host").orderBy("listed_on")
    return (
        entries.select(F.lower("host").alias("entry_host"), "listed_on", "action", "category")
        .where(F.col("entry_host").isNotNull() & F.col("listed_on").isNotNull() & F.col("action").isin("add", "remove"))
        .withColumn("k", F.row_number().over(day)).where("k = 1")
        .withColumn("listed_to", F.coalesce(F.lead("listed_on").over(on), F.lit(horizon).cast("date")))
        .where("action = 'add'")
        .select("entry_host", F.col("listed_on").alias("listed_from"), "listed_to", "category")
        .where("listed_from < listed_to")
    )


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port or last dot; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1)), F.lit(""))


def domains(host: Column) -> Column:
    """The host and the domains above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def blocked_as_of(captures: DataFrame, entries: DataFrame, horizon="2100-01-01") -> DataFrame:
    """page_id, host, fetched_on, blocked, matched, category, listed_from; a row for each capture.

    captures: page_id, url, fetched_on (date). A capture is blocked if its host or a domain above it was listed on
    the day it was fetched: listed_from <= fetched_on < listed_to. The most specific listed domain is reported.
    Intervals are dealt out by host and calendar year, so a capture meets only entries near its time.

    Captures of one host and day are judged once. Of the domains above a host, those that no entry names are dropped
    before anything is dealt out, so that all captures under one suffix never meet.

    Null or odd url: host null, not blocked. Null date: not blocked. Null, repeated page_id: each row for itself, also
    where all of it repeats. Repeated entries count once. Empty list: nothing blocked. Empty captures: no rows.
    Other columns are left out, whatever their names.
    """
    held = captures.select(captures["page_id"].alias("page_id"), host_of(captures["url"]).alias("host"), captures["fetched_on"].cast("date").alias("fetched_on"))
    listed = validity(entries, horizon)
    last = F.lit(horizon).cast("date")
    years = F.sequence(F.year("listed_from"), F.year(F.least(F.col("listed_to"), last)))
    sliced = listed.select("*", F.explode(years).alias("slice"))
    asked = held.where(F.col("host").isNotNull() & F.col("fetched_on").isNotNull()).select("host", "fetched_on").distinct()
    asked = asked.select("host", "fetched_on", F.year("fetched_on").alias("slice"), F.explode(domains(F.col("host"))).alias("entry_host"))
    asked = asked.join(sent(listed.select("entry_host").distinct()), "entry_host", "left_semi")
    best = F.max(F.struct(F.length("entry_host").alias("l"), F.col("entry_host").alias("matched"), "category", "listed_from")).alias("best")
    met = (
        asked.join(sliced, ["entry_host", "slice"]).where("listed_from <= fetched_on and fetched_on < listed_to")
        .groupBy(F.col("host").alias("h"), F.col("fetched_on").alias("f")).agg(best)
    )
    return held.join(met, (F.col("host") == F.col("h")) & (F.col("fetched_on") == F.col("f")), "left").select(
        "page_id", "host", "fetched_on", F.col("best").isNotNull().alias("blocked"), F.col("best.matched").alias("matched"), F.col("best.category").alias("category"), F.col("best.listed_from").alias("listed_from")
    )


# Fixed list of this query: host, day, action, category.
LIST = [
    ("spam-farm.example.org", "2020-01-01", "add", "spam"),
    ("spam-farm.example.org", "2021-06-01", "remove", "spam"),
    ("spam-farm.example.org", "2022-03-01", "add", "spam"),
    ("cheap-pills.example.com", "2020-09-15", "add", "pharma"),
    ("free-bets.example.com", "2021-01-01", "add", "gambling"),
    ("free-bets.example.com", "2023-01-01", "remove", "gambling"),
    ("ads-track.example.org", "2019-01-01", "add", "ads"),
    ("example.net", "2022-12-01", "add", "network"),
    ("example.net", "2022-12-20", "remove", "network"),
]
FIRST_DAY, DAYS = "2020-01-01", 1461


def op2_url_filter(pages: DataFrame) -> DataFrame:
    """The pages carry no fetch time; a day of the four years from FIRST_DAY is dealt by page_id."""
    spark = pages.sparkSession
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id") * 37, F.lit(DAYS)).cast("int"))
    entries = spark.createDataFrame(LIST, "host string, listed_on string, action string, category string").withColumn("listed_on", F.to_date("listed_on"))
    return blocked_as_of(pages.select("page_id", "url", day.alias("fetched_on")), entries)


SQL = rf"""
WITH e(host, listed_on, action, category) AS (VALUES {", ".join(f"('{h}', DATE '{d}', '{a}', '{c}')" for h, d, a, c in LIST)}),
v AS (SELECT host, listed_on AS listed_from, coalesce(lead(listed_on) OVER (PARTITION BY host ORDER BY listed_on), DATE '2100-01-01') AS listed_to, action, category FROM e),
p AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
  (DATE '{FIRST_DAY}' + ((page_id * 37) % {DAYS})::INTEGER)::DATE AS fetched_on FROM pages),
m AS (SELECT page_id, max_by(v.host, length(v.host)) AS matched, max_by(category, length(v.host)) AS category, max_by(listed_from, length(v.host)) AS listed_from
  FROM p JOIN v ON (p.host = v.host OR ends_with(p.host, '.' || v.host)) AND listed_from <= fetched_on AND fetched_on < listed_to AND action = 'add' GROUP BY page_id)
SELECT p.page_id, p.host, fetched_on, matched IS NOT NULL AS blocked, matched, category, listed_from FROM p LEFT JOIN m USING (page_id)
"""
