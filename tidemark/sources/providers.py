"""Readers of provider payloads as frames: price CSV, series and positions JSON, vintages, RSS, question and event lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bars import keep_last

#: The canonical names of price columns.
PRICE_COLUMNS = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close", "Volume": "volume", "Dividends": "dividends", "Stock Splits": "splits"}


def period_date(period: Column) -> Column:
    """A month stands for its last day, anything else for the date that it is."""
    return F.when(F.length(period) == 7, F.last_day(F.to_date(F.concat(period, F.lit("-01"))))).otherwise(period.try_cast("date"))


def price_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars dated on the wall date of their stamp, whatever its zone; the last row of a date stays; columns may be absent."""
    raw = spark.read.option("header", True).csv(path)
    there = [c for c in PRICE_COLUMNS if c in raw.columns]
    rows = raw.select(F.to_date(F.substring("Date", 1, 10)).alias("date"), *[F.col(f"`{c}`").try_cast("double").alias(PRICE_COLUMNS[c]) for c in there], F.monotonically_increasing_id().alias("_seq"))
    return keep_last(rows, ["date"], F.col("_seq").desc()).drop("_seq")


def series_json(spark: SparkSession, path: str) -> DataFrame:
    """(date, value, units, total) of paged responses {response: {total, data: [{period, value, units}]}}; a payload without response is an error."""
    kind = "response struct<total: string, data: array<struct<period: string, value: string, units: string>>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path)
    checked = rows.select(F.when(F.col("response").isNull(), F.raise_error(F.lit("payload has no response")).cast(rows.schema["response"].dataType)).otherwise(F.col("response")).alias("r"))
    flat = checked.select(F.col("r.total").try_cast("long").alias("total"), F.inline("r.data"))
    return flat.select(period_date(F.col("period")).alias("date"), F.col("value").try_cast("double").alias("value"), "units", "total")


def positions_json(spark: SparkSession, path: str, date: str, columns: dict[str, str]) -> DataFrame:
    """An array of objects of number strings as renamed doubles by report date."""
    schema = ", ".join(f"`{c}` string" for c in (date, *columns))
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.to_date(F.substring(F.col(f"`{date}`"), 1, 10)).alias("date"), *[F.col(f"`{c}`").try_cast("double").alias(n) for c, n in columns.items()])


def vintages_json(spark: SparkSession, path: str) -> DataFrame:
    """(date, value, first_published) of observations; a dot is a missing value."""
    rows = spark.read.schema("observations array<struct<realtime_start: string, date: string, value: string>>").option("multiLine", True).json(path)
    flat = rows.select(F.inline("observations"))
    return flat.select(F.to_date("date").alias("date"), F.col("value").try_cast("double").alias("value"), F.to_date("realtime_start").alias("first_published"))


def mail_date(text: Column) -> Column:
    """An RFC 2822 stamp, else an ISO one, in UTC; null for neither."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), text.try_cast("timestamp"))


def rss(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """Items of a feed, newest first; the source falls back to the feed's name."""
    schema = "title string, link string, pubDate string, source string, description string"
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return rows.select(F.trim("title").alias("title"), "link", mail_date(F.col("pubDate")).alias("published"), F.coalesce("source", F.lit(feed)).alias("source"), "description", F.lit(feed).alias("feed")).orderBy(F.col("published").desc_nulls_last())


def headlines(feeds: DataFrame, since: Column) -> DataFrame:
    """One row a title, the first feed's, not older than since, newest first."""
    recent = feeds.filter(F.col("published") >= since)
    return keep_last(recent, ["title"], F.col("feed").asc(), F.col("published").desc(), F.col("link").asc()).orderBy(F.col("published").desc())


def lines_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines and those that start with // are left out."""
    kept = spark.read.text(path).filter(~F.trim("value").startswith("//") & (F.trim("value") != ""))
    return kept.select(F.from_json("value", schema).alias("row")).select("row.*")
