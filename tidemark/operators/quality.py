"""Data-quality checks: pure, one table of issues (symbol, check, severity, date, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import island, previous
from tidemark.sources.written import Written

from . import calendars

#: Ratios of share splits that a price step is compared with.
SPLITS = (2, 3, 4, 5, 8, 10, 20, 25, 50)


def issue(rows: DataFrame, check: str, severity: str, detail: Column | None = None) -> DataFrame:
    return rows.select("symbol", F.lit(check).alias("check"), F.lit(severity).alias("severity"), "date", (detail if detail is not None else F.lit(None)).cast("double").alias("detail"))


def missing_values(bars: DataFrame) -> DataFrame:
    return issue(bars.filter("open is null or high is null or low is null or close is null"), "missing_values", "warn")


def ohlc_inconsistent(bars: DataFrame) -> DataFrame:
    top, low, size = F.greatest("open", "high", "low", "close"), F.least("open", "high", "low", "close"), F.greatest(*[F.abs(c) for c in ("open", "high", "low", "close")])
    return issue(bars.filter((F.col("high") + 1e-6 * size < top) | (F.col("low") - 1e-6 * size > low)), "ohlc_inconsistent", "warn")


def nonpositive_price(bars: DataFrame) -> DataFrame:
    return issue(bars.filter("close <= 0"), "nonpositive_price", "warn", F.col("close"))


def zero_volume(bars: DataFrame) -> DataFrame:
    return issue(bars.filter("volume = 0"), "zero_volume", "warn")


def expected_sessions(bars: DataFrame, calendar: str = "cme") -> DataFrame:
    edge = bars.groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return edge.select("symbol", F.explode(calendars.sessions(F.col("first"), F.col("last"), calendar)).alias("date"))


def missing_sessions(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    return issue(sessions.join(bars.select("symbol", "date"), ["symbol", "date"], "left_anti"), "missing_sessions", "info")


def unexpected_sessions(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    return issue(bars.join(sessions, ["symbol", "date"], "left_anti"), "unexpected_sessions", "info")


def gaps(bars: DataFrame, sessions: DataFrame, most: int = 2) -> DataFrame:
    """Runs of more than so many absent sessions, dated on their first."""
    marked = sessions.join(bars.select("symbol", "date", F.lit(True).alias("there")), ["symbol", "date"], "left")
    runs = marked.withColumn("run", island(F.col("there").isNull())).filter("there is null").groupBy("symbol", "run").agg(F.min("date").alias("date"), F.count(F.lit(1)).alias("n"))
    return issue(runs.filter(F.col("n") > most), "gap", "warn", F.col("n"))


def repeated_close(bars: DataFrame, least: int = 4) -> DataFrame:
    same = bars.withColumn("same", F.coalesce(F.col("close") == previous("close"), F.lit(False)))
    runs = same.withColumn("run", island(F.col("same"))).filter("same").groupBy("symbol", "run").agg(F.min("date").alias("date"), (F.count(F.lit(1)) + 1).alias("n"))
    return issue(runs.filter(F.col("n") >= least), "repeated_close", "warn", F.col("n"))


def stale(bars: DataFrame, today: Column, most: int = 3, calendar: str = "cme") -> DataFrame:
    last = bars.groupBy("symbol").agg(F.max("date").alias("date"))
    between = F.size(calendars.sessions(F.date_add("date", 1), F.date_sub(today, 1), calendar))
    return issue(last.withColumn("n", between).filter(F.col("n") > most), "stale_data", "warn", F.col("n"))


def rolls(found: DataFrame) -> DataFrame:
    """The detected rolls: those dated by volume, and those whose whole window is masked as no jump was seen."""
    dated = found.withColumn("date", F.coalesce("roll_date", "expiry"))
    return issue(dated.filter("method = 'volume'"), "rolls", "info").unionByName(issue(dated.filter("method = 'window' and not provisional"), "rolls_unclear", "warn"))


def empty(symbols: DataFrame, bars: DataFrame) -> DataFrame:
    """Symbols without a bar."""
    return issue(symbols.select("symbol").distinct().join(bars.select("symbol"), "symbol", "left_anti").withColumn("date", F.lit(None).cast("date")), "empty", "error")


def by_check(issues: DataFrame, dates: int = 20) -> DataFrame:
    """(symbol, check, severity, n, ok, dates): the first dates of each check; ok unless an error."""
    at = F.row_number().over(Window.partitionBy("symbol", "check").orderBy("date"))
    listed = F.array_sort(F.collect_list(F.when(F.col("_at") <= dates, F.col("date"))))
    return issues.withColumn("_at", at).groupBy("symbol", "check", "severity").agg(F.count(F.lit(1)).alias("n"), listed.alias("dates")).withColumn("ok", F.col("severity") != "error")


def outliers(returns: DataFrame, sigmas: float = 10.0, least: int = 30) -> DataFrame:
    """Returns beyond so many robust deviations of their symbol."""
    middle = returns.groupBy("symbol").agg(F.percentile("ret", 0.5).alias("mid"), F.count("ret").alias("n"))
    apart = returns.join(middle, "symbol")
    mad = apart.groupBy("symbol").agg(F.percentile(F.abs(F.col("ret") - F.col("mid")), 0.5).alias("mad"))
    found = apart.join(mad, "symbol").filter((F.col("n") > least) & (F.col("mad") > 0) & (F.abs("ret") > sigmas * 1.4826 * F.col("mad")))
    return issue(found, "outlier_return", "info", F.col("ret"))


def split_suspects(returns: DataFrame, tolerance: float = 0.02) -> DataFrame:
    step = F.exp("ret")
    near = F.lit(False)
    for n in SPLITS:
        for ratio in (float(n), 1.0 / n):
            near = near | (F.abs(step / ratio - 1) <= tolerance)
    return issue(returns.filter("ret is not null").filter(near), "split_suspect", "warn", step)


def report(bars: DataFrame, returns: DataFrame, today: Column, calendar: str = "cme", calendar_of: DataFrame | None = None) -> DataFrame:
    """All issues of all symbols; calendar_of (symbol, calendar) says whose sessions each symbol keeps, else all keep those of one calendar."""
    names = [calendar] if calendar_of is None else sorted({*calendars.EXCHANGES.values(), calendar})
    own = {n: bars if calendar_of is None else bars.join(calendar_of.filter(F.col("calendar") == n), "symbol", "left_semi") for n in names}
    sessions = reduce(DataFrame.unionByName, [expected_sessions(rows, n) for n, rows in own.items()])
    sessions = Written(bars.sparkSession, "sessions").save(sessions, "expected")  # three checks read it
    parts = [missing_values(bars), ohlc_inconsistent(bars), nonpositive_price(bars), zero_volume(bars), missing_sessions(bars, sessions), unexpected_sessions(bars, sessions), gaps(bars, sessions), repeated_close(bars)]
    parts += [*(stale(rows, today, calendar=n) for n, rows in own.items()), outliers(returns), split_suspects(returns)]
    return reduce(DataFrame.unionByName, parts)
