"""Queries of positions, references, evidence and ranges over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import content, registry
from tidemark.operators import decisions, evaluate, indicators, regimes, reports, services, snapshots, text
from tidemark.sources import news, ranges
from tidemark.sources.written import Written
from tidemark.sources.tables import table

from .catalog import register
from .series import AVAILABLE, POSITIONS, RETURNS, available, c, day_returns, guard, over

# reports on a Tuesday are out on the Friday, those of March three weeks later, behind newer ones
PUBLIC = f"""p AS ({POSITIONS}), r AS (
  SELECT symbol, date, long - short AS net, (long - short) / open_interest AS share, date + CASE WHEN month(date) = 3 THEN 24 ELSE 3 END AS public FROM p)"""


def public_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(c("l_returnflag").alias("symbol"), F.date_add(F.to_date(F.date_trunc("week", "l_shipdate")), 1).alias("date"))
    side = lambda s: F.sum(F.when(c("l_linestatus") == s, c("l_quantity")).otherwise(0.0))
    rows = lines.agg(side("O").alias("long"), side("F").alias("short"), F.sum("l_quantity").alias("open_interest"))
    return rows.withColumn("available_at", F.date_add("date", F.when(F.month("date") == 3, 24).otherwise(3)).cast("timestamp_ntz"))


@register("positions_at", f"""WITH {PUBLIC}, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS t FROM orders),
k AS (
  SELECT r.symbol, t, r.date, net, share, public, row_number() OVER (PARTITION BY r.symbol, t ORDER BY r.date DESC) AS back
  FROM d JOIN r ON public <= t),
l AS (SELECT *, first_value(net) OVER (PARTITION BY symbol, t ORDER BY back) AS last FROM k WHERE back <= 156)
SELECT symbol, t, max(date) AS report_date, max(public) FILTER (back = 1) AS released, round(max(net) FILTER (back = 1), 4) AS net, round(max(share) FILTER (back = 1), 6) AS share,
       round(max(net) FILTER (back = 1) - max(net) FILTER (back = 2), 4) AS change,
       round(CASE WHEN count(*) >= 78 THEN 100.0::DOUBLE * (count(*) FILTER (net < last) + 0.5 * (count(*) FILTER (net = last) - 1)) / (count(*) - 1) END, 6) AS pctile
FROM l GROUP BY symbol, t""")
def positions_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of positions at every day of every symbol."""
    rows = public_reports(spark, sf_dir)
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").cast("timestamp_ntz").alias("t")).distinct()
    found = services.positions_at(rows, days.crossJoin(rows.select("symbol").distinct()))  # three symbols
    p = c("positions")
    return found.select(
        "symbol", F.to_date("t").alias("t"), p.report_date.alias("report_date"), F.to_date(p.released_at).alias("released"), F.round(p.net, 4).alias("net"),
        F.round(p.share, 6).alias("share"), F.round(p.change, 4).alias("change"), F.round(p.pctile, 6).alias("pctile"),
    )


def nested(value: str, props: str) -> F.Column:
    """A payload with objects in lists in objects, around an event's own numbers."""
    v = c(value).cast("string")
    return F.concat(
        F.lit('{"a": {"list": [{"name": "x", "v": '), v, F.lit('}, {"name": 7.0, "v": [1, '), v, F.lit(', "last \\"one\\""]}], "move_pctile": '), F.lit("55}, \"p\": "), c(props),
        F.lit(', "rate": {"units": "%", "now": '), v, F.lit('}, "bad": {"error": "no 99", "was": 99}, "result_id": 12345}'),
    )


@register("reference_answers", """
SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) WHEN 1 THEN value WHEN 2 THEN value END AS value,
       CASE event_id % 5 WHEN 3 THEN 'last \\"one\\"' WHEN 4 THEN CASE WHEN value > 50 THEN 'yes' ELSE 'no' END END AS choice
FROM events""")
def reference_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field by key, by a list's field, by place, by place from the end, and a comparison, one for each event."""
    rows = table(spark, sf_dir, "events").select(c("event_id").alias("id"), "value", "props")
    which = c("id") % 5
    path = F.when(which == 0, "p.k").when(which == 1, "a.list[name=x].v").when(which == 2, "a.list[name=7].v[1]").when(which == 3, "a.list[-1].v[2]")
    none = F.lit(None).cast("string")
    questions = rows.select(
        "id", F.when(which == 4, "compare").otherwise("field").alias("kind"), F.when(which < 4, "t").alias("tool"), path.alias("path"),
        F.when(which == 4, "a.list[0].v").alias("a"), F.when(which == 4, "t").alias("a_tool"), F.lit(">").alias("op"), none.alias("b"), none.alias("b_tool"), F.lit(50.0).alias("b_value"),
    )
    return reports.reference_answers(questions, rows.select("id", F.lit("t").alias("tool"), nested("value", "props").alias("payload")))


@register("json_evidence", """
SELECT event_id, 7::INT AS numbers, 2::INT AS percentages, 3::INT AS strings, round(4 * value + 63 + CAST(json_extract_string(props, '$.k') AS DOUBLE) - value, 4) AS total FROM events""")
def json_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, percentages and strings that an event's payload holds as evidence."""
    rows = table(spark, sf_dir, "events").select("event_id", text.json_leaves(nested("value", "props")).alias("l"))
    count = lambda f: F.size(F.filter("l", f))
    total = F.aggregate("l", F.lit(0.0), lambda s, x: s + F.coalesce(x.v, F.lit(0.0)))
    return rows.select("event_id", count(lambda x: x.v.isNotNull()).alias("numbers"), count(lambda x: x.raw_percent).alias("percentages"), count(lambda x: x.s.isNotNull()).alias("strings"), F.round(total, 4).alias("total"))


# every customer's orders stand for a cached series: what it covers, when it was last fetched, and what is asked of it now
@register("ranges_to_fetch", """WITH held AS (
  SELECT o_custkey AS key, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders WHERE o_custkey % 7 <> 0 GROUP BY 1),
asked AS (
  SELECT DISTINCT o_custkey AS key, DATE '1995-01-01' + CAST(o_custkey % 900 AS INT) AS s, DATE '2001-08-01' - CAST(o_custkey % 800 AS INT) AS e, o_custkey % 11 = 0 AS refresh, o_custkey % 48 > 24 AS old FROM orders)
SELECT key, 'all' AS part, s AS first, e AS last FROM asked LEFT JOIN held USING (key) WHERE a IS NULL OR refresh
UNION ALL SELECT key, 'head', s, a - 1 FROM asked JOIN held USING (key) WHERE NOT refresh AND s < a
UNION ALL SELECT key, 'tail', b - 7, e FROM asked JOIN held USING (key) WHERE NOT refresh AND old AND e >= b""")
def ranges_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(c("o_custkey").alias("key"), F.to_date("o_orderdate").alias("date"))
    now, k = F.lit("2001-09-01 00:00:00").cast("timestamp"), c("key")
    fetched = F.timestamp_seconds(F.unix_timestamp(now) - 3600 * (k % 48))
    coverage = orders.filter(k % 7 != 0).groupBy("key").agg(F.min("date").alias("coverage_start"), F.max("date").alias("last_row")).withColumn("fetched_at", fetched)
    start, end = F.date_add(F.lit("1995-01-01").cast("date"), (k % 900).cast("int")), F.date_sub(F.lit("2001-08-01").cast("date"), (k % 800).cast("int"))
    asked = orders.select("key").distinct().select("key", start.alias("start"), end.alias("end"), now.alias("now"), F.lit(24.0).alias("ttl_hours"), (k % 11 == 0).alias("refresh"))
    return ranges.to_fetch(asked, coverage, ["key"]).select("key", F.inline("parts"))


@register("ranges_missing", """WITH held AS (
  SELECT DISTINCT o_custkey AS key, CAST(unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 45, INTERVAL 1 DAY)) AS DATE) AS day FROM orders),
asked AS (
  SELECT DISTINCT o_custkey AS key, CAST(unnest(generate_series(DATE '1996-01-01' + CAST(o_custkey % 90 AS INT), DATE '1998-12-31', INTERVAL 1 DAY)) AS DATE) AS day FROM orders),
gone AS (SELECT key, day FROM asked EXCEPT SELECT key, day FROM held),
runs AS (SELECT key, day, day - CAST(row_number() OVER (PARTITION BY key ORDER BY day) AS INT) AS run FROM gone)
SELECT key, min(day) AS first, max(day) AS last FROM runs GROUP BY key, run""")
def ranges_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 45 days from each order leave open of three years, as ranges."""
    held = table(spark, sf_dir, "orders").select(c("o_custkey").alias("key"), F.to_date("o_orderdate").alias("first"), F.date_add(F.to_date("o_orderdate"), 45).alias("last"))
    start = F.date_add(F.lit("1996-01-01").cast("date"), (c("key") % 90).cast("int"))
    wanted = held.select("key").distinct().select("key", start.alias("first"), F.lit("1998-12-31").cast("date").alias("last"))
    return ranges.missing(wanted, held, ["key"])


# snapshots at the end of every month of every symbol
ENDS = f"""{RETURNS}, level AS (SELECT *, exp(sum(coalesce(ret, 0)) {over()}) AS level FROM returns),
ends AS (SELECT DISTINCT last_day(date) AS month_end FROM bars),
asked AS (SELECT symbol, month_end AS date FROM (SELECT DISTINCT symbol FROM bars) s, ends),
moments AS (SELECT a.symbol, a.date, max(b.date) AS session FROM asked a JOIN bars b ON b.symbol = a.symbol AND b.date <= a.date GROUP BY 1, 2)"""


def month_ends(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The bars and the last day of each month in them for every symbol."""
    rows = day_returns(spark, sf_dir).drop("pos")
    return rows, rows.select(F.last_day("date").alias("date")).distinct().crossJoin(rows.select("symbol").distinct())  # three symbols


CHANGES = ", ".join(f"level / lag(level, {n}) OVER (PARTITION BY symbol ORDER BY date) - 1 AS c{n}" for n in (1, 5, 20, 60))


@register("snapshot_price_at", f"""WITH {ENDS}, years AS (SELECT symbol, year(date) AS y, arg_max(level, date) AS last FROM level GROUP BY 1, 2),
w AS (
  SELECT symbol, date, close, ret, level, {CHANGES}, max(high * level / close) {over(252)} AS hi, min(low * level / close) {over(252)} AS lo, level / max(level) {over(252)} - 1 AS off FROM level)
SELECT a.symbol, a.date, w.date AS last_date, round(close, 4) AS last_close, round(CASE WHEN ret IS NOT NULL THEN c1 END, 6) AS change_1d, round(c5, 6) AS change_5d, round(c20, 6) AS change_20d, round(c60, 6) AS change_60d,
       round(level / last - 1, 6) AS change_ytd, round(hi * close / level, 3) AS high_52w, round(lo * close / level, 3) AS low_52w, round(off, 6) AS pct_from_52w_high
FROM moments a JOIN w ON w.symbol = a.symbol AND w.date = a.session LEFT JOIN years y ON y.symbol = a.symbol AND y.y = year(w.date) - 1""")
def snapshot_price_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ends = month_ends(spark, sf_dir)
    found = snapshots.sessions(snapshots.enriched(rows), ends).select("symbol", "date", snapshots.price_block().alias("p")).select("symbol", "date", "p.*")
    digits = {"last_close": 4, "high_52w": 3, "low_52w": 3} | dict.fromkeys(("change_1d", "change_5d", "change_20d", "change_60d", "change_ytd", "pct_from_52w_high"), 6)
    return found.withColumns({x: F.round(x, n) for x, n in digits.items()})


@register("snapshot_technicals_at", f"""WITH {ENDS}, w AS (
  SELECT symbol, date, close / level AS scale, level, {", ".join(f"{guard(f'avg(level) {over(n)}', 'level', n)} AS s{n}" for n in (20, 50, 200))},
         CASE WHEN count(ret) {over(20)} >= 16 THEN stddev_samp(ret) {over(20)} * sqrt(252) END AS vol20 FROM level),
v AS (SELECT *, lag(s200, 20) OVER (PARTITION BY symbol ORDER BY date) AS before, count(vol20) {over(756)} AS n, list(vol20) {over(756)} AS seen FROM w),
x AS (SELECT *, list_filter(seen, lambda z: z IS NOT NULL) AS vols FROM v),
r AS (SELECT *, CASE WHEN n >= 252 THEN 100.0::DOUBLE * (len(list_filter(vols, lambda z: z < vols[-1])) + 0.5 * (len(list_filter(vols, lambda z: z = vols[-1])) - 1)) / greatest(len(vols) - 1, 1) END AS rank FROM x)
SELECT a.symbol, a.date, round(s20 * scale, 1) AS sma20, round(s50 * scale, 1) AS sma50, round(s200 * scale, 1) AS sma200, round(vol20, 6) AS vol20, round(rank, 4) AS vol_percentile_3y,
       CASE WHEN before IS NULL THEN 'insufficient_data' WHEN level > s50 AND s50 > s200 AND s200 > before THEN 'uptrend' WHEN level < s50 AND s50 < s200 AND s200 < before THEN 'downtrend' ELSE 'range' END AS trend,
       CASE WHEN rank IS NULL THEN 'insufficient_data' WHEN rank > 95 THEN 'extreme' WHEN rank > 75 THEN 'high' WHEN rank < 25 THEN 'low' ELSE 'normal' END AS vol_regime
FROM moments a JOIN r ON r.symbol = a.symbol AND r.date = a.session""")
def snapshot_technicals_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ends = month_ends(spark, sf_dir)
    seen = regimes.vol_regime(snapshots.trend_of_level(snapshots.enriched(rows)))
    found = snapshots.sessions(seen, ends).select("symbol", "date", snapshots.technical_block(recursive=False).alias("t")).select("symbol", "date", "t.*")
    return found.withColumns({x: F.round(x, n) for x, n in {"sma20": 1, "sma50": 1, "sma200": 1, "vol20": 6, "vol_percentile_3y": 4}.items()})


@register("snapshot_risk_at", f"""WITH {ENDS}, placed AS (SELECT symbol, date, pos, CASE WHEN ret IS NOT NULL THEN exp(ret / 50) - 1 END AS r FROM returns),
year AS (SELECT a.symbol, a.date, p.date AS day, p.r FROM moments a JOIN placed e ON e.symbol = a.symbol AND e.date = a.session JOIN placed p ON p.symbol = a.symbol AND p.pos <= e.pos AND p.pos > e.pos - 252 AND p.r IS NOT NULL),
walk AS (SELECT *, product(1 + r) OVER w AS level FROM year WINDOW w AS (PARTITION BY symbol, date ORDER BY day)),
fall AS (SELECT symbol, date, level / greatest(max(level) OVER w, 1) - 1 AS fall FROM walk WINDOW w AS (PARTITION BY symbol, date ORDER BY day)),
worst AS (SELECT symbol, date, min(fall) AS max_drawdown FROM fall GROUP BY 1, 2)
SELECT y.symbol, y.date, count(*) AS n, round(stddev_samp(r) * sqrt(252), 6) AS annual_vol, round(avg(r) / stddev_samp(r) * sqrt(252), 5) AS sharpe, round(any_value(max_drawdown), 6) AS max_drawdown
FROM year y JOIN worst USING (symbol, date) GROUP BY 1, 2 HAVING count(*) > 2""")
def snapshot_risk_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ends = month_ends(spark, sf_dir)
    written = Written(spark, "risk")
    seen = snapshots.enriched(rows.withColumn("ret", c("ret") / 50))
    seen = written.save(seen.withColumn("vol20", indicators.realized_vol(c("ret"), 20)), "rows")
    found = snapshots.risk_blocks(written.save(snapshots.sessions(seen, ends), "sessions"), seen).select("symbol", "date", "risk.year.*").filter("n > 2")
    return found.select("symbol", "date", "n", F.round("annual_vol", 6).alias("annual_vol"), F.round("sharpe", 5).alias("sharpe"), F.round("max_drawdown", 6).alias("max_drawdown"))


@register("snapshot_season_at", f"""WITH {ENDS}, months AS (
  SELECT symbol, last_day(date) AS month_end, sum(ret) AS ret FROM returns GROUP BY 1, 2 HAVING count(ret) / count(*) >= 0.8 AND sum(ret) IS NOT NULL)
SELECT a.symbol, a.date, count(*) AS n, round(avg(ret), 6) AS mean, round(median(ret), 6) AS median, round(avg(CAST(ret > 0 AS INT)), 6) AS hit_rate,
       CAST(min(year(month_end)) AS INT) AS first_year, CAST(max(year(month_end)) AS INT) AS last_year
FROM moments a JOIN months m ON m.symbol = a.symbol AND month(m.month_end) = month(a.session) AND m.month_end < a.session GROUP BY 1, 2""")
def snapshot_season_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ends = month_ends(spark, sf_dir)
    found = snapshots.season_blocks(snapshots.sessions(rows, ends), rows).select("symbol", "date", "seasonality.*").drop("t_stat")
    return found.withColumns({x: F.round(x, 6) for x in ("mean", "median", "hit_rate")})


@register("snapshot_cot_at", f"""WITH {PUBLIC}, {ENDS}, k AS (
  SELECT a.symbol, a.date, r.date AS report_date, net, share, row_number() OVER (PARTITION BY a.symbol, a.date ORDER BY r.date DESC) AS back
  FROM moments a JOIN r ON r.symbol = CASE a.symbol WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AND public <= a.session)
SELECT symbol, date, max(report_date) AS report_date, round(max(net) FILTER (back = 1), 4) AS net, round(max(net) FILTER (back = 1) - max(net) FILTER (back = 2), 4) AS change FROM k GROUP BY 1, 2""")
def snapshot_cot_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positions block beside bars of other names: a flag's reports stand for a status."""
    name = F.when(c("symbol") == "A", "F").when(c("symbol") == "N", "O").otherwise("P")
    rows, ends = month_ends(spark, sf_dir)
    found = snapshots.cot_blocks(snapshots.sessions(rows, ends), public_reports(spark, sf_dir).withColumn("symbol", name))
    return found.select("symbol", "date", c("cot.report_date").alias("report_date"), F.round("cot.net", 4).alias("net"), F.round("cot.change", 4).alias("change"))


@register("snapshot_inventory_at", f"""WITH {ENDS}, {AVAILABLE},
keyed AS (SELECT period, value, available_at, value - lag(value) OVER (ORDER BY period) AS wow, year(period) AS y, least(weekofyear(period), 52) AS w FROM avail),
yearly AS (SELECT y, w, arg_max(value, period) AS v FROM keyed GROUP BY 1, 2),
banded AS (SELECT k.period, k.value, k.wow, k.available_at, avg(b.v) AS mid FROM keyed k LEFT JOIN yearly b ON b.w = k.w AND b.y BETWEEN k.y - 5 AND k.y - 1 GROUP BY 1, 2, 3, 4),
moment AS (SELECT *, timezone('America/New_York', CAST(session AS TIMESTAMP) + INTERVAL '14 hours 30 minutes') AT TIME ZONE 'UTC' AS t FROM moments),
last AS (SELECT symbol, date, max(period) AS period FROM moment JOIN banded ON available_at <= t GROUP BY 1, 2)
SELECT symbol, date, period, value, round(wow, 4) AS wow, round(value - mid, 4) AS dev FROM last JOIN banded USING (period)""")
def snapshot_inventory_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ends = month_ends(spark, sf_dir)
    found = snapshots.inventory_blocks(snapshots.sessions(rows, ends), available(spark, sf_dir)).filter("inventories is not null").select("symbol", "date", "inventories.*")
    return found.select("symbol", "date", "period", "value", F.round("wow", 4).alias("wow"), F.round("dev", 4).alias("dev"))


@register("snapshot_at")
def snapshot_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks of every symbol at every month's end, without names and dates."""
    return snapshots.anonymous(snapshots.snapshot_at(*month_ends(spark, sf_dir), weekly=available(spark, sf_dir)))


# revisions: the line items of an order revise its first value, by line number
@register("first_releases", """SELECT CAST(l_returnflag AS VARCHAR) AS series, CAST(l_shipdate AS DATE) AS date, round(arg_min(l_extendedprice, l_linenumber * 10000000 + l_orderkey), 4) AS value,
  min(DATE '2002-01-01' + CAST(l_linenumber AS INT)) AS first_published FROM lineitem GROUP BY 1, 2""")
def first_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first published value of each day of each series; of those of one day, that of the least order."""
    lines = table(spark, sf_dir, "lineitem").select(c("l_returnflag").alias("series"), F.to_date("l_shipdate").alias("date"), c("l_extendedprice").alias("value"), "l_linenumber", "l_orderkey")
    first = lines.groupBy("series", "date", "l_linenumber").agg(F.min_by("value", "l_orderkey").alias("value"))
    rows = first.select("series", "date", "value", F.date_add(F.lit("2002-01-01").cast("date"), c("l_linenumber").cast("int")).alias("realtime_start"))
    return services.first_releases(rows).select("series", "date", F.round("value", 4).alias("value"), "first_published")


@register("macro_last", """WITH days AS (SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
seen AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS back FROM days WHERE date + 3 <= DATE '2000-06-30')
SELECT series, max(date) FILTER (back = 1) AS last_date, max(value) FILTER (back = 1) AS last, max(value) FILTER (back = 1) - max(value) FILTER (back = 21) AS change_20_obs FROM seen GROUP BY series""")
def macro_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "lineitem").groupBy(c("l_returnflag").alias("series"), F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("value"))
    return services.macro_last(days.withColumn("available_at", F.date_add("date", 3)), F.lit("2000-06-30").cast("date"))


# settled skill: every event is a forecast by one of two models, losses from its value
SKILL = """pairs AS (
  SELECT user_id % 10 AS symbol, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) * 5 AS pos, value / 100 AS loss, 1 + (event_id % 7) / 10.0::DOUBLE AS base_loss FROM events),
asked AS (SELECT symbol, pos + 3 AS decided FROM pairs WHERE pos % 250 = 0),
settled AS (SELECT a.symbol, a.decided, p.pos, loss, base_loss, row_number() OVER (PARTITION BY a.symbol, a.decided ORDER BY p.pos) - 1 AS i, count(*) OVER (PARTITION BY a.symbol, a.decided) AS n FROM asked a JOIN pairs p ON p.symbol = a.symbol AND p.pos + 10 <= a.decided),
blocks AS (
  SELECT symbol, decided, i // (CASE WHEN n // 12 >= 4 THEN 12 ELSE n // 4 END) AS b, avg(loss - base_loss) AS m FROM settled
  WHERE n >= 20 AND i // (CASE WHEN n // 12 >= 4 THEN 12 ELSE n // 4 END) < CASE WHEN n // 12 >= 4 THEN n // 12 ELSE 4 END GROUP BY 1, 2, 3),
tested AS (SELECT symbol, decided, avg(m) / (stddev_samp(m) / sqrt(count(*))) AS t FROM blocks GROUP BY 1, 2)"""


@register("past_skill", f"""WITH {SKILL} SELECT s.symbol, s.decided, count(*) AS scored, round(1 - avg(loss) / avg(base_loss), 6) AS skill, any_value(t) < 0 AS better
FROM settled s JOIN tested USING (symbol, decided) GROUP BY s.symbol, s.decided HAVING count(*) >= 20""")
def past_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill settled at every fiftieth forecast of ten series; the test's side stands for its p value."""
    numbered = table(spark, sf_dir, "events").select((c("user_id") % 10).alias("symbol"), "event_id", "value")
    pos = F.row_number().over(Window.partitionBy("symbol").orderBy("event_id")) * 5
    pairs = numbered.select("symbol", pos.alias("pos"), (c("value") / 100).alias("own"), (1 + (c("event_id") % 7) / 10).alias("base"))
    models = F.array(F.struct(F.lit("ar").alias("model"), c("own").alias("loss")), F.struct(F.lit(evaluate.BASELINE).alias("model"), c("base").alias("loss")))
    scored = pairs.select("symbol", F.lit(5).alias("horizon"), "pos", F.inline(models))
    asked = pairs.filter("pos % 250 = 0").select("symbol", (c("pos") + 3).cast("long").alias("at"))  # a decision every fifty forecasts
    return decisions.past_skill(scored, asked, "ar", 5, 12).select("symbol", c("at").alias("decided"), "scored", F.round("skill", 6).alias("skill"), (c("p") < 0.5).alias("better"))


@register("content_laws", """SELECT o_orderstatus AS symbol, count(*) AS n, true AS same_in_any_order, true AS other_when_changed FROM orders GROUP BY 1""")
def content_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of the orders of each status: of all rows as they are, dealt out anew, and with one price changed."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "symbol")
    least = orders.groupBy("symbol").agg(F.min("o_orderkey").alias("_k"))
    price = F.when(c("o_orderkey") == c("_k"), c("o_totalprice") + 0.01).otherwise(c("o_totalprice"))
    changed = orders.join(least, "symbol").withColumn("o_totalprice", price).select(orders.columns)
    one, two, three = (content.content_of(x, "symbol").select("symbol", "n", c("content").alias(f"c{k}")) for k, x in enumerate((orders, orders.select(*orders.columns[::-1]).repartition(7), changed)))
    met = one.join(two.drop("n"), "symbol").join(three.drop("n"), "symbol")
    return met.select("symbol", "n", (c("c0") == c("c1")).alias("same_in_any_order"), (c("c0") != c("c2")).alias("other_when_changed"))


@register("news_vintages", """WITH items AS (SELECT user_id % 20 AS feed, event_type || event_id % 40 AS title, 'u' || event_id AS link, ts, event_id FROM events),
one AS (SELECT *, row_number() OVER (PARTITION BY feed, title ORDER BY ts DESC, link) AS k FROM items WHERE event_id % 3 <> 0),
two AS (SELECT *, row_number() OVER (PARTITION BY feed, title ORDER BY ts DESC, link) AS k FROM items WHERE event_id % 3 = 0)
SELECT CAST(coalesce(o.feed, t.feed) AS VARCHAR) AS feed, coalesce(o.title, t.title) AS title, coalesce(t.link, o.link) AS link, CASE WHEN o.feed IS NULL THEN 2 ELSE 1 END AS vintage, CASE WHEN o.feed IS NOT NULL AND t.feed IS NOT NULL THEN 1 ELSE 0 END AS revisions
FROM (FROM one WHERE k = 1) o FULL JOIN (FROM two WHERE k = 1) t ON o.feed = t.feed AND o.title = t.title""")
def news_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items of feeds that arrive in two batches, the second of them twice."""
    rows = table(spark, sf_dir, "events").withColumn("third", c("event_id") % 3 == 0)
    items = rows.select((c("user_id") % 20).cast("string").alias("feed"), F.concat("event_type", (c("event_id") % 40).cast("string")).alias("title"), F.concat(F.lit("u"), c("event_id").cast("string")).alias("link"), c("ts").cast("timestamp").alias("published"), F.lit("s").alias("source"), "third")
    at = lambda k: F.lit(f"2024-02-0{k} 00:00:00").cast("timestamp")
    seen = news.merged(news.empty(spark), items.filter("not third"), at(1))
    for k in (2, 3):
        seen = news.merged(seen, items.filter("third"), at(k))
    return seen.select("feed", "title", "link", F.dayofmonth("first_seen").alias("vintage"), "revisions")


@register("sql_functions", r"""SELECT item_id, CAST(least(weekofyear(DATE '2026-01-01' + CAST(item_id AS INT)), 52) AS INT) AS week, len(list_filter(list_transform(regexp_split_to_array(text, '[.!?;]\s+|\n+'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS sentences FROM benchmark""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's functions called from SQL, a table function of each row's text among them."""
    registry.register(spark)
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark_items")
    return spark.sql("""SELECT item_id, folded_week(date_add(DATE '2026-01-01', int(item_id))) AS week, count(s.sentence) AS sentences
        FROM benchmark_items LEFT JOIN LATERAL sentences_of(text) AS s GROUP BY item_id""")
