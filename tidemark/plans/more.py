"""Queries of rolls, blending, scoring and shapes of data that the two SQL dialects write differently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import backtest, bars, decisions, evaluate, features, fundamentals, indicators, pit, reports, rolls, text
from tidemark.sources.tables import table

from .catalog import oracle_sql, register
from .series import BARS, RETURNS, c, day_bars, day_returns, over, trend

# rolls: a window of days around the 15th of every month stands for a contract's
WINDOWS = "win AS (SELECT DISTINCT symbol, CAST(date_trunc('month', date) AS DATE) + 14 AS expiry, CAST(date_trunc('month', date) AS DATE) + 8 AS s, CAST(date_trunc('month', date) AS DATE) + 15 AS e FROM bars)"
ROLLS = f"""{WINDOWS}, placed AS (SELECT *, row_number() OVER w AS pos, volume / nullif(lag(volume) OVER w, 0) AS ratio FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
inside AS (SELECT win.symbol, expiry, e, date, pos, ratio, row_number() OVER (PARTITION BY win.symbol, expiry ORDER BY ratio DESC NULLS LAST, pos) AS k FROM win JOIN placed p ON p.symbol = win.symbol AND p.date BETWEEN s AND e AND pos > 1),
found AS (SELECT symbol, expiry, max(date) FILTER (WHERE k = 1) AS best, max(ratio) FILTER (WHERE k = 1) AS jump, max(pos) FILTER (WHERE k = 1) AS at_pos, min(pos) AS first_pos, max(pos) AS last_pos FROM inside GROUP BY 1, 2),
rolled AS (SELECT symbol, expiry, CASE WHEN coalesce(jump >= 1.8, false) THEN 'volume' ELSE 'window' END AS method, CASE WHEN coalesce(jump >= 1.8, false) THEN at_pos ELSE first_pos END AS mask_from, CASE WHEN coalesce(jump >= 1.8, false) THEN at_pos + 1 ELSE last_pos END AS mask_to FROM found)"""
MASKED = f"""{ROLLS}, masked AS (SELECT p.symbol, p.date, p.pos, p.close, CASE WHEN close <= 0 OR lag(close) OVER w <= 0 THEN 'nonpositive_price' WHEN lag(close) OVER w IS NULL THEN 'missing'
  WHEN EXISTS (SELECT 1 FROM rolled r WHERE r.symbol = p.symbol AND p.pos BETWEEN mask_from AND mask_to) THEN 'roll' END AS reason, ln(close / lag(close) OVER w) AS raw FROM placed p WINDOW w AS (PARTITION BY p.symbol ORDER BY p.date))"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.to_date(F.date_trunc("month", "date"))
    return day_bars(spark, sf_dir).select("symbol", F.date_add(month, 14).alias("expiry"), F.date_add(month, 8).alias("start"), F.date_add(month, 15).alias("end")).distinct()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolls.detect_rolls(day_bars(spark, sf_dir), windows(spark, sf_dir))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolls.masked_returns(day_bars(spark, sf_dir), found(spark, sf_dir))


register("detect_rolls", f"WITH {BARS}, {ROLLS} SELECT symbol, strftime(expiry, '%Y-%m-%d') AS expiry, method, mask_from, mask_to FROM rolled")(
    lambda spark, sf_dir: found(spark, sf_dir).select("symbol", F.date_format("expiry", "yyyy-MM-dd").alias("expiry"), "method", c("mask_from").cast("long").alias("mask_from"), c("mask_to").cast("long").alias("mask_to"))
)
register("mask_reasons", f"WITH {BARS}, {MASKED} SELECT symbol, date, coalesce(reason, '') AS reason, round(CASE WHEN reason IS NULL THEN raw END, 6) AS ret FROM masked")(
    lambda spark, sf_dir: masked(spark, sf_dir).select("symbol", "date", F.coalesce("reason", F.lit("")).alias("reason"), F.round("ret", 6).alias("ret"))
)
register("adjusted_close", f"WITH {BARS}, {MASKED}, r AS (SELECT *, CASE WHEN reason IS NULL THEN raw ELSE 0 END AS ret FROM masked), a AS (SELECT symbol, arg_max(close, pos) AS anchor FROM r GROUP BY 1) SELECT r.symbol, date, round(ln(anchor) - coalesce(sum(ret) OVER (PARTITION BY r.symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0), 5) AS log_adj FROM r JOIN a USING (symbol)")(
    lambda spark, sf_dir: rolls.adjusted(masked(spark, sf_dir)).select("symbol", "date", F.round(F.log("close_adj"), 5).alias("log_adj"))
)
register("calendar_roll_windows", f"WITH {BARS}, {WINDOWS} SELECT symbol, date, EXISTS (SELECT 1 FROM win WHERE win.symbol = bars.symbol AND bars.date BETWEEN s AND e) AS in_window FROM bars")(
    lambda spark, sf_dir: rolls.in_windows(day_bars(spark, sf_dir), windows(spark, sf_dir)).select("symbol", "date", "in_window")
)
register("asof_forward_expiry", f"WITH {BARS}, {WINDOWS}, e AS (SELECT DISTINCT expiry FROM win), d AS (SELECT DISTINCT date FROM bars) SELECT strftime(date, '%Y-%m-%d') AS date, coalesce(strftime((SELECT min(expiry) FROM e WHERE expiry >= date), '%Y-%m-%d'), '') AS next FROM d")(
    lambda spark, sf_dir: pit.next_after(day_bars(spark, sf_dir).select("date").distinct(), windows(spark, sf_dir).select("expiry").distinct(), "date", "expiry", "next").select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.coalesce(F.date_format("next", "yyyy-MM-dd"), F.lit("")).alias("next"))
)


@register("relative_strength", f"WITH {BARS}, m AS (SELECT symbol, date, " + ", ".join(f"close / lag(close, {n}) OVER w - 1 AS r{n}" for n in (20, 60, 120)) + " FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)) SELECT symbol, " + ", ".join(f"round(arg_max(r{n}, date), 6) AS r{n}" for n in (20, 60, 120)) + " FROM m GROUP BY symbol")
def relative_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = day_bars(spark, sf_dir).select("symbol", "date", *[indicators.pct_change(c("close"), n).alias(f"r{n}") for n in (20, 60, 120)])
    return rows.groupBy("symbol").agg(*[F.round(F.max_by(f"r{n}", "date"), 6).alias(f"r{n}") for n in (20, 60, 120)])


@register("vol_target", f"WITH {RETURNS}, v AS (SELECT *, CASE WHEN count(ret) {over(20)} >= 16 THEN stddev_samp(ret) {over(20)} * sqrt(252) END AS vol FROM returns) SELECT symbol, date, round(last_value(CASE WHEN vol > 0 THEN least(0.2 / vol, 1.0) END IGNORE NULLS) {over()}, 6) AS target FROM v")
def vol_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.vol_targeted(day_returns(spark, sf_dir).withColumn("target", F.lit(1.0))).select("symbol", "date", F.round("target", 6).alias("target"))


# tests, weights, blends
MODELS = "SELECT o_orderstatus AS grp, o_orderpriority AS model, stddev_samp(o_totalprice) / 1000 AS loss FROM orders GROUP BY 1, 2"


def model_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(c("o_orderstatus").alias("grp"), c("o_orderpriority").alias("model")).agg((F.stddev_samp("o_totalprice") / 1000).alias("loss"))


register("inverse_loss_weights", f"WITH m AS ({MODELS}) SELECT grp, model, round((1 / loss) / sum(1 / loss) OVER (PARTITION BY grp), 6) AS weight FROM m")(
    lambda spark, sf_dir: evaluate.inverse_loss_weights(model_losses(spark, sf_dir), ["grp"]).select("grp", "model", F.round("weight", 6).alias("weight"))
)
register("auto_select", f"WITH m AS ({MODELS}) SELECT grp, model, CASE WHEN row_number() OVER (PARTITION BY grp ORDER BY loss, model) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM m")(
    lambda spark, sf_dir: evaluate.best_only(model_losses(spark, sf_dir), ["grp"]).select("grp", "model", "weight")
)
register("holm_adjust", f"WITH m AS (SELECT grp || model AS model, loss / 5000 AS p FROM ({MODELS})), s AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, model) + 1) * p) AS s FROM m) SELECT model, round(max(s) OVER (ORDER BY p, model), 6) AS p_adj FROM s")(
    lambda spark, sf_dir: evaluate.holm(model_losses(spark, sf_dir).select(F.concat("grp", "model").alias("model"), (c("loss") / 5000).alias("p"))).select("model", F.round("p_adj", 6).alias("p_adj"))
)
# the origins of every symbol are the places of its bars; five apart
register("non_overlapping_origins", f"WITH {RETURNS} SELECT symbol, CAST(pos AS BIGINT) AS pos FROM returns WHERE (pos - 1) % 5 = 0")(
    lambda spark, sf_dir: evaluate.spaced(day_returns(spark, sf_dir).select("symbol", c("pos").cast("long").alias("pos")), ["symbol"], 5)
)
# microseconds of every event of every user, an hour apart: gaps are irregular and many are wider than the spacing
SPACED = "WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS pos FROM events), k AS (SELECT user_id, min(pos) AS pos FROM e GROUP BY 1 UNION ALL SELECT k.user_id, min(e.pos) FROM k JOIN e ON e.user_id = k.user_id AND e.pos >= k.pos + 3600000000 GROUP BY k.user_id) SELECT user_id, pos FROM k"
register("non_overlapping_events", SPACED)(lambda spark, sf_dir: evaluate.spaced(table(spark, sf_dir, "events").select("user_id", F.unix_micros(c("ts").cast("timestamp")).alias("pos")), ["user_id"], 3_600_000_000))
# four agents have views, from customers of every nation; the fifth is silent
VIEWS = "SELECT c_mktsegment AS symbol, 'agent' || CAST(c_nationkey % 4 AS VARCHAR) AS agent, avg(sign(c_acctbal)) AS stance, avg(abs(c_acctbal)) / 10000 AS confidence FROM customer GROUP BY 1, 2"


@register("weighted_decision", f"WITH v AS ({VIEWS}), w(agent, weight) AS (VALUES ('agent0', 0.3::DOUBLE), ('agent1', 0.2::DOUBLE), ('agent2', 0.1::DOUBLE), ('agent3', 0.15::DOUBLE), ('agent4', 0.25::DOUBLE)) SELECT s.symbol, round(sum(w.weight * coalesce(v.stance * v.confidence, 0)) / sum(w.weight), 6) AS score FROM (SELECT DISTINCT symbol FROM v) s CROSS JOIN w LEFT JOIN v ON v.symbol = s.symbol AND v.agent = w.agent GROUP BY s.symbol")
def weighted_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "customer").groupBy(c("c_mktsegment").alias("symbol"), F.concat(F.lit("agent"), (c("c_nationkey") % 4).cast("string")).alias("agent"))
    views = views.agg(F.avg(F.signum("c_acctbal")).alias("stance"), (F.avg(F.abs("c_acctbal")) / 10000).alias("confidence"))
    weights = spark.createDataFrame([("agent0", 0.3), ("agent1", 0.2), ("agent2", 0.1), ("agent3", 0.15), ("agent4", 0.25)], "agent string, weight double")
    return text.weighted_decision(views, weights).withColumn("score", F.round("score", 6))


# scoring, costs, logs
register("eval_tolerance", "SELECT event_id, greatest(0.001::DOUBLE * abs(value), CASE WHEN event_type = 'click' THEN 0.0006::DOUBLE ELSE 0.006::DOUBLE END) AS tol FROM events")(lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", text.tolerance(F.lit(None).cast("double"), c("value"), c("event_type") == "click").alias("tol")))
# every event's value rounded is an answer to what the value is: numbers by the tolerance or the precision they are written in, a tenth of them as choices
SCORED = """SELECT event_type, count(*) AS run, count(*) FILTER (WHERE CASE WHEN event_id % 10 = 0 THEN event_type IN ('click', 'view')
  ELSE abs(v - value) <= greatest(0.001::DOUBLE * abs(value), 0.006, CASE WHEN v = round(v) THEN 0.5 ELSE 0.05 END) END) AS correct FROM (SELECT *, round(value, 1) AS v FROM events) GROUP BY event_type"""


@register("eval_by_category", SCORED)
def eval_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, none = c("event_id") % 10 == 0, F.lit(None)
    kinds = F.array(F.lit("click"), F.lit("view"))
    answers = table(spark, sf_dir, "events").select(
        "event_type", F.when(asked, "choice").otherwise("number").alias("type"), c("value").alias("expected"), F.round("value", 1).alias("value"), F.lit(False).alias("percent"), none.cast("double").alias("tol"),
        F.when(c("event_type").isin("click", "view"), c("event_type")).otherwise("click").alias("option"), F.concat(F.lit("It is a "), "event_type").alias("text"), kinds.alias("options"),
    )
    return reports.score(answers).groupBy("event_type").agg(F.count(F.lit(1)).alias("run"), F.count_if("correct").alias("correct"))


@register("token_cost_by_agent", """SELECT event_type AS agent, round(sum((value * p * 3 + user_id * p * 15 + 2 * p + event_id % 7 * p * 0.5) / 1e6), 6) AS cost
  FROM events JOIN (VALUES ('click', 3.0::DOUBLE), ('view', 1.0::DOUBLE), ('purchase', 15.0::DOUBLE)) AS t(k, p) ON k = event_type GROUP BY 1""")
def token_cost_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([(m, 3 * p, 15 * p, p, 0.5 * p) for m, p in (("click", 3.0), ("view", 1.0), ("purchase", 15.0))], "model string, input_price double, output_price double, cache_read_price double, cache_write_price double")
    usage = table(spark, sf_dir, "events").select(c("event_type").alias("agent"), c("event_type").alias("model"), F.lit("llm").alias("kind"), c("value").alias("input_tokens"), c("user_id").alias("output_tokens"), F.lit(2).alias("cache_read_tokens"), (c("event_id") % 7).alias("cache_write_tokens"))
    priced = reports.cost_usd(usage, prices).filter("cost is not null")
    return reports.cost_by_agent(priced).withColumn("cost", F.round("cost", 6))


@register("decide", """WITH v AS (SELECT c_mktsegment AS symbol, 'agent' || CAST(c_nationkey % 3 AS VARCHAR) AS name, CASE WHEN avg(c_acctbal) > 4500 THEN 1.0 WHEN avg(c_acctbal) > 4400 THEN 0.0 ELSE -1.0 END * avg(abs(c_acctbal)) / 10000 AS signal FROM customer GROUP BY 1, 2),
  f AS (SELECT c_mktsegment AS symbol, avg(2 * p - 1) FILTER (WHERE edge) AS s FROM (SELECT c_mktsegment, c_nationkey % 5 AS h, avg(c_acctbal) / 10000 AS p, avg(c_acctbal) > 4450 AS edge FROM customer GROUP BY 1, 2) GROUP BY 1),
  w(name, weight) AS (VALUES ('agent0', 0.3::DOUBLE), ('agent1', 0.2::DOUBLE), ('agent2', 0.1::DOUBLE), ('silent', 0.15::DOUBLE)),
  d AS (SELECT f.symbol, (0.25 * coalesce(any_value(f.s), 0) + sum(w.weight * coalesce(v.signal, 0))) / (0.25 + sum(w.weight)) AS score, any_value(f.s) IS NOT NULL AS forecast_edge FROM f CROSS JOIN w LEFT JOIN v ON v.symbol = f.symbol AND v.name = w.name GROUP BY f.symbol)
  SELECT symbol, round(score, 6) AS score, round(abs(score), 6) AS conviction, forecast_edge, CASE WHEN score >= 0.45 THEN 'strong_buy' WHEN score >= 0.15 THEN 'buy' WHEN score <= -0.45 THEN 'strong_sell' WHEN score <= -0.15 THEN 'sell' ELSE 'hold' END AS rating FROM d""")
def decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    mean = F.avg("c_acctbal")
    stance = F.when(mean > 4500, "bullish").when(mean > 4400, "neutral").otherwise("bearish").alias("stance")
    views = customers.groupBy(c("c_mktsegment").alias("symbol"), F.concat(F.lit("agent"), (c("c_nationkey") % 3).cast("string")).alias("agent")).agg(stance, (F.avg(F.abs("c_acctbal")) / 10_000).alias("confidence"))
    horizons = customers.groupBy(c("c_mktsegment").alias("symbol"), (c("c_nationkey") % 5).alias("horizon")).agg((mean / 10_000).alias("p_up"), (mean > 4450).alias("edge"))
    out = decisions.decide(views, decisions.forecast_signal(horizons), {"forecast": 0.25, "agent0": 0.3, "agent1": 0.2, "agent2": 0.1, "silent": 0.15})
    return out.select("symbol", "rating", F.round("score", 6).alias("score"), F.round("conviction", 6).alias("conviction"), "forecast_edge")


@register("labels_until", f"WITH {RETURNS}, y AS (SELECT symbol, date, pos, CASE WHEN lead(pos, 5) OVER w IS NOT NULL AND count(ret) OVER n >= 3 THEN sum(coalesce(ret, 0)) OVER n END AS y FROM returns WINDOW w AS (PARTITION BY symbol ORDER BY date), n AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) SELECT symbol, pos, round(CASE WHEN pos + 5 <= 500 THEN y END, 6) AS y_5 FROM y WHERE pos <= 500")
def labels_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.with_labels(day_returns(spark, sf_dir), (5,))
    return decisions.until(rows, F.lit(500), (5,)).select("symbol", c("pos").cast("long").alias("pos"), F.round("y_5", 6).alias("y_5"))


@register("budget_allowed", "WITH e AS (SELECT user_id, event_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent FROM events) SELECT user_id, event_id, round(coalesce(spent, 0), 4) AS spent, coalesce(spent, 0) + value <= 5000 AS allowed FROM e")
def budget_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select(c("user_id").alias("run"), c("event_id").alias("seq"), c("value").alias("cost_usd"), F.lit(0).alias("tokens"), c("value").alias("est_usd"), F.lit(0).alias("est_tokens"))
    return decisions.charged(calls, 5000.0, 1).select(c("run").alias("user_id"), c("seq").alias("event_id"), F.round("spent_usd", 4).alias("spent"), "allowed")


register("events_flatten", "SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, coalesce(event_type, '') AS kind, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")(lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "HH:mm:ss").alias("clock"), F.coalesce("event_type", F.lit("")).alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k")))
register("search_universe", "SELECT c_custkey FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), 'build')")(lambda spark, sf_dir: table(spark, sf_dir, "customer").filter(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")).contains("build")).select("c_custkey"))
register("citation_ids", "SELECT event_id, concat(event_id % 7, ',', event_id % 7 + 3) AS ids FROM events")(lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", F.array_join(text.cited_ids(F.format_string("x [T%d] y [T%d] [T%d]", c("event_id") % 7 + 3, c("event_id") % 7, c("event_id") % 7)).cast("array<string>"), ",").alias("ids")))
@register("claim_match", """SELECT p_partkey, true AS whole, abs(round(round(p_retailprice, 1) + 0.2, 1) - p_retailprice) <= 0.05 + 1e-9 AS off, abs(round(p_retailprice / 1000, 1) - p_retailprice / 1000) <= 0.05 + 1e-9 AS thousands, true AS points FROM part""")
def claim_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated numbers against the price: as it is, a little off, in thousands, and a fraction in basis points."""
    price = c("p_retailprice")
    says = lambda form, x: text.claims_of(F.format_string(form, x))[0]
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.matches(says("-$%.2f", price), text.known(F.array(price))).alias("whole"),
        text.matches(says("at %.1f", F.round(price, 1) + 0.2), text.known(F.array(price))).alias("off"),
        text.matches(says("%.1fk", F.round(price / 1000, 1)), text.known(F.array(price))).alias("thousands"),
        text.matches(says("%.0fbps", price), text.known(F.array(F.round(price) / 10_000))).alias("points"),
    )


register("safe_keys", "SELECT s_suppkey, regexp_replace(s_name || '/' || s_nationkey, '[^A-Za-z0-9._=-]', '_', 'g') AS k FROM supplier")(lambda spark, sf_dir: table(spark, sf_dir, "supplier").select("s_suppkey", text.safe_key(F.concat_ws("/", "s_name", c("s_nationkey").cast("string"))).alias("k")))
register("iso_week_folded", "SELECT o_orderkey, least(weekofyear(o_orderdate), 52) AS w FROM orders")(lambda spark, sf_dir: table(spark, sf_dir, "orders").select("o_orderkey", fundamentals.folded_week(F.to_date("o_orderdate")).cast("long").alias("w")))
register("merge_range", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS v FROM orders")(
    lambda spark, sf_dir: bars.merge_range(table(spark, sf_dir, "orders").select("o_orderkey", c("o_totalprice").alias("v")), table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select("o_orderkey", (c("o_totalprice") * 2).alias("v")), "o_orderkey")
)
register("null_normalise", "SELECT event_id, CASE WHEN value > 1 THEN value END AS v FROM events")(lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", F.nanvl(F.when(c("value") > 1, c("value")).otherwise(F.lit(float("nan"))), F.lit(None).cast("double")).alias("v")))
register("trend_counts", f"SELECT symbol, trend, count(*) AS count FROM ({oracle_sql()['trend_regime']}) t GROUP BY 1, 2")(lambda spark, sf_dir: trend(spark, sf_dir).groupBy("symbol", "trend").count())

# shapes
register("pivot", "SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS p1, count(*) FILTER (WHERE o_orderpriority LIKE '2%') AS p2 FROM orders GROUP BY 1")(
    lambda spark, sf_dir: table(spark, sf_dir, "orders").withColumn("p", F.substring("o_orderpriority", 1, 1)).groupBy("o_orderstatus").pivot("p", ["1", "2"]).agg(F.count(F.lit(1))).select("o_orderstatus", F.coalesce("1", F.lit(0)).alias("p1"), F.coalesce("2", F.lit(0)).alias("p2"))
)
register("unpivot", "SELECT p_partkey, 'size' AS name, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")(
    lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", c("p_size").cast("double").alias("size"), c("p_retailprice").alias("price")).unpivot("p_partkey", ["size", "price"], "name", "v")
)
register("string_agg", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")(lambda spark, sf_dir: table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat_ws(",", F.array_sort(F.collect_list("n_name"))).alias("names")))
register("quantiles", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS q50, round(quantile_cont(l_extendedprice, 0.9), 4) AS q90 FROM lineitem GROUP BY 1")(lambda spark, sf_dir: table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_quantity", 0.5).alias("q50"), F.round(F.percentile("l_extendedprice", 0.9), 4).alias("q90")))
register("min_by_max_by", "SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest FROM orders GROUP BY 1")(lambda spark, sf_dir: table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("cheapest"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("dearest")))
register("product_geometric", "SELECT l_returnflag, round(ln(product(1 + l_tax / 100)), 6) AS x FROM lineitem GROUP BY 1")(lambda spark, sf_dir: table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.log(F.product(1 + c("l_tax") / 100)), 6).alias("x")))
register("explode_arrays", "SELECT vec_id, CAST(i AS INT) AS i, round(CAST(embedding[i + 1] AS DOUBLE), 5) AS x FROM embeddings, generate_series(0, len(embedding) - 1) t(i)")(lambda spark, sf_dir: table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", F.round(c("x").cast("double"), 5).alias("x")))
register("struct_and_map_access", "SELECT n_nationkey, n_name AS a, n_regionkey AS b FROM nation")(lambda spark, sf_dir: table(spark, sf_dir, "nation").select("n_nationkey", F.struct("n_name").alias("s"), F.create_map(F.lit("r"), "n_regionkey").alias("m")).select("n_nationkey", c("s.n_name").alias("a"), F.element_at("m", "r").alias("b")))
register("approx_distinct", None)(lambda spark, sf_dir: table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("n")))
register("file_name_provenance", "SELECT 'region' AS name, count(*) AS n FROM region")(lambda spark, sf_dir: table(spark, sf_dir, "region").select(F.regexp_extract("_metadata.file_path", r"([a-z]+)\.parquet", 1).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")))
register("union_by_name", "SELECT n_name AS name, n_regionkey AS k, CAST(NULL AS VARCHAR) AS more FROM nation UNION ALL SELECT r_name, r_regionkey, 'region' FROM region")(lambda spark, sf_dir: table(spark, sf_dir, "nation").select(c("n_name").alias("name"), c("n_regionkey").alias("k")).unionByName(table(spark, sf_dir, "region").select(c("r_regionkey").alias("k"), c("r_name").alias("name"), F.lit("region").alias("more")), allowMissingColumns=True))
register("session_gaps", "WITH g AS (SELECT *, CASE WHEN date_diff('second', lag(ts) OVER w, ts) <= 86400 THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(k AS BIGINT) AS k, count(*) AS n FROM s GROUP BY 1, 2")(
    lambda spark, sf_dir: table(spark, sf_dir, "events").withColumn("f", F.when(F.unix_seconds(c("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("timestamp")) <= 86400, 0).otherwise(1)).withColumn("k", F.sum("f").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "k").agg(F.count(F.lit(1)).alias("n"))
)
