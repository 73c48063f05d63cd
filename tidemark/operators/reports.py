"""Listings, run logs, answer scoring and sinks over JSON and CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import variant

from .text import normalised, tolerance, written_decimals


def significant(x: Column, digits: int) -> Column:
    """x to so many significant digits; null where it is not finite."""
    size = F.floor(F.log10(F.abs(x)))
    scale = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - size)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite & (x != 0), F.rint(x * scale) / scale).when(x == 0, 0.0)


def weekdays_after(date: Column, n: Column | int) -> Column:
    """The date n weekdays later; from a weekend the count begins on Friday."""
    friday = F.date_sub(date, F.greatest(F.weekday(date) - 4, F.lit(0)))
    days = F.weekday(friday) + n
    return F.date_add(friday, (F.floor(days / 5) * 7 + days % 5 - F.weekday(friday)).cast("int"))


def listing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a readable JSON file with its name, newest first; malformed files are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    named = rows.select("*", F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("name"), F.col("_metadata.file_modification_time").alias("modified"))
    return named.filter("_corrupt is null").drop("_corrupt").orderBy(F.col("modified").desc(), F.col("name").desc())


def events(spark: SparkSession, path: str) -> DataFrame:
    """Run logs: one JSON object a line, with the run's name from the file."""
    schema = "seq long, ts string, kind string, agent string, tool string, id string, model string, cost double, tokens long, error string, rating string"
    return spark.read.schema(schema).json(path).withColumn("run", F.regexp_extract("_metadata.file_path", r"([^/]+)\.jsonl$", 1))


def run_summaries(log: DataFrame, limit: int | None = 200) -> DataFrame:
    """Counts of calls and errors, costs, tokens and the last rating of each run, latest names first; all runs without a limit."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    rows = log.groupBy("run").agg(
        kind("llm").alias("llm_calls"), kind("tool").alias("tool_calls"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.max_by(F.col("rating"), F.when(F.col("rating").isNotNull(), F.col("seq"))).alias("rating"),
    )
    return rows.orderBy(F.col("run").desc()).limit(limit) if limit is not None else rows.orderBy(F.col("run").desc())


def cost_by_agent(log: DataFrame) -> DataFrame:
    return log.filter("kind = 'llm'").groupBy("agent").agg(F.sum("cost").alias("cost")).orderBy(F.col("cost").desc(), "agent")


def cost_usd(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, four token classes) with its cost by the prices of a million tokens; a price for each of a few models."""
    classes = ("input", "output", "cache_read", "cache_write")
    joined = usage.join(prices, "model", "left")
    return joined.withColumn("cost", sum((F.col(f"{c}_tokens") * F.col(f"{c}_price") for c in classes), F.lit(0.0)) / 1e6).drop(*[f"{c}_price" for c in classes])


def leaderboard_summary(boards: DataFrame) -> DataFrame:
    """(evaluation, horizon) with the model of the highest skill beside the baseline and the switch, and whether any has an edge."""
    own = boards.filter(~F.col("model").isin("naive", "auto_select"))
    best = own.groupBy("evaluation", "horizon").agg(F.max_by("model", F.struct("skill", "model")).alias("model"), F.max("skill").alias("skill"))
    return best.join(boards.groupBy("evaluation", "horizon").agg(F.bool_or("edge").alias("edge")), ["evaluation", "horizon"])


def score(answers: DataFrame) -> DataFrame:
    """answers (type, expected, value, percent, tol, option, text, options) with correct.

    A number is right within the tolerance or half a unit of the precision it
    is written in, a percentage also as a share. A choice is right when it is
    the option, or the text names that option alone. What cannot be answered
    must be declined without a value.
    """
    within = F.greatest(tolerance(F.col("tol"), F.col("expected"), F.col("percent")), 0.5 * F.pow(F.lit(10.0), -written_decimals(F.col("value")).cast("double")))
    number = (F.abs(F.col("value") - F.col("expected")) <= within) | (F.col("percent") & (F.abs(F.col("value") / 100 - F.col("expected")) <= within / 100))
    named = F.filter("options", lambda o: F.concat(F.lit(" "), normalised(F.col("text")), F.lit(" ")).contains(F.concat(F.lit(" "), normalised(o), F.lit(" "))))
    choice = (normalised(F.col("text")) == normalised(F.col("option"))) | ((F.size(named) == 1) & (named[0] == F.col("option")))
    right = F.when(F.col("type") == "number", number).when(F.col("type") == "choice", choice).otherwise(F.col("value").isNull() & F.col("text").isNull())
    return answers.withColumn("correct", F.coalesce(right, F.lit(False)))


def extract(payload: Column, path: Column) -> Column:
    """What a path leads to in a JSON text, as JSON; null where it leads nowhere."""
    return F.to_json(variant.followed(F.try_parse_json(payload), path))


def reference_answers(questions: DataFrame, payloads: DataFrame) -> DataFrame:
    """(id, value, choice): a field's value, or yes or no for a comparison; neither where nothing can be answered.

    questions are (id, kind none / field / compare, tool, path, a, a_tool, op,
    b, b_tool, b_value), payloads (id, tool, payload).
    """
    asked = F.array(*[F.struct(F.lit(n).alias("part"), F.col(t).alias("tool"), F.col(p).alias("path")) for n, t, p in (("field", "tool", "path"), ("a", "a_tool", "a"), ("b", "b_tool", "b"))])
    parts = questions.select("id", F.inline(asked)).filter("tool is not null and path is not null").join(payloads, ["id", "tool"])
    parts = parts.select("id", "part", extract(F.col("payload"), F.col("path")).alias("json"))
    one = lambda n: F.max(F.when(F.col("part") == n, F.col("json"))).alias(f"_{n}")
    out = questions.join(parts.groupBy("id").agg(one("field"), one("a"), one("b")), "id", "left")
    a, b = F.col("_a").try_cast("double"), F.coalesce(F.col("_b").try_cast("double"), F.col("b_value"))
    told = F.when(F.col("op") == ">", a > b).otherwise(a < b)
    field = F.when(F.col("_field").isin("true", "false"), F.when(F.col("_field") == "true", "yes").otherwise("no")).otherwise(F.regexp_replace("_field", '^"|"$', ""))
    value = F.when(F.col("kind") == "field", F.col("_field").try_cast("double"))
    choice = F.when(F.col("kind") == "compare", F.when(told, "yes").when(~told, "no")).when((F.col("kind") == "field") & value.isNull(), field)
    return out.select("id", value.alias("value"), choice.alias("choice"))


def drifted(type_: Column, expected: Column, expected_choice: Column, value: Column, choice: Column, tolerated: Column) -> Column:
    """Whether a reference answer left what is expected of it."""
    number = F.coalesce(F.abs(value - expected) > tolerated, F.lit(True))
    return F.when(type_ == "unanswerable", F.lit(False)).when(type_ == "number", number).otherwise(~normalised(choice).eqNullSafe(normalised(expected_choice)))


def frozen(questions: DataFrame, answers: DataFrame, digits: int = 6) -> DataFrame:
    """questions (id, type, expected, expected_choice) with the reference answers written in, and changed."""
    new = answers.select("id", significant(F.col("value"), digits).alias("_v"), F.col("choice").alias("_c"))
    out = questions.join(new, "id", "left").withColumn("_keep", (F.col("type") == "unanswerable") | (F.col("_v").isNull() & F.col("_c").isNull()))
    out = out.withColumn("changed", ~F.col("_keep") & ~(F.col("expected").eqNullSafe(F.col("_v")) & F.col("expected_choice").eqNullSafe(F.col("_c"))))
    return out.withColumn("expected", F.when(F.col("_keep"), F.col("expected")).otherwise(F.col("_v"))).withColumn("expected_choice", F.when(F.col("_keep"), F.col("expected_choice")).otherwise(F.col("_c"))).drop("_v", "_c", "_keep")


def contiguous_curve(settles: DataFrame, reference: Column, contracts: int, days: int = 30) -> DataFrame:
    """settles (symbol, expiry, date, settle): the last one within days of the reference for each contract, up to the first that has none.

    expiries without a settle come as rows with a null date, so a gap in the
    middle ends the curve.
    """
    usable = F.when((F.col("date") <= reference) & (F.col("date") >= F.date_sub(reference, days)), F.struct("date", "settle"))
    last = settles.filter(F.col("expiry") >= reference).groupBy("symbol", "expiry").agg(F.max(usable).alias("last"))
    order = Window.partitionBy("symbol").orderBy("expiry")
    placed = last.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= contracts)
    gaps = F.count_if(F.col("last").isNull()).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("gaps", gaps).filter("gaps = 0").select("symbol", "expiry", "last.settle")


def save_curves(curves: DataFrame, path: str, digits: int = 8) -> None:
    """Doubles to so many significant digits, as CSV with a header."""
    rounded = curves.withColumns({c: significant(F.col(c), digits) for c, t in curves.dtypes if t == "double"})
    rounded.write.mode("overwrite").option("header", True).csv(path)
