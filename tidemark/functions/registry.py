"""The engine's rules as SQL functions, for sessions that write SQL only.

Scalar and table functions are SQL themselves, so they are planned with the
query that calls them. A fold over an ordered group has no such form: it is a
Python table function over a partitioned and ordered TABLE argument.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import LongType, StructField, StructType

#: name, parameters, what it returns, body.
SCALARS = (
    ("folded_week", "d DATE", "INT", "least(weekofyear(d), 52)"),
    ("weekdays_between", "a DATE, b DATE", "INT", "CASE WHEN b < a THEN 0 ELSE size(filter(sequence(a, b), x -> weekday(x) < 5 AND x > a)) END"),
    ("pinball", "y DOUBLE, q DOUBLE, level DOUBLE", "DOUBLE", "greatest(level * (y - q), (level - 1) * (y - q))"),
    ("log_return", "before DOUBLE, now DOUBLE", "DOUBLE", "CASE WHEN before > 0 AND now > 0 THEN ln(now / before) END"),
    ("written_decimals", "x DOUBLE", "INT", r"CASE WHEN contains(string(x), 'E') OR endswith(string(x), '.0') THEN 0 ELSE length(regexp_extract(string(x), '[.]([0-9]+)$', 1)) END"),
)
TABLES = (
    ("sentences_of", "body STRING", "TABLE (at INT, sentence STRING)", r"SELECT pos, trim(col) FROM posexplode(split(body, '(?<=[.!?;])\\s+|\\n+')) WHERE trim(col) <> ''"),
    ("business_weeks", "a DATE, b DATE", "TABLE (week DATE, days INT)", "SELECT date(date_trunc('week', d)), int(count_if(weekday(d) < 5)) FROM explode(sequence(a, b)) AS t(d) GROUP BY 1"),
)


@udtf
class Spaced:
    """The greedy subset of an ordered group's values at least `apart` from each other.

    SELECT * FROM spaced(TABLE(t) PARTITION BY k ORDER BY (pos), 'pos', 5); all columns of t come back.
    """

    def __init__(self) -> None:
        self.last = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, apart: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or column.value not in rows.dataType.fieldNames():
            raise ValueError(f"spaced needs a table with a column {column.value!r}")
        return AnalyzeResult(StructType([*rows.dataType.fields, StructField("kept", LongType())]))

    def eval(self, row, column: str, apart: int):
        value = row[column]
        if value is not None and (self.last is None or value - self.last[0] >= apart):
            self.last = (value, 1 if self.last is None else self.last[1] + 1)
            yield (*row, self.last[1])


def register(spark: SparkSession) -> list[str]:
    """Add all functions to a session; their names."""
    for name, parameters, returns, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    for name, parameters, returns, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    spark.udtf.register("spaced", Spaced)
    return [*(s[0] for s in SCALARS), *(t[0] for t in TABLES), "spaced"]
