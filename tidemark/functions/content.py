"""Keys of contents: the same for the same rows in any order and partitioning."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPLEX = ("array", "map", "struct", "variant")


def row_hash(columns: dict[str, str], salt: int) -> Column:
    """64 bits of a row: of each column its name, whether it is null, and its value; lists, maps and structs by their JSON."""
    cells = []
    for name, kind in sorted(columns.items()):
        col = F.col(f"`{name}`")
        value = F.to_json(F.struct(col.alias("v")), {"ignoreNullFields": "false"}) if kind.startswith(COMPLEX) else col
        cells.append(F.xxhash64(F.lit(salt), F.lit(name), col.isNull(), value))
    return F.xxhash64(F.lit(salt), *cells)


def content_of(rows: DataFrame, *by: str) -> DataFrame:
    """(by, n, content): the number of rows and 128 bits of their contents as 32 hexadecimal digits, a key each.

    Rows are hashed twice and the hashes added, so order and partitions do not
    matter and repeated rows count; partial sums meet in one shuffle.
    """
    kinds = {c: t for c, t in rows.dtypes if c not in by}
    whole = F.lit(str(1 << 64)).cast("decimal(38,0)")
    total = lambda salt: F.coalesce(F.pmod(F.sum(row_hash(kinds, salt).cast("decimal(20,0)")), whole), F.lit(0).cast("decimal(38,0)"))
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), total(1).alias("a"), total(2).alias("b"))
    half = lambda text: F.lpad(F.lower(F.hex(F.expr(text))), 8, "0")
    digits = [half(f"cast({c} {op} 4294967296 as bigint)") for c in ("a", "b") for op in ("div", "%")]
    return sums.select(*by, "n", F.concat(*digits).alias("content"))


def content_key(frames: dict[str, DataFrame], config: object = None) -> str:
    """One key of named frames and a configuration: other contents, columns, types or settings give another."""
    parts = {}
    for name, frame in sorted(frames.items()):
        row = content_of(frame).first()  # one row
        parts[name] = [row.n, row.content, sorted(frame.dtypes)]
    return hashlib.sha256(json.dumps([parts, config], sort_keys=True, default=str).encode()).hexdigest()
