"""Archives, exports and profiles of files. Everything is written by Spark's sinks in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_raw(payloads: DataFrame, root: str, provider: str, import_id: str) -> None:
    """Archives payloads (match_external_id, payload) before they are parsed, by provider, import and match."""
    keyed = payloads.select(F.lit(provider).alias("provider"), F.lit(import_id).alias("import_id"), "match_external_id", "payload")
    keyed.repartition("match_external_id").write.mode("append").partitionBy("provider", "import_id", "match_external_id").json(root)


def _flat(df: DataFrame) -> list[Column]:
    nested = ("array", "map", "struct")
    return [F.to_json(f"`{c}`").alias(c) if t.startswith(nested) else F.col(f"`{c}`").cast("string").alias(c) for c, t in df.dtypes]


def export_csv(df: DataFrame, path: str) -> None:
    """Header, empty cells for null, JSON in cells of nested columns, quotes where needed."""
    df.select(*_flat(df)).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_sql(df: DataFrame, path: str, table: str) -> None:
    """An INSERT for each row: numbers and truth values bare, the rest quoted, null as NULL."""
    bare = ("int", "bigint", "smallint", "tinyint", "double", "float", "decimal", "boolean")
    cells = [F.coalesce(F.col(f"`{c}`").cast("string") if t.startswith(bare) else F.concat(F.lit("'"), F.regexp_replace(v, "'", "''"), F.lit("'")), F.lit("NULL")) for v, (c, t) in zip(_flat(df), df.dtypes)]
    names = ", ".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    df.select(F.concat(F.lit(f'INSERT INTO "{table}" ({names}) VALUES ('), F.concat_ws(", ", *cells), F.lit(");")).alias("line")).write.mode("overwrite").text(path)


def profile_file(df: DataFrame, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One row (rows, columns, blank_columns), and the ids that occur repeatedly with their counts."""
    full = [F.coalesce(F.max((F.trim(F.col(f"`{c}`").cast("string")) != "").cast("int")), F.lit(0)).alias(c) for c in df.columns]
    one = df.agg(F.count("*").alias("__rows"), *full)
    blank = F.filter(F.array(*(F.when(F.col(f"`{c}`") == 0, F.lit(c)) for c in df.columns)), lambda c: c.isNotNull())
    id_ = F.col(f"`{key or df.columns[0]}`")
    repeated = df.where(id_.isNotNull()).groupBy(id_.alias("id")).agg(F.count("*").alias("n")).where("n > 1")
    return one.select(F.col("__rows").alias("rows"), F.lit(len(df.columns)).alias("columns"), blank.alias("blank_columns")), repeated
