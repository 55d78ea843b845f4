"""What readers can't read, as rows: files that are no JSON, and cells that don't hold what their column is for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of what was rejected that a row shows.
SHOWN = 200


def broken_json(spark: SparkSession, path: str, files: str = "*.json") -> DataFrame:
    """(path, severity, message, shown): files of a folder and its subfolders that are empty or no JSON, from which readers take no rows."""
    raw = spark.read.option("pathGlobFilter", files).option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    blank = F.trim("value") == ""
    return raw.where(blank | F.try_parse_json("value").isNull()).select(
        "path", F.lit("ERROR").alias("severity"), F.when(blank, "the file is empty").otherwise("the file isn't JSON").alias("message"), F.substring("value", 1, SHOWN).alias("shown")
    )


def unread_cells(raw: DataFrame, kinds: dict[str, str], path: Column | None = None) -> DataFrame:
    """(path, severity, message, shown): cells of columns of text that hold something but not what their column is for. A reader takes
    null or its default instead. kinds: column -> type."""
    held = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    cells = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), held(c).alias("value"), (held(c).isNotNull() & held(c).try_cast(k).isNull()).alias("bad")) for c, k in kinds.items() if c in raw.columns]
    each = raw.select((path if path is not None else F.col("_metadata.file_path")).alias("path"), F.explode(F.filter(F.array(*cells), lambda x: x["bad"])).alias("c"))
    return each.select("path", F.lit("WARNING").alias("severity"), F.concat(F.lit("no "), "c.kind", F.lit(" in column "), "c.column").alias("message"), F.substring("c.value", 1, SHOWN).alias("shown"))


def import_log(accepted: dict[str, DataFrame], rejected: list[DataFrame], import_id: Column) -> tuple[DataFrame, DataFrame]:
    """records (import_id, entity) and errors (import_id, severity) of an import, as import_summary() takes them. accepted: what each
    reader returned, with import_id; import_id: of rejected rows, from their path."""
    records = errors = None
    for entity, rows in accepted.items():
        one = rows.select("import_id", F.lit(entity).alias("entity"))
        records = one if records is None else records.unionByName(one)
    for rows in rejected:
        one = rows.select(import_id.alias("import_id"), "severity")
        errors = one if errors is None else errors.unionByName(one)
    return records, errors
