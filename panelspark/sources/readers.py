"""Reading loosely described sources: everything as text, columns by role, years from file names; and the sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

DELIMITERS = "\t,;|"


def delimited(spark: SparkSession, path: str, sep: str | None = None, *, line_breaks: bool = True) -> DataFrame:
    """Delimited text (gzip too), every column a string, quotes doubled inside quotes. Rows of fewer or more cells than the
    header are dropped, whichever columns are read later.

    With `line_breaks` lines may break inside quotes. Such a file can't be split, nor can gzip: its rows come from one task;
    dealt() spreads them, once what the file's name gives is added.
    """
    options = {"sep": sep or sniff_delimiter(spark, path), "header": True, "quote": '"', "escape": '"', "multiLine": line_breaks}
    names = [f.name for f in spark.read.csv(path, inferSchema=False, **options).schema]
    bad = "__malformed"
    schema = StructType([StructField(n, StringType()) for n in [*names, bad]])
    rows = spark.read.csv(path, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord=bad, **options)
    # reading the mark of malformed rows makes Spark parse all cells; it has to be read beside another column
    return rows.filter(F.col(bad).isNull() & (F.length(F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))) >= 0)).drop(bad)


def dealt(df: DataFrame) -> DataFrame:
    """The rows of few large files over as many tasks as the session shuffles to."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that the first line has most of; the file extension is not trusted."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return max(DELIMITERS, key=line.count)


def fixed_width(lines: DataFrame, layout: dict[str, tuple[int, int, int | None]], column: str = "value") -> DataFrame:
    """layout: name -> (start, width, implied decimals or None for text)."""
    cut = {k: F.trim(F.substring(column, start, width)) for k, (start, width, _) in layout.items()}
    return lines.select(*[
        (F.nullif(c, F.lit("")) if layout[k][2] is None else c.try_cast("double") / 10.0 ** layout[k][2]).alias(k) for k, c in cut.items()])


def with_year(df: DataFrame, pattern: str = r"(\d{4})", name: str = "year") -> DataFrame:
    """The year that the file name gives; of a pair of two-digit years (2122) the later."""
    return df.withColumn(name, F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), pattern, 1).cast("int"))


def flow_file(df: DataFrame) -> DataFrame:
    """year and direction that the name of a flow file gives: `countyinflow2122.csv` -> 2022, in; `stateoutflow1112` -> 2012, out."""
    name = F.lower(F.element_at(F.split(F.input_file_name(), "/"), -1))
    pair = F.regexp_extract(name, r"(\d{4})", 1)
    direction = F.when(F.contains(name, F.lit("inflow")), "in").when(F.contains(name, F.lit("outflow")), "out")
    return df.withColumns({"year": F.when(pair != "", second_of_pair(pair)), "direction": direction})


def second_of_pair(x):
    """`2122` -> 2022."""
    return F.lit(2000) + F.substring(x, 3, 2).cast("int")


def united(parts: list[DataFrame]) -> DataFrame:
    """All rows by column name; a column that a part lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def squashed(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def find_column(columns: list[str], patterns: list[str]) -> str | None:
    """The column whose squashed name is matched whole by the earliest pattern, else in part."""
    for match in (re.fullmatch, re.search):
        for p in patterns:
            for c in columns:
                if match(p, squashed(c)):
                    return c
    return None


def select_roles(df: DataFrame, spec: dict[str, tuple]) -> DataFrame:
    """spec: name -> (patterns, type, required). A missing optional role is a typed null; a missing required one an error."""
    chosen, missing = [], []
    for name, (patterns, kind, required) in spec.items():
        found = find_column(df.columns, patterns)
        if found is None and required:
            missing.append(name)
        chosen.append((F.col(f"`{found}`").try_cast(kind) if found else F.lit(None).cast(kind)).alias(name))
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(df.columns)}")
    return df.select(*chosen)


def classify(columns: list[str], kinds: dict[str, list[list[str]]]) -> str | None:
    """The first kind each of whose groups of patterns is found among the columns."""
    for kind, groups in kinds.items():
        if all(find_column(columns, g) for g in groups):
            return kind
    return None


def array_reply(df: DataFrame, column: str = "value") -> DataFrame:
    """A reply that is a JSON array of arrays, its first row being the names; names come from the first reply."""
    rows = df.select(F.posexplode(F.from_json(column, "array<array<string>>")).alias("pos", "row"))
    names = rows.filter("pos = 0").select("row").first()[0]
    return rows.filter("pos > 0").select(*[F.col("row")[i].alias(n) for i, n in enumerate(names)])


def exploded_map(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON object whose keys are data: a row per key."""
    return df.withColumn("__m", F.from_json(column, schema)).select("*", F.explode("__m").alias("key", "item")).drop("__m")


def changed_files(spark: SparkSession, path: str, manifest: DataFrame | None) -> DataFrame:
    """(path, length, modificationTime) of files that the manifest lacks in this form."""
    now = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return now if manifest is None else now.join(manifest, ["path", "length", "modificationTime"], "left_anti")


def save_panel(df: DataFrame, path: str, by: str = "year") -> None:
    """A panel as Parquet (zstd) and as CSV, each split by year."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(by).parquet(f"{path}/parquet")
    df.write.mode("overwrite").option("header", True).partitionBy(by).csv(f"{path}/csv")
