"""File inputs: inferred, raw-text and tolerant CSV, Parquet, directories, guarded SQL."""
from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
UTF8, CP1251, LATIN1 = "UTF-8", "cp1251", "ISO-8859-1"
SEPARATORS = [",", ";", "\t", "|"]
DML_WORDS = ["INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "MERGE", "GRANT", "REVOKE", "RENAME",
             "ATTACH", "DETACH", "OPTIMIZE", "SYSTEM", "SET", "KILL"]


def _cp1251_table() -> tuple[str, str]:
    """Upper half of the byte table as Latin-1 reads it, and as it is meant; the unassigned byte stays."""
    upper = [bytes([b]) for b in range(0x80, 0x100)]
    return "".join(b.decode("latin-1") for b in upper), "".join(
        b.decode("cp1251") if b != b"\x98" else "\x98" for b in upper)


def from_cp1251(c: Column) -> Column:
    """Text that was read byte for byte as Latin-1, as Cyrillic."""
    return F.translate(c, *_cp1251_table())


def to_cp1251(c: Column) -> Column:
    """The reverse, for writing with the Latin-1 encoder."""
    return F.translate(c, *_cp1251_table()[::-1])


def read_csv_inferred(spark: SparkSession, path: str, sampling_ratio: float = 1.0, sep: str = ",") -> DataFrame:
    return (spark.read.option("header", True).option("inferSchema", True).option("samplingRatio", sampling_ratio)
            .option("sep", sep).csv(path))


def read_csv_raw(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8",
                 columns: Sequence[str] | None = None) -> DataFrame:
    """Every column text; missing values and whole-value ``nan`` become ''.

    With ``columns`` the header is not read for a schema, which saves a pass over the listing.
    """
    cyrillic = encoding == CP1251
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", LATIN1 if cyrillic else encoding)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = reader.csv(path)
    names = [c.encode("latin-1", "replace").decode("cp1251", "replace") if cyrillic else c for c in df.columns]

    def clean(c: Column) -> Column:
        text = from_cp1251(c) if cyrillic else c
        return F.when(F.lower(F.trim(c)) == "nan", "").otherwise(F.coalesce(text, F.lit("")))

    return df.select(*[clean(F.col(f"`{c}`")).alias(n) for c, n in zip(df.columns, names)])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_dir(spark: SparkSession, folder: str, pattern: str = "*", fmt: str = "parquet", **options: str) -> DataFrame:
    return spark.read.format(fmt).options(**options).option("pathGlobFilter", pattern).load(folder)


def rows_per_file(df: DataFrame) -> DataFrame:
    return df.groupBy(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file")).agg(F.count("*").alias("n"))


def sniff_separator(spark: SparkSession, path: str, lines: int = 20) -> str:
    """The separator that splits the first lines most evenly; reads a bounded number of lines."""
    head = [row.value for row in spark.read.text(path).limit(lines).collect() if row.value]

    def score(sep: str) -> tuple[int, int]:
        counts = [line.count(sep) for line in head]
        return (sum(c == counts[0] for c in counts), counts[0]) if counts and counts[0] else (0, 0)

    return max(SEPARATORS, key=score)


def pick_encoding(spark: SparkSession, path: str) -> str:
    """The first table that can decode all lines: UTF-8, the Cyrillic one, Latin-1. One or two distributed passes."""
    if not spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count():
        return UTF8
    lines = spark.read.option("encoding", LATIN1).option("sep", "\x01").option("quote", "").csv(path)
    return LATIN1 if lines.where(F.col("_c0").contains("\x98")).limit(1).count() else CP1251


def read_csv_tolerant(spark: SparkSession, path: str, encoding: str | None = None, sep: str | None = None) -> DataFrame:
    return read_csv_raw(spark, path, sep or sniff_separator(spark, path), encoding or pick_encoding(spark, path))


def resolve_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """One column per target: the first alias that is present and not NULL, else the default."""
    defaults = defaults or {}
    picked = []
    for target, names in aliases.items():
        present = [F.col(f"`{n}`") for n in names if n in df.columns]
        picked.append(F.coalesce(*present, F.lit(defaults.get(target, ""))).alias(target))
    return df.select(*picked)


def safe_select(spark: SparkSession, sql: str, limit: int = 1000) -> DataFrame:
    """One SELECT (or WITH) statement without data-changing words; a row limit is added when the text has none."""
    text = sql.strip().rstrip(";").strip()
    bare = re.sub(r"'(?:[^']|'')*'", "''", text)
    if ";" in bare:
        raise ValueError("only one statement is allowed")
    if not re.match(r"(?is)^\s*(select|with)\b", bare):
        raise ValueError("only SELECT is allowed")
    for word in DML_WORDS:
        if re.search(rf"(?i)\b{word}\b", bare):
            raise ValueError(f"{word} is not allowed")
    df = spark.sql(text)
    return df if re.search(r"(?i)\blimit\b", bare) else df.limit(limit)
