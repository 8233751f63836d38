"""Scans: Parquet, CSV, JSON and folders of workbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyforge.functions.semantics import any_of, col, nan_to_null, text_columns
from tallyforge.sources.excel import sheet_rows

_CORRUPT = "_corrupt_record"
SUPPORTED = {".csv", ".json", ".xlsx", ".parquet"}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table; zone-less timestamps become TIMESTAMP, NaN becomes NULL."""
    return nan_to_null(spark.read.parquet(f"{folder}/{name}.parquet"))


def reject_empty(df: DataFrame) -> DataFrame:
    """The frame itself; raises when it has no columns or no rows."""
    if not df.columns or df.isEmpty():
        raise ValueError("Dataset is empty or has no columns.")
    return df


def _csv(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    header = spark.read.csv(path, header=True, encoding=encoding, multiLine=False)
    schema = T.StructType([T.StructField(f.name, T.StringType()) for f in header.schema])
    return spark.read.schema(schema.add(_CORRUPT, T.StringType())).csv(
        path, header=True, encoding=encoding, mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT
    )


def read_csv(spark: SparkSession, path: str, keep_bad: bool = False) -> DataFrame:
    """Header CSV as text columns; malformed lines are left out (or kept in ``_corrupt_record``).

    The file is read as UTF-8; when that yields replacement characters it is read
    again as Latin-1.
    """
    df = _csv(spark, path, "UTF-8")
    texts = text_columns(df)
    garbled = any_of([F.coalesce(F.contains(col(c), F.lit("�")), F.lit(False)) for c in texts])
    if any("�" in c for c in df.columns) or not df.where(garbled).isEmpty():
        df = _csv(spark, path, "ISO-8859-1")
    if keep_bad:
        return df
    return df.where(col(_CORRUPT).isNull()).drop(_CORRUPT)


def count_bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """Good and malformed line counts of a CSV."""
    df = read_csv(spark, path, keep_bad=True)
    bad = col(_CORRUPT).isNotNull()
    return df.agg(F.count_if(~bad).alias("good_lines"), F.count_if(bad).alias("bad_lines"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON of one array or one object per file: records, or an object of columns; a bare list of scalars becomes column ``value``.

    An object whose members are all objects or all arrays holds columns (``{"a": {"0": 1, "1": 2}}``, ``{"a": [1, 2]}``); see
    ``columns_as_rows``. Any other object is one record. Files of both kinds under one path are refused.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    members = F.map_values(F.from_json(F.when(F.regexp("value", F.lit(r"^\s*\{")), F.col("value")), "map<string,string>"))
    nested = (F.size(members) > 0) & F.forall(members, lambda m: F.coalesce(F.regexp(m, F.lit(r"^\s*[\[{]")), F.lit(False)))
    kinds = whole.where(F.regexp("value", F.lit(r"\S"))).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.coalesce(nested, F.lit(False))).alias("by_columns")).first()
    if kinds["by_columns"]:
        if kinds["by_columns"] < kinds["files"]:
            raise ValueError("Could not read dataset: files of records and files of columns under one path.")
        return columns_as_rows(whole)
    df = spark.read.json(path, multiLine=True)
    if df.columns == [_CORRUPT]:
        whole = spark.read.text(path, wholetext=True)
        return whole.select(F.explode(F.from_json("value", "array<string>")).alias("value"))
    return nan_to_null(df)


def columns_as_rows(files: DataFrame) -> DataFrame:
    """Rows of ``file`` and ``value``, a JSON object of columns: values with an equal key (or place in an array) make one row.

    Columns come in the order of their first place; a key that a column lacks is NULL there. A column is LONG, DOUBLE or BOOLEAN where all
    its values are, else text. Values are spread by file and key, so only the text of one file is held in one task; the driver
    gets one line per column.
    """
    members = F.map_entries(F.from_json("value", "map<string,string>"))
    column = files.select("file", F.posexplode(members).alias("place", "member"))
    text = F.col("member.value")
    listed = F.transform(F.from_json(text, "array<string>"), lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value")))
    keyed = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    cells = column.select("file", "place", F.col("member.key").alias("name"), F.explode_outer(F.when(F.regexp(text, F.lit(r"^\s*\[")), listed).otherwise(keyed)).alias("cell")
                          ).select("file", "place", "name", "cell.key", F.col("cell.value").alias("value"))
    known = F.col("value").isNotNull()
    kinds = {"bigint": r"^[+-]?[0-9]{1,18}$", "double": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", "boolean": "^(true|false)$"}
    facts = cells.groupBy("name").agg(
        F.min(F.struct("file", "place")).alias("at"), F.count_if(known).alias("n"),
        *[F.count_if(known & F.regexp("value", F.lit(shape))).alias(kind) for kind, shape in kinds.items()]).orderBy("at", "name").collect()
    types = {r["name"]: next((kind for kind in kinds if r["n"] and r[kind] == r["n"]), "string") for r in facts}
    rows = cells.where(F.col("key").isNotNull()).groupBy("file", "key").agg(
        *[F.max(F.when(F.col("name") == name, F.col("value"))).cast(kind).alias(name) for name, kind in types.items()])
    return nan_to_null(rows.select(*[rows[f"`{name}`"] for name in types]))


def read_excel_folder(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """First sheet of every .xlsx below ``path``; files are spread over tasks, all values are text.

    Columns default to the headers of all files, in the order of files and of columns in
    them; a file without a column has NULL there. ``source_file`` tells the files apart.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    if columns is None:
        columns = header_union(files)
        if not columns:
            raise ValueError("Dataset is empty or has no columns.")
    return parse_workbooks(files, columns)


def header_union(files: DataFrame) -> list[str]:
    """All column names of workbooks, by file and place. Headers are read in tasks; only distinct names reach the driver."""
    def names(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame([(file, k, name) for file, content in zip(batch["path"], batch["content"])
                                for k, name in enumerate(next(sheet_rows(bytes(content)), []))], columns=["file", "place", "name"])

    found = files.mapInPandas(names, "file string, place int, name string")
    first = found.groupBy("name").agg(F.min(F.struct("file", "place")).alias("at")).orderBy("at", "name")
    return [r["name"] for r in first.collect()]


def parse_workbooks(files: DataFrame, columns: list[str]) -> DataFrame:
    """(source_file, columns...) from rows of ``path`` and workbook ``content``; a workbook is read as a stream."""
    names = list(columns)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ["source_file", *names]])

    def parse(batches):
        import pandas as pd

        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                rows = sheet_rows(bytes(content))
                header = next(rows, [])
                where = [header.index(n) if n in header else None for n in names]
                chunk = []
                for row in rows:
                    chunk.append([file] + [row[i] if i is not None and i < len(row) else None for i in where])
                    if len(chunk) == 10000:
                        yield pd.DataFrame(chunk, columns=schema.names)
                        chunk = []
                if chunk:
                    yield pd.DataFrame(chunk, columns=schema.names)

    return files.mapInPandas(parse, schema)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Read by suffix and refuse empty input."""
    suffix = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix not in SUPPORTED:
        raise ValueError("Unsupported file type. Upload CSV, XLSX, or JSON.")
    if suffix == ".csv":
        df = read_csv(spark, path)
    elif suffix == ".json":
        df = read_json(spark, path)
    elif suffix == ".xlsx":
        df = read_excel_folder(spark, path).drop("source_file")
    else:
        df = nan_to_null(spark.read.parquet(path))
    return reject_empty(df)
