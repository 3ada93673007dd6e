"""Table scans (S1), raw preview (S5) and the predictions export (S4)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from retentio.functions.columns import nan_to_null, normalize_key
from retentio.sources.csv_split import read_split_csv

# Text tokens read as missing (the pandas CSV reader's NA list).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

#: Larger quoted CSV files are read in byte ranges.
SPLIT_BYTES = 128 << 20

CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"'}


def _csv_reader(spark: SparkSession, schema: T.StructType | str | None, multiline: bool = True):
    # multiLine keeps quoted newlines inside one field, but such a file is read by
    # one task: larger files go through csv_split.
    r = spark.read.options(**CSV_OPTIONS).option("multiLine", "true" if multiline else "false")
    if schema is not None:
        return r.schema(schema)
    return r.option("inferSchema", "false")


def _largest_file(spark: SparkSession, path: str) -> int | None:
    """Bytes of the largest file below ``path`` (a listing, no content is read)."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]


def _normalise_na_and_types(df: DataFrame, infer: bool, key: str | None = None) -> DataFrame:
    """NA tokens -> NULL; then, if asked, type each text column as boolean
    (True/False), bigint or double when all its non-null values parse so;
    other columns (dates included) stay text and are parsed where used.  The
    ``key`` is never typed: '007' and '7' are different customers, and long
    digit strings do not fit a number."""
    exprs = {}
    str_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    for c in str_cols:
        exprs[c] = F.when(~F.col(c).isin(*NA_TOKENS), F.col(c))
    df = df.withColumns(exprs) if exprs else df
    str_cols = [c for c in str_cols if c != key]
    if not infer or not str_cols:
        return df
    # One distributed pass decides every column's type (bounded 3*ncols result).
    checks = []
    for c in str_cols:
        v = F.col(c)
        checks += [
            F.sum(F.when(v.isNotNull() & v.try_cast("bigint").isNull(), 1).otherwise(0)).alias(f"{c}__l"),
            F.sum(F.when(v.isNotNull() & v.try_cast("double").isNull(), 1).otherwise(0)).alias(f"{c}__d"),
            F.sum(F.when(v.isNotNull(), 1).otherwise(0)).alias(f"{c}__n"),
            F.sum(F.when(v.isNotNull() & ~F.lower(v).isin("true", "false"), 1).otherwise(0)).alias(f"{c}__b"),
        ]
    stats = df.agg(*checks).first().asDict()
    casts = {}
    for c in str_cols:
        if stats[f"{c}__n"] == 0:
            continue
        if stats[f"{c}__b"] == 0:
            casts[c] = F.lower(F.col(c)) == "true"
        elif stats[f"{c}__l"] == 0:
            casts[c] = F.col(c).cast("bigint")
        elif stats[f"{c}__d"] == 0:
            casts[c] = F.col(c).cast("double")
    return df.withColumns(casts) if casts else df


def _file_place():
    """Sorts by file, block and row: a block is read by one task, in order."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: T.StructType | str | None = None, optional: bool = False,
               infer_types: bool = True, key: str | None = "customer_id",
               multiline: bool = True, row_id: str | None = None,
               split_bytes: int = SPLIT_BYTES) -> DataFrame | None:
    """Read a CSV or Parquet table.

    CSV: header row, quoted fields may hold newlines and doubled quotes; NA
    tokens become NULL; without a schema each text column gets the narrowest
    numeric type all its values parse as.  NaN becomes NULL, and the entity key
    is cast to string.  ``optional=True`` returns None for a missing path
    instead of raising (the dashboard's behaviour).  A folder with a CSV file of
    more than ``split_bytes`` is read in byte ranges by many tasks, with the same
    rows; ``multiline=False`` spares that when no field holds a newline;
    passing ``schema`` skips the type-inference pass.  ``row_id`` adds a column
    that sorts rows by file path, then by place in the file, for tables whose
    row order matters and that carry no order key.
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    try:
        if fmt == "csv":
            reader = _csv_reader(spark, schema, multiline)
            df = reader.csv(path)
            if multiline and (_largest_file(spark, path) or 0) > split_bytes:
                df = read_split_csv(spark, path, df.schema, CSV_OPTIONS, row_id)
            if row_id and row_id not in df.columns:
                df = df.withColumn(row_id, _file_place())
            df = _normalise_na_and_types(df, infer=infer_types and schema is None, key=key)
        else:
            df = spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
    except AnalysisException as e:
        if optional and "PATH_NOT_FOUND" in str(e):
            return None
        raise
    if row_id and row_id not in df.columns:
        df = df.withColumn(row_id, _file_place())
    df = nan_to_null(df)
    if key:
        df = normalize_key(df, key)
    return df


# What both CSV exports write, and S1 reads back unchanged: doubled quotes, empty strings as such.
EXPORT_OPTIONS = {"escape": '"', "quote": '"', "emptyValue": "", "timestampFormat": "yyyy-MM-dd HH:mm:ss"}


def _scalar_columns_only(df: DataFrame) -> None:
    bad = [f.name for f in df.schema.fields
           if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) or f.dataType.typeName() == "vector"]
    if bad:
        raise ValueError(f"widen or drop non-scalar columns before export: {bad}")


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write every scored customer as a folder of CSV parts with headers (S4).

    Quotes are doubled, empty strings stay empty, so S1 reads it back
    unchanged.  Vector/array columns must be widened or dropped first.
    """
    _scalar_columns_only(df)
    df.write.mode(mode).options(header="true", **EXPORT_OPTIONS).csv(path)


def export_csv(df: DataFrame, path: str, order_by: Sequence[str] = ("customer_id",)) -> None:
    """Write one CSV file with one header, rows in ``order_by`` order (S4).

    Tasks write ordered parts beside the target; the parts are put together by
    the file system's own concatenation where it has one, by a streaming copy
    elsewhere, and the whole is renamed over ``path``.  Until then an earlier
    file stays as it was, and a failed run leaves neither parts nor half a file.
    """
    _scalar_columns_only(df)
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    work = f"{path.rstrip('/')}.writing-{uuid.uuid4().hex[:12]}"
    folder, target = hadoop.Path(work), hadoop.Path(path)
    fs = target.getFileSystem(conf)

    def parts(name):
        found = [x.getPath() for x in fs.listStatus(hadoop.Path(f"{work}/{name}"))]
        return sorted((x for x in found if x.getName().startswith("part-")), key=lambda x: x.getName())
    try:
        # all are text, so the header is quoted as the rows are
        names = spark.createDataFrame([tuple(df.columns)], ", ".join(f"c{i} string" for i in range(len(df.columns))))
        names.coalesce(1).write.options(header="false", **EXPORT_OPTIONS).csv(f"{work}/names")
        df.orderBy(*order_by).write.options(header="false", **EXPORT_OPTIONS).csv(f"{work}/rows")
        whole = parts("names")[0]
        rows = [x for x in parts("rows") if fs.getFileStatus(x).getLen() > 0]
        if rows:
            try:
                array = spark.sparkContext._gateway.new_array(hadoop.Path, len(rows))
                for i, x in enumerate(rows):
                    array[i] = x
                fs.concat(whole, array)
            except UnsupportedOperationException:
                joined = hadoop.Path(f"{work}/whole.csv")
                out = fs.create(joined)
                try:
                    for x in [whole, *rows]:
                        part = fs.open(x)
                        try:
                            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                        finally:
                            part.close()
                finally:
                    out.close()
                whole = joined
        rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
        how = spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(whole), fs.makeQualified(target), how)
    finally:
        fs.delete(folder, True)


def preview(df: DataFrame, key: Sequence[str] | str, n: int = 200) -> DataFrame:
    """First ``n`` rows by an explicit key (S5, L3) — a top-k, not a full sort."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*keys).limit(n)
