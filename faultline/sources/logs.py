"""Log scans: five formats, detection per file, routing, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import fields as X
from faultline.operators.slices import positions
from faultline.sources import quoted

PARSED_FIELDS = ("line_number", "format", *X.COMMON_FIELDS, "raw_data", "file", "corrupt")
SAMPLE_LINES = 8

_FORMATS: dict[str, Callable[..., DataFrame]] = {}


def register_format(name: str, scan: Callable[..., DataFrame]) -> None:
    """Add or replace the scan ``(spark, paths, mapping) -> parsed`` of a format."""
    _FORMATS[name] = scan


def read_lines(spark: SparkSession, paths: str | list[str], line_numbers: bool = False) -> DataFrame:
    """Non-blank lines with their file; numbers are 1-based and count blanks."""
    raw = spark.read.text(paths).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    if line_numbers:
        # A file block is a bounded slice of its file, so no file has to pass through one task.
        raw = raw.withColumn("_at", F.monotonically_increasing_id())
        raw = positions(raw, ["file"], ["_block"], ["_at"], "line_number")
    else:
        raw = raw.withColumn("line_number", F.lit(None).cast("bigint"))
    return raw.filter(F.trim("line") != "").select("file", "line_number", "line")


def _record(df: DataFrame, fmt: str, common: dict[str, Column], raw_data: Column, corrupt: Column) -> DataFrame:
    wanted = {"file": F.lit(None).cast("string"), "line_number": F.lit(None).cast("bigint")}
    keep = {c: (F.col(c) if c in df.columns else missing) for c, missing in wanted.items()}
    null = F.lit(None).cast("string")
    columns = {f: common.get(f, null) for f in X.COMMON_FIELDS}
    extra = [c for c in df.columns if c not in {"file", "line_number", "line", "_json", "_data", "_keys", "_kinds", *PARSED_FIELDS}]
    return df.select(
        keep["line_number"].alias("line_number"),
        F.lit(fmt).alias("format"),
        *[c.alias(f) for f, c in columns.items()],
        raw_data.alias("raw_data"),
        keep["file"].alias("file"),
        corrupt.alias("corrupt"),
        *extra,
    )


def _with_data(df: DataFrame, data: Column) -> DataFrame:
    """The row's map, and the same with normal keys, each computed once."""
    return df.withColumn("_data", data).withColumn("_keys", X.normal_keys(F.col("_data")))


def _common(mapping: dict[str, str] | None) -> dict[str, Column]:
    m, keys = F.col("_data"), F.col("_keys")
    if mapping:
        return X.apply_mapping(m, mapping, keys)
    return {f: X.convert(f, c) for f, c in X.extract_raw(m, keys).items()}


def parse_plain(lines: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    fields = X.extract_plain(F.col("line"))
    if mapping:
        text = {f: c.cast("string") for f, c in fields.items()}
        m = F.create_map(*[x for f, c in text.items() for x in (F.lit(f), c)])
        fields = X.apply_mapping(m, mapping)
    raw = F.create_map(F.lit("line"), F.col("line"))
    return _record(lines, "plain_text", fields, raw, F.lit(False))


def parse_kv(lines: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    df = _with_data(lines, X.extract_kv(F.col("line")))
    raw = F.map_concat(F.create_map(F.lit("line"), F.col("line")), F.col("_data"))
    return _record(df, "structured_text", _common(mapping), raw, F.lit(False))


def parse_jsonl(lines: DataFrame, mapping: dict[str, str] | None = None, fmt: str = "jsonl") -> DataFrame:
    """One JSON object per line; other lines are kept and marked corrupt."""
    df = _with_data(lines, F.from_json("line", "map<string,string>"))
    common = _common(mapping)
    if not (mapping and "timestamp" in mapping):
        keys = F.col("_keys")
        text = X.first_alias(keys, "timestamp")
        # Only a numeric text needs to know whether it was a JSON number.
        number_text = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"
        typed = F.transform_values(F.from_json("line", "map<string,variant>"), lambda _, v: F.schema_of_variant(v))
        df = df.withColumn("_kinds", F.when(text.rlike(number_text), X.normal_keys(typed)))
        kind_keys = F.col("_kinds")
        kind = F.coalesce(
            *[
                F.when(X.blank_to_null(F.try_element_at(keys, F.lit(a))).isNotNull(), F.try_element_at(kind_keys, F.lit(a)))
                for a in X.ALIASES["timestamp"]
            ]
        )
        number = text.try_cast("double")
        is_number = kind_keys.isNotNull()
        common["timestamp"] = F.when(is_number, F.when(kind != "STRING", X.parse_epoch(number))).otherwise(
            common["timestamp"]
        )
    return _record(df, fmt, common, F.col("_data"), F.col("_data").isNull())


def parse_json(docs: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Column ``line`` holds a whole document: one object or an array of objects."""
    body = F.trim("line")
    single = F.array(F.try_parse_json("line"))
    many = F.try_variant_get(F.try_parse_json("line"), "$", "array<variant>")
    items = F.when(F.startswith(body, F.lit("[")), many).otherwise(single)
    kept = docs.drop("line_number").withColumn("_json", items)
    exploded = kept.select(
        *[c for c in kept.columns if c not in {"_json", "line"}], F.posexplode_outer("_json").alias("_pos", "_item")
    )
    is_object = F.startswith(F.schema_of_variant("_item"), F.lit("OBJECT"))
    lines = exploded.select(
        *[c for c in exploded.columns if c not in {"_pos", "_item"}],
        (F.col("_pos") + 1).cast("bigint").alias("line_number"),
        F.when(is_object, F.to_json("_item")).alias("line"),
    )
    return parse_jsonl(lines, mapping, fmt="json")


def parse_csv(rows: DataFrame, mapping: dict[str, str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """String columns of a CSV read; all-blank rows are dropped."""
    names = columns or [c for c in rows.columns if c not in {"file", "line_number"}]
    filled = F.coalesce(*[F.when(F.trim(F.col(f"`{c}`")) != "", F.lit(True)) for c in names])
    data = F.create_map(*[x for c in names for x in (F.lit(c), F.col(f"`{c}`"))])
    df = _with_data(rows.filter(filled), data).drop(*names)
    return _record(df, "csv", _common(mapping), F.col("_data"), F.lit(False))


def scan_plain(spark, paths, mapping=None, line_numbers: bool = False) -> DataFrame:
    return parse_plain(read_lines(spark, paths, line_numbers), mapping)


def scan_kv(spark, paths, mapping=None, line_numbers: bool = False) -> DataFrame:
    return parse_kv(read_lines(spark, paths, line_numbers), mapping)


def scan_jsonl(spark, paths, mapping=None, line_numbers: bool = False) -> DataFrame:
    return parse_jsonl(read_lines(spark, paths, line_numbers), mapping)


def scan_json(spark, paths, mapping=None, line_numbers: bool = False) -> DataFrame:
    docs = spark.read.option("wholetext", True).text(paths)
    return parse_json(docs.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")), mapping)


def scan_csv(spark, paths, mapping=None, line_numbers: bool = False) -> DataFrame:
    """CSV files, each with its own header; data rows count from 2 when numbered.

    A file is read by many tasks, also where quoted cells hold line breaks.
    """
    rows = quoted.rows(spark, paths).filter(F.exists(F.map_values("data"), lambda v: F.trim(v) != ""))
    rows = rows if line_numbers else rows.withColumn("line_number", F.lit(None).cast("bigint"))
    df = _with_data(rows, F.col("data")).drop("data")
    return _record(df, "csv", _common(mapping), F.col("_data"), F.lit(False))


register_format("plain_text", scan_plain)
register_format("structured_text", scan_kv)
register_format("json", scan_json)
register_format("jsonl", scan_jsonl)
register_format("csv", scan_csv)


def detect_samples(samples: DataFrame) -> DataFrame:
    """(file, lines: first lines of the file, in order) -> format, confidence, reason."""
    lines = F.filter("lines", lambda x: F.trim(x) != "")
    n = F.size(lines)
    ext = F.lower(F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"^.+(\.[^.]*)$", 1))
    first = F.try_element_at(lines, F.lit(1))
    joined = F.trim(F.array_join(lines, ""))
    objects = F.forall(
        lines,
        lambda x: F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(x)), F.lit("OBJECT")), F.lit(False)),
    )
    document = joined.rlike(r"^[{\[]") & F.try_parse_json(joined).isNotNull()
    header = F.exists(F.split(first, ","), lambda c: F.trim(c).rlike(r"^(?U)[\p{L}_]\w*$") | F.contains(c, F.lit("_")))
    csv_like = (n >= 2) & F.contains(first, F.lit(",")) & header
    pairs = F.size(F.filter(lines, lambda x: F.contains(x, F.lit("="))))
    structured = (n > 0) & (pairs >= F.greatest(F.lit(1), F.floor(n / 2)))

    def verdict(fmt: str, confidence: float, reason: str | Column) -> Column:
        why = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(
            F.lit(fmt).alias("format"), F.lit(confidence).alias("confidence"), why.alias("reason")
        )

    quoted = F.concat(F.lit("extension '"), ext, F.lit("'"))
    chosen = (
        F.when(ext == ".csv", verdict("csv", 0.95, "csv extension"))
        .when(ext == ".jsonl", verdict("jsonl", 0.95, "jsonl extension"))
        .when((n >= 2) & objects, verdict("jsonl", 0.9, "each sample line is a JSON object"))
        .when((ext == ".json") | F.coalesce(document, F.lit(False)), verdict("json", 0.9, "json document"))
        .when(csv_like, verdict("csv", 0.85, "csv-like header row"))
        .when(structured, verdict("structured_text", 0.8, "key=value structured text"))
        .when(ext != "", verdict("plain_text", 0.6, quoted))
        .otherwise(verdict("plain_text", 0.5, "default plain text"))
    )
    return samples.withColumn("_v", chosen).select("file", "_v.*", first.alias("first_line"))


def detect_formats(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    from pyspark.sql import Window

    raw = spark.read.text(paths).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at"),
    )
    w = Window.partitionBy("file").orderBy("_at")
    head = raw.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= SAMPLE_LINES)
    samples = head.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("_n", "line"))).alias("_l"))
    return detect_samples(samples.select("file", F.col("_l.line").alias("lines"))).drop("first_line")


def scan_logs(
    spark: SparkSession,
    paths: list[str] | None = None,
    lines: list[str] | None = None,
    mapping: dict[str, str] | None = None,
    line_numbers: bool = False,
) -> DataFrame:
    """Inline lines as plain text, then every file with its detected format.

    The path list is the caller's, so one verdict per listed file is what
    comes back to the driver; file contents never do.
    """
    parts: list[DataFrame] = []
    if lines:
        inline = spark.createDataFrame(
            [(i + 1, text) for i, text in enumerate(lines) if text.strip()], "line_number bigint, line string"
        )
        parts.append(parse_plain(inline, mapping))
    by_format: dict[str, list[str]] = {}
    if paths:
        for row in detect_formats(spark, paths).orderBy("file").collect():
            by_format.setdefault(row["format"], []).append(row["file"])
    for fmt, files in by_format.items():
        parts.append(_FORMATS[fmt](spark, files, mapping, line_numbers=line_numbers))
    if not parts:
        raise ValueError("no lines and no paths")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def parse_stats(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("file", "format").agg(
        F.count_if(~F.col("corrupt")).alias("records_parsed"), F.count_if(F.col("corrupt")).alias("records_skipped")
    )


def validate_mapping(
    df: DataFrame, mapping: dict[str, str], require_message: bool = False, sample: int | None = None
) -> DataFrame:
    """Errors of a field mapping on a map column ``data``, one row per error.

    ``sample`` is the number of rows looked at; all of them by default.
    """
    if not mapping:
        raise ValueError("at least one field mapping is required")
    rows = df.limit(sample) if sample else df
    checks = {}
    for field, column in mapping.items():
        value = X.resolve_column(F.col("data"), column)
        checks[f"column '{column}' for '{field}' not found in sample data"] = F.count(value) == 0
        if field in ("timestamp", "severity"):
            bad = value.isNotNull() & X.convert(field, value).isNull()
            checks[f"column '{column}' contains unparseable {field}"] = F.count_if(bad) > 0
        if field == "message" and require_message:
            checks[f"column '{column}' for message is empty in sample data"] = (
                F.count_if(F.coalesce(value, F.lit("")) != "") == 0
            )
    found = rows.agg(
        F.array_compact(F.array(*[F.when(bad, F.lit(text)) for text, bad in checks.items()])).alias("e")
    )
    return found.select(F.explode("e").alias("error"))
