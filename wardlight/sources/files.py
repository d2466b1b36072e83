"""Dropped and uploaded files: reading, gates, parsing, per-file summary."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.functions import columns as c
from wardlight.operators.normalize import parse_fields
from wardlight.operators.ordering import small_side

DROP_PATTERN = "*.{json,jsonl,txt}"
# Extensions an upload may have.
UPLOAD_EXTENSIONS = ["json", "jsonl", "csv", "log", "txt"]
MAX_FILE_BYTES = 100 * 1024 * 1024
RATIO_CAP = 20.0
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def scan_drop(spark: SparkSession, folder: str, pattern: str = DROP_PATTERN) -> DataFrame:
    """(file, received_at, line): every line of the dropped files, recursively.

    Lines are split by Spark's text source, so a large file is read by many
    tasks.
    """
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(folder)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_modification_time").alias("received_at"),
            F.col("value").alias("line"),
        )
    )


def stream_drop(spark: SparkSession, folder: str, pattern: str = DROP_PATTERN, files_per_trigger: int = 100) -> DataFrame:
    """The same as a stream; each file is read from its beginning once."""
    return (
        spark.readStream.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .text(folder)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_modification_time").alias("received_at"),
            F.col("value").alias("line"),
        )
    )


def extension(name: Column) -> Column:
    """Lower-case extension without the dot; empty when there is none."""
    return F.lower(F.regexp_extract(name, r"[^/\\]\.([A-Za-z0-9]+)$", 1))


def read_files(spark: SparkSession, folder: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(file, ext, bytes, content): uploaded files.

    A file beyond ``max_bytes`` has a row with null content, which is never
    read; :func:`utf8_gate` refuses it by name.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = [F.col("path").alias("file"), extension(F.col("path")).alias("ext"), F.col("length").alias("bytes")]
    small = found.filter(F.col("length") <= max_bytes).select(*named, "content")
    large = found.filter(F.col("length") > max_bytes).select(*named, F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def utf8_gate(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``verdict``: accepted, or why the file is refused.

    A file is refused for its extension, for its size (no content was read),
    for bytes that are not UTF-8, or for a NUL byte.
    """
    as_text = F.col(content).cast("string")
    return files.withColumn(
        "verdict",
        F.when(~F.col("ext").isin(UPLOAD_EXTENSIONS), "UNSUPPORTED_FILE_TYPE")
        .when(F.col(content).isNull(), "FILE_TOO_LARGE")
        .when(~F.is_valid_utf8(as_text), "BINARY_CONTENT_REJECTED")
        .when(F.instr(as_text, "\0") > 0, "BINARY_CONTENT_REJECTED")
        .otherwise("accepted"),
    )


def decompression_gate(
    files: DataFrame, cap: float = RATIO_CAP, content: str = "content", chunk: int = 65536
) -> DataFrame:
    """(file, compressed, expanded, ratio, verdict) for gzip or zlib content.

    Inflating stops as soon as the output passes ``cap`` times the input, so a
    bomb costs no more than the cap.  Output is counted, never kept.
    """

    def inflate(data: bytes) -> tuple[int, str]:
        limit, seen = int(len(data) * cap), 0
        engine = zlib.decompressobj(wbits=47)
        pending = data
        try:
            while pending and not engine.eof:
                seen += len(engine.decompress(pending, chunk))
                pending = engine.unconsumed_tail
                if seen > limit:
                    return seen, "DecompressionCapTrip"
                if engine.eof and engine.unused_data:
                    pending, engine = engine.unused_data, zlib.decompressobj(wbits=47)
        except zlib.error:
            return seen, "CorruptArchive"
        return seen, "accepted" if engine.eof else "CorruptArchive"

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [inflate(bytes(x)) for x in batch[content]]
            sizes = batch[content].map(len)
            yield pd.DataFrame(
                {
                    "file": batch["file"],
                    "compressed": sizes,
                    "expanded": [n for n, _ in found],
                    "ratio": [round(n / max(1, size), 4) for (n, _), size in zip(found, sizes)],
                    "verdict": [v for _, v in found],
                }
            )

    return files.select("file", content).mapInPandas(
        judge, "file string, compressed bigint, expanded bigint, ratio double, verdict string"
    )


def decompression_health(judged: DataFrame, at: Column) -> DataFrame:
    """Health rows for the files that tripped the cap."""
    return judged.filter(F.col("verdict") == "DecompressionCapTrip").select(
        at.alias("TimeGenerated"),
        F.lit("DecompressionCapTrip").alias("EventType"),
        F.lit("Error").alias("Severity"),
        F.col("file").alias("SourceId"),
        F.lit(1).cast("bigint").alias("EventCount"),
        F.concat(F.lit("ratio above cap after "), F.col("expanded").cast("string"), F.lit(" bytes")).alias("Detail"),
    )


def _lines(content: Column) -> Column:
    return F.filter(
        F.transform(F.split(content, LINE_END), lambda x: c.strip(x)), lambda x: F.length(x) > 0
    )


#: Separators within quotes, hidden behind a NUL, which text that passed the gate does not hold.
_HIDDEN = [(",", "\0c"), ("\n", "\0n"), ("\r", "\0r")]


def _shown(x: Column, back: bool = False) -> Column:
    for plain, mark in _HIDDEN:
        x = F.replace(x, F.lit(mark), F.lit(plain)) if back else F.replace(x, F.lit(plain), F.lit(mark))
    return x


def csv_rows(content: Column) -> Column:
    """The rows of a CSV text that are not empty, separators within quotes hidden.

    Every second part between quotes is quoted; a doubled quote is a quote.
    """
    parts = F.transform(F.split(content, '"'), lambda x, i: F.when(i % 2 == 1, _shown(x)).otherwise(x))
    return F.filter(F.split(F.array_join(parts, '"'), "[\r\n]+"), lambda x: F.length(x) > 0)


def csv_cells(row: Column) -> Column:
    """The values of a row of :func:`csv_rows`."""

    def cell(x: Column) -> Column:
        inner = F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
        return _shown(F.when(x.startswith('"'), inner).otherwise(x), back=True)

    return F.transform(F.split(row, ","), cell)


def csv_object(header: Column, row: Column) -> Column:
    """A row as a JSON object; cells beyond the header, or beyond the row, are left out."""
    pairs = F.arrays_zip(header.alias("key"), F.slice(csv_cells(row), F.lit(1), F.size(header)).alias("value"))
    return F.to_json(F.map_from_entries(F.filter(pairs, lambda e: e["key"].isNotNull() & e["value"].isNotNull())))


def _csv_records(content: Column) -> Column:
    """Rows of a CSV text with a header, as JSON objects."""
    rows = csv_rows(content)
    header = csv_cells(F.try_element_at(rows, F.lit(1)))
    body = F.when(F.size(rows) > 1, F.slice(rows, F.lit(2), F.size(rows) - 1)).otherwise(
        F.array().cast("array<string>")
    )
    return F.transform(body, lambda row: csv_object(header, row))


def is_object(json_text: Column) -> Column:
    return parse_fields(json_text).isNotNull()


def parse_evidence(files: DataFrame, content: str = "content", max_events: int | None = None) -> DataFrame:
    """(file, ext, position, record): one row per event in a file.

    ``files`` holds (file, ext, text content), one row per file; a file is
    bounded by the upload cap.  ``record`` is JSON object text.

    * json: an array of objects, or one object
    * jsonl: an object per line, bad lines skipped
    * csv: header and rows
    * log, txt: as jsonl; if that gives nothing, as json; else one
      ``{"message": line}`` per non-empty line

    All records are taken; with ``max_events`` only so many of a file, in file
    order, and ``left_out`` tells on every row how many of its file were not.
    """
    text = F.col(content)
    lines = _lines(text)
    objects = F.filter(lines, is_object)
    whole = F.transform(
        F.filter(
            F.coalesce(
                F.try_parse_json(text).try_cast("array<variant>"),
                F.array_compact(F.array(F.try_parse_json(text))),
            ),
            lambda v: v.try_cast("map<string,variant>").isNotNull(),
        ),
        lambda v: F.to_json(v),
    )
    messages = F.transform(lines, lambda x: F.to_json(F.struct(x.alias("message"))))
    empty = F.array().cast("array<string>")
    ext = F.col("ext")
    # The first non-empty reading wins for log and txt.
    loose = F.when(F.size(objects) > 0, objects).when(F.size(whole) > 0, whole).otherwise(messages)
    records = (
        F.when(ext == "json", whole)
        .when(ext == "jsonl", objects)
        .when(ext == "csv", _csv_records(text))
        .when(ext.isin("log", "txt"), loose)
        .otherwise(empty)
    )
    keep = [n for n in files.columns if n != content]
    if max_events is None:
        return files.select(*keep, F.posexplode(records).alias("position", "record"))
    counted = files.select(*keep, records.alias("_records"))
    left_out = F.greatest(F.size("_records") - max_events, F.lit(0)).alias("left_out")
    return counted.select(*keep, left_out, F.posexplode(F.slice("_records", 1, max_events)).alias("position", "record"))


def parse_drop_lines(lines: DataFrame) -> DataFrame:
    """(file, received_at, record) from :func:`scan_drop` of line files.

    For ``.log`` and ``.txt`` the reading is chosen per file: JSON lines if
    any line is an object, else messages.  The choice needs one flag per file,
    computed map-side, so a file may be of any size.
    """
    work = lines.select("file", "received_at", c.strip(F.col("line")).alias("line")).filter("line <> ''")
    work = work.withColumn("_object", is_object(F.col("line")))
    flags = small_side(work.groupBy("file").agg(F.max("_object").alias("_has_objects")))
    loose = extension(F.col("file")).isin("log", "txt")
    return (
        work.join(flags, "file")
        .filter(F.col("_object") | (loose & ~F.col("_has_objects")))
        .select(
            "file",
            "received_at",
            F.when(F.col("_object"), F.col("line"))
            .otherwise(F.to_json(F.struct(F.col("line").alias("message"))))
            .alias("record"),
        )
    )


def upload_summary(files: DataFrame, mapped: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Per file: parsed, written, unmapped, errors and the resulting status.

    ``mapped`` has one row per written event with ``file`` and
    ``had_unmapped``; ``errors`` one row per event that failed to map.
    """
    written = mapped.groupBy("file").agg(
        F.count("*").alias("events_written"), F.count_if("had_unmapped").alias("events_unmapped")
    )
    out = files.select("file").join(written, "file", "left")
    if errors is not None:
        out = out.join(errors.groupBy("file").agg(F.count("*").alias("error_count")), "file", "left")
    else:
        out = out.withColumn("error_count", F.lit(0).cast("bigint"))
    out = out.na.fill(0, ["events_written", "events_unmapped", "error_count"])
    parsed = F.col("events_written") + F.col("error_count")
    return out.select(
        "file",
        parsed.alias("events_parsed"),
        "events_written",
        "events_unmapped",
        "error_count",
        F.when((F.col("events_written") == 0) & (parsed > 0), "failed")
        .when(F.col("error_count") > 0, "partial")
        .otherwise("success")
        .alias("status"),
    )
