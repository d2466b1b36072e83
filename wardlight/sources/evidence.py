"""Evidence files of any size, lexed by many tasks at once.

A file is not read whole: Spark's text source cuts it at one separator (``}`` for
JSON, the line feed for CSV) and hands the pieces of one file to many tasks.
Where a piece stands in its file is known (block start, then order within the
block), what state the lexer is in there is not.  So each piece is lexed for
either state it may start in, inside or outside a quoted string, and gives what
it changes: the parity of its quotes and, for JSON, the change of bracket depth.
These compose by adding up, so running sums over all pieces of a file
(:func:`with_running`, a prefix scan that no hot file can overload) tell the
state and depth at every piece.  Records end where the depth is back, or where a
line ends outside quotes; the pieces of a record meet by (file, record number)
and are parsed together.  No task holds more than a piece or a record.

Text is UTF-8.  A file that holds other bytes or a NUL is refused, a JSON file that
is malformed anywhere has no records, as if it had been parsed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.functions import columns as c
from wardlight.operators.ordering import small_side, with_running
from wardlight.session import checkpointed
from wardlight.sources import files

PLACE = ["block", "seq"]
LINE_TYPES = ["jsonl", "log", "txt"]


def _glob(exts: list[str]) -> str:
    """Glob of file names with one of the extensions, in any case."""
    return "*.{" + ",".join("".join(f"[{x}{x.upper()}]" for x in ext) for ext in exts) + "}"


def pieces(spark: SparkSession, folder: str, exts: list[str], separator: str | None) -> DataFrame:
    """(file, ext, file_size, block, seq, text): the files cut at ``separator`` (line ends by default)."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(exts))
    if separator:
        reader = reader.option("lineSep", separator)
    found = reader.text(folder).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),  # ascends within a block
        F.col("value").alias("text"),
    )
    return checkpointed(found.withColumn("ext", files.extension(F.col("file"))))


def binary_files(read: DataFrame) -> DataFrame:
    """(file, binary): whether a file holds bytes that are not text."""
    odd = ~F.is_valid_utf8("text") | (F.instr("text", "\0") > 0)
    return read.groupBy("file").agg(F.max(odd).alias("binary"))


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _together(read: DataFrame, numbered: DataFrame, separator: str) -> DataFrame:
    """(file, record_no, text, ended): the pieces of each record joined in order."""
    held = read.select("file", *PLACE, "text").join(numbered.select("file", *PLACE, "record_no", "ended"), ["file", *PLACE])
    parts = F.sort_array(F.collect_list(F.struct(*PLACE, "text")))  # one record
    return held.groupBy("file", "record_no").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), separator).alias("text"), F.max("ended").alias("ended")
    )


# -- JSON ------------------------------------------------------------------------


def _json_changes(text: Column) -> list[Column]:
    """Quotes of a piece, and its change of depth if it starts outside or inside a string.

    The brace that ends the piece counts where it lies outside strings.
    """
    bare = F.split(F.regexp_replace(text, r"(?s)\\.", ""), '"')
    quotes = F.size(bare) - 1

    def change(start: int) -> Column:
        outside = F.array_join(F.filter(bare, lambda _, i: i % 2 == start), "")
        closes = F.when((quotes + start) % 2 == 0, 1).otherwise(0)
        return _count(outside, "[{") - _count(outside, "]}") - closes

    return [quotes.cast("long").alias("q"), change(0).cast("long").alias("d0"), change(1).cast("long").alias("d1")]


def json_groups(read: DataFrame) -> DataFrame:
    """(file, record_no, text, ended, base) of pieces cut at ``}``: top-level elements with what stands before them.

    ``base`` is 1 for a file that is an array, 0 for one that is an object.
    """
    heads = read.groupBy("file").agg(
        F.min(F.struct(*PLACE, F.substring(F.ltrim(F.regexp_replace("text", r"^\s+", "")), 1, 1).alias("head"))).alias("first"),
        F.max(F.struct(*PLACE)).alias("last"),
        # One separator too many was counted if the file does not end in one; a byte-order mark is three bytes.
        (F.max("file_size") - F.sum(F.octet_length("text") + 1)).isin(-1, 2).alias("open_end"),
    )
    heads = heads.select("file", (F.col("first.head") == "[").cast("int").alias("base"), "last", "open_end")
    side = small_side(heads)
    lexed = read.select("file", *PLACE, *_json_changes(F.col("text")))
    stated = with_running(lexed, ["file"], PLACE, sums={"quotes": "q"})
    inside = F.pmod(F.col("quotes") - F.col("q"), F.lit(2)) == 1
    tail = (F.struct(*PLACE) == F.col("last")) & F.col("open_end")
    stated = stated.join(side, "file").select(
        "file", *PLACE, "base", tail.alias("tail"), (F.pmod("quotes", F.lit(2)) == 0).alias("outside"),
        F.when(inside, F.col("d1")).otherwise(F.col("d0")).alias("d"),
    )
    deep = with_running(stated, ["file"], PLACE, sums={"depth": "d"})
    ended = F.col("outside") & ~F.col("tail") & (F.col("depth") == F.col("base"))
    deep = deep.select("file", *PLACE, "base", ended.alias("ended"), ended.cast("long").alias("e"))
    numbered = with_running(deep, ["file"], PLACE, sums={"upto": "e"}).withColumn("record_no", F.col("upto") - F.col("e"))
    groups = _together(read, numbered, "}")
    text = F.when(F.col("ended"), F.concat("text", F.lit("}"))).otherwise(F.col("text"))
    return groups.withColumn("text", text).join(side.select("file", "base"), "file")


def _json_elements(groups: DataFrame) -> DataFrame:
    """(file, record_no, objects, valid): the JSON objects of each group; null where it is malformed."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    first = F.col("record_no") == 0
    lead = F.when(first, "[").otherwise(",")
    is_tail = ~F.col("ended")
    body = F.when(text.startswith(lead), F.substr(text, F.lit(2))).when(is_tail & ~first, text)
    # The last group ends the array, and holds no comma without an element.
    closed = F.when(~is_tail, body).when(body.endswith("]"), F.substr(body, F.lit(1), F.length(body) - 1))
    bare_comma = is_tail & ~first & text.startswith(",") & (F.trim(closed) == "")
    missing_comma = is_tail & ~first & ~text.startswith(",") & (F.trim(closed) != "")
    array = F.when(~bare_comma & ~missing_comma, F.try_parse_json(F.concat(F.lit("["), closed, F.lit("]"))).try_cast("array<variant>"))
    single = F.when(first & F.col("ended"), F.array(F.try_parse_json(text))).when(text == "", F.array().cast("array<variant>"))
    parsed = F.when(F.col("base") == 1, array).otherwise(F.filter(single, lambda v: v.isNotNull()))
    whole = (F.col("base") == 1) | (text == "") | (F.size(parsed) > 0)
    objects = F.transform(F.filter(parsed, lambda v: v.try_cast("map<string,variant>").isNotNull()), lambda v: F.to_json(v))
    return groups.select("file", "record_no", objects.alias("objects"), (parsed.isNotNull() & whole).alias("valid"), "ended", "base")


def json_records(read: DataFrame) -> DataFrame:
    """(file, position, record) of JSON files cut at ``}``; a malformed file has none."""
    found = checkpointed(_json_elements(json_groups(read)))
    verdicts = found.groupBy("file").agg(
        F.min("valid").alias("_valid"), F.max(~F.col("ended")).alias("_tail"), F.max("base").alias("_base")
    )
    # An array needs its closing bracket, which lies in a group that no brace ends.
    good = small_side(verdicts.where(F.col("_valid") & (F.col("_tail") | (F.col("_base") == 0))).select("file"))
    sized = found.join(good, "file").withColumn("n", F.size("objects").cast("long"))
    counted = with_running(sized.select("file", "record_no", "n"), ["file"], ["record_no"], sums={"upto": "n"})
    starts = counted.select("file", "record_no", (F.col("upto") - F.col("n")).alias("start"))
    return (
        sized.join(starts, ["file", "record_no"])
        .select("file", "start", F.posexplode("objects").alias("at", "record"))
        .select("file", (F.col("start") + F.col("at")).alias("position"), "record")
    )


# -- CSV -------------------------------------------------------------------------


def csv_records(read: DataFrame) -> DataFrame:
    """(file, position, record) of CSV files with a header, cut at line feeds."""
    lexed = read.select("file", *PLACE, _count(F.col("text"), '"').cast("long").alias("q"))
    stated = with_running(lexed, ["file"], PLACE, sums={"quotes": "q"})
    ended = F.pmod("quotes", F.lit(2)) == 0
    stated = stated.select("file", *PLACE, ended.alias("ended"), ended.cast("long").alias("e"))
    numbered = with_running(stated, ["file"], PLACE, sums={"upto": "e"}).withColumn("record_no", F.col("upto") - F.col("e"))
    rows = _together(read, numbered, "\n").select("file", "record_no", files.csv_rows(F.col("text")).alias("rows"))
    rows = checkpointed(rows.where(F.size("rows") > 0).withColumn("n", F.size("rows").cast("long")))
    header = rows.groupBy("file").agg(F.min(F.struct("record_no", F.col("rows")[0].alias("header"))).alias("first"))
    header = small_side(header.select("file", F.col("first.record_no").alias("head_no"), "first.header"))
    counted = with_running(rows.select("file", "record_no", "n"), ["file"], ["record_no"], sums={"upto": "n"})
    starts = counted.select("file", "record_no", (F.col("upto") - F.col("n") - 1).alias("start"))  # the header is row -1
    each = rows.join(starts, ["file", "record_no"]).select("file", "start", F.posexplode("rows").alias("at", "row"))
    each = each.withColumn("position", F.col("start") + F.col("at")).where("position >= 0").join(header, "file")
    return each.select("file", "position", files.csv_object(files.csv_cells(F.col("header")), F.col("row")).alias("record"))


# -- lines -----------------------------------------------------------------------


def line_records(read: DataFrame, whole: DataFrame) -> DataFrame:
    """(file, position, record) of line files; ``whole`` are the same files cut at ``}``.

    ``jsonl``: an object per line, other lines skipped.  ``log`` and ``txt``: the
    same if any line is an object, else the records of the file as JSON if it has
    any, else one message for each line.
    """
    lines = read.select("file", "ext", *PLACE, F.posexplode(F.split("text", files.LINE_END)).alias("sub", "line"))
    lines = lines.withColumn("line", c.strip(F.col("line"))).where("line <> ''")
    lines = checkpointed(lines.withColumn("object", files.is_object(F.col("line"))))
    flags = small_side(lines.groupBy("file", "ext").agg(F.max("object").alias("has_objects")))
    plain = flags.where("ext in ('log', 'txt') and not has_objects").select("file")
    as_json = checkpointed(json_records(whole.join(small_side(plain), "file")))
    messages = small_side(plain.join(as_json.select("file").distinct(), "file", "left_anti").withColumn("messages", F.lit(True)))
    kept = lines.join(messages, "file", "left").where(F.col("object") | F.coalesce("messages", F.lit(False)))
    kept = with_running(kept.select("file", *PLACE, "sub", "line", "object"), ["file"], [*PLACE, "sub"], number="n")
    record = F.when(F.col("object"), F.col("line")).otherwise(F.to_json(F.struct(F.col("line").alias("message"))))
    return kept.select("file", (F.col("n") - 1).alias("position"), record.alias("record")).unionByName(as_json)


def read_evidence(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Records (file, ext, position, record) of all evidence files under ``folder``, and (file, verdict) of every file."""
    by_type = {ext: pieces(spark, folder, [ext], sep) for ext, sep in (("json", "}"), ("csv", "\n"))}
    lines, whole = pieces(spark, folder, LINE_TYPES, None), pieces(spark, folder, ["log", "txt"], "}")
    binary = checkpointed(binary_files(by_type["json"]).unionByName(binary_files(by_type["csv"])).unionByName(binary_files(lines)))
    refused = small_side(binary.where("binary").select("file"))

    def text(read: DataFrame) -> DataFrame:
        return read.join(refused, "file", "left_anti")

    records = (
        json_records(text(by_type["json"]))
        .unionByName(csv_records(text(by_type["csv"])))
        .unionByName(line_records(text(lines), text(whole)))
    )
    records = checkpointed(records.select("file", files.extension(F.col("file")).alias("ext"), "position", "record"))
    held = records.groupBy("file").agg(F.count("*").alias("records"))
    verdict = F.when(F.col("binary"), "BINARY_CONTENT_REJECTED").when(F.col("records").isNull(), "NO_RECORDS").otherwise("accepted")
    return records, binary.join(held, "file", "left").select("file", verdict.alias("verdict"))
