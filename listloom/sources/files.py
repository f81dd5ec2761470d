"""File sources: commented CSV, JSON arrays, JSON lines, XML link lists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from listloom.functions.text import squeeze, strip, unescape
from listloom.operators.store import manifest, path_exists, publish_together
from listloom.session import stored

# The positional columns and the confidence of hand-kept lists.
CSV_COLUMNS = ("title", "start_date", "end_date", "time", "category", "venue_name", "commune", "description", "source_url")
CSV_CONFIDENCE = 0.61


def read_listing_csv(spark: SparkSession, path: str, source: str, confidence: float = CSV_CONFIDENCE) -> DataFrame:
    """Nine positional columns; comment lines, short rows and rows without title or date are skipped.

    Cells beyond the ninth are ignored. Texts are trimmed; an empty end or time becomes null.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*CSV_COLUMNS, "_bad")])
    # without pruning every cell is counted, whichever columns the caller goes on to use
    raw = spark.read.option("columnPruning", "false").csv(path, schema=schema, comment="#", mode="PERMISSIVE", columnNameOfCorruptRecord="_bad",
                         quote='"', escape='"')
    cells = F.size(F.split("_bad", ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1))
    text = {c: strip(F.coalesce(F.col(c), F.lit(""))) for c in CSV_COLUMNS}
    out = raw.where(F.col("_bad").isNull() | (cells >= len(CSV_COLUMNS)))
    out = out.withColumns({c: F.nullif(text[c], F.lit("")) if c in ("end_date", "time") else text[c] for c in CSV_COLUMNS})
    return (out.where("title <> '' and start_date <> ''").drop("_bad")
            .withColumns({"source_id": F.lit(source), "confidence": F.lit(confidence),
                          "image_url": F.lit(""), "status": F.lit("published")}))


def _over_blocks(rows: DataFrame, **sums: Column) -> DataFrame:
    """(file, block, …): totals of each block of a file; a file has one for each block that is read by itself."""
    return rows.groupBy("file", "block").agg(*(F.sum(v).alias(k) for k, v in sums.items()))


def _before(value: Column | str, *order: str) -> Column:
    """Sum over all earlier rows, zero for the first; ``order`` names the partition and then what rows go by."""
    w = Window.partitionBy(*order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, element): the texts of the elements of files that each hold one JSON array, however large.

    Files are read in blocks and cut at every comma. A piece changes the state of the scan (inside a string or not,
    depth of brackets), and the change of depth depends only on whether it starts inside a string. So sums inside each
    block are taken for both cases, sums over blocks choose between them, and an element starts at each piece of
    depth one. A file that is no array, or has an element that is no JSON, gives no rows.
    """
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')

    def depth(side: int) -> Column:
        """Opening less closing brackets of the parts before the first quote, behind the second, ... or of the others."""
        joined = F.array_join(F.filter(parts, lambda _, i: i % 2 == side), "")
        return F.length(F.translate(joined, "]}", "")) - F.length(F.translate(joined, "[{", ""))

    raw = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value",
        (F.size(parts) - 1).alias("quotes"), depth(0).alias("even"), depth(1).alias("odd"))
    local = raw.withColumn("turned", _before("quotes", "file", "block", "seq") % 2 == 1)
    for case, (first, other) in enumerate((("even", "odd"), ("odd", "even"))):
        local = local.withColumn(f"change{case}", F.when(F.col("turned"), F.col(other)).otherwise(F.col(first)))
        local = local.withColumn(f"depth{case}", _before(f"change{case}", "file", "block", "seq"))
    local = stored(local.drop("even", "odd"), "json-pieces")
    blocks = _over_blocks(local, quotes=F.col("quotes"), change0=F.col("change0"), change1=F.col("change1"))
    blocks = blocks.withColumn("inside", _before("quotes", "file", "block") % 2 == 1)
    blocks = blocks.withColumn("base", _before(F.when(F.col("inside"), F.col("change1")).otherwise(F.col("change0")), "file", "block"))
    rows = local.join(blocks.select("file", "block", "inside", "base"), ["file", "block"]).select(
        "file", "block", "seq", "value", "quotes", (F.col("turned") != F.col("inside")).alias("in_string"),
        F.when(F.col("inside"), F.col("change1")).otherwise(F.col("change0")).alias("change"),
        (F.col("base") + F.when(F.col("inside"), F.col("depth1")).otherwise(F.col("depth0"))).alias("depth"))
    rows = rows.withColumn("starts", (~F.col("in_string") & (F.col("depth") <= 1)).cast("int"))
    rows = stored(rows.withColumn("nth", _before("starts", "file", "block", "seq") + F.col("starts") - 1), "json-states")
    firsts = _over_blocks(rows, starts=F.col("starts")).withColumn("earlier", _before("starts", "file", "block")).select("file", "block", "earlier")
    place, after = F.struct("block", "seq"), F.col("depth") + F.col("change")
    ends = rows.groupBy("file").agg(
        F.min_by("value", place).alias("head"), F.max_by("value", place).alias("tail"), F.max_by(after, place).alias("left"), F.sum("quotes").alias("quotes"), F.sum("starts").alias("n"),
        F.max(place).alias("end"), F.min(F.when(after < 1, place)).alias("closed"))
    space = r"[ \t\r\n]*"
    arrays = ends.where(F.col("head").rlike(rf"^{space}\[") & F.col("tail").rlike(rf"\]{space}$") & (F.col("left") == 0) & (F.col("quotes") % 2 == 0) & (F.col("closed") == F.col("end")))
    pieces = rows.join(firsts, ["file", "block"]).groupBy("file", (F.col("nth") + F.col("earlier")).alias("number")).agg(F.array_sort(F.collect_list(F.struct("block", "seq", "value"))).alias("held"))
    text = F.array_join(F.transform("held", lambda p: p["value"]), ",")
    text = F.when(F.col("number") == 0, F.regexp_replace(text, rf"^{space}\[", "")).otherwise(text)
    text = F.when(F.col("number") == F.col("n") - 1, F.regexp_replace(text, rf"\]{space}$", "")).otherwise(text)
    found = pieces.join(arrays.select("file", "n"), "file").select("file", "number", strip(text).alias("element"), "n")
    found = stored(found.where("element <> '' or n > 1").drop("n"), "json-elements")
    broken = found.where(F.try_parse_json("element").isNull()).select("file").distinct()
    return found.join(broken, "file", "left_anti")


def read_json_arrays(spark: SparkSession, path: str, schema: T.StructType | str, text: str | None = None) -> DataFrame:
    """Rows of files that each hold one JSON array. A file that is unreadable or no array gives no rows.

    A large array is read by many tasks. With ``text`` that column holds each element as it stands, so that
    fields of another type than ``schema`` says, which are null, and elements that are no objects keep their text.
    """
    struct = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    found = json_elements(spark, path).withColumn("_row", F.from_json("element", struct, {"mode": "PERMISSIVE"}))
    return found.select("_row.*", *([F.col("element").alias(text)] if text else []))


def load_once(spark: SparkSession, root: str, arrays: Mapping[str, tuple[str, str]], marker: str = "first_load") -> bool:
    """Publish JSON-array files as tables, name to (path, schema), the first time only; says whether it did.

    A file that is missing, unreadable or no array gives an empty table. All tables and the marker are one
    commit, also when nothing was found: a load that broke off has left nothing, and a finished one never repeats.
    """
    if not manifest(spark, root).where(F.col("name") == marker).isEmpty():
        return False
    tables = {name: read_json_arrays(spark, path, schema) if path_exists(spark, path) else spark.createDataFrame([], schema) for name, (path, schema) in arrays.items()}
    tables[marker] = spark.createDataFrame([(name,) for name in arrays], "name string")
    return bool(publish_together(tables, root, version=0))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; blank and bad lines are skipped."""
    return parse_json_lines(spark.read.text(path), F.col("value"), schema).select("record.*")


def parse_json_lines(df: DataFrame, line: Column, schema: str) -> DataFrame:
    """Add ``record`` for lines that hold a JSON object; drop all other lines."""
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    text = strip(line)
    parsed = df.where(text.rlike(r"^\{")).withColumn("record", F.from_json(text, schema + ", _bad string", opts))
    return parsed.where("record is not null and record._bad is null").withColumn(
        "record", F.col("record").dropFields("_bad"))


def xml_links(docs: DataFrame, xml: str, position: str, tag: str = "loc", contains: str | None = None) -> DataFrame:
    """Distinct ``<tag>`` values of XML documents (site maps, feeds) in order of first sight."""
    pattern = rf"(?s)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}>"
    found = docs.select(F.col(position).alias("doc"),
                        F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(pattern), 1)).alias("pos", "raw"))
    link = squeeze(unescape(F.regexp_replace("raw", r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")))
    found = found.withColumn("link", link).where("link <> ''")
    if contains:
        found = found.where(F.contains("link", F.lit(contains)))
    return found.groupBy("link").agg(F.min(F.struct("doc", "pos")).alias("first_seen")) \
        .select("link", "first_seen.doc", "first_seen.pos")
