"""Items: the contract with whatever parses files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright import limits, schemas
from pagewright.functions import text as tx


def read_items(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """[A1, A3, A4] Positioned text items; ``item_index`` is positional and never renumbered, markers without text are left out."""
    return spark.read.schema(schemas.ITEMS).format(kind).load(path).where("str is not null")


def read_files(spark: SparkSession, path: str, parse, pattern: str = "*.pdf") -> DataFrame:
    """[A1] Items of whole files by ``parse(name, bytes) -> iterable of item tuples``; files over the size limit aren't opened."""
    import pandas as pd

    names = [c.split(" ")[0] for c in schemas.ITEMS.split(", ")]

    def run(frames):
        for frame in frames:
            rows = [row for name, content in zip(frame["path"], frame["content"]) for row in parse(name, bytes(content))]
            yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.where(F.col("length") <= limits.MAX_FILE_BYTES).select("path", "content").mapInPandas(run, schemas.ITEMS)


def route_files(files: DataFrame, accept: str, most_bytes: int) -> DataFrame:
    """[A5, A6] Adds ``route`` to files (name, type, size): size first, then type."""
    accepted = tx.is_file_accepted(F.col("name"), F.col("type"), accept)
    return files.withColumn("route", F.when(F.col("size") > most_bytes, "oversized").when(accepted, "accepted").otherwise("unaccepted"))


def bounded_json(bodies: DataFrame, schema: str, most_bytes: int = limits.MAX_REQUEST_BODY_BYTES) -> DataFrame:
    """[A7-A9] Parses request bodies (body binary, content_type, content_length): value, or the first gate's error_code.

    The size gates come before parsing, so an oversized body is never decoded.
    """
    body = F.col("body")
    gate = (
        F.when(~tx.is_json_media_type(F.col("content_type")), "invalid_request")
        .when(tx.declared_length_exceeds(F.col("content_length"), most_bytes) | (F.octet_length(body) > most_bytes), "request_body_too_large")
        .when(body.isNull() | ~F.is_valid_utf8(body.cast("string")), "invalid_request")
    )
    parsed = F.from_json(F.when(gate.isNull(), body.cast("string")), schema, {"mode": "PERMISSIVE"})
    shaped = F.get_json_object(body.cast("string"), "$").startswith("{")
    value = F.when(gate.isNull() & F.coalesce(shaped, F.lit(False)), parsed)
    return bodies.withColumn("value", value).withColumn("error_code", F.coalesce(gate, F.when(value.isNull(), "invalid_request")))


def write_messages(messages: DataFrame, path: str) -> None:
    """[A10] One JSON line per message; absent fields are left out."""
    messages.select(F.to_json(F.struct(*messages.columns), {"ignoreNullFields": "true"}).alias("value")).write.text(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """[A11, I4] Messages of NDJSON files; a line that isn't one gives a row of nulls with ``malformed`` true."""
    lines = spark.read.text(path).where("length(value) > 0")
    parsed = lines.select("value", F.from_json("value", schemas.MESSAGE).alias("m"))
    return parsed.select("m.*", (F.col("m.type").isNull() | (F.length("value") > limits.STREAM_BUFFER_CHARACTERS)).alias("malformed"))


def read_cases(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """[A16] Evaluation cases (id, document, category, query, expect) of files that are one JSON value each, or one a line."""
    case = "array<struct<id: string, document: string, category: string, query: string, expect: struct<kind: string, snippet: string, status: string>>>"
    return spark.read.schema(f"cases {case}").json(path, multiLine=multi_line).select(F.explode("cases").alias("c")).select("c.*")


def page_ceiling(pages: DataFrame, ceiling: int = limits.EXTRACTION_CHARACTER_CEILING) -> DataFrame:
    """[A2, D8] Adds chars_before and extracted to pages (document_id, page_number, character_count): a page is read if the pages before it stay within the ceiling."""
    before = Window.partitionBy("document_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("chars_before", F.coalesce(F.sum("character_count").over(before), F.lit(0))).withColumn("extracted", F.col("chars_before") <= ceiling)


def error_reply(code: Column) -> Column:
    """[A18] struct<http_status, message> of an error code."""
    pairs = [x for name, status, said in limits.ERRORS for x in (F.lit(name), F.struct(F.lit(status).alias("http_status"), F.lit(said).alias("message")))]
    return F.create_map(*pairs)[code]
