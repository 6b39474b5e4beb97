"""Archive jobs: digest reports, index lines, recompression, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.headers import header_get
from ..sources.warc import read_warcs

INDEX_FIELDS = ("offset", "warc-type", "warc-target-uri")


def digest_report(records: DataFrame, payloads: bool = True) -> DataFrame:
    """(record_id, block_ok, payload_ok, status): NULL where a record has no digest."""
    ok = lambda c: F.when(F.col(c).isin("missing", "no_payload"), F.lit(None).cast("boolean")).otherwise(F.col(c) == "ok")
    word = lambda c, p: F.when(c.isNull(), f"{p}NO_DIGEST").when(c, f"{p}OK").otherwise(f"{p}FAIL")
    out = records.select("record_id", ok("block_digest_status").alias("block_ok"), (ok("payload_digest_status") if payloads else F.lit(None).cast("boolean")).alias("payload_ok"))
    block = word(F.col("block_ok"), "")
    return out.withColumn("status", F.concat(block, F.lit(", "), word(F.col("payload_ok"), "PAYLOAD_")) if payloads else block)


def digest_summary(report: DataFrame) -> DataFrame:
    """(status, n)"""
    return report.groupBy("status").agg(F.count("*").alias("n"))


def _field(name: str) -> Column:
    if name == "offset":
        return F.col("stream_pos").cast("string")
    if name == "length":
        return F.col("__wa_length").cast("string")
    if name == "filename":
        return F.element_at(F.split("path", "/"), -1)
    if name == "http:status":
        return F.col("http_status").cast("string")
    if name.startswith("http:"):
        return header_get("http_headers", name[5:])
    return header_get("headers", name)


def cdxj(records: DataFrame, fields: tuple[str, ...] = INDEX_FIELDS, sizes: DataFrame | None = None) -> DataFrame:
    """(path, offset, line): a JSON line for each record, all values strings, absent ones left out.

    The length of a record is the way to the next one of its file; that of the last is told by sizes (path, size) or by the reader's record_length.
    """
    out = records
    if "length" in fields:
        if sizes is None and "record_length" in records.columns:
            out = out.withColumn("__wa_length", F.col("record_length"))
        else:
            after = F.lead("stream_pos").over(Window.partitionBy("path").orderBy("stream_pos"))
            out = out.join(sizes.select("path", F.col("size").alias("__wa_size")) if sizes is not None else records.sparkSession.createDataFrame([], "path string, __wa_size bigint"), "path", "left")
            out = out.withColumn("__wa_length", F.coalesce(after, F.col("__wa_size")) - F.col("stream_pos"))
    return out.select("path", F.col("stream_pos").alias("offset"), F.to_json(F.struct(*[_field(f).alias(f) for f in fields])).alias("line"))


def write_cdxj(lines: DataFrame, path: str) -> None:
    """One sorted text file a task; files and lines follow path and offset."""
    lines.repartitionByRange("path", "offset").sortWithinPartitions("path", "offset").select("line").write.mode("overwrite").text(path)


def recompress(spark: SparkSession, source: str, target: str, compression: str = "gzip", **options) -> int:
    """Writes the records of source anew with another codec, one member a record; returns how many there are. HTTP isn't parsed."""
    records = read_warcs(spark, source, ["warc_version", "record_type", "headers", "payload"], parseHttp="false")
    records.write.format("warc").option("compression", compression).option("checksumData", "false").options(**{k: str(v) for k, v in options.items()}).mode("append").save(target)
    return read_warcs(spark, target, ["stream_pos"]).count()


def count_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, bytes): bodies are skipped, not read into rows."""
    return read_warcs(spark, path, ["path", "block_length"], parseHttp="false").groupBy("path").agg(F.count("*").alias("n"), F.sum("block_length").alias("bytes"))
