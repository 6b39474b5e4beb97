"""The jobs from a command line: python -m webarc COMMAND ..."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import encoding, html, lang
from .operators import archive, lang_jobs
from .sources.warc import extract_record, read_warcs, register


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="webarc", description=__doc__)
    c = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *arguments: tuple) -> None:
        sub = c.add_parser(name, help=text)
        for a in arguments:
            sub.add_argument(*a[:-1], **a[-1])

    source, target = ("source", {}), ("target", {})
    add("recompress", "write archives with another codec", source, target, ("--codec", {"default": "gzip"}), ("--level", {"type": int}))
    add("check", "verify digests; exit 1 if any fails", source, ("--payloads", {"action": "store_true"}), ("--report", {"help": "folder for a row a record"}))
    add("index", "write CDXJ lines", source, target, ("--fields", {"default": ",".join(archive.INDEX_FIELDS)}))
    add("extract", "print the record at an offset", source, ("offset", {"type": int}), ("--headers", {"action": "store_true"}), ("--payload", {"action": "store_true"}))
    add("benchmark", "count records", source)
    add("html-benchmark", "parse the titles of all responses", source)
    add("lang-train", "train profiles from a Parquet table (lang, text)", source, target)
    add("lang-evaluate", "precision, recall and F1 on a Parquet table (lang, text)", source, ("--profiles", {"help": "folder that lang-train wrote"}), ("--truncate", {"type": int}))
    add("lang-dataset", "deduplicate and split a Parquet table (lang, text)", source, target, ("--min-examples", {"type": int, "default": 0}))
    return p


def run(spark: SparkSession, a: argparse.Namespace, out=sys.stdout) -> int:
    register(spark)
    if a.command == "recompress":
        n = archive.recompress(spark, a.source, a.target, a.codec, **({"level": a.level} if a.level is not None else {}))
        print(f"{n} records", file=out)
    elif a.command == "check":
        report = archive.digest_report(read_warcs(spark, a.source, ["record_id", "block_digest_status", "payload_digest_status"]), a.payloads)
        if a.report:
            report.write.mode("overwrite").parquet(a.report)
            report = spark.read.parquet(a.report)
        found = {r.status: r.n for r in archive.digest_summary(report).collect()}
        for status, n in sorted(found.items()):
            print(f"{n}\t{status}", file=out)
        return int(any("FAIL" in s for s in found))
    elif a.command == "index":
        fields = tuple(a.fields.split(","))
        columns = ["path", "stream_pos", "headers", "http_headers", "http_status", *(["record_length"] if "length" in fields else [])]
        archive.write_cdxj(archive.cdxj(read_warcs(spark, a.source, columns), fields), a.target)
    elif a.command == "extract":
        row = extract_record(spark, a.source, a.offset).first()
        if row is None:
            print("no record there", file=sys.stderr)
            return 1
        both = a.headers == a.payload
        if a.headers or both:
            print((bytes(row.raw_warc_headers) + bytes(row.raw_http_headers or b"")).decode("utf-8", "replace"), end="", file=out)
        if a.payload or both:
            print(bytes(row.payload or b"").decode("utf-8", "replace"), file=out)
    elif a.command in ("benchmark", "html-benchmark"):
        start = time.perf_counter()
        if a.command == "benchmark":
            n = read_warcs(spark, a.source, ["stream_pos"]).count()
        else:
            pages = read_warcs(spark, a.source, ["payload", "http_charset"], recordTypes="response", autoDecode="all").select(encoding.decoded("payload", encoding.encoding_label("http_charset")).alias("h"))
            n = pages.select(html.html_title("h").alias("t")).agg(F.count("t")).first()[0]
        t = time.perf_counter() - start
        print(f"{n} records in {t:.2f} s, {n / t:.0f} a second", file=out)
    elif a.command == "lang-train":
        lang_jobs.train_profiles(spark.read.parquet(a.source)).write.mode("overwrite").parquet(a.target)
    elif a.command == "lang-evaluate":
        texts = spark.read.parquet(a.source)
        text = F.substring("text", 1, a.truncate) if a.truncate else F.col("text")
        known = lang_jobs.load_profiles(spark.read.parquet(a.profiles)) if a.profiles else None
        for r in lang_jobs.evaluate(texts.select("lang", lang.language(text, known)["lang"].alias("predicted"))).collect():
            print(f"{r.lang}\t{r.n}\t{r.precision:.4f}\t{r.recall:.4f}\t{r.f1:.4f}", file=out)
    elif a.command == "lang-dataset":
        lang_jobs.create_dataset(spark.read.parquet(a.source), min_examples=a.min_examples).write.mode("overwrite").partitionBy("split").parquet(a.target)
    return 0


if __name__ == "__main__":
    arguments = parser().parse_args()
    session = SparkSession.builder.appName("webarc").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    sys.exit(run(session, arguments))
