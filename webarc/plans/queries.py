"""Queries over the test tables, one or more for each kind of operator, with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import prepare
from ..functions import digests, encoding, headers, html, lang
from ..operators import archive, bulk, lang_jobs
from ..sources.files import match_files
from ..sources.shared import shared_folder
from ..sources.text import read_text
from ..sources.warc import read_all_warcs, read_warcs, register
from ..streaming.archives import hourly_types, stream_warcs
from . import page_queries, record_queries

Query = Callable[[SparkSession, str], DataFrame]
#: How many files the round-trip queries write.
FILES = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark: SparkSession, sf_dir: str, body="html") -> DataFrame:
    """Pages (or what body makes of them) as HTTP responses, a minute apart."""
    date = F.timestamp_seconds(F.lit(1704067200) + 60 * F.col("page_id"))
    head = F.array(F.struct(F.lit("Content-Type").alias("key"), F.lit("text/html; charset=UTF-8").alias("value")), F.struct(F.lit("X-Page").alias("key"), F.col("page_id").cast("string").alias("value")))
    return _table(spark, sf_dir, "pages").select(
        F.lit("response").alias("record_type"), F.lit(True).alias("is_http"), F.col("url").alias("target_uri"), date.alias("record_date"), F.lit("HTTP/1.1 200 OK").alias("http_status_line"), head.alias("http_headers"), F.encode(body, "UTF-8").alias("payload")
    )


def _archive(spark: SparkSession, sf_dir: str, codec: str = "gzip") -> str:
    """Writes the pages as an archive; its folder."""
    register(spark)
    path = shared_folder(spark, "archive")
    _records(spark, sf_dir).repartition(FILES, F.xxhash64("target_uri")).write.format("warc").option("compression", codec).mode("append").save(path)
    return path


# ---- archives -------------------------------------------------------------------------------------


def _round_trip(codec: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = read_warcs(spark, _archive(spark, sf_dir, codec), ["target_uri", "record_type", "http_status", "http_charset", "content_length", "record_date", "payload"])
        return r.select("target_uri", "record_type", "http_status", "http_charset", "content_length", F.unix_timestamp("record_date").alias("at"), F.md5("payload").alias("payload_md5"))

    return run


def warc_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of 1000 to 3000 bytes, chosen while reading."""
    r = read_warcs(spark, _archive(spark, sf_dir), ["target_uri", "content_length"], recordTypes="response|request", minContentLength=1000, maxContentLength=3000, lengthBasis="payload")
    return r.select("target_uri", "content_length")


def warc_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_warcs(spark, _archive(spark, sf_dir), ["target_uri", "headers", "warc_version", "record_type_code", "content_length", "is_http", "block_digest_status", "payload_digest_status"])
    return r.filter(headers.has_record_type(4 | 16) & headers.is_warc_11() & headers.has_block_digest() & headers.has_valid_block_digest() & headers.has_valid_payload_digest() & headers.has_content_length_gte(2000) & F.col("is_http") & ~headers.is_concurrent()).select("target_uri", "content_length")


def warc_keep_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long records without their bodies."""
    r = read_warcs(spark, _archive(spark, sf_dir), ["target_uri", "payload"], maxContentLength=4000, alwaysKeepMeta="true")
    return r.select("target_uri", F.when(F.col("payload").isNotNull(), F.length("payload")).cast("bigint").alias("kept_bytes"))


def warc_all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = match_files(spark, _archive(spark, sf_dir, "zstd") + "/*.warc.zst", shuffle=FILES)
    return read_all_warcs(files, columns=["target_uri", "content_length"])


def digest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.digest_summary(archive.digest_report(read_warcs(spark, _archive(spark, sf_dir), ["record_id", "block_digest_status", "payload_digest_status"])))


def cdxj_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_warcs(spark, _archive(spark, sf_dir), ["path", "stream_pos", "headers", "http_headers", "http_status"])
    return archive.cdxj(r, ("warc-type", "warc-target-uri", "http:status", "http:x-page")).select("line")


def cdxj_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets and lengths must fill the files: their sums are the files' sizes."""
    path = _archive(spark, sf_dir, "none")
    r = read_warcs(spark, path, ["path", "stream_pos", "record_length", "headers", "http_headers", "http_status"])
    lines = archive.cdxj(r, ("offset", "length", "filename"))
    sums = lines.groupBy("path").agg(F.sum(F.get_json_object("line", "$.length").cast("bigint")).alias("covered"))
    return sums.join(match_files(spark, path), "path").agg(F.count("*").alias("n_files"), F.count_if(F.col("covered") == F.col("size")).alias("n_covered"))


def recompressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = shared_folder(spark, "recompressed")
    archive.recompress(spark, _archive(spark, sf_dir, "gzip"), target, "lz4")
    return read_warcs(spark, target, ["target_uri", "payload_digest_status", "content_length"]).select("target_uri", "payload_digest_status", "content_length")


def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.count_records(spark, _archive(spark, sf_dir)).agg(F.sum("n").alias("n"))


def hourly_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_warcs(spark, _archive(spark, sf_dir), ["record_date", "record_type", "block_length"])
    return hourly_types(r).select(F.unix_timestamp("window_start").alias("hour"), "record_type", "n")


def streamed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rollup over a stream that ends with the files that are there."""
    path, out = _archive(spark, sf_dir), shared_folder(spark, "stream")
    s = stream_warcs(spark, path).select("record_date", "record_type", "target_uri")
    s.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    rows = spark.read.schema("record_date timestamp, record_type string, target_uri string").parquet(f"{out}/rows")
    return rows.withColumn("block_length", F.lit(0)).transform(hourly_types).select(F.unix_timestamp("window_start").alias("hour"), "record_type", "n")


# ---- headers, digests, encodings ------------------------------------------------------------------


def header_multimap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as a header block: roles are keys that repeat."""
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("key"), F.col("text").alias("value")))).alias("t"))
    h = turns.select("conv_id", F.transform("t", lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))).alias("h"))
    return h.select(
        "conv_id", F.size("h").alias("n"), headers.header_get("h", "USER").alias("first_user"), F.size(headers.header_get_all("h", "Assistant")).alias("n_assistant"), headers.header_contains("h", "system").alias("has_system"),
        F.try_element_at(headers.header_to_map("h"), F.lit("user")).alias("all_user"), headers.header_get(headers.header_set("h", "user", F.lit("x")), "user").alias("after_set"), F.size(headers.header_remove("h", "user")).alias("n_without"),
    )


def status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("HTTP/1.1 "), (199 + F.col("l_linenumber")).cast("string"), F.lit(" "), F.col("l_returnflag"), F.lit(" "), F.col("l_linestatus"))
    s = _table(spark, sf_dir, "lineitem").select(line.alias("line"))
    return s.groupBy(headers.status_code("line").alias("code"), headers.reason_phrase("line").alias("reason")).agg(F.count("*").alias("n"))


def document_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return d.select("doc_id", digests.digest_of("data", "md5").alias("digest"), digests.digest_status("data", F.concat(F.lit("sha-1:"), F.sha1("data"))).alias("status"))


def encoding_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(x) for x in ("Latin1", " UTF8 ", "shift_jis", "koi8-r", "oops")]), F.col("r_regionkey") + 1)
    return _table(spark, sf_dir, "region").select("r_regionkey", encoding.encoding_label(label).alias("codec"))


def decoded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return d.select("doc_id", F.md5(F.encode(encoding.decoded("data", F.lit("utf-8")), "UTF-8")).alias("md5"), encoding.mime_of(F.encode(F.lit("%PDF-1.7"), "UTF-8")).alias("mime"))


def detected_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return d.select("doc_id", encoding.encoding_of("data").alias("codec"))


def chunked_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is cut in two chunks and put together again."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    half = F.ceil(F.length("b") / 2).cast("int")
    chunk = lambda x: F.concat(F.encode(F.concat(F.lower(F.hex(F.length(x).cast("bigint"))), F.lit("\r\n")), "UTF-8"), x, F.encode(F.lit("\r\n"), "UTF-8"))
    first, second = F.substring("b", 1, half), F.substring("b", half + 1, F.length("b"))
    body = F.concat(chunk(first), F.when(F.length(second) > 0, chunk(second)).otherwise(F.encode(F.lit(""), "UTF-8")), F.encode(F.lit("0\r\n\r\n"), "UTF-8"))
    return d.select("doc_id", F.md5(encoding.dechunked(body)).alias("md5"), F.coalesce(F.size(encoding.http_chunks(body)), F.lit(0)).alias("n_chunks"))


# ---- pages ----------------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages")


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", html.html_title("html").alias("title"))


def page_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, links and number of elements from one parse."""
    p = _pages(spark, sf_dir).select("page_id", html.analyze_page("html", ["lang", "links"]).alias("a"))
    return p.select("page_id", F.col("a.lang").alias("lang"), F.array_join("a.links", " ").alias("links"))


def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five selections from one parse."""
    wanted = {"n_nav": ("count", "nav > ul > li > a"), "ad": ("text", "div.ad"), "charset": ("attr", "meta[charset]", "charset"), "has_h1": ("matches", "article h1"), "first_href": ("attr", "nav a:first-child", "href")}
    return _pages(spark, sf_dir).select("page_id", html.select_page("html", wanted).alias("x")).select("page_id", "x.*")


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by tag, from the table function."""
    _pages(spark, sf_dir).createOrReplaceTempView("__wa_pages")
    html.register(spark)
    n = spark.sql("SELECT page_id, n.tag FROM __wa_pages, LATERAL html_nodes(html) n WHERE n.type = 'element' AND n.tag IN ('li', 'nav', 'article', 'h1', 'script', 'title')")
    return n.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    _pages(spark, sf_dir).createOrReplaceTempView("__wa_pages")
    html.register(spark)
    return spark.sql("SELECT page_id, l.href, l.text FROM __wa_pages, LATERAL html_links(html) l")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", html.extract_plain_text("html").alias("text"))


def page_main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", html.extract_plain_text("html", main_content=True, preserve_formatting="minimal_html", links=True).alias("text"))


def page_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).groupBy(encoding.mime_of(F.encode("html", "UTF-8")).alias("mime")).agg(F.count("*").alias("n"))


# ---- language -------------------------------------------------------------------------------------


def language_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lang_jobs.create_dataset(_table(spark, sf_dir, "documents"), min_examples=5)
    return d.select("lang", F.sha1("text").alias("text_sha1"), "split")


def language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_jobs.train_profiles(_table(spark, sf_dir, "documents")).select("lang", F.array_join(F.transform("profile", lambda x: x.cast("string")), ",").alias("profile"))


def language_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text against profiles trained from all of them."""
    docs = _table(spark, sf_dir, "documents")
    found = lang.language("text", lang_jobs.load_profiles(lang_jobs.train_profiles(docs)))
    return docs.select("doc_id", "lang", found.alias("d")).select("doc_id", "lang", F.col("d.lang").alias("predicted"), F.col("d.rank").alias("rank"))


def language_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_jobs.evaluate(language_detection(spark, sf_dir))


def language_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of a rule on letters, which SQL can say too."""
    rule = F.when(F.rlike("text", F.lit("[ßäöü]")), "de").when(F.rlike("text", F.lit("[ñ]")), "es").when(F.rlike("text", F.lit("[êçè]")), "fr").otherwise("en")
    e = lang_jobs.evaluate(_table(spark, sf_dir, "documents").select("lang", rule.alias("predicted")))
    return e.select("lang", "n", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


# ---- text and sinks -------------------------------------------------------------------------------


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as files and read again as lines, in splits of 64 KiB."""
    prepare(spark)
    path = shared_folder(spark, "text")
    _table(spark, sf_dir, "documents").select("text").repartition(FILES, F.xxhash64("text")).write.text(path)
    lines = read_text(spark, path + "/*.txt", desired_split_size=1 << 16, min_split_size=1 << 12)
    return lines.groupBy(F.md5("line").alias("line_md5")).agg(F.count("*").alias("n"))


def bulk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = bulk.index_action(_table(spark, sf_dir, "customer"), "c_custkey", "customers")
    return bulk.bulk_index(actions, transport=None, dry_run=True)


def bulk_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bulk.index_action(_table(spark, sf_dir, "nation"), "n_nationkey", "nations")


_WARC = {f"warc_round_trip_{c}": _round_trip(c) for c in ("gzip", "zstd", "lz4", "none", "brotli")}
_NAMES = [
    warc_filtered, warc_predicates, warc_keep_meta, warc_all_files, digest_report, cdxj_index, cdxj_lengths, recompressed, record_counts, hourly_records, streamed_records, header_multimap, status_lines, document_digests, encoding_labels, decoded_text,
    detected_encodings, chunked_bodies, page_titles, page_analysis, page_selection, page_nodes, page_links, page_text, page_main_content, page_mime, language_dataset, language_profiles, language_detection, language_quality, language_evaluation, text_lines,
    bulk_ids, bulk_actions,
]


def queries() -> dict[str, Query]:
    def ready(f: Query) -> Query:
        return lambda spark, sf_dir: f(prepare(spark), sf_dir)

    return {k: ready(f) for k, f in (_WARC | {f.__name__: f for f in [*_NAMES, *record_queries.QUERIES, *page_queries.QUERIES]}).items()}


_PAGE = "SELECT url AS target_uri, octet_length(encode(html)) AS n, page_id, html FROM pages"
_ROUND_TRIP = f"SELECT target_uri, 'response' AS record_type, 200 AS http_status, 'utf-8' AS http_charset, n AS content_length, 1704067200 + 60 * page_id AS \"at\", md5(html) AS payload_md5 FROM ({_PAGE})"
_HOURLY = "SELECT 1704067200 + 3600 * (60 * page_id // 3600) AS hour, 'response' AS record_type, count(*) AS n FROM pages GROUP BY ALL"
_TITLE = "regexp_replace(trim(regexp_extract(html, '<title>(.*?)</title>', 1)), '\\s+', ' ', 'g')"
_PLAIN = lambda x: f"replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_HREFS = """regexp_extract_all(html, '<a href="([^"]*)"', 1)"""
_BASE32 = "translate(to_base(CAST('0x' || {} AS BIGINT), 32, 8), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"


#: Vectors of the documents (v by row and bin), and profiles of the languages (p by language and bin), as functions.lang makes them.
_VECTORS = r"""
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, text, length(text) AS size FROM documents),
kept AS MATERIALIZED (
  SELECT r, regexp_replace(regexp_replace(text, '[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), '[^\p{L} ]', '', 'g') AS s
  FROM d WHERE text IS NOT NULL),
letter AS (SELECT r, unnest(cs) AS x, generate_subscripts(cs, 1) AS i FROM (SELECT r, string_split(s, '') AS cs FROM kept WHERE s != '')),
gram AS (
  SELECT r, unicode(x) AS a, unicode(lead(x, 1) OVER o) AS b, unicode(lead(x, 2) OVER o) AS c, unicode(lead(x, 3) OVER o) AS e, unicode(lead(x, 4) OVER o) AS f
  FROM letter WINDOW o AS (PARTITION BY r ORDER BY i)),
h1 AS (SELECT *, (xor(2166136261, CAST(a AS BIGINT)) * 16777619) & 4294967295 AS p1 FROM gram),
h2 AS (SELECT *, (xor(p1, CAST(b AS BIGINT)) * 16777619) & 4294967295 AS p2 FROM h1),
h3 AS (SELECT *, (xor(p2, CAST(c AS BIGINT)) * 16777619) & 4294967295 AS p3 FROM h2),
h4 AS (SELECT *, (xor(p3, CAST(e AS BIGINT)) * 16777619) & 4294967295 AS p4 FROM h3),
h5 AS (SELECT *, (xor(p4, CAST(f AS BIGINT)) * 16777619) & 4294967295 AS p5 FROM h4),
hashed AS (SELECT r, unnest([p1, p2, p3, p4, p5]) AS h FROM h5),
counted AS (SELECT r, xor(h >> 8, h) & 255 AS bin, count(*) AS n FROM hashed WHERE h IS NOT NULL GROUP BY ALL),
v AS MATERIALIZED (SELECT r, bin, least(255, n * 256 // length(s)) AS v FROM counted JOIN kept USING (r)),
bins AS (SELECT unnest(range(256)) AS bin),
many AS (SELECT lang, count(*) AS n FROM d WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY lang),
added AS (SELECT lang, bin, sum(v) AS t FROM v JOIN d USING (r) GROUP BY ALL),
p AS MATERIALIZED (SELECT many.lang, bins.bin, CAST(coalesce(t, 0) // many.n AS INT) AS p FROM many CROSS JOIN bins LEFT JOIN added ON added.lang = many.lang AND added.bin = bins.bin)"""


def oracle_sql() -> dict[str, str]:
    group = lambda i: _BASE32.format(f"substr(h, {10 * i + 1}, 10)")
    out = {k: _ROUND_TRIP for k in _WARC} | {"hourly_records": _HOURLY, "streamed_records": _HOURLY}
    out["warc_filtered"] = f"SELECT target_uri, n AS content_length FROM ({_PAGE}) WHERE n BETWEEN 1000 AND 3000"
    out["warc_predicates"] = f"SELECT target_uri, n AS content_length FROM ({_PAGE}) WHERE n >= 2000"
    head = "octet_length(encode('HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=UTF-8' || chr(13) || chr(10) || 'X-Page: ' || page_id || chr(13) || chr(10) || chr(13) || chr(10)))"
    out["warc_keep_meta"] = f"SELECT target_uri, CASE WHEN n + {head} <= 4000 THEN n END AS kept_bytes FROM ({_PAGE})"
    out["warc_all_files"] = f"SELECT target_uri, n AS content_length FROM ({_PAGE})"
    out["recompressed"] = f"SELECT target_uri, 'ok' AS payload_digest_status, n AS content_length FROM ({_PAGE})"
    out["record_counts"] = "SELECT count(*) AS n FROM pages"
    out["digest_report"] = "SELECT 'OK, PAYLOAD_OK' AS status, count(*) AS n FROM pages"
    out["cdxj_index"] = """SELECT '{"warc-type":"response","warc-target-uri":' || to_json(url) || ',"http:status":"200","http:x-page":"' || page_id || '"}' AS line FROM pages"""
    out["header_multimap"] = """
WITH t AS (SELECT conv_id, list({'k': role, 'v': text} ORDER BY turn, role, text) AS h FROM conversations GROUP BY conv_id),
u AS (SELECT conv_id, h, list_transform(list_filter(h, lambda x: x.k = 'user'), lambda x: x.v) AS users FROM t)
SELECT conv_id, len(h) AS n, users[1] AS first_user, len(list_filter(h, lambda x: x.k = 'assistant')) AS n_assistant,
  len(list_filter(h, lambda x: x.k = 'system')) > 0 AS has_system, CASE WHEN len(users) > 0 THEN array_to_string(users, ',') END AS all_user,
  'x' AS after_set, len(list_filter(h, lambda x: x.k != 'user')) AS n_without
FROM u"""
    out["status_lines"] = "SELECT CAST(199 + l_linenumber AS INT) AS code, l_returnflag || ' ' || l_linestatus AS reason, count(*) AS n FROM lineitem GROUP BY ALL"
    out["document_digests"] = f"SELECT doc_id, 'md5:' || {group(0)} || {group(1)} || {group(2)} || substr({_BASE32.format("(substr(h, 31, 2) || '00000000')")}, 1, 2) || '======' AS digest, 'ok' AS status FROM (SELECT doc_id, md5(text) AS h FROM documents)"
    out["encoding_labels"] = "SELECT r_regionkey, ['cp1252', 'utf-8', 'shift-jis', 'koi8-r', 'utf-8'][r_regionkey + 1] AS codec FROM region"
    out["decoded_text"] = "SELECT doc_id, md5(text) AS md5, 'application/pdf' AS mime FROM documents"
    out["detected_encodings"] = "SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN text != '' AND octet_length(encode(text)) = length(text) THEN 'cp1252' ELSE 'utf-8' END AS codec FROM documents"
    out["cdxj_lengths"] = f"SELECT {FILES} AS n_files, {FILES} AS n_covered"
    out["chunked_bodies"] = "SELECT doc_id, md5(text) AS md5, CASE WHEN octet_length(encode(text)) >= 2 THEN 2 WHEN octet_length(encode(text)) = 1 THEN 1 ELSE 0 END AS n_chunks FROM documents"
    out["page_titles"] = f"SELECT page_id, {_PLAIN(_TITLE)} AS title FROM pages"
    out["page_analysis"] = f"SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, array_to_string({_HREFS}, ' ') AS links FROM pages"
    out["page_selection"] = f"""
SELECT page_id, len({_HREFS}) AS n_nav, CASE WHEN contains(html, 'class="ad"') THEN {_PLAIN("regexp_extract(html, '<div class=\"ad\">([^<]*)', 1)")} END AS ad, 'utf-8' AS charset,
  contains(html, '<h1>') AS has_h1, {_HREFS}[1] AS first_href
FROM pages"""
    out["page_nodes"] = "SELECT page_id, tag, len(regexp_extract_all(html, '<' || tag || '>')) AS n FROM pages, (SELECT unnest(['li', 'nav', 'article', 'h1', 'script', 'title']) AS tag) WHERE contains(html, '<' || tag || '>')"
    out["page_links"] = f"""
SELECT page_id, unnest({_HREFS}) AS href, {_PLAIN("trim(regexp_replace(t, '\\s+', ' ', 'g'))")} AS text
FROM (SELECT page_id, html, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)', 1)) AS t FROM pages) WHERE false
UNION ALL SELECT page_id, p.href, {_PLAIN("trim(regexp_replace(p.t, '\\s+', ' ', 'g'))")}
FROM (SELECT page_id, unnest(list_zip({_HREFS}, regexp_extract_all(html, '<a href="[^"]*">([^<]*)', 1))) AS z FROM pages), LATERAL (SELECT z[1] AS href, z[2] AS t) p"""
    out["page_mime"] = "SELECT 'text/html' AS mime, count(*) AS n FROM pages"
    out["language_dataset"] = """
WITH c AS (SELECT DISTINCT ON (sha1(t)) lang, sha1(t) AS h FROM (SELECT lang, trim(replace(replace(text, '[[', ''), ']]', ''), ' ') AS t FROM documents) WHERE length(t) >= 200 AND NOT starts_with(t, '<doc')),
p AS (SELECT lang, h, (row_number() OVER (PARTITION BY lang ORDER BY h) - 1) / count(*) OVER (PARTITION BY lang) AS s, count(*) OVER (PARTITION BY lang) AS n FROM c)
SELECT lang, h AS text_sha1, CASE WHEN s < 0.1 THEN 'test' WHEN s < 0.2 THEN 'val' ELSE 'train' END AS split FROM p WHERE n >= 5"""
    out["language_evaluation"] = """
WITH p AS (SELECT lang AS t, CASE WHEN regexp_matches(text, '[ßäöü]') THEN 'de' WHEN regexp_matches(text, '[ñ]') THEN 'es' WHEN regexp_matches(text, '[êçè]') THEN 'fr' ELSE 'en' END AS p FROM documents),
l AS (SELECT t AS lang FROM p UNION SELECT p FROM p),
c AS (SELECT lang, (SELECT count(*) FROM p WHERE t = lang) AS n, (SELECT count(*) FROM p WHERE p.p = lang) AS said, (SELECT count(*) FROM p WHERE t = lang AND p.p = lang) AS ok FROM l WHERE lang IS NOT NULL),
r AS (SELECT lang, n, coalesce(ok / nullif(said, 0), 0) AS pr, coalesce(ok / nullif(n, 0), 0) AS re FROM c)
SELECT lang, n, round(pr, 9) AS precision, round(re, 9) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 9) AS f1 FROM r"""
    out["language_profiles"] = f"WITH {_VECTORS} SELECT lang, array_to_string(list(p ORDER BY bin), ',') AS profile FROM p GROUP BY lang"
    out["language_detection"] = f"""WITH {_VECTORS},
place AS (SELECT lang AS l, row_number() OVER (ORDER BY lang) - 1 AS k FROM many),
far AS (SELECT r, p.lang AS l, sum(abs(coalesce(v.v, 0) - p.p)) AS away FROM d CROSS JOIN p LEFT JOIN v USING (r, bin) WHERE text IS NOT NULL GROUP BY ALL),
ranked AS (SELECT r, l, k, away + CASE WHEN away > 500 AND size < 150 THEN least(50, 3 * k) ELSE 0 END AS rank FROM far JOIN place USING (l) JOIN d USING (r)),
best AS (SELECT r, l, rank FROM ranked WHERE rank <= 1200 QUALIFY row_number() OVER (PARTITION BY r ORDER BY rank, k) = 1)
SELECT doc_id, lang, CASE WHEN text IS NOT NULL THEN coalesce(l, 'unknown') END AS predicted, CAST(CASE WHEN text IS NOT NULL THEN coalesce(rank, 0) END AS INT) AS rank FROM d LEFT JOIN best USING (r)"""
    out["text_lines"] = "SELECT md5(line) AS line_md5, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY ALL"
    out["bulk_ids"] = "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer"
    out["bulk_actions"] = """SELECT 'index' AS op_type, 'nations' AS "index", CAST(n_nationkey AS VARCHAR) AS id, '{"n_name":' || to_json(n_name) || ',"n_regionkey":' || n_regionkey || '}' AS doc FROM nation"""
    return out | record_queries.oracle_sql() | page_queries.oracle_sql()
