"""Header, digest, encoding and language functions."""

import base64
import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from webarc.functions import digests, encoding, headers, lang
from webarc.operators import lang_jobs
from webarc.plans.queries import queries

DDL = "h array<struct<key:string,value:string>>"


def one(df, *columns):
    return df.select(*columns).first()


def test_header_columns(spark):
    df = spark.createDataFrame([([("A", "1"), ("b", "2"), ("a", "3")],)], DDL)
    h = headers
    r = one(df, h.header_get("h", "a"), h.header_get("h", "x"), h.header_get("h", "x", "d"), h.header_get_all("h", "A"), h.header_contains("h", "B"), h.header_to_map("h"), h.header_keys("h"), h.header_values("h"))
    assert tuple(r) == ("1", None, "d", ["1", "3"], True, {"A": "1,3", "b": "2"}, ["A", "b", "a"], ["1", "2", "3"])
    pairs = lambda c: [tuple(x) for x in one(df, c)[0]]
    assert pairs(h.header_set("h", "A", F.lit(" x\r\ny "))) == [("A", "x y"), ("b", "2")]
    assert pairs(h.header_set("h", "c:", F.lit("9")))[-1] == ("c", "9") and len(pairs(h.header_set("h", "b", F.lit("9")))) == 3
    assert pairs(h.header_append("h", "A", F.lit("4")))[-1] == ("A", "4") and pairs(h.header_remove("h", "A")) == [("b", "2")]
    assert one(df, h.header_block("h", F.lit("HTTP/1.1 200 OK")))[0] == "HTTP/1.1 200 OK\r\nA: 1\r\nb: 2\r\na: 3\r\n"
    block = spark.createDataFrame([(b"A: 1\r\nB: two\r\n three\r\nnone\r\nC:x:y\r\n",)], "b binary")
    assert [tuple(x) for x in one(block, h.parse_headers("b"))[0]] == [("A", "1"), ("B", "two three"), ("C", "x:y")]
    lines = spark.createDataFrame([("HTTP/1.1 404 Not Found",), ("HTTP/1.0 x",), ("GET / HTTP/1.1",), (None,), ("HTTP/1.1 99999 no",)], "l string")
    assert [tuple(x) for x in lines.select(h.status_code("l"), h.reason_phrase("l")).collect()] == [(404, "Not Found"), (None, None), (None, None), (None, None), (None, "no")]
    kinds = spark.createDataFrame([("text/html; charset=UTF-8",), ("text/html",), (None,)], "c string")
    assert [tuple(x) for x in kinds.select(h.content_type("c"), h.content_charset("c")).collect()] == [("text/html", "utf-8"), ("text/html", None), (None, None)]


@pytest.mark.parametrize("name", list(digests.ALGORITHMS))
def test_digest_columns(spark, name):
    raw = hashlib.new(name, b"ABC").digest()
    df = spark.createDataFrame([(b"ABC", f"{name}:{raw.hex()}"), (b"ABD", f"{name}:{raw.hex()}"), (b"ABC", f"{name}:{base64.b32encode(raw).decode()}"), (b"ABC", None), (None, f"{name}:x"), (b"ABC", name), (b"ABC", f"{name}:!"), (b"ABC", "crc:1")], "d binary, v string")
    assert one(df, digests.digest_of("d", name))[0] == f"{name}:{base64.b32encode(raw).decode()}"
    assert [r[0] for r in df.select(digests.digest_status("d", "v")).collect()] == ["ok", "fail", "ok", "missing", "no_payload", "format", "format", "unsupported"]


def test_short_bodies_are_cut_in_two(spark, tmp_path):
    texts = [None, "", "a", "ab", "é", "abc", "ab" * 40]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["md5"], r["n_chunks"]) for r in queries()["chunked_bodies"](spark, str(tmp_path)).collect()}
    assert got == {i: (None, 0) if t is None else (hashlib.md5(t.encode()).hexdigest(), min(2, len(t.encode()))) for i, t in enumerate(texts)}


def test_encodings():
    e = encoding
    assert e.detect_encoding(b"plain") == "cp1252" and e.detect_encoding(b"plain", html5=False) == "ascii" and e.detect_encoding(b"") == "utf-8" and e.detect_encoding(b"", html5=False) is None
    samples = {"cp1251": "Это обычный русский текст, написанный для проверки.", "koi8-r": "Это обычный русский текст, написанный для проверки.", "shift-jis": "日本語のテキストです。", "euc_jp": "これは日本語のテキストです。", "gb18030": "这是用来测试的一段中文。", "euc-kr": "한국어 문장을 확인합니다", "cp1253": "Αυτό είναι ένα κείμενο", "cp1252": "Où est la forêt près de l'école", "utf-8": "déjà vu"}
    for codec, text in samples.items():
        assert e.detect_encoding(text.encode(codec)) == codec, codec
    assert e.detect_encoding("Ĝis".encode("utf-16")) == "utf-16-le" and e.detect_encoding("abc".encode("utf-16-be") * 9) == "utf-16-be"
    page = '<meta charset="windows-1251"><p>é'.encode()
    assert e.detect_encoding(page) == "utf-8" and e.detect_encoding(page, from_meta=True) == "cp1251"
    assert e.detect_encoding(b"a" * 300 + "é".encode(), max_len=100) == "utf-8"
    for text in ("é" * 150, "a" + "é" * 150, "a" * 150 + "é" + "a" * 150, "a" * 49 + "日" * 60):  # cut within a character, and nothing but ASCII at the ends
        assert e.detect_encoding(text.encode(), max_len=100) == "utf-8"
    assert e.detect_encoding(b"a" * 300, max_len=100) == "cp1252" and e.detect_encoding("a".encode() + "é".encode() * 80 + b"\xff" + "é".encode() * 80, max_len=100) == "utf-8"
    assert e.detect_encoding(("日本語のテキストです。" * 9).encode("shift-jis"), max_len=101) == "shift-jis"
    d = e.EncodingDetector().update(b"a").update("é".encode())
    assert d.encoding() == "utf-8"
    d.reset()
    assert d.encoding() is None
    assert e.map_label(" Latin1 ") == "cp1252" and e.map_label("what") == "utf-8" and e.map_label("what", False) is None
    assert e.bytes_to_str("ü".encode(), "ascii") == "ü" and e.bytes_to_str(b"\xfc", "ascii") == "ü" and e.bytes_to_str(b"a\xff", "ascii", fallback=()) == "a" and e.bytes_to_str(None) is None
    assert e.bytes_to_str(b"\xef\xbb\xbfx") == "x" and e.bytes_to_str(b"\xef\xbb\xbfx", strip_bom=False) == "﻿x" and e.bytes_to_str(b"x", "nonsense") == "x"


@pytest.mark.parametrize("data,kind", [(b"\x89PNG\r\n\x1a\n", "image/png"), (b"PK\x03\x04..", "application/zip"), (b" \n<!doctype html><p>", "text/html"), (b'<?xml version="1.0"?><svg x="1">', "image/svg+xml"), (b"<?xml ?><a>", "application/xml"), (b"just some words", "text/plain"), (b"\x00\x01\x02\x03 binary", "application/octet-stream"), (b"", "text/plain"), (b"RIFF....WAVE", "image/webp")])
def test_mime(data, kind):
    assert encoding.detect_mime(data) == kind


def test_encoding_columns(spark):
    df = spark.createDataFrame([(b"\xe9t\xe9 fran\xe7ais",), (None,)], "d binary")
    assert [tuple(r) for r in df.select(encoding.encoding_of("d"), encoding.decoded("d"), encoding.mime_of("d")).collect()] == [("cp1252", "été français", "application/octet-stream"), (None, None, None)]
    import gzip

    z = spark.createDataFrame([(gzip.compress(b"x"), None, "gzip"), (b"x", None, "odd"), (None, None, None)], "d binary, t string, c string")
    assert [None if r[0] is None else bytes(r[0]) for r in z.select(encoding.decoded_payload("d", "t", "c")).collect()] == [b"x", None, None]


def slow_vector(text, bins):
    kept, space = [], False
    for c in text:
        if c.isalpha():
            kept.append(c)
            space = False
        elif c.isspace():
            if not space:
                kept.append(" ")
            space = True
        else:
            space = False
    counts = [0] * bins
    for i in range(len(kept)):
        for n in range(1, 6):
            if i + n <= len(kept):
                h = 0x811C9DC5
                for c in kept[i : i + n]:
                    h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
                h = ((h >> 8) ^ h) & 0xFF
                counts[h % bins if bins < 256 else h] += 1
    return [min(255, c * 256 // max(len(kept), 1)) for c in counts]


@pytest.mark.parametrize("bins", [256, 150])
def test_vectors_match_a_plain_loop(bins):
    texts = ["Hello,  wörld! 12 a", "", None, "   ", "日本語 テキスト", "a" * 300, "x\t\n . y"]
    got = lang.text_vectors(texts, bins)
    assert got.tolist() == [slow_vector(t or "", bins) for t in texts]


def test_language(spark):
    known = lang.built_in()
    for code, text in lang._PARAGRAPHS.items():
        assert lang.detect_fast(text)[0] == code
    assert lang.detect_fast("some words", langs=["xx"]) == lang.UNKNOWN and lang.detect_fast("some words", langs=[]) == lang.UNKNOWN and lang.detect_fast("x", cutoff=0) == lang.UNKNOWN
    got = lang.detect_fast(lang._PARAGRAPHS["en"], n_results=3)
    assert len(got) == 3 and [r for _, r in got] == sorted(r for _, r in got) and lang.detect_fast("x", n_results=0) == []
    assert lang.supported_langs() == sorted(known) and lang.supported_langs_table(spark).count() == len(known)
    df = spark.createDataFrame([(lang._PARAGRAPHS["de"],), (None,)], "t string")
    a, b = df.select(lang.language("t").alias("l"), lang.languages("t", 2).alias("m")).collect()
    assert a.l.lang == "de" and a.m[0].lang == "de" and len(a.m) == 2 and b.l is None and b.m is None


def test_training(spark):
    rows = [("aa", "abc def"), ("aa", "abc xyz"), ("bb", "qqq www"), ("bb", None), (None, "x")]
    profiles = lang_jobs.load_profiles(lang_jobs.train_profiles(spark.createDataFrame(rows, "lang string, text string")))
    assert profiles == {"aa": lang.train_profile(["abc def", "abc xyz"]), "bb": lang.train_profile(["qqq www"])}
    assert lang.train_profile([]) == [0] * 256 and np.array(lang.train_profile(["ab"], 150)).shape == (150,)


def test_evaluation(spark):
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "lang string, predicted string")
    got = {r.lang: (r.n, round(r.precision, 3), round(r.recall, 3), round(r.f1, 3)) for r in lang_jobs.evaluate(p).collect()}
    assert got == {"a": (2, 0.5, 0.5, 0.5), "b": (1, 0.5, 1.0, 0.667), "c": (1, 0.0, 0.0, 0.0)}
    assert lang_jobs.accuracy(p).first().accuracy == 0.5
    assert {r["lang"]: (r["a"], r["b"]) for r in lang_jobs.confusion(p).collect()} == {"a": (1, 1), "b": (0, 1), "c": (1, 0)}


def test_dataset(spark):
    rows = [("a", f"text number {i} " + "x" * 200) for i in range(20)] + [("a", "short"), ("a", "<doc id=1>" + "y" * 300), ("b", "z" * 300)] * 2 + [("a", None)]
    d = lang_jobs.create_dataset(spark.createDataFrame(rows, "lang string, text string"), min_examples=5)
    got = {r.split: r["count"] for r in d.groupBy("split").count().collect()}
    assert got == {"test": 2, "val": 2, "train": 16} and {r.lang for r in d.collect()} == {"a"}


def test_dataset_spreads_a_language(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("a" if i % 10 else None, f"text number {i} " + "x" * 200) for i in range(2000)]
        d = lang_jobs.create_dataset(spark.createDataFrame(rows, "lang string, text string")).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(Counter(r.task for r in d).values()) < 1000
    for name, n in (("a", 1800), (None, 200)):
        order = sorted((hashlib.sha1(r.text.encode()).hexdigest(), r.split) for r in d if r.lang == name)
        assert [x for _, x in order] == ["test"] * (n // 10) + ["val"] * (n // 10) + ["train"] * (n * 8 // 10)
