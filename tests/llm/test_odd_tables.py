"""All queries and the pipeline over tables without rows, and over nulls, empty and very long texts, repeated rows and clashing columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brightwell.llm import registry

QUERIES = registry.QUERIES | {"pipeline": corpus_pipeline.run}
LONG = "ab " * 150_000 + "\n" * 5_000 + "x" * 100_000
TEXTS = [None, "", " ", "one", "é😀\t\x00", "same words in two rows of this table", "same words in two rows of this table", LONG, "\n\n", "password=hunter22 and more"]
CLASH = ["cid", "k1", "text_", "found", "epoch", "score", "bands", "toxicity", "route", "kind", "copies", "line", "host", "hash", "tokens", "weight"]
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn int, role string, text string",
    "pages": "page_id long, url string, html string",
}


def write(spark, at, rows, extra=()):
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(rows.get(name, []), schema)
        for c in extra:
            df = df.withColumn(c, F.lit("clash"))
        df.write.mode("overwrite").parquet(str(at / f"{name}.parquet"))
    return str(at)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    ids = [1, 2, None, 4, 5, 6, 6, 8, None, 10]
    rows = {
        "documents": [(i, t, "en" if k % 3 else None, "src1" if k % 2 else None, None) for k, (i, t) in enumerate(zip(ids, TEXTS, strict=True))] * 2,
        "labels": [(1, 1, 0), (1, 0, 1), (None, 1, 1), (5, None, None), (6, 1, 7)],
        "benchmark": [(1, "same words in two rows of this table"), (1, None), (None, ""), (2, "...")],
        "conversations": [(1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, 0, None, "x"), (2, 1, "user", ""), (None, 0, "user", "hm")],
    }
    return write(spark, tmp_path_factory.mktemp("odd"), rows, CLASH)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_rows(spark, empty, name):
    got = QUERIES[name](spark, empty).collect()
    assert len(got) == (1 if name == "op4_chat_format" else 0)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd, name):
    got = QUERIES[name](spark, odd).collect()
    n = 2 * len(TEXTS)
    if name in ("op2_near_dedup", "op3_line_dedup", "op7_secret_scan", "op8_suffix_dedup", "op9_media", "op10_toxicity"):
        assert len(got) == n
    if name == "op2_near_dedup":
        assert {r["class_id"] for r in got if r["doc_id"] == 6} == {6} and {r["class_id"] for r in got if r["doc_id"] == 8} == {8}
    if name == "op5_decontamination":
        assert [(r["doc_id"], r["item_id"], r["distance"]) for r in got] == [(6, 1, 0)] * 4
    if name == "op7_secret_scan":
        assert sum(r["n_assign"] for r in got) == 2
    if name == "op9_media":
        for r in got:
            if r["doc_id"] in (1, 2):
                payload = ("" if r["doc_id"] == 1 else "").encode() + b"\xff" * 576
                assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (0, 576, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    if name == "op10_toxicity":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    if name == "pipeline":
        assert {r["text"] for r in got} <= set(TEXTS) and 6 not in {r["doc_id"] for r in got}


def test_media_payloads(spark, sf):
    """The query's payload is the text's bytes, padded; equal texts have equal values."""
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by_text = {}
    for r in QUERIES["op9_media"](spark, sf).collect():
        raw = docs[r["doc_id"]]
        size = max(576, -(-len(raw) // 576) * 576)
        payload = raw + b"\xff" * (size - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert by_text.setdefault(raw, (r["media_sha256"], r["media_bytes"], r["feature"])) == (r["media_sha256"], r["media_bytes"], r["feature"])
