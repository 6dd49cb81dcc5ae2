import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pactlake.llm import audio, language_id, queries, quality_crf

DIR = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out(spark):
    truth = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang")
    rows = queries.op1_language_id(spark, DIR).filter("held_out").join(truth, "doc_id").filter("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(rows) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, score string"
    train = [(i, "the cat and the dog went to the house" if i % 2 else "der Hund und die Katze gingen nach Hause", "en" if i % 2 else "de", "x") for i in range(200)]
    labelled = spark.createDataFrame(train, schema)
    docs = spark.createDataFrame([(1, None, None, "x"), (2, "", "en", "x"), (3, "12 34 !!", None, "x"), (4, "the dog and the cat", None, "x"), (4, "the dog and the cat", None, "x"), (None, "die Katze und der Hund " * 4000, None, "x")], schema)
    got = sorted((r["doc_id"] or 0, r["lang_pred"]) for r in language_id.identify(docs, labelled).collect())
    assert got == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    assert {r["lang_pred"] for r in language_id.identify(docs, labelled.limit(0)).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), labelled).count() == 0


def test_quality_on_held_out(spark):
    labels = spark.read.parquet(f"{DIR}/labels.parquet").filter("quality IS NOT NULL").select("doc_id", "quality")
    rows = queries.op6_quality_crf(spark, DIR).filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 30
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.9 * len(rows)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_quality_edges(spark):
    schema = "doc_id long, text string, score string, predicted string"
    docs = spark.createDataFrame([(i, "a clean line of plain words\nand another one" if i % 2 else "$$$ ### 0000 @@@\n!!!! 1111", "x", "y") for i in range(80)], schema)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality_crf.fit(docs, labels)
    odd = spark.createDataFrame([(500, None, "x", "y"), (501, "", "x", "y"), (502, "a clean line of plain words\n" * 5000, "x", "y"), (None, "#### 0000 $$$", "x", "y"), (503, "\n\n", "x", "y")], schema)
    got = {r["doc_id"]: r for r in quality_crf.score_documents(odd, model).collect()}
    assert got[500]["score"] == got[501]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[502]["predicted"] == 1 and got[None]["predicted"] == 0
    kept = quality_crf.keep_good(odd, model)
    assert kept.columns == odd.columns and 502 in {r["doc_id"] for r in kept.collect()}
    assert {r["score"] for r in quality_crf.score_documents(odd, quality_crf.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality_crf.score_documents(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("text", [None, "", "a", "x" * 576, "中" * 300, "line of words " * 30000])
def test_audio_payload(spark, text):
    docs = spark.createDataFrame([(1, text, "clash"), (2, text, "clash")], "doc_id long, text string, feature string")
    a, b = audio.audio_columns(docs, with_media=True).collect()
    raw = (text or "").encode()
    payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
    assert (a["n_bytes"], a["payload_bytes"]) == (len(raw), len(payload))
    assert a["payload_sha256"] == hashlib.sha256(payload).hexdigest() and a["tail_crc32"] == zlib.crc32(payload[-32:])
    assert audio.read_wav(bytes(a["media"]))[0] == payload
    assert (a["media_bytes"], a["media_sha256"]) == (len(a["media"]), hashlib.sha256(bytes(a["media"])).hexdigest())
    assert a["feature"] == b["feature"] and a["feature"]
    tensors = audio.from_ipc(bytes(a["tensors"]))
    assert tensors.num_rows >= 1


def test_audio_empty_table(spark):
    assert audio.audio_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0
