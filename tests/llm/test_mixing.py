"""Mixing counts tokens, also of texts without spaces."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from pactlake.llm import byte_bpe, mixing


def test_shares_are_of_tokens(spark):
    long = "".join(chr(0x4E00 + i * 37 % 3000) for i in range(400))
    rows = [(i, long[i:], "zh") for i in range(20)] + [(100 + i, "a few words more " * 3, "en") for i in range(20)] + [(200, None, "en"), (201, "", "zh")]
    with open(public_tokenizers.path(mixing.RANKS), "rb") as f:
        codec = byte_bpe.Codec(byte_bpe.load_ranks(f.read()), public_tokenizers.PATTERN)
    want = {i: len(codec.encode(t or "")) // 4 for i, t, _ in rows}
    got = {r["doc_id"]: r for r in mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string"), repetition_limit=2.0).collect()}
    assert {i: r["_n_tokens"] for i, r in got.items()} == want
    tokens = {s: sum(want[i] for i, _, x in rows if x == s) for s in ("zh", "en")}
    assert tokens["zh"] > 10 * tokens["en"]  # of words it has the fewer
    assert all(r["_copies"] == 1 for r in got.values() if r["source"] == "zh")
    made = sum(r["_n_tokens"] * r["_copies"] for r in got.values() if r["source"] == "en")
    assert 1.5 * tokens["en"] < made <= 2 * tokens["en"]
    assert got[0]["_weight"] > got[100]["_weight"]


def _codec():
    with open(public_tokenizers.path(mixing.RANKS), "rb") as f:
        return byte_bpe.Codec(byte_bpe.load_ranks(f.read()), public_tokenizers.PATTERN)


@pytest.mark.parametrize("targets", [{"repetition_limit": 2.0}, {"repetition_limit": 1.3}, {"entropy": 0.8}, {"entropy": 9.0}, {"entropy": 0.2}, {"repetition_limit": 4.0, "budget_tokens": 2500}, {"entropy": 0.7, "budget_tokens": 40}])
def test_copies_equal_brute_force(spark, targets):
    rng = random.Random(5)
    words = "one two three vier fünf sechs".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice("aaaaaaabbc")) for i in range(300)]
    rows += [(1000, None, "a"), (1001, "", "b"), (None, "no id", "a"), (7, "same row", "b"), (7, "same row", "b"), (1002, "null source", None), (1003, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    codec = _codec()
    given = {"budget" if k == "budget_tokens" else k: v for k, v in targets.items()}
    want, weight = brute.mixed(docs, lambda t: len(codec.encode(t or "")) // 4, **given)
    got = mixing.copies(docs, **targets).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["text"], r["source"]): r["_copies"] for r in got} == want
    assert all(abs(r["_weight"] - weight.get(r["source"], 0.0)) < 1e-9 for r in got)
    again = mixing.copies(docs.repartition(7), **targets).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    if "budget_tokens" in targets:
        made = sum(r["_n_tokens"] * r["_copies"] for r in got)
        assert made <= targets["budget_tokens"] and made > targets["budget_tokens"] - 60 * len(weight)


def test_equal_sources_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "a b c", "xy"[i % 2]) for i in range(10)], "doc_id long, text string, source string")
    assert {r["_copies"] for r in mixing.copies(docs).collect()} == {1}
    assert mixing.copies(docs.limit(0)).count() == 0 and mixing.realise(docs.limit(0)).columns == docs.columns
    nothing = docs.withColumn("text", F.lit(None).cast("string"))
    assert {r["_copies"] for r in mixing.copies(nothing).collect()} == {1}


def test_the_mix_is_read_in_blocks_at_the_weights(spark):
    rng = random.Random(8)
    rows = [(i, "some words of text " * rng.randint(1, 6), "a" if i % 12 else "b") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.realise(docs, with_place=True, repetition_limit=3.0)
    assert found.columns == ["doc_id", "text", "source", "_place"]
    mix = sorted(found.collect(), key=lambda r: r["_place"])
    assert all(0 <= r["_place"] <= 1 for r in mix)
    size = {i: len(t) for i, t, _ in rows}
    share = lambda part: sum(size[r.doc_id] for r in part if r.source == "b") / sum(size[r.doc_id] for r in part)
    whole, quarter = share(mix), len(mix) // 4
    assert all(abs(share(mix[a : a + quarter]) - whole) < 0.05 for a in range(0, 3 * quarter, quarter))
    # Rows of one block stand together in every pass, in other orders of blocks from pass to pass.
    block = {r.doc_id: r.b for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id, 11), 1024L) AS b").collect()}
    passes = {}
    for r in mix:
        if r.source == "b":
            passes.setdefault(r.doc_id, []).append(r["_place"])
    places = {}
    for i, p in passes.items():
        for n, x in enumerate(p):
            assert places.setdefault((block[i], n), x) == x
    first, second = ([b for b, n in sorted((k for k in places if k[1] == m), key=places.get)] for m in (0, 1))
    assert set(second) <= set(first) and [b for b in first if b in set(second)] != second


def test_budgets_in_shares_of_the_corpus(spark):
    docs = spark.createDataFrame([(i, "one two three " * (1 + i % 7), "xyz"[i % 3 if i % 5 else 0]) for i in range(900)], "doc_id long, text string, source string")
    found = mixing.copies(docs, budget_share=0.5).collect()
    made, whole = sum(r["_n_tokens"] * r["_copies"] for r in found), sum(r["_n_tokens"] for r in found)
    assert 0.48 * whole < made <= 0.5 * whole
    assert all(len(r["_places"]) == r["_copies"] for r in found)


def test_python_is_given_one_slice_of_texts_at_a_time(spark, monkeypatch):
    seen, write = [], mixing.materialize

    def watched(df, tag, **k):
        seen.append((tag, k.get("batch")))
        return write(df, tag, **k)

    monkeypatch.setattr(mixing, "materialize", watched)
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    out, _ = mixing.counted(docs)
    assert seen == [("mix-counted", mixing.SLICE_ROWS)] and {r.doc_id: r._n_tokens > 0 for r in out.collect()} == {1: True, 2: False}


def test_counts_are_those_of_the_ids():
    import gc

    import public_tokenizers

    from pactlake.llm import byte_bpe

    with open(public_tokenizers.path(mixing.RANKS), "rb") as f:
        codec = byte_bpe.Codec(byte_bpe.load_ranks(f.read()), public_tokenizers.PATTERN)
    texts = ["a\tb c d  e\n\nf 12,345 x-y  ", " lead", "a b\u0085 c,d e", "", " ", "x'll don't 3.14e10 　 z;", "a \x1cb c\x1d d. e", "q9 " * 50 + "zq7x,9 " * 3]
    assert codec.count_all(texts) == [len(codec.values.plain(t)) // 4 for t in texts] and codec.encode_all(texts) == [codec.values.plain(t) for t in texts]
    assert codec.many.count([b"abc", b"", b"zzzz"]) == [len(x) // 4 for x in codec.many.merge([b"abc", b"", b"zzzz"])] and gc.isenabled()


def test_a_word_is_looked_up_once_however_often_it_stands():
    import pyarrow as pa

    from pactlake.llm.pretokens import Memory

    class Watched(Memory):
        asked = 0

        def __getitem__(self, key):
            Watched.asked += 1
            return super().__getitem__(key)

    codec = _codec()
    codec.counts.words = Watched(codec.counts.words.make)
    texts = ["start " + "seven words, of which 1234 are-some rare " * 200 + "end"] * 20 + [None, "", "\n lead  and\ttabs \n", "中文" * 40]
    got = codec.count_all(pa.array(texts))
    assert Watched.asked <= 10 and got == [len(codec.values.plain(t or "")) // 4 for t in texts]


def test_tables_count_as_the_queue_does():
    rng = random.Random(4)
    codec = _codec()
    pieces = [bytes(rng.choices(b" aeinrst.,09\xc3\xa9\xff", k=rng.randint(0, 40))) for _ in range(3000)] + [b"a" * n for n in range(70)]
    assert codec.many.count(pieces) == [len(byte_bpe.merge(p, codec.ranks)) for p in pieces] and codec.many.count([]) == []
