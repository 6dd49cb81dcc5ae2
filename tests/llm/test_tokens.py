import base64
import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers

from pactlake.llm import byte_bpe, token_counts

DATA = "/root/testdata/sf0.001/documents.parquet"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens int, ids_sha256 string"


def odd_texts():
    rng = random.Random(8)
    odd = ["", " ", "\n\n \t", "a" * 5000, "ab" * 3000, "éè 中文 \U0001f600\U0001f600", "x" * 63 + " " + "y" * 65, "1234567890" * 20, "it's we'll I'M", "<|endoftext|> <s> </s>", "​﻿\x00\x7f"]
    return odd + ["".join(rng.choice(" abABßñЖ水'.,\n0") for _ in range(rng.randint(1, 300))) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(100000 + i, t, 5, "clash") for i, t in enumerate([*odd_texts(), None, "twice", "twice"])] + [(None, "no id", 5, "clash")]
    return spark.createDataFrame(rows, SCHEMA).unionByName(spark.read.parquet(DATA).select("doc_id", "text"), allowMissingColumns=True)


def test_bpe_equals_library(docs):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f.read().splitlines() if line)}
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r for r in byte_bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        ids = library.encode_ordinary(text)
        assert list(got[k]["token_ids"]) == ids
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_counts_equal_library(docs):
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs, VOCABULARY, public_tokenizers.PATTERN, limit=100).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        n = count(text)
        assert (got[k]["n_tokens"], got[k]["n_bytes"], got[k]["over_limit"]) == (n, len(text.encode()), n > 100), text[:80]


def test_long_pretoken_is_linear(spark):
    import time

    codec = byte_bpe.codec_of(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    took = []
    for n in (50_000, 400_000):
        text = "".join(random.Random(n).choices("abcde", k=n))
        began = time.perf_counter()
        ids = codec.encode(text)
        took.append(time.perf_counter() - began)
        assert codec.decode(ids) == text.encode()
    assert took[1] < 24 * max(took[0], 0.05)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert byte_bpe.encode_decode(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_counts.token_counts(none, VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_merge_equals_plain_bpe():
    rng = random.Random(5)
    for _ in range(50):
        pieces = {bytes([c]): i for i, c in enumerate(b"abc")}
        for size in (2, 3, 4):
            for p in itertools.product(b"abc", repeat=size):
                if rng.random() < 0.3:
                    pieces[bytes(p)] = 0
        longer = [p for p in pieces if len(p) > 1]
        rng.shuffle(longer)
        ranks = {p: i for i, p in enumerate([b"a", b"b", b"c", *longer])}
        word = bytes(rng.choices(b"abc", k=rng.randint(1, 40)))
        parts = [bytes([c]) for c in word]
        while True:
            best = min(((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(itertools.pairwise(parts))), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert byte_bpe.merge(word, ranks) == [ranks[p] for p in parts]


def test_many_at_once_equals_one_by_one():
    rng = random.Random(15)
    for _ in range(20):
        base = [bytes([c]) for c in range(256)]
        longer = list({bytes(rng.choices(b"abcd", k=rng.randint(2, 5))) for _ in range(60)})
        ranks = {p: i for i, p in enumerate([*base, *longer])}
        pieces = [p for p in (bytes(rng.choices(b"abcdx", k=rng.randint(0, 30))) for _ in range(80)) if p not in ranks]  # whole tokens need no queue
        want = [np.array(byte_bpe.merge(p, ranks) if p else [], "<u4").tobytes() for p in pieces]
        assert byte_bpe.Merger(ranks).merge(pieces) == want


def test_remembered_words_equal_library():
    with open(RANKS, "rb") as f:
        ranks = byte_bpe.load_ranks(f.read())
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rng = byte_bpe.Codec(ranks, public_tokenizers.PATTERN), random.Random(9)
    texts = ["".join(rng.choice(" abABßñЖ水'.,\n0\u3000\x1c\xa0\t") for _ in range(rng.randint(0, 60))) for _ in range(1500)] + odd_texts()
    for ids, text in zip(codec.encode_all(texts), texts, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text)


def test_slices_that_bring_nothing_new():
    """No word, no new word, or new ones that are all whole tokens: nothing is left for the queue."""
    with open(RANKS, "rb") as f:
        ranks = byte_bpe.load_ranks(f.read())
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.Codec(ranks, public_tokenizers.PATTERN)
    assert codec.many.merge([]) == [] and codec.many.count([]) == []
    for texts in ([], [""], [" ", "\n"], ["the and of"], ["antidisestablishmentarianism twice"], ["twice antidisestablishmentarianism"]):
        want = [library.encode_ordinary(t) for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode_all(texts)] == want
        assert codec.count_all(texts) == [len(x) for x in want]


def test_prefix_tables_and_cuts_equal_library(spark):
    """Counts of prefixes that end with a pre-token are the library's; within one, those of its own bytes."""
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    with open(VOCABULARY, "rb") as f:
        counter = token_counts.counter_of(f.read(), public_tokenizers.PATTERN)
    rng = random.Random(21)
    texts = ["", "it's we'll", "<|endoftext|>a<|endoftext|>", "antidisestablishmentarianism", "x" * 70, "éè 中文 naïve"] + ["".join(rng.choice("abcde ABß中.,\n0'") for _ in range(rng.randint(1, 50))) for _ in range(60)]
    for text in texts:
        table, data = counter.prefix_table(text), text.encode()
        assert len(table) == len(data) + 1 and table[0] == 0 and table[-1] == count(text)
        at = base = 0
        whole = set()  # ends within a special string
        for part, width in counter.parts(text):
            for piece in [None] if part is None else counter.split(part):
                raw = b"\0" * width if piece is None else piece.encode()
                whole.update(range(at + 1, at + width) if piece is None else ())
                for i in range(1, len(raw) + 1):
                    if piece is not None and (i == len(raw) or raw[i] & 0xC0 != 0x80):
                        assert table[at + i] == base + len(library.model.tokenize("".join(chars[b] for b in raw[:i]))), (text, piece, i)
                at += len(raw)
                base = int(table[at])
        for budget in (0, 1, 2, 5, 1000):
            ends = [i for i in range(len(data) + 1) if (i == len(data) or data[i] & 0xC0 != 0x80) and i not in whole and table[i] <= budget]
            assert counter.cut(text, budget) == max(ends)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in token_counts.token_counts(docs, VOCABULARY, public_tokenizers.PATTERN, limit=5, with_prefixes=True).collect():
        assert r["prefix_tokens"] == counter.prefix_table(texts[r["doc_id"]]).tolist()
        assert r["cut_bytes"] == (counter.cut(texts[r["doc_id"]], 5) if r["over_limit"] else r["n_bytes"])


chars = {b: c for c, b in token_counts.byte_alphabet().items()}
