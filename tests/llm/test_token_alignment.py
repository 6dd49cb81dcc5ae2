"""Token alignment against loops over every pair of tokens, with the libraries' own ids."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pactlake.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox can't jump 12345 times over the lazy dog.", "The quick brown fox", None, "", " ", "  two  spaces \n\n and\tlines  ", "naïve café Ünïcödé 漢字 😀 emoji",
    "a▁b keeps no space", "<|endoftext|> stays text </s> <0x41>", "The quick brown fox", "x" * 400 + " y" * 50, "ᚠᛇᚻ᛫ᛒᛦᚦ " * 7, "the the the the cat",
]


def brute(texts):
    left, right = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    left.encode_special_tokens = True
    chars = ta.byte_level()
    raw_a = lambda i: bytes(chars[c] for c in left.id_to_token(i))
    raw_b = lambda i: bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode()
    out = []
    for text in texts:
        a = left.encode(" " + text, add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        whole = b" " + (text or "").encode()
        if not text or b"".join(map(raw_a, a)) != whole or b"".join(map(raw_b, b)) != whole:
            out.append(([], [], [], []))
            continue
        groups, at, i, j, ga, gb, ea, eb = [], 0, 0, 0, [], [], 0, 0
        while i < len(a) or j < len(b):
            if ea <= eb and i < len(a):
                ga.append(a[i])
                ea += len(raw_a(a[i]))
                i += 1
            else:
                gb.append(b[j])
                eb += len(raw_b(b[j]))
                j += 1
            if ea == eb and ga and gb:
                groups.append((ga, gb))
                ga, gb = [], []
        out.append((a, b, groups, [(x, y) for p, q in groups for x in p for y in q]))
    count = Counter(p for *_, links in out for p in set(links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    rows = []
    for a, b, groups, links in out:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        rows.append((len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return rows


@pytest.mark.parametrize("hot", [ta.HOT, 5, 0])
def test_all_columns_equal_loops(spark, hot):
    docs = spark.createDataFrame([(None if i == 9 else i % 11, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, row string")
    found = ta.align_tokens(docs, A, B, public_tokenizers.PATTERN, hot=hot).collect()
    want = sorted((str((None if i == 9 else i % 11)), *r) for i, r in enumerate(brute(TEXTS)))
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in found) == want
    assert sum(r.n_a for r in found) > 300


def test_empty_table_and_long_white_space(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ta.align_tokens(docs, A, B, public_tokenizers.PATTERN).count() == 0
    long = "word " * 80_000 + " " * 300_000 + "end" + "\n" * 120_000
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    (row,) = ta.align_tokens(docs, A, B, public_tokenizers.PATTERN).collect()
    left, right = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    assert (row.n_a, row.n_b) == (len(left.encode(" " + long, add_special_tokens=False).ids), len(right.encode(long)))


def test_stretches_leave_ids_as_they_are():
    pieces = ta.Pieces(open(B, "rb").read())
    text = "some words  with two spaces, \n lines and\u3000more " * 300
    assert pieces.cuts
    whole = pieces.model.encode(text)
    assert [i for x in ta.stretches(text, 50) for i in pieces.model.encode(x)] == whole
    assert len(list(ta.stretches(text, 50))) > 100


def test_pairs_of_large_groups_come_in_ranges_of_ids():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 40, 600), rng.integers(0, 30, 500)
    last_a, last_b = np.array([9, 10, 399, 599]), np.array([0, 200, 201, 499])
    (want,) = ta.link_pairs(a, b, last_a, last_b, limit=1 << 40)
    parts = list(ta.link_pairs(a, b, last_a, last_b, limit=100))
    assert len(parts) > 3
    assert np.array_equal(np.concatenate([p for p, _ in parts]), want[0])
    assert np.array_equal(np.concatenate([n for _, n in parts]), want[1])
