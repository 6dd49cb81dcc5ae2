"""The pipeline against chained plain versions, on a small table with nulls, ties, copies and clashing names."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from tests.llm import brute
from tests.llm.test_line_dedup import brute as lines_brute

import corpus_pipeline
from pactlake.llm import line_dedup, quality_crf

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string"


def _texts(rng):
    words = ["w" + str(i) for i in range(150)]
    base = [" ".join(rng.choices(words, k=rng.randint(9, 14))) for _ in range(25)]
    out = []
    for i in range(90):
        lines = [rng.choice(base) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(3, 25))) for _ in range(rng.randint(1, 5))]
        out.append("\n".join(lines) if i % 4 else "\n".join("#$%& 0000 !!!! " + str(rng.randrange(10**9)) for _ in lines))
    copies = [out[k] for k in (1, 5, 9)]
    near = [out[k] + " tail" for k in (2, 6, 10, 13)]
    return out + copies + near + ["", None, "\n\n", "  ", out[1] + "\n"]


def test_run_equals_chained_brute_force(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, t, "en", rng.choice("aaaab"), len(t or ""), "clash") for i, t in enumerate(_texts(rng))]
    rows += [(rows[3][0], *rows[3][1:])]  # a repeated row
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], int("#" not in (r[1] or "#")), 0) for r in rows if r[0] % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    learned = spark.createDataFrame([x for x in labels if zlib.crc32(str(x[0]).encode()) % 3 != 1], "doc_id long, quality int, toxic int")
    model = quality_crf.fit(docs, learned)
    kept = [r for r in rows if brute.line_score(model, r[1]) >= 0.5]
    assert 20 < len(kept) < len(rows)
    assert not any("#" in (r[1] or "") for r in kept)
    text = lines_brute([(i, t) for i, t, *_ in dict((r[0], r) for r in kept).values()], line_dedup.MIN_WORDS)
    kept = [(r[0], text[r[0]], *r[2:]) for r in kept if text[r[0]] == r[1] or text[r[0]].strip()]
    sets = {r[0]: brute.shingles(r[1]) for r in kept}
    low = brute.components(sets)
    kept = [r for r in kept if low[r[0]] == r[0]]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    copies, _ = brute.mixed(spark.createDataFrame(kept, SCHEMA), lambda t: len(library.encode_ordinary(t or "")), repetition_limit=corpus_pipeline.REPETITION_LIMIT)
    want = []
    for r in kept:
        ids = library.encode_ordinary(r[1] or "")
        row = (r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())
        want += [row] * copies[r[0], r[1], r[3]]
    assert got == sorted(want)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
