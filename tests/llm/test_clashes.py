"""Columns whose names the operators use inside themselves change nothing."""

import public_tokenizers
import pytest

import corpus_pipeline
from pactlake.llm import audio, byte_bpe, embedding_dedup, jaccard_join, language_id, line_dedup, mixing, quality_crf, substring_dedup, token_counts

#: Names that the operators give to columns of their own, with those of their results.
NAMES = """a ac above act action after at b before best block blocks bp bi bucket c cell class comp component component_id copies cost cut data doc
f f1 feature first gone group h half hi hub i id index inner inner_cut inner_room j k key kept kept_text label lang_pred left lines links lo low many mine n ni
n_bytes n_links n_shingles n_tokens n_words n_removed near node norm np over_limit own p part passes payload_bytes pos predicted probe query rank rid role room
rate _rate _places place s s1 score side sketch t tail theirs tokens top up upto v vector w weight x y _n _pass _gone _doc _places _block _room _source _weight _copies _n_tokens _upto
_passes _cut _inner_cut _inner_room _place _inner_place""".split()

TEXT = ["the first line of some plain words here and there\nand a second one of them", "the first line of some plain words here and there", None, "", "$$$ ### 1111\n@@@ 2222", "a few words " * 9]
ROWS = [(i, TEXT[i % 6], "en", "web" if i % 3 else "book", i % 2) for i in range(36)]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, quality int")


@pytest.fixture(scope="module")
def clashing(spark, plain):
    extra = {n: "x" for n in NAMES}
    return plain.selectExpr("*", *[f"'x' AS `{n}`" for n in extra])


def _rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def _operators():
    codec, spec = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
    labels = lambda d: d.select("doc_id", "quality")
    return {
        "op1": (lambda d: language_id.identify(d, d), ("doc_id", "lang_pred")),
        "op2": (lambda d: line_dedup.dedup_lines(d), ("doc_id", "text", "_n_lines", "_n_removed")),
        "op3": (lambda d: byte_bpe.encode_decode(d, codec, public_tokenizers.PATTERN), ("doc_id", "n_tokens", "token_ids")),
        "op4": (lambda d: audio.audio_columns(d), ("doc_id", "feature")),
        "op5": (lambda d: jaccard_join.near_duplicates(d), ("doc_id", "n_shingles", "component_id")),
        "op5 keep": (lambda d: jaccard_join.keep_first(d), ("doc_id", "text")),
        "op6": (lambda d: quality_crf.score_documents(d, quality_crf.fit(d, labels(d))), ("doc_id", "predicted")),
        "op6 keep": (lambda d: quality_crf.keep_good(d, quality_crf.fit(d, labels(d))), ("doc_id", "text")),
        "op7": (lambda d: mixing.copies(d, repetition_limit=1.5), ("doc_id", "text", "_copies")),
        "op7 mix": (lambda d: mixing.realise(d, repetition_limit=1.5), ("doc_id", "text", "source")),
        "op9": (lambda d: token_counts.token_counts(d, spec, public_tokenizers.PATTERN), ("doc_id", "n_tokens")),
        "op10": (lambda d: substring_dedup.dedup_substrings(d), ("doc_id", "n_words", "n_removed", "kept_sha256")),
    }


@pytest.mark.parametrize("name", list(_operators()))
def test_operator(plain, clashing, name):
    run, columns = _operators()[name]
    assert _rows(run(clashing), *columns) == _rows(run(plain), *columns)


def test_embeddings(spark):
    rows = [(i, [float(i % 4), 1.0, 0.5], i % 2) for i in range(24)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    clashing = plain.selectExpr("*", *[f"'x' AS `{n}`" for n in NAMES if n != "label"])
    columns = ("vec_id", "n_links", "component_id", "kept")
    assert _rows(embedding_dedup.near_duplicates(clashing), *columns) == _rows(embedding_dedup.near_duplicates(plain), *columns)


@pytest.mark.parametrize("name", ["lines", "near_duplicates", "mix", "tokens"])
def test_stage(spark, plain, clashing, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    a, b = stage(spark, plain, ""), stage(spark, clashing, "")
    columns = ("doc_id", "n_tokens") if name == "tokens" else ("doc_id", "text", "source")
    assert name == "tokens" or b.columns == clashing.columns
    assert _rows(a, *columns) == _rows(b, *columns)
