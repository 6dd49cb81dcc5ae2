"""Line deduplication over all documents by a deletion-neighbourhood join.

Lines are compared as sequences of words (ASCII letters in lower case, white space squeezed). Two different lines are
near copies when one word edit (substitution, insertion or deletion) turns one into the other and both have at least
`min_words` words. A line goes when an equal line or a near copy starts earlier, by document and then position.

Every line emits the hashes of its words with one word left out, keyed with the place of that word:
 - lines that share (variant, place) differ in that word only: a substitution;
 - a variant that equals a whole line: an insertion or deletion.
Only the earliest line of each key matters, so keys are aggregated to a minimum and no pairs of a group are made. Two
lines within one edit share the first or the second half of their words, so lines without such a shared half emit no
variants, and those with one emit only the deletions in the other half. The earliest line found is then checked against the words themselves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlake.llm.common import discard, fresh, materialize, mix, power_table, row_chunks, text_buffer, word_hashes

MIN_WORDS = 8
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Ranges:
    """Hashes of ranges of consecutive words, by prefix sums."""

    def __init__(self, h: np.ndarray, base: int) -> None:
        n = len(h)
        self.base, self.back = base, power_table(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * power_table(base, n + 1)[:n], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64))


def _lines(buf: np.ndarray, off: np.ndarray):
    """Lines with words of consecutive rows: row, position, first word, end word; and the word hashes with their bytes."""
    h, s, e, _ = word_hashes(buf, off, fold=True)
    base = off[0]
    raw = buf[base : off[-1]]
    starts = np.union1d(off[:-1] - base, np.flatnonzero(raw == 10) + 1)
    line = np.searchsorted(starts, s, "right") - 1
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    end = np.append(first[1:], len(line))
    at = starts[line[first]] if len(line) else first
    row = np.searchsorted(off - base, at, "right") - 1
    breaks = np.concatenate([[0], np.cumsum(raw == 10)])
    pos = breaks[at] - breaks[(off[:-1] - base)[row]]
    return row, pos, first, end, h, s, e


def _line_rows(min_words: int):
    """(doc, text) -> doc, pos, a, b, f1, f2, s1, s2: two hashes of each line with words, and of its halves."""

    def run(batches):
        import pyarrow as pa

        names = ["doc", "pos", "a", "b", "f1", "f2", "s1", "s2"]
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            for x, y in row_chunks(off):
                row, pos, first, end, h, _, _ = _lines(buf, off[x : y + 1])
                n = end - first
                one, two = Ranges(h, _BASES[0]), Ranges(mix(h), _BASES[1])
                half, less = n // 2, (n - 1) // 2
                parts = [one.of(first, first + half), one.of(first, first + less), ~one.of(first + half, end), ~one.of(first + less + 1, end)]
                short = n < min_words
                hashes = [one.of(first, end), two.of(first, end)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(x + row)), pa.array(pos, pa.int32()), *(pa.array(v.view(np.int64)) for v in hashes), *(pa.array(v.view(np.int64), mask=short) for v in parts),
                ], names=names)

    return run


def _variant_rows(batches):
    """(doc, text, near: pos, head, tail) -> doc, pos, key, place, norm: of the named lines the whole at place -1, with its
    words, and the deletions after a shared head or before a shared tail."""
    import pyarrow as pa

    for batch in batches:
        buf, off = text_buffer(batch.column(1))
        lists = batch.column(2).to_pylist()
        for x, y in row_chunks(off):
            row, pos, first, end, h, s, e = _lines(buf, off[x : y + 1])
            one = Ranges(h, _BASES[0])
            place_of = {(r, p): i for i, (r, p) in enumerate(zip(row.tolist(), pos.tolist(), strict=True))}
            rows, at, keys, places, norms = [], [], [], [], []
            base = int(off[x])
            for r in range(x, y):
                for near in lists[r]:
                    i = place_of[r - x, near["pos"]]
                    a, b = int(first[i]), int(end[i])
                    n = b - a
                    lo, hi = ((n - 1) // 2 if near["head"] and not near["tail"] else 0), ((n + 1) // 2 if near["tail"] and not near["head"] else n)
                    q = np.arange(a + lo, a + hi)
                    # The hash of the line without word q: the part after it moves one place down.
                    sums, back = one.sums, one.back
                    gone = mix(((sums[q] - sums[a]) + (sums[b] - sums[q + 1]) * np.uint64(pow(_BASES[0], -1, 1 << 64))) * back[a] + np.uint64(n - 1))
                    keys.append(np.concatenate([one.of(np.array([a]), np.array([b])), gone]))
                    places.append(np.concatenate([[-1], q - a]))
                    rows.append(np.full(len(q) + 1, r))
                    at.append(np.full(len(q) + 1, near["pos"]))
                    words = _LOWER[buf[base + s[a] : base + e[b - 1]]].tobytes().split()
                    norms += [b" ".join(words).decode(), *[None] * len(q)]
            if keys:
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(at), pa.int32()), pa.array(np.concatenate(keys).view(np.int64)),
                    pa.array(np.concatenate(places), pa.int32()), pa.array(norms, pa.string()),
                ], names=["doc", "pos", "key", "place", "norm"])


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by one word edit at most."""
    n, m = F.size(a), F.size(b)
    short, long = F.least(n, m), F.greatest(n, m)
    pairs = F.arrays_zip(F.slice(a, 1, short).alias("x"), F.slice(b, 1, short).alias("y"))
    same = F.aggregate(pairs, F.struct(F.lit(True).alias("on"), F.lit(0).alias("k")), lambda s, p: F.struct((s["on"] & (p["x"] == p["y"])).alias("on"), (s["k"] + (s["on"] & (p["x"] == p["y"])).cast("int")).alias("k")))["k"]
    rest_a, rest_b = F.slice(a, same + 1 + F.when(n < m, 0).otherwise(1), n), F.slice(b, same + 1 + F.when(n > m, 0).otherwise(1), m)
    return (long - short <= 1) & F.when(same == long, True).otherwise(rest_a == rest_b)


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """(doc, pos) of every line to remove, and the paths of the tables that this reads."""
    spark = docs.sparkSession
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = texts.schema["doc"].dataType.simpleString()
    halves = ("f1", "f2", "s1", "s2")
    # One row a line: two halves of its hash, and where it is long enough the hashes of its halves.
    occurrences, p1 = materialize(texts.mapInArrow(_line_rows(min_words), f"doc {kind}, pos int, a long, b long, f1 long, f2 long, s1 long, s2 long"), "lines")
    me = F.struct("doc", "pos")
    distinct, p2 = materialize(occurrences.groupBy("a", "b").agg(F.min(me).alias("first"), *[F.max(k).alias(k) for k in halves]), "lines-distinct")

    parts = distinct.select("first", F.explode(F.array_compact(F.array_distinct(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.col(k).alias("half"), F.lit(k[0]).alias("side"))) for k in halves])))).alias("h"))
    parts = parts.select("first", "h.half", "h.side")
    shared = parts.groupBy("half", "side").agg(F.count("*").alias("c")).filter("c > 1").select("half", "side")
    near = parts.join(shared, ["half", "side"], "left_semi").groupBy("first.doc", "first.pos").agg(F.max(F.col("side") == "f").alias("head"), F.max(F.col("side") == "s").alias("tail"))
    by_doc = near.groupBy("doc").agg(F.collect_list(F.struct("pos", "head", "tail")).alias("near"))
    wanted = texts.join(by_doc, "doc").select("doc", "text", "near")

    rows, p3 = materialize(wanted.mapInArrow(_variant_rows, f"doc {kind}, pos int, key long, place int, norm string"), "lines-variants")
    whole = rows.filter("place = -1").select("doc", "pos", "key", "norm")
    gaps = rows.filter("place >= 0").select("doc", "pos", "key", "place")
    # (1) the earliest line with the same variant at the same place
    # Written, so that the join may split a variant of very many lines over several tasks.
    low, p4 = materialize(gaps.groupBy("key", "place").agg(F.min(me).alias("low"), F.count("*").alias("c")).filter("c > 1").drop("c"), "lines-low")
    swapped = gaps.join(low, ["key", "place"]).select("doc", "pos", "low")
    # (2) whole lines against variants of lines that are one word longer, both ways
    met = gaps.join(whole.select("key", me.alias("w")), "key").select(me.alias("g"), "w")
    longer = met.select("g.doc", "g.pos", F.col("w").alias("low"))
    shorter = met.groupBy("w").agg(F.min("g").alias("low")).select("w.doc", "w.pos", "low")
    found = swapped.unionByName(shorter).unionByName(longer).filter(F.col("low") < me).distinct()
    a = whole.select("doc", "pos", F.split("norm", " ").alias("x"))
    b = whole.select(me.alias("low"), F.split("norm", " ").alias("y"))
    checked = found.join(a, ["doc", "pos"]).join(b, "low").filter(within_one_edit(F.col("x"), F.col("y")))
    gone = checked.select("doc", "pos").distinct().select(me.alias("first"), F.lit(True).alias("gone"))
    marked = distinct.select("a", "b", "first").join(gone, "first", "left")
    out = occurrences.select("doc", "pos", "a", "b").join(marked, ["a", "b"]).filter((me > F.col("first")) | F.col("gone")).select("doc", "pos")
    table, kept = materialize(out, "lines-removed")
    discard(spark, p1, p2, p3, p4)
    return table, [kept]


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the column text_col without repeated lines, and with _n_lines and _n_removed.

    Lines end at \\n and keep their order; a text all of whose lines go becomes empty, a null text stays null. Lines of
    white space never go. Rows that share an id count as one document whose lines are judged by position. Lines under a
    null id come first in the order and never go. Columns of `docs` named _n_lines or _n_removed are replaced; other
    columns stay as they are, whatever their names.
    """
    docs = docs.drop("_n_lines", "_n_removed")
    gone, _ = removed_lines(docs, min_words, id_col, text_col)
    doc, places = fresh(docs, "_doc", "_places")
    by_doc = gone.groupBy("doc").agg(F.collect_set("pos").alias(places)).withColumnRenamed("doc", doc)
    joined = docs.join(by_doc, docs[id_col] == by_doc[doc], "left").drop(doc)
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, n, k = [], [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                lines = text.split("\n") if text is not None else []
                n.append(len(lines))
                if gone and text is not None:
                    out = set(gone)
                    lines = [x for i, x in enumerate(lines) if i not in out]
                    text = "\n".join(lines)
                k.append(n[-1] - len(lines))
                texts.append(text)
            columns = [pa.array(texts, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(k, pa.int64())], names=[*names, "_n_lines", "_n_removed"])

    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_n_lines", T.LongType()), T.StructField("_n_removed", T.LongType())]))
