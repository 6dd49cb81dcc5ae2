"""Language identification with a byte convolutional network, trained and applied in numpy.

Texts are cut into overlapping windows of WINDOW bytes. Each byte has a small vector; filters of several widths run
over them, each filter keeps its maximum in the window, and a softmax over the kept values gives the language. A
document's score is the softmax of its windows' mean log-probabilities, weighted by their bytes, so every byte counts.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlake.llm.common import discard, materialize, row_chunks, text_buffer

WINDOW, VECTOR, FILTERS, WIDTHS = 256, 8, 16, (2, 3, 5)
WIDE = max(WIDTHS)
STRIDE = WINDOW - WIDE + 1
PAD = 256
#: Bounds on the labelled sample: rows of a language, rows, and windows over all of them. Chosen texts are read whole; one
#: that would pass the bound on windows is left out of the sample.
PER_LANGUAGE, MAX_ROWS, MAX_WINDOWS = 400, 20_000, 12_000

_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(257, dtype=np.int16)
_FOLD[65:91] += 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def windows_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window x WINDOW byte codes, row of each window, its own bytes); an empty row has one window of padding."""
    size = np.diff(off)
    count = np.maximum(1, -(-np.maximum(size - (WIDE - 1), 1) // STRIDE))
    row = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = off[row] + k * STRIDE
    weight = np.minimum(off[row + 1] - start, WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < weight[:, None]
    codes = np.full(at.shape, PAD, np.int16)  # bytes can't hold PAD
    if len(buf):
        codes[inside] = buf[at[inside]]
    return _FOLD[codes], row, weight


class ByteConvNet:
    """Byte vectors, filters of WIDTHS in one kernel of the widest, max pooling and a softmax layer."""

    def __init__(self, langs: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.langs = langs
        self.mask = np.zeros((WIDE, VECTOR, n), np.float32)
        for j, w in enumerate(WIDTHS):
            self.mask[:w, :, j * FILTERS : (j + 1) * FILTERS] = 1
        self.p = {
            "vec": rng.normal(0, 0.5, (257, VECTOR)).astype(np.float32),
            "conv": (rng.normal(0, 0.3, (WIDE, VECTOR, n)) * self.mask).astype(np.float32),
            "bias": np.zeros(n, np.float32),
            "out": rng.normal(0, 0.1, (n, len(langs))).astype(np.float32),
            "base": np.zeros(len(langs), np.float32),
        }
        self.p["vec"][PAD] = 0

    def pooled(self, codes: np.ndarray, with_at: bool = False):
        p = self.p
        x = p["vec"][codes]
        view = np.lib.stride_tricks.sliding_window_view(x.reshape(len(codes), -1), WIDE * VECTOR, axis=1)[:, ::VECTOR]
        z = (view.reshape(-1, WIDE * VECTOR) @ p["conv"].reshape(WIDE * VECTOR, -1)).reshape(len(codes), STRIDE, -1)
        if not with_at:
            return np.tanh(z.max(1) + p["bias"])
        at = z.argmax(1)
        return np.tanh(np.take_along_axis(z, at[:, None], 1)[:, 0] + p["bias"]), at

    def log_probs(self, h: np.ndarray) -> np.ndarray:
        s = h @ self.p["out"] + self.p["base"]
        s -= s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True))

    def gradients(self, c: np.ndarray, y: np.ndarray, gain: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy weighted by `gain` of the language; the pooled maximum's goes to the position that gave it."""
        p = self.p
        h, at = self.pooled(c, True)
        d = np.exp(self.log_probs(h))
        d[np.arange(len(y)), y] -= 1
        d *= gain[y][:, None] / len(y)
        dz = (d @ p["out"].T) * (1 - h * h)
        near = at[:, :, None] + np.arange(WIDE)  # batch x filter x WIDE
        seen = c[np.arange(len(c))[:, None, None], near]
        g = {"out": h.T @ d, "base": d.sum(0), "bias": dz.sum(0)}
        g["conv"] = np.einsum("bf,bfwv->wvf", dz, p["vec"][seen]) * self.mask
        g["vec"] = np.zeros_like(p["vec"])
        np.add.at(g["vec"], seen.ravel(), np.einsum("bf,wvf->bfwv", dz, p["conv"]).reshape(-1, VECTOR))
        g["vec"][PAD] = 0
        return g

    def train(self, codes: np.ndarray, target: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> None:
        """Adam on the cross-entropy."""
        rng, p = np.random.default_rng(seed), self.p
        m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        share = np.bincount(target, minlength=len(self.langs)) / len(target)
        gain = (1 / np.maximum(share, 1e-9) / len(self.langs)).astype(np.float32)
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for a in range(0, len(order), batch):
                c, y = codes[order[a : a + batch]], target[order[a : a + batch]]
                g = self.gradients(c, y, gain)
                t += 1
                for k in p:
                    m1[k] += 0.1 * (g[k] - m1[k])
                    m2[k] += 0.001 * (g[k] ** 2 - m2[k])
                    p[k] -= rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)

    def predict(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language, its probability) for each row."""
        total = np.zeros((len(off) - 1, len(self.langs)))
        for a, b in row_chunks(off, 1 << 16):
            codes, row, weight = windows_of(buf, off[a : b + 1])
            for i in range(0, len(codes), 512):
                lp = self.log_probs(self.pooled(codes[i : i + 512]))
                np.add.at(total, a + row[i : i + 512], lp * np.maximum(weight[i : i + 512], 1)[:, None])
        mean = total / np.maximum(np.diff(off), 1)[:, None]
        e = np.exp(mean - mean.max(1, keepdims=True))
        best = e.argmax(1)
        return best, e[np.arange(len(e)), best] / e.sum(1)


def training_rows(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, max_rows: int, max_windows: int) -> list:
    """(lang, text) of at most `max_rows` labelled rows with `max_windows` windows at most, at most `per_language` of each
    language, chosen by a hash of the id. Rows without an id, a label or a text are not chosen."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (F.length(text_col) > 0))
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.greatest(F.lit(1), F.ceil(F.octet_length(text_col) / STRIDE)).alias("n"))
    order = (F.xxhash64("id", F.lit("language")), "id", "n")
    # A hash leaves about twice the rows wanted of each language, however many it has; the first of these are ranked, and
    # texts are fetched for the chosen alone.
    counts, path = materialize(rows.groupBy("lang").agg(F.count("*").alias("c")), "language-counts")
    unit = F.pmod(F.xxhash64("id", F.lit("share")), F.lit(1 << 30)) / float(1 << 30)
    some = rows.select("id", "lang", "n").join(counts, "lang").filter(unit * F.col("c") < 2 * per_language + 20).drop("c")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    room, chosen = max_windows, []
    for r in ranked.filter(F.col("rank") <= per_language).orderBy("rank", "lang").limit(max_rows).collect():
        if r["n"] <= room:
            room -= r["n"]
            chosen.append((r["id"], r["lang"], r["n"]))
    discard(labelled.sparkSession, path)
    if not chosen:
        return []
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    picked = labelled.sparkSession.createDataFrame(chosen, f"id {kinds['id']}, lang {kinds['lang']}, n {kinds['n']}").distinct()
    found = rows.join(F.broadcast(picked), ["id", "lang", "n"]).orderBy(*order, "lang", "text").limit(len(chosen))
    return found.select("lang", "text").collect()


def fit(rows: list) -> ByteConvNet | None:
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    data = [r["text"].encode() for r in rows]
    off = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    codes, row, weight = windows_of(np.frombuffer(b"".join(data), np.uint8), off)
    good = weight >= min(16, int(weight.max()))
    target = np.array([langs.index(r["lang"]) for r in rows])[row]
    net = ByteConvNet(langs)
    if len(langs) > 1:
        net.train(codes[good], target[good])
    return net


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Language of each whole text by a network trained on a bounded sample of `labelled`.

    Returns id_col, lang_pred, score (0 to 1). A text that is null or has no letter gives `und` with score 1; without
    any labelled row every text is `und` with score 0. Equal texts give equal predictions up to float rounding.
    Repeated rows give repeated rows, null ids stay null, very long texts are read whole, window by window; other columns of
    `docs` are not read, and an empty table gives an empty result.
    """
    net = fit(training_rows(labelled, id_col, text_col, lang_col, per_language, max_rows, max_windows))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        net = shared.value
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            n = batch.num_rows
            if net is None or not n:
                lang, score = ["und"] * n, np.zeros(n)
            else:
                best, score = net.predict(buf, off)
                letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[buf[off[0] : off[-1]]])])
                plain = letters[off[1:] - off[0]] > letters[off[:-1] - off[0]]
                known = [bool(p) or bool(_LETTER.search(bytes(buf[a:b]).decode())) for p, a, b in zip(plain, off[:-1], off[1:], strict=True)]
                lang = [net.langs[i] if k else "und" for i, k in zip(best, known, strict=True)]
                score = np.where(known, score, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, lang_pred string, score double")
