"""Document quality by a linear-chain conditional random field over lines.

Each line has features of its bytes and words and of the lines before and after it. The chain labels every line good
or bad; forward-backward marginals, weighted by line length, give the document's share of good text, and a logistic
map fitted on the labelled documents turns that share into a score. Lines inherit their document's label in training.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.llm.common import row_chunks, text_buffer, word_hashes

#: Bounds on the labelled sample: documents, and lines over all of them. Chosen documents are read whole; one that would
#: pass the bound on lines is left out of the sample.
MAX_DOCS, MAX_LINES = 6000, 200_000
#: Lines and bytes whose features are held at once, and lines of one piece of a chain.
BLOCK_LINES, BLOCK_BYTES, PIECE = 1 << 14, 1 << 20, 256

_CLASS = np.full(256, 5, np.int64)  # control bytes and whatever is not named below
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[[32, 9]], _CLASS[128:] = 0, 1, 2, 3, 4
_PUNCT = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS[_PUNCT] = 6 + np.arange(len(_PUNCT))
CLASSES = 6 + len(_PUNCT)
FEATURES = CLASSES + 4


def lines_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of its first byte, row) of every line of consecutive rows; an empty row has one empty line."""
    edge = off - off[0]
    after = np.flatnonzero(buf[off[0] : off[-1]] == 10) + 1
    after = after[edge[np.searchsorted(edge, after)] != after]  # a break that ends its row begins no line
    row = np.concatenate([np.arange(len(edge) - 1), np.searchsorted(edge, after, "right") - 1])
    start = np.concatenate([edge[:-1], after])
    order = np.argsort(start, kind="stable")
    return off[0] + start[order], row[order]


def features(buf: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Features of consecutive lines; `edge` holds the first byte of each and the end of the last."""
    size = np.diff(edge)
    n = len(size)
    counts = np.zeros(n * CLASSES, np.int64)
    for a in range(int(edge[0]), int(edge[-1]), BLOCK_BYTES):  # a line may be longer than a block
        b = min(a + BLOCK_BYTES, int(edge[-1]))
        i, j = np.searchsorted(edge, [a, b - 1], "right") - 1
        line = np.repeat(np.arange(i, j + 1), np.minimum(edge[i + 1 : j + 2], b) - np.maximum(edge[i : j + 1], a))
        counts[i * CLASSES : (j + 1) * CLASSES] += np.bincount((line - i) * CLASSES + _CLASS[buf[a:b]], minlength=(j + 1 - i) * CLASSES)
    x = np.zeros((n, FEATURES), np.float32)
    x[:, :CLASSES] = np.sqrt(counts.reshape(n, CLASSES) / np.maximum(size, 1)[:, None])
    h, s, e, first = word_hashes(buf, edge, fold=False)
    if len(h):
        words = np.diff(first)
        at = np.repeat(np.arange(n), words)
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (at[1:] == at[:-1])
        x[:, CLASSES] = np.bincount(at, same, minlength=n) / np.maximum(words, 1)
        x[:, CLASSES + 1] = np.bincount(at, e - s, minlength=n) / np.maximum(words, 1) / 10
    x[:, CLASSES + 2] = np.log1p(size) / 8
    x[:, CLASSES + 3] = size <= 1
    return x


def line_blocks(edge: np.ndarray):
    """Ranges of lines of about BLOCK_BYTES and BLOCK_LINES at most."""
    for a, b in row_chunks(edge, BLOCK_BYTES):
        for i in range(a, b, BLOCK_LINES):
            yield i, min(i + BLOCK_LINES, b)


def line_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, row, byte length) of every line of consecutive rows."""
    start, row = lines_of(buf, off)
    edge = np.append(start, off[-1])
    x = np.concatenate([features(buf, edge[i : j + 1]) for i, j in line_blocks(edge)]) if len(start) else np.zeros((0, FEATURES), np.float32)
    return x, row, np.diff(edge)


def with_neighbours(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Features of the line, of the one before and of the one after it in its row, and a constant."""
    out = np.zeros((len(x), 3 * x.shape[1] + 1), np.float32)
    d = x.shape[1]
    out[:, :d] = x
    same = row[1:] == row[:-1]
    out[1:, d : 2 * d] = x[:-1] * same[:, None]
    out[:-1, 2 * d : 3 * d] = x[1:] * same[:, None]
    out[:, -1] = 1
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Each row's vector or matrix, scaled to sum 1."""
    return x / x.sum(tuple(range(1, x.ndim)), keepdims=True)


class Chains:
    """Chains of lines cut into pieces of PIECE lines, side by side: step t holds line t of every piece that has one.

    Products of transfer matrices within the pieces are made step by step for all pieces at once; then each piece takes
    over the state at its edge from its neighbour. So a chain of any length takes PIECE steps and one for each piece.
    """

    def __init__(self, row: np.ndarray) -> None:
        self.first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        size = np.diff(np.append(self.first, len(row)))
        count = -(-size // PIECE)
        self.place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)  # of a piece in its chain
        self.start = np.repeat(self.first, count) + self.place * PIECE
        self.end = np.minimum(self.start + PIECE, np.repeat(self.first + size, count))
        self.piece = np.repeat(np.arange(len(self.start)), self.end - self.start)
        length = self.end - self.start
        order = np.argsort(-length, kind="stable")
        self.steps = [self.start[order[: int(np.searchsorted(-length[order], -t, "left"))]] + t for t in range(int(length.max(initial=0)))]
        order = np.argsort(self.place, kind="stable")
        self.later = np.split(order, np.searchsorted(self.place[order], np.arange(1, int(self.place.max(initial=0)) + 1)))[1:]

    def marginals(self, gain: np.ndarray, trans: np.ndarray, pairs: bool = False):
        """P(good) of every line; with `pairs` also the pairwise marginals at the later line (0 at a chain's first)."""
        p, two, _ = self.run(gain, trans, None, None, pairs)
        return (p, two) if pairs else p

    def run(self, gain: np.ndarray, trans: np.ndarray, carry: np.ndarray | None, tail: np.ndarray | None, pairs: bool = False):
        """(marginals, pairwise marginals, transfer matrix of each piece).

        With `carry` and `tail` the lines are a stretch of one longer chain: the state before it and what follows it.
        """
        emit = np.stack([np.ones(len(gain)), np.exp(np.clip(gain, -30, 30))], 1)
        move = np.exp(np.clip(trans, -8, 8))
        g = move * emit[:, None, :]
        if carry is None:
            g[self.first] = emit[self.first][:, None, :]  # no transition into a chain's first line
        q, s = np.empty_like(g), np.empty_like(g)
        for t, at in enumerate(self.steps):
            q[at] = _unit(q[at - 1] @ g[at] if t else g[at])
        s[self.end - 1] = np.eye(2)
        for t in range(len(self.steps) - 1, 0, -1):
            at = self.steps[t]
            s[at - 1] = _unit(g[at] @ s[at])
        before, after = np.empty((len(self.start), 2)), np.empty((len(self.start), 2))
        before[:] = [1, 0] if carry is None else carry
        after[:] = 1 if tail is None else tail
        for i in self.later:
            before[i] = _unit(np.einsum("ni,nij->nj", before[i - 1], q[self.end[i - 1] - 1]))
        for i in reversed(self.later):
            a = self.start[i]
            after[i - 1] = _unit(np.einsum("nij,njk,nk->ni", g[a], s[a], after[i]))
        fwd = _unit(np.einsum("ni,nij->nj", before[self.piece], q))
        bwd = _unit(np.einsum("nij,nj->ni", s, after[self.piece]))
        p = fwd * bwd
        two = None
        if pairs:
            two = np.zeros_like(g)
            two[1:] = _unit(fwd[:-1, :, None] * move * (emit[1:] * bwd[1:])[:, None, :])
            two[self.first] = 0
        return p[:, 1] / p.sum(1), two, q[self.end - 1]


def long_marginals(gain: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(good) of every line of one long chain, a stretch of BLOCK_LINES at a time: states are carried over first."""
    parts = [(a, min(a + BLOCK_LINES, len(gain))) for a in range(0, len(gain), BLOCK_LINES)]
    chains = {n: Chains(np.zeros(n, np.int64)) for n in {b - a for a, b in parts}}
    start = np.array([1.0, 0.0])
    whole = []
    for a, b in parts:
        w = np.eye(2)
        for piece in chains[b - a].run(gain[a:b], trans, start if a else None, None)[2]:
            w = w @ piece
            w /= w.sum()
        whole.append(w)
    carry, tail = [None], [np.ones(2)]
    for w in whole[:-1]:
        c = (start if carry[-1] is None else carry[-1]) @ w
        carry.append(c / c.sum())
    for w in whole[:0:-1]:
        d = w @ tail[-1]
        tail.append(d / d.sum())
    return np.concatenate([chains[b - a].run(gain[a:b], trans, c, d)[0] for (a, b), c, d in zip(parts, carry, tail[::-1], strict=True)])


class QualityModel:
    """Weights of the chain and of the logistic map from good share to score."""

    def __init__(self) -> None:
        self.w = np.zeros(3 * FEATURES + 1)
        self.trans = np.zeros((2, 2))
        self.map = (8.0, -4.0)

    def train(self, x: np.ndarray, row: np.ndarray, size: np.ndarray, label: np.ndarray, rounds: int = 150, rate: float = 0.1, ridge: float = 1e-4) -> None:
        """Adam on the chains' log-likelihood, every row with the same weight. `label` is by row."""
        x = with_neighbours(x, row).astype(np.float64)
        y = label[row].astype(float)
        lines = np.bincount(row, minlength=len(label))
        weight = (1 / lines)[row] / len(label)
        chains = Chains(row)
        later = np.concatenate([[False], row[1:] == row[:-1]])
        seen = np.zeros((2, 2))
        for v in (0, 1):
            seen[v, v] = weight[later & (y == v)].sum()
        m1, m2 = np.zeros(len(self.w) + 4), np.zeros(len(self.w) + 4)
        for t in range(1, rounds + 1):
            p, two = chains.marginals(x @ self.w, self.trans, pairs=True)
            g = np.concatenate([x.T @ (weight * (y - p)) - ridge * self.w, (seen - (two * weight[:, None, None]).sum(0) - ridge * self.trans).ravel()])
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
            self.w += step[:-4]
            self.trans += step[-4:].reshape(2, 2)
        share = self.share(chains.marginals(x @ self.w, self.trans), row, size, len(label))
        a, b = 8.0, -4.0
        for _ in range(200):  # damped Newton steps on the logistic loss with a weak pull to the start
            s = 1 / (1 + np.exp(-np.clip(a * share + b, -30, 30)))
            r, c = s - label, s * (1 - s)
            grad = np.array([(r * share).mean() + 1e-3 * (a - 8), r.mean() + 1e-3 * (b + 4)])
            hess = np.array([[(c * share * share).mean() + 1e-3, (c * share).mean()], [(c * share).mean(), c.mean() + 1e-3]])
            d = np.linalg.solve(hess, grad)
            a, b = a - 0.5 * d[0], b - 0.5 * d[1]
        self.map = (float(a), float(b))

    @staticmethod
    def share(p: np.ndarray, row: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
        w = np.maximum(size, 1).astype(float)
        return np.bincount(row, w * p, minlength=n) / np.maximum(np.bincount(row, w, minlength=n), 1e-9)

    def good_lines(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(P(good), row, byte length) of every line; only a few numbers a line are held beyond one block."""
        start, row = lines_of(buf, off)
        edge = np.append(start, off[-1])
        part = np.empty((len(start), 3))
        for i, j in line_blocks(edge):
            part[i:j] = features(buf, edge[i : j + 1]) @ self.w[:-1].reshape(3, FEATURES).T
        gain = part[:, 0] + self.w[-1]
        same = row[1:] == row[:-1]
        gain[1:] += part[:-1, 1] * same
        gain[:-1] += part[1:, 2] * same
        p = np.empty(len(gain))
        first = np.searchsorted(row, np.arange(len(off)))
        for a, b in row_chunks(first, BLOCK_LINES):
            i, j = first[a], first[b]
            p[i:j] = long_marginals(gain[i:j], self.trans) if j - i > BLOCK_LINES else Chains(row[i:j]).marginals(gain[i:j], self.trans)
        return p, row, np.diff(edge)

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Score of each row, between 0 and 1."""
        out = np.empty(len(off) - 1)
        for a, b in row_chunks(off, BLOCK_BYTES):
            p, row, size = self.good_lines(buf, off[a : b + 1])
            out[a:b] = self.share(p, row, size, b - a)
        return 1 / (1 + np.exp(-np.clip(self.map[0] * out + self.map[1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> QualityModel:
    """Train on at most `max_docs` labelled rows, chosen by a hash of the id, with `max_lines` lines at most over all.

    Chosen texts are read whole; ids whose texts would pass the bound on lines are left out. Label 1 is good, 0 bad; rows
    with another label or a null text or id are not used. Where one of the labels is missing the model keeps its start
    values and scores every text 0.5. What is broadcast has `max_docs` rows of two numbers at most.
    """
    chosen = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("k", F.lit("quality")), "k", "y").limit(max_docs)
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "k").select("k", "y", "t")
    breaks = F.octet_length("t") - F.octet_length(F.replace("t", F.lit("\n"), F.lit("")))
    sizes = rows.groupBy("k").agg(F.sum(breaks + 1).alias("lines")).orderBy(F.xxhash64("k", F.lit("quality")), "k").collect()
    room, ids = max_lines, []
    for r in sizes:
        if r["lines"] <= room:
            room -= r["lines"]
            ids.append((r["k"],))
    model = QualityModel()
    model.map = (0.0, 0.0)
    if not ids:
        return model
    id_type = rows.schema["k"].dataType.simpleString()
    picked = rows.join(F.broadcast(docs.sparkSession.createDataFrame(ids, f"k {id_type}")), "k").select("k", "y", "t")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            buf, off = text_buffer(batch.column(2))
            found = [line_features(buf, off[i : i + 2]) for i in range(batch.num_rows)]
            lengths, feats = ([x[j].astype(kind).tobytes() for x in found] for j, kind in ((2, "<i8"), (0, "<f4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.binary()), pa.array(feats, pa.binary())], names=["k", "y", "sizes", "feats"])

    found = picked.mapInArrow(run, f"k {id_type}, y int, sizes binary, feats binary").orderBy("k", "y", "sizes", "feats").collect()
    label = np.array([r["y"] for r in found], float)
    if len(set(label.tolist())) == 2:
        size = [np.frombuffer(r["sizes"], "<i8") for r in found]
        x = np.concatenate([np.frombuffer(r["feats"], "<f4").reshape(-1, FEATURES) for r in found])
        model = QualityModel()
        model.train(x, np.repeat(np.arange(len(found)), [len(s) for s in size]), np.concatenate(size), label)
    return model


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score (0 to 1, higher: label 1 likelier), predicted (1 where score >= 0.5).

    A null text counts as empty: one empty line. A null id stays null; repeated rows give repeated rows; other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            s = shared.value.score(*text_buffer(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text scores 0.5 or more."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(shared.value.score(*text_buffer(batch.column(at))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
