"""Plain versions of operators and stages, in lists and loops."""

import math
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mixed(docs, tokens, repetition_limit=None, entropy=None, budget=None, seed=11):
    """{(id, text, source): copies}: rows of a source in the order of their blocks, the partial pass ends where the budget does."""
    # Blocks and their order as hashes of SQL: a block is one of 1024, its place its own hash.
    block = lambda *of: f"CAST(pmod(xxhash64({', '.join(of)}), 1024L) AS INT)"
    b, i = block("doc_id", str(seed)), block("doc_id", "'inner'", str(seed + 1))
    rows = docs.selectExpr("doc_id", "text", "source", f"struct(xxhash64({b}, {seed}), {b}) AS a", f"struct(xxhash64({i}, {seed + 1}), {i}) AS i", f"xxhash64({seed}, doc_id) AS h", "xxhash64(text) AS t").collect()
    total = {}
    for r in rows:
        total[r["source"]] = total.get(r["source"], 0) + tokens(r["text"])
    live = {s: n for s, n in total.items() if n}
    whole = sum(live.values())
    if entropy is not None:

        def gap(a):
            w = np.array([(n / whole) ** a for n in live.values()])
            w /= w.sum()
            return float(-(w * np.log(w)).sum())

        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if gap(mid) >= entropy else (low, mid)
        a = 0.0 if gap(0.0) < entropy else 1.0 if gap(1.0) >= entropy else low
    else:
        ratio = max(live.values()) / min(live.values()) if live else 1
        a = 1.0 if ratio <= 1 else min(1.0, max(0.0, 1 - math.log(repetition_limit) / math.log(ratio)))
    z = sum((n / whole) ** a for n in live.values())
    weight = {s: (n / whole) ** a / z for s, n in live.items()}
    if budget is None:
        budget_tokens = max((n / weight[s] for s, n in live.items()), default=0)
    else:
        budget_tokens = budget
    out = {}
    for s, n in total.items():
        quota = round(budget_tokens * weight.get(s, 0) * (1 + 1e-12), 3)
        passes, rest = (math.floor(quota / n), math.floor(quota - math.floor(quota / n) * n)) if n else (1 if budget is None else 0, 0)
        mine = sorted((r for r in rows if r["source"] == s), key=lambda r: (tuple(r["a"]), tuple(r["i"]), r["h"], r["doc_id"] is not None, r["doc_id"] or 0, r["t"]))
        upto = 0
        for k, r in enumerate(mine):
            ties = [x for x in mine[k:] if (x["doc_id"], x["text"]) == (r["doc_id"], r["text"])]
            m = tokens(r["text"])
            key = (r["doc_id"], r["text"], s)
            if key not in out:
                out[key] = passes + (1 if m and upto + m * len(ties) <= rest else 0)
            upto += m
    return out, weight


def line_score(model, text):
    """Score of one text: features of each line on its own, forward and backward line by line."""
    from pactlake.llm import quality_crf as crf

    data = (text or "").encode()
    lines = data.split(b"\n")
    lines = [*(x + b"\n" for x in lines[:-1]), *([lines[-1]] if lines[-1] or len(lines) == 1 else [])]
    x = [crf.features(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0].astype(float) for b in lines]
    none = np.zeros(crf.FEATURES)
    gain = [float(np.concatenate([x[i], x[i - 1] if i else none, x[i + 1] if i + 1 < len(x) else none, [1.0]]) @ model.w) for i in range(len(x))]
    emit, move = [np.array([1.0, math.exp(min(30, max(-30, g)))]) for g in gain], np.exp(np.clip(model.trans, -8, 8))
    fwd, bwd = [emit[0] / emit[0].sum()], [np.ones(2)]
    for e in emit[1:]:
        v = (fwd[-1] @ move) * e
        fwd.append(v / v.sum())
    for e in emit[:0:-1]:
        v = move @ (e * bwd[-1])
        bwd.append(v / v.sum())
    p = [f * b for f, b in zip(fwd, bwd[::-1])]
    weight = [max(len(b), 1) for b in lines]
    share = sum(w * v[1] / v.sum() for w, v in zip(weight, p)) / sum(weight)
    return 1 / (1 + math.exp(-(model.map[0] * share + model.map[1])))


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())


def components(sets):
    """Smallest id reachable by links of 3/4, for each id of {id: set}."""
    low = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low
