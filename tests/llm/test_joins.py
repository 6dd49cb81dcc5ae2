import hashlib
import random
import re

import numpy as np

from pactlake.llm import embedding_dedup, jaccard_join, mixing, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components_of(ids, linked):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        at = rng.randrange(len(w))
        w[at] = rng.choice("pqrst") + str(rng.randrange(99))
    return w


def family(rng, count):
    out = []
    for _ in range(count):
        base = ["w" + str(rng.randrange(400)) for _ in range(rng.choice([3, 6, 9, 20, 60, 200]))]
        out += [" ".join(edited(rng, base, rng.randint(0, max(1, len(base) // 30)))) for _ in range(rng.randint(1, 6))]
    return out


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(2)
    texts = family(rng, 60) + ["", None, "  ", "One two", "ONE TWO", "a b c d e", "a b c d e f"]
    hot = " ".join("h" + str(i) for i in range(80)).split()
    texts += [" ".join(edited(rng, hot, i % 2)) for i in range(120)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, n_shingles int")
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    low = components_of(sets, linked)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == {i: (len(s), low[i]) for i, s in sets.items()}
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in sets if low[i] == i}


def test_jaccard_edges(spark):
    schema = "doc_id long, text string"
    assert jaccard_join.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (7, None), (9, "z " * 30000)]
    got = sorted(tuple(r) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 3, 1), (1, 3, 1), (7, 0, 7), (9, 1, 9)]


def test_substrings_equal_brute_force(spark):
    rng = random.Random(6)
    passages = [["p" + str(rng.randrange(500)) for _ in range(rng.randint(11, 70))] for _ in range(15)]
    rows = []
    for d in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(passages) if rng.random() < 0.5 else ["u" + str(rng.randrange(10**6)) for _ in range(rng.randint(0, 30))]
        rows.append((d, rng.choice([" ", "\n", "  "]).join(w), 3))
    rows += [(200, None, 3), (201, "", 3), (202, "same " * 40, 3), (203, "same " * 40, 3)]
    words = {d: WORD.findall(t or "") for d, t, _ in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][i : i + 13]), d)
    want = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in substring_dedup.dedup_substrings(docs, with_text=True).collect()}
    assert got == want
    assert sum(n for _, n, *_ in want.values()) > 500
    assert substring_dedup.dedup_substrings(docs.limit(0)).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for label in (0, 1, None):
        for c in rng.normal(size=(25, 16)):
            for _ in range(int(rng.integers(1, 7))):
                rows.append((len(rows), [float(x) for x in c + rng.normal(size=16) * 0.12], label, "x"))
    hot = rng.normal(size=16)
    rows += [(len(rows) + i, [float(x) for x in hot * (1 + i % 3)], 1, "x") for i in range(150)]
    n = len(rows)
    rows += [(n, None, 1, "x"), (n + 1, [0.0] * 16, 1, "x"), (n + 2, [float("nan")] * 16, 1, "x"), (n + 3, [None, 1.0] * 8, 1, "x"), (n + 4, [], 1, "x")]
    unit = {i: np.array(v, np.float32).astype(float) for i, v, lab, _ in rows if lab is not None and i < n}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    label = {r[0]: r[2] for r in rows}
    linked = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and unit[a] @ unit[b] >= 0.98]
    low = components_of([r[0] for r in rows], linked)
    links = {r[0]: 0 for r in rows}
    for a, b in linked:
        links[a] += 1
        links[b] += 1
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(docs).collect()}
    assert len([x for x in linked if max(x) < n - 150]) > 50
    assert got == {i: (links[i], low[i], low[i] == i) for i in links}
    assert embedding_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_mixing_meets_its_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 10 else "small", 4) for i in range(4000)] + [(9001, None, None, 4), (9002, "", "big", 4), (9002, "", "big", 4), (9003, "w w", None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight int")
    got = mixing.copies(docs, repetition_limit=2.0).collect()
    assert len(got) == len(rows)
    tokens, made = {}, {}
    for r in got:
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["_n_tokens"]
        made[r["source"]] = made.get(r["source"], 0) + r["_n_tokens"] * r["_copies"]
    passes = {s: made[s] / tokens[s] for s in tokens}
    assert min(passes.values()) >= 1 and max(passes.values()) <= 2.0 + 1e-9
    assert passes["big"] == 1
    total = sum(r["_copies"] for r in got)
    mixed = mixing.realise(docs, repetition_limit=2.0)
    assert mixed.columns == docs.columns and mixed.count() == total
    small = {r["source"]: r["_weight"] for r in mixing.copies(docs, entropy=0.6).collect()}
    assert abs(sum(small.values()) - 1) < 1e-9
    assert -sum(w * np.log(w) for w in small.values() if w) >= 0.6 - 1e-6
    assert mixing.copies(docs.limit(0)).count() == 0
