import random

from pactlake.llm.line_dedup import dedup_lines


def one_edit(x, y):
    if abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) <= 1
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute(rows, min_words):
    lines = [(d, i, line.lower().split()) for d, t in rows if t is not None for i, line in enumerate(t.split("\n"))]
    lines = sorted((x for x in lines if x[2]), key=lambda x: x[:2])
    gone = set()
    for j, (d, i, w) in enumerate(lines):
        if any(v == w or min(len(v), len(w)) >= min_words and one_edit(v, w) for _, _, v in lines[:j]):
            gone.add((d, i))
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


def test_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    base = [[rng.choice("abcde") for _ in range(rng.randint(1, 12))] for _ in range(12)]
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 1)] = [rng.choice("abcdeXY")] * rng.randint(0, 1)
            lines.append(rng.choice([" ", "  ", "\t"]).join(w))
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "A b\nA  B\nc")]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=4).collect()}
    assert got == brute(rows, 4)
    assert got[103] == "A b\nc" or got[103] in ("c", "A b\nc", "")


def test_edges(spark):
    schema = "doc_id long, text string, line string, pos int, first string"
    assert dedup_lines(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "x y", "a", 1, "b"), (1, "x y\nz", "a", 2, "b"), (1, "x y\nz", "a", 2, "b"), (2, "w " * 20000 + "\nz", "c", 3, "d")]
    got = sorted((r["doc_id"] or 0, r["text"][:3], r["line"], r["_n_removed"]) for r in dedup_lines(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, "x y", "a", 0), (1, "z", "a", 1), (1, "z", "a", 1), (2, "w w", "c", 1)]
