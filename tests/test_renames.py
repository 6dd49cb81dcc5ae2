"""Whole rename outputs of the registered queries against loops over the same rows."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from pactlake import catalog
from pactlake.operators import diff
from pactlake.plans import contract_views

DIR = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a, b):
    return 1 - distance(a, b) / max(len(a), len(b)) if a or b else 1.0


def related(a, b):
    x, y = sorted((re.sub("[^a-zA-Z0-9]", "", s).lower() for s in (a, b)), key=len)
    return bool(x) and (x == y or len(y) - len(x) <= 8 and (y.startswith(x) or y.endswith(x)) or similarity(x, y) >= 0.7)


def first_fit(found):
    """found: (score, from, to, conf) of one block."""
    left, right, out = set(), set(), []
    for s, f, t, c in sorted(found, key=lambda r: (-r[0], r[1], r[2])):
        if f not in left and t not in right:
            left.add(f)
            right.add(t)
            out.append((f, t, c))
    return out


def siblings(spark, part):
    """(renames, removed without one, added without one) of fields or params."""
    key = (lambda r: (r["op"], r["direction"], r["pointer"])) if part == "fields" else (lambda r: (r["op"], r["location"], r["name"]))
    cls = (lambda r: (r["op"], r["direction"], r["parent"], r["schema_fp"])) if part == "fields" else (lambda r: (r["op"], r["location"], r["type"]))
    old, new = (contract_views.view(spark, DIR, f"{part}_{s}").collect() for s in ("old", "new"))
    gone, come = {key(r) for r in old} - {key(r) for r in new}, {key(r) for r in new} - {key(r) for r in old}
    sides = defaultdict(lambda: ([], []))
    for r in old:
        if key(r) in gone:
            sides[cls(r)][0].append(r)
    for r in new:
        if key(r) in come:
            sides[cls(r)][1].append(r)
    renames, removed, added = [], [], []
    for a, b in sides.values():
        if len(a) == len(b) == 1:
            pairs = [(a[0]["ord"], b[0]["ord"], "high")]
        else:
            pairs = first_fit([(1, x["ord"], y["ord"], "medium") for x in a for y in b if related(x["name"], y["name"])])
        x, y = {r["ord"]: r for r in a}, {r["ord"]: r for r in b}
        renames += [(x.pop(f), y.pop(t), c) for f, t, c in pairs]
        removed += x.values()
        added += y.values()
    return renames, removed, added


def contexts(spark):
    return {r["op"]: r["path"] for r in contract_views.view(spark, DIR, "contexts").collect()}


def of(spark, name, *cols):
    return Counter(tuple(r) for r in catalog.queries()[name](spark, DIR).select(*cols).collect())


@pytest.mark.parametrize("part", ["fields", "params"])
def test_what_no_rename_claims(spark, part):
    _, removed, added = siblings(spark, part)
    paths, name = contexts(spark), "pointer" if part == "fields" else "name"
    assert of(spark, f"{part}_removed_all", "path", "from_name") == Counter((paths[r["op"]], r[name]) for r in removed if r["op"] in paths)
    want = Counter((paths[r["op"]], r[name]) for r in added if r["op"] in paths and r["required"] and (part == "params" or r["direction"] == "request"))
    assert of(spark, f"{part}_added_required_all", "path", "to_name") == want
    assert want.total() > of(spark, f"{part}_added_required", "path", "to_name").total()


def test_parameter_renames_of_all_confidences(spark):
    renames, _, _ = siblings(spark, "params")
    want = Counter((a["op"], a["location"], a["name"], b["name"], c) for a, b, c in renames)
    assert of(spark, "param_rename_all", "op", "location", "from_n", "to_n", "confidence") == want
    assert {c for *_, c in want} == {"high", "medium"}


def operations(spark):
    """Chosen operation renames: (removed, added, confidence)."""
    old, new = (catalog._shapes(spark, DIR, f"ops_{s}").collect() for s in ("old", "new"))
    r = [x for x in old if x["op_key"] not in {y["op_key"] for y in new}]
    a = [x for x in new if x["op_key"] not in {y["op_key"] for y in old}]
    shape = lambda p: re.sub(r"\{[^}]*\}", "{}", p)
    jaccard = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    found = defaultdict(list)
    for x, y in itertools.product(r, a):
        if x["method"] != y["method"]:
            continue
        close = similarity(shape(x["path"]), shape(y["path"]))
        alike = (jaccard(x["request"], y["request"]) + jaccard(x["response"], y["response"])) / 2
        if x["operation_id"] and x["operation_id"] == y["operation_id"]:
            found[x["method"]].append((2 + close, x["ord"], y["ord"], "high"))
        elif close >= 0.5 and alike >= 0.6:
            found[x["method"]].append((close + alike, x["ord"], y["ord"], "medium"))
    r, a = {x["ord"]: x for x in r}, {x["ord"]: x for x in a}
    return [(r[f], a[t], c) for rows in found.values() for f, t, c in first_fit(rows)]


def test_path_renames_are_whole(spark):
    groups = defaultdict(list)
    for x, y, c in operations(spark):
        if x["path"] != y["path"]:
            groups[x["path"], y["path"]].append((x["ord"], x["method"], c))
    want = Counter((f, t, "medium" if any(c == "medium" for *_, c in g) else "high", g[0][1] if len(g) == 1 else None) for (f, t), g in groups.items())
    assert of(spark, "path_rename_all", "from_name", "to_name", "confidence", "method") == want
    assert len(want) > 3


def breaks(a, b):
    """Whether a type change breaks: another base, or a format that is more than a number's width."""
    split = lambda t: t.split(":", 1) if ":" in t and not ("<" in t and t.index("<") < t.index(":")) else (t, None)
    (x, f), (y, g) = split(a), split(b)
    widths = (None, "int32", "int64", "float", "double")
    return x != y or (f is not None and g is not None and f != g if f in widths and g in widths else True)


def test_field_diff_is_whole(spark):
    """Every field change of every confidence, cascades folded, against loops."""
    old, new = (contract_views.view(spark, DIR, f"fields_{s}").collect() for s in ("old", "new"))
    ctx = {r["op"]: r for r in contract_views.view(spark, DIR, "contexts").collect()}
    ranks = ("low", "medium", "high")
    key = lambda r: (r["op"], r["direction"], r["pointer"])
    after, found = {key(r): r for r in new}, defaultdict(list)

    def add(r, kind, breaking, detail, a, b, cap="high"):
        if r["op"] in ctx:
            conf = ranks[min(ctx[r["op"]]["rank"], ranks.index(cap))]
            found[r["op"], r["direction"]].append((kind, breaking, detail, a, b, conf))

    for r in old:
        n, d, p = after.get(key(r)), r["direction"], r["pointer"]
        if n and r["type"] != n["type"]:
            add(r, f"{d}.field.type.changed", breaks(r["type"], n["type"]), f"{d} field {p} changed from {r['type']} to {n['type']}", p, p)
        if n and d == "request" and n["required"] and not r["required"]:
            add(r, "request.field.became.required", True, f"request field {p} is now required", p, p)
    renames, removed, added = siblings(spark, "fields")
    for a, b, c in renames:
        add(a, f"{a['direction']}.field.renamed", True, f"{a['direction']} field {a['pointer']} renamed to {b['pointer']}", a["pointer"], b["pointer"], c)
    for r in removed:
        add(r, f"{r['direction']}.field.removed", r["direction"] == "response" or r["required"], f"{r['direction']} field {r['pointer']} removed", r["pointer"], None)
    for r in added:
        if r["direction"] == "request" and r["required"]:
            add(r, "request.field.added.required", True, f"new required request field {r['pointer']} ({r['type']})", None, r["pointer"])

    want, hidden = Counter(), 0
    for (op, direction), rows in found.items():
        casts = {a for k, _, _, a, _, _ in rows if k.endswith((".type.changed", ".field.removed"))}
        shadow = lambda a: next((a[:i] for i in range(1, len(a)) if (a[i] == "." or a[i : i + 2] == "[]") and a[:i] in casts), None) if a else None  # noqa: B023, E731
        below = Counter(shadow(a) for *_, a, _, _ in rows)
        for kind, breaking, detail, a, b, conf in rows:
            if shadow(a) is None:
                n = below[a] if a else 0
                text = detail + (f", along with {n} nested fields below it" if n else "")
                want[ctx[op]["path"], direction, kind, breaking, text, a, b, conf] += 1
            else:
                hidden += 1
    assert of(spark, "field_diff", "path", "direction", "kind", "breaking", "detail", "from_name", "to_name", "confidence") == want
    assert hidden > 10 and {k[-1] for k in want} == set(ranks) and len({k[2] for k in want}) == 8


def test_field_renames_of_larger_classes(spark):
    renames, _, _ = siblings(spark, "fields")
    want = Counter((a["op"], a["direction"], a["ord"], b["ord"]) for a, b, c in renames if c == "medium")
    assert of(spark, "field_rename_ambiguous", "op", "direction", "from_ord", "to_ord") == want and want


def test_classes_of_any_shape_are_paired_by_first_fit(spark):
    rng = random.Random(3)
    names = ["amount", "amount_total", "total_amount", "amt", "fee", "feeAmount", "note", "notes", "x"]
    schema = "pair_id string, op string, location string, name string, required boolean, type string, enum_values array<string>, ord int"
    old, new, want = [], [], Counter()
    for op in range(60):
        a, b = rng.sample(names, rng.randint(0, 5)), rng.sample(names, rng.randint(0, 5))
        a, b = [n + "1" for n in a], [n + "2" for n in b]
        old += [("p", str(op), "query", n, True, "string", None, i) for i, n in enumerate(a)]
        new += [("p", str(op), "query", n, True, "string", None, i) for i, n in enumerate(b)]
        pairs = [(0, 0, 2)] if len(a) == len(b) == 1 else first_fit([(1, i, j, 1) for i, x in enumerate(a) for j, y in enumerate(b) if related(x, y)])
        want.update((str(op), a[f], b[t], c) for f, t, c in pairs)
    found = diff.renames(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), diff.PARAM_KEYS, diff.PARAM_CLASS)
    assert Counter((r["op"], r["f"]["name"], r["t"]["name"], r["conf"]) for r in found.collect()) == want
    assert want.total() > 30
