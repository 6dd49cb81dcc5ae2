"""Registry of the engine's own queries and of the SQL that each must equal.

Queries run the operators over the driver's tables read as contracts (plans/contract_views.py). The oracle states the
same result in plain SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlake.functions import schema_types, text, urls, vendor
from pactlake.operators import artifacts, call_sites, cascade, changes, diff, edits, grouping, history, matching
from pactlake.plans import check_cycle, contract_diff, contract_views, fix, part_contracts, version_checks
from pactlake.sources.store import Store
from pactlake.sources.tables import table
from pactlake.streaming import checks
from pactlake.work import work_dir, written

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
V = contract_views.sql


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _view(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [contract_views.view(spark, sf_dir, n) for n in names]


# ---- text functions ----

_NORM = "lower(regexp_replace({}, '[^a-zA-Z0-9]', '', 'g'))"
_SIM = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 1.0 ELSE 1.0 - CAST(levenshtein({0}, {1}) AS DOUBLE) / greatest(length({0}), length({1})) END"


@query(f"SELECT p_partkey, {_NORM.format('p_name')} AS norm, {_NORM.format('p_brand')} AS brand FROM part")
def text_normalize_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_name("p_name").alias("norm"), text.normalize_name("p_brand").alias("brand"))


@query(f"SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(levenshtein(a.n_name, b.n_name) AS BIGINT) AS distance, round({_SIM.format('a.n_name', 'b.n_name')}, 9) AS similarity FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def text_levenshtein_similarity(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")), n.select("n_regionkey", F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"))
    return a.join(b, "n_regionkey").select("a", "b", F.levenshtein("x", "y").cast("long").alias("distance"), F.round(text.similarity("x", "y"), 9).alias("similarity"))


@query(f"""WITH d AS (SELECT DISTINCT p_name, p_brand FROM part), n AS (SELECT p_name, p_brand, {_NORM.format('p_name')} AS x, {_NORM.format("p_name || p_brand")} AS y, {_NORM.format("p_brand || '_id'")} AS z FROM d),
w AS (SELECT *, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS s, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS l, CASE WHEN length(x) <= length(z) THEN x ELSE z END AS s2, CASE WHEN length(x) <= length(z) THEN z ELSE x END AS l2 FROM n)
SELECT p_name, p_brand, length(s) > 0 AND (x = y OR (length(l) - length(s) <= 8 AND (starts_with(l, s) OR ends_with(l, s))) OR {_SIM.format('x', 'y')} >= 0.7) AS extended,
length(s2) > 0 AND (x = z OR (length(l2) - length(s2) <= 8 AND (starts_with(l2, s2) OR ends_with(l2, s2))) OR {_SIM.format('x', 'z')} >= 0.7) AS other FROM w""")
def text_names_related(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_name", "p_brand").distinct()
    return d.select("p_name", "p_brand", text.names_related("p_name", F.concat("p_name", "p_brand")).alias("extended"), text.names_related("p_name", F.concat("p_brand", F.lit("_id"))).alias("other"))


@query(f"""WITH o AS {V('ops_old')}, n AS {V('ops_new')}, j AS (SELECT o.ord, regexp_replace(o.path, '\\{{[^}}]*\\}}', '{{}}', 'g') AS a, regexp_replace(n.path, '\\{{[^}}]*\\}}', '{{}}', 'g') AS b FROM o JOIN n USING (ord))
SELECT ord, round({_SIM.format('a', 'b')}, 9) AS similarity FROM j""")
def text_path_similarity(spark, sf_dir):
    o, n = _view(spark, sf_dir, "ops_old", "ops_new")
    return o.select("ord", F.col("path").alias("a")).join(n.select("ord", F.col("path").alias("b")), "ord").select("ord", F.round(text.path_similarity("a", "b"), 9).alias("similarity"))


@query(f"SELECT op, ord, pointer, nullif(replace(list_extract(string_split(pointer, '.'), -1), '[]', ''), '') AS leaf FROM {V('fields_old')} f")
def text_pointer_leaf(spark, sf_dir):
    (f,) = _view(spark, sf_dir, "fields_old")
    return f.select("op", "ord", "pointer", text.leaf_of("pointer").alias("leaf"))


@query(f"SELECT op_key, upper(method) || ' ' || path AS label FROM {V('ops_old')} o")
def endpoint_label(spark, sf_dir):
    (o,) = _view(spark, sf_dir, "ops_old")
    return o.select("op_key", text.endpoint_label("method", "path").alias("label"))


@query("WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '...' ELSE t END AS snippet FROM d")
def snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet("text").alias("snippet"))


@query(f"SELECT ord, lower(regexp_replace(method || 'Part' || CAST(ord AS STRING) || 'ById', '([A-Z])', '_\\1', 'g')) AS snake FROM {V('ops_old')} o")
def text_snake_case(spark, sf_dir):
    (o,) = _view(spark, sf_dir, "ops_old")
    return o.select("ord", text.snake_case(F.concat("method", F.lit("Part"), F.col("ord").cast("string"), F.lit("ById"))).alias("snake"))


@query(f"SELECT op_key, substr(sha1('operation.removed|' || method || '|' || path || '|||' || coalesce(operation_id, '') || '||'), 1, 10) AS id FROM {V('ops_old')} o")
def change_id(spark, sf_dir):
    (o,) = _view(spark, sf_dir, "ops_old")
    none = F.lit(None).cast("string")
    return o.select("op_key", text.change_id(F.lit("operation.removed"), "method", "path", none, none, "operation_id", none, none).alias("id"))


@query("SELECT p_brand, substr(sha1(string_agg(substr(sha1(p_name || CAST(p_partkey AS STRING)), 1, 10), '|' ORDER BY substr(sha1(p_name || CAST(p_partkey AS STRING)), 1, 10))), 1, 7) AS digest FROM part GROUP BY p_brand")
def branch_digest(spark, sf_dir):
    ids = F.substring(F.sha1(F.concat("p_name", F.col("p_partkey").cast("string"))), 1, 10)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_list(ids).alias("ids")).select("p_brand", text.branch_digest("ids").alias("digest"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash("text").alias("hash"))


# ---- schema types ----

_SPLIT = "(strpos({0}, ':') > 0 AND NOT (strpos({0}, '<') > 0 AND strpos({0}, '<') < strpos({0}, ':')))"
_BASE = f"CASE WHEN {_SPLIT} THEN substr({{0}}, 1, strpos({{0}}, ':') - 1) ELSE {{0}} END"
_FMT = f"CASE WHEN {_SPLIT} THEN substr({{0}}, strpos({{0}}, ':') + 1) END"
_NUM = "('int32', 'int64', 'float', 'double')"
_BREAKS = f"({_BASE.format('a')}) <> ({_BASE.format('b')}) OR CASE WHEN coalesce(({_FMT.format('a')}) IN {_NUM}, true) AND coalesce(({_FMT.format('b')}) IN {_NUM}, true) THEN coalesce(({_FMT.format('a')}) <> ({_FMT.format('b')}), false) ELSE true END"
_TYPES = "SELECT DISTINCT CASE l_linenumber % 8 WHEN 0 THEN 'string' WHEN 1 THEN 'integer' WHEN 2 THEN 'integer:int32' WHEN 3 THEN 'integer:int64' WHEN 4 THEN 'string:date-time' WHEN 5 THEN 'array<integer:int64>' WHEN 6 THEN 'array<integer>' ELSE 'number:double' END AS t FROM {lineitem}"


@query(f"WITH t AS ({_TYPES.format(lineitem='lineitem')}) SELECT t, {_BASE.format('t')} AS base, {_FMT.format('t')} AS format FROM t")
def type_split(spark, sf_dir):
    t = spark.sql(_TYPES, lineitem=table(spark, sf_dir, "lineitem"))
    return t.select("t", schema_types.base_type("t").alias("base"), schema_types.type_format("t").alias("format"))


@query(f"WITH t AS ({_TYPES.format(lineitem='lineitem')}), p AS (SELECT x.t AS a, y.t AS b FROM t x, t y) SELECT a, b, {_BREAKS} AS breaking FROM p")
def type_matrix(spark, sf_dir):
    t = spark.sql(_TYPES, lineitem=table(spark, sf_dir, "lineitem"))
    pairs = t.select(F.col("t").alias("a")).crossJoin(t.select(F.col("t").alias("b")))  # eight names at most
    return pairs.select("a", "b", schema_types.is_type_change_breaking("a", "b").alias("breaking"))


_FIELD_BOTH = f"SELECT o.op, o.direction, o.pointer, o.ord AS old_ord, n.ord AS new_ord, o.type AS a, n.type AS b, o.required AS old_required, n.required AS new_required FROM {V('fields_old')} o JOIN {V('fields_new')} n ON o.op = n.op AND o.direction = n.direction AND o.pointer = n.pointer"


@query(f"SELECT op, pointer, a AS from_type, b AS to_type, {_BREAKS} AS breaking FROM ({_FIELD_BOTH}) j WHERE a <> b")
def type_change_breaking(spark, sf_dir):
    o, n = _view(spark, sf_dir, "fields_old", "fields_new")
    keys = ["op", "direction", "pointer"]
    j = o.select(*keys, F.col("type").alias("from_type")).join(n.select(*keys, F.col("type").alias("to_type")), keys).filter("from_type <> to_type")
    return j.select("op", "pointer", "from_type", "to_type", schema_types.is_type_change_breaking("from_type", "to_type").alias("breaking"))


# ---- operations ----


@query(f"SELECT 'parts' AS pair_id, o.op_key FROM {V('ops_old')} o JOIN {V('ops_new')} n ON o.op_key = n.op_key")
def ops_matched(spark, sf_dir):
    return diff.match_operations(*_view(spark, sf_dir, "ops_old", "ops_new"))[0]


_CHANGE = "substr(sha1({kind} || '|' || coalesce(method, '') || '|' || path || '|' || {loc} || '|' || {frm} || '|' || {to} || '|' || {ft} || '|' || {tt}), 1, 10) AS id, {kind} AS kind"


def _id(kind: str, loc: str = "''", frm: str = "''", to: str = "''", ft: str = "''", tt: str = "''") -> str:
    return _CHANGE.format(kind=kind, loc=loc, frm=frm, to=to, ft=ft, tt=tt)


_OUT = ("id", "kind", "breaking", "confidence", "path", "method", "from_name", "to_name", "detail")


def _out(df: DataFrame) -> DataFrame:
    return df.select(*_OUT)


@query(f"SELECT {_id(repr('operation.removed'))}, true AS breaking, 'high' AS confidence, path, method, NULL AS from_name, NULL AS to_name, upper(method) || ' ' || path || ' removed' AS detail FROM {V('ops_old')} o WHERE op_key NOT IN (SELECT op_key FROM {V('ops_new')} n)")
def ops_removed(spark, sf_dir):
    return _out(diff.unpaired_changes(diff.match_operations(*_view(spark, sf_dir, "ops_old", "ops_new"))[1], "operation.removed", True, "removed"))


@query(f"SELECT {_id(repr('operation.added'))}, false AS breaking, 'high' AS confidence, path, method, NULL AS from_name, NULL AS to_name, upper(method) || ' ' || path || ' added' AS detail FROM {V('ops_new')} o WHERE op_key NOT IN (SELECT op_key FROM {V('ops_old')} n)")
def ops_added(spark, sf_dir):
    return _out(diff.unpaired_changes(diff.match_operations(*_view(spark, sf_dir, "ops_old", "ops_new"))[2], "operation.added", False, "added"))


def _flag_pairs(spark, sf_dir) -> DataFrame:
    o, n = _view(spark, sf_dir, "ops_old", "ops_new")
    names = lambda d: F.when(F.col(d), F.array(F.lit("key"), F.lit("oauth"))).otherwise(F.array(F.lit("key")))
    a = o.select("pair_id", "op_key", "path", "method", "operation_id", F.col("deprecated").alias("old_deprecated"), names("deprecated").alias("old_security"))
    b = n.select("pair_id", "op_key", F.col("deprecated").alias("new_deprecated"), names("deprecated").alias("new_security"), (F.col("ord") % 3 != 0).alias("new_own_security"))
    return a.join(b, ["pair_id", "op_key"]).withColumn("rank", F.lit(changes.HIGH))


_DEP = f"FROM {V('ops_old')} o JOIN {V('ops_new')} n ON o.op_key = n.op_key WHERE NOT o.deprecated AND n.deprecated"


@query(f"WITH j AS (SELECT o.path, o.method {_DEP}) SELECT {_id(repr('operation.deprecated'))}, false AS breaking, 'high' AS confidence, path, method, NULL AS from_name, NULL AS to_name, upper(method) || ' ' || path || ' is now deprecated' AS detail FROM j")
def ops_deprecated(spark, sf_dir):
    return _out(diff.diff_operation_flags(_flag_pairs(spark, sf_dir)).filter("kind = 'operation.deprecated'"))


@query(f"WITH j AS (SELECT o.path, o.method {_DEP} AND n.ord % 3 <> 0) SELECT {_id(repr('security.added'), repr('security'), to=repr('oauth'))}, true AS breaking, 'high' AS confidence, path, method, NULL AS from_name, 'oauth' AS to_name, 'now requires oauth' AS detail FROM j")
def op_security_added(spark, sf_dir):
    return _out(diff.diff_operation_flags(_flag_pairs(spark, sf_dir)).filter("kind = 'security.added'"))


# ---- servers and security ----


@query(f"""WITH o AS {V('servers_old')}, n AS {V('servers_new')}, a AS (SELECT pair_id, url FROM o WHERE pos = 0), b AS (SELECT pair_id, url FROM n WHERE pos = 0)
SELECT a.pair_id, 'server.url.changed' AS kind, a.url AS from_name, b.url AS to_name FROM a JOIN b ON a.pair_id = b.pair_id AND a.url <> b.url
UNION ALL SELECT o.pair_id, 'server.removed', o.url, NULL FROM o LEFT JOIN a ON a.pair_id = o.pair_id WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.pair_id = o.pair_id AND n.url = o.url) AND o.url IS DISTINCT FROM a.url
UNION ALL SELECT n.pair_id, 'server.added', NULL, n.url FROM n LEFT JOIN b ON b.pair_id = n.pair_id WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.pair_id = o.pair_id AND n.url = o.url) AND n.url IS DISTINCT FROM b.url""")
def servers_diff(spark, sf_dir):
    return diff.diff_servers(*_view(spark, sf_dir, "servers_old", "servers_new")).select("pair_id", "kind", "from_name", "to_name")


@query(f"""WITH o AS {V('security_old')}, n AS {V('security_new')}, x AS {V('schemes_old')}, y AS {V('schemes_new')}
SELECT pair_id, 'security.added' AS kind, NULL AS from_name, name AS to_name, NULL AS from_type, NULL AS to_type FROM (SELECT * FROM n EXCEPT SELECT * FROM o) t
UNION ALL SELECT pair_id, 'security.removed', name, NULL, NULL, NULL FROM (SELECT * FROM o EXCEPT SELECT * FROM n) t
UNION ALL SELECT x.pair_id, 'security.scheme.changed', x.name, x.name, x.description, y.description FROM x JOIN y ON x.pair_id = y.pair_id AND x.name = y.name AND x.description <> y.description""")
def security_diff(spark, sf_dir):
    return diff.diff_security(*_view(spark, sf_dir, "security_old", "security_new", "schemes_old", "schemes_new")).select("pair_id", "kind", "from_name", "to_name", "from_type", "to_type")


# ---- enums, statuses, media types ----

_ENUMS = "SELECT user_id, CAST(date_part('week', ts) AS INT) AS w, event_type AS v FROM events"


def _enum_pairs(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.weekofyear("ts").alias("w"), "event_type").groupBy("user_id", "w").agg(F.array_sort(F.collect_set("event_type")).alias("s"))
    a = e.select("user_id", "w", F.col("s").alias("before"))
    b = e.select("user_id", (F.col("w") - 1).alias("w"), F.col("s").alias("after"))
    return a.join(b, ["user_id", "w"])


@query(f"WITH s AS (SELECT DISTINCT * FROM ({_ENUMS}) t), k AS (SELECT a.user_id, a.w FROM (SELECT DISTINCT user_id, w FROM s) a JOIN (SELECT DISTINCT user_id, w FROM s) b ON a.user_id = b.user_id AND b.w = a.w + 1) SELECT k.user_id, k.w, 'removed' AS way, s.v AS value FROM k JOIN s ON s.user_id = k.user_id AND s.w = k.w WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.user_id = k.user_id AND t.w = k.w + 1 AND t.v = s.v) UNION ALL SELECT k.user_id, k.w, 'added', s.v FROM k JOIN s ON s.user_id = k.user_id AND s.w = k.w + 1 WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.user_id = k.user_id AND t.w = k.w AND t.v = s.v)")
def enum_delta(spark, sf_dir):
    p = _enum_pairs(spark, sf_dir)
    one = lambda way, x, y: p.select("user_id", "w", F.lit(way).alias("way"), F.explode(F.array_except(x, y)).alias("value"))
    return one("removed", "before", "after").unionByName(one("added", "after", "before"))


@query(f"WITH g AS (SELECT user_id, w, list_sort(list_distinct(list(v))) AS s FROM ({_ENUMS}) t GROUP BY user_id, w), k AS (SELECT a.user_id, a.w, a.user_id % 2 = 0 AS req, list_sort(list_filter(a.s, lambda v: NOT list_contains(b.s, v))) AS lost, list_sort(list_filter(b.s, lambda v: NOT list_contains(a.s, v))) AS won FROM g a JOIN g b ON a.user_id = b.user_id AND b.w = a.w + 1) SELECT CAST(user_id AS STRING) AS path, w, 'enum.value.removed' AS kind, req AS breaking, CASE WHEN req THEN 'type no longer accepts ' ELSE 'type no longer returns ' END || array_to_string(lost, ', ') AS detail FROM k WHERE len(lost) > 0 UNION ALL SELECT CAST(user_id AS STRING), w, 'enum.value.added', NOT req, CASE WHEN req THEN 'type now also accepts ' ELSE 'type can now return ' END || array_to_string(won, ', ') FROM k WHERE len(won) > 0")
def enum_change_classified(spark, sf_dir):
    rows = _enum_pairs(spark, sf_dir).select(F.col("w").cast("string").alias("pair_id"), F.col("user_id").cast("string").alias("path"), F.lit("get").alias("method"), F.lit("type").alias("name"), "before", "after", F.lit(2).alias("rank"), F.when(F.col("user_id") % 2 == 0, "request").otherwise("response").alias("d"))
    return diff.enum_changes(rows, "name", F.col("d"), F.lit("body")).select("path", F.col("pair_id").cast("int").alias("w"), "kind", "breaking", "detail")


_SETS = "SELECT o_custkey AS c, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 0 ELSE 1 END AS side, {v} AS v FROM orders"


def _order_sets(spark, sf_dir, value, name: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("late", F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    got = o.groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.when(~F.col("late"), value))).alias(f"old_{name}"), F.array_sort(F.collect_set(F.when(F.col("late"), value))).alias(f"new_{name}"))
    return got.withColumns({"pair_id": F.lit("orders"), "path": F.col("o_custkey").cast("string"), "method": F.lit("get"), "rank": F.lit(changes.HIGH)})


@query(f"WITH s AS (SELECT DISTINCT * FROM ({_SETS.format(v=repr('application/') + ' || lower(o_orderstatus)')}) t) SELECT CAST(c AS STRING) AS path, 'content.type.removed' AS kind, true AS breaking, v AS name FROM s WHERE side = 0 AND NOT EXISTS (SELECT 1 FROM s t WHERE t.c = s.c AND t.side = 1 AND t.v = s.v) UNION ALL SELECT CAST(c AS STRING), 'content.type.added', false, v FROM s WHERE side = 1 AND NOT EXISTS (SELECT 1 FROM s t WHERE t.c = s.c AND t.side = 0 AND t.v = s.v)")
def content_types_diff(spark, sf_dir):
    rows = _order_sets(spark, sf_dir, F.concat(F.lit("application/"), F.lower("o_orderstatus")), "request_types")
    return diff.diff_content_types(rows, "request").select("path", "kind", "breaking", F.coalesce("from_name", "to_name").alias("name"))


@query(f"WITH s AS (SELECT DISTINCT * FROM ({_SETS.format(v='CAST(200 + 100 * (o_orderkey % 3) + o_orderkey % 2 AS STRING)')}) t) SELECT CAST(c AS STRING) AS path, v AS status, 'success response ' || v || ' removed' AS detail FROM s WHERE side = 0 AND v LIKE '2%' AND NOT EXISTS (SELECT 1 FROM s t WHERE t.c = s.c AND t.side = 1 AND t.v = s.v)")
def statuses_removed(spark, sf_dir):
    rows = _order_sets(spark, sf_dir, (200 + 100 * (F.col("o_orderkey") % 3) + F.col("o_orderkey") % 2).cast("string"), "statuses")
    return diff.diff_statuses(rows).select("path", F.col("from_name").alias("status"), "detail")


# ---- parameters and fields ----

_RANK = "CASE rank WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"
_LOC = "CASE WHEN direction = 'request' THEN 'body' ELSE 'response' END"


def _renames_sql(part: str, scope: str, shape: str) -> str:
    """Rename pairs of a part by SQL: sure where a class has one row a side, else first fit among related names is
    approximated by classes in which at most one side has one row and names decide; larger ones are left to the tests."""
    return f"""o AS {V(part + '_old')}, n AS {V(part + '_new')},
r AS (SELECT o.*, count(*) OVER (PARTITION BY {scope}, {shape}) AS c FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE {' AND '.join(f'n.{k} = o.{k}' for k in _keys(part))})),
a AS (SELECT n.*, count(*) OVER (PARTITION BY {scope}, {shape}) AS c FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE {' AND '.join(f'n.{k} = o.{k}' for k in _keys(part))})),
sure AS (SELECT r.op, r.ord AS from_ord, a.ord AS to_ord, r.name AS from_n, a.name AS to_n{', r.direction, r.pointer AS from_p, a.pointer AS to_p' if part == 'fields' else ', r.location'} FROM r JOIN a ON {' AND '.join(f'r.{k.strip()} = a.{k.strip()}' for k in (scope + ',' + shape).split(','))} WHERE r.c = 1 AND a.c = 1)"""


def _keys(part: str) -> tuple[str, ...]:
    return ("op", "direction", "pointer") if part == "fields" else ("op", "location", "name")


_FR = _renames_sql("fields", "op, direction", "parent, schema_fp")
_PR = _renames_sql("params", "op", "location, type")


@query(f"WITH {_FR} SELECT op, direction, from_p, to_p FROM sure")
def field_rename_unambiguous(spark, sf_dir):
    found = diff.renames(*_view(spark, sf_dir, "fields_old", "fields_new"), diff.FIELD_KEYS, diff.FIELD_CLASS).filter(F.col("conf") == changes.HIGH)
    return found.select("op", F.col("f.direction").alias("direction"), F.col("f.pointer").alias("from_p"), F.col("t.pointer").alias("to_p"))


@query(f"WITH {_PR} SELECT op, location, from_n, to_n FROM sure")
def param_rename(spark, sf_dir):
    """The sure renames, as SQL can state them; param_rename_all has every confidence."""
    return param_rename_all(spark, sf_dir).filter("confidence = 'high'").drop("confidence")


@query()
def param_rename_all(spark, sf_dir):
    """Sure and ambiguous parameter renames; first fit has no plain SQL form."""
    found = diff.renames(*_view(spark, sf_dir, "params_old", "params_new"), diff.PARAM_KEYS, diff.PARAM_CLASS)
    return found.select("op", F.col("f.location").alias("location"), F.col("f.name").alias("from_n"), F.col("t.name").alias("to_n"), changes.confidence_of(F.col("conf")).alias("confidence"))


@query()
def field_rename_ambiguous(spark, sf_dir):
    """Classes with several rows a side, paired one to one by related names; first fit has no plain SQL form."""
    found = diff.renames(*_view(spark, sf_dir, "fields_old", "fields_new"), diff.FIELD_KEYS, diff.FIELD_CLASS).filter(F.col("conf") == changes.MEDIUM)
    return found.select("op", F.col("f.direction").alias("direction"), F.col("f.ord").alias("from_ord"), F.col("t.ord").alias("to_ord"))


def _field_changes(spark, sf_dir, only: str | None = None, folded: bool = False) -> DataFrame:
    ctx, o, n = _view(spark, sf_dir, "contexts", "fields_old", "fields_new")
    none = F.lit(None).cast("array<string>")
    return diff.field_changes(ctx, o.withColumn("enum_values", none), n.withColumn("enum_values", none), only, folded)


def _param_changes(spark, sf_dir, only: str | None = None) -> DataFrame:
    ctx, o, n = _view(spark, sf_dir, "contexts", "params_old", "params_new")
    none = F.lit(None).cast("array<string>")
    return diff.diff_params(ctx, o.withColumn("enum_values", none), n.withColumn("enum_values", none), only)


_FKIND = "direction || '.field.{}'"


@query(f"""WITH j AS (SELECT c.*, direction, pointer, a, b FROM ({_FIELD_BOTH}) f JOIN {V('contexts')} c ON c.op = f.op WHERE a <> b)
SELECT {_id(_FKIND.format('type.changed'), _LOC, 'pointer', 'pointer', 'a', 'b')}, {_BREAKS} AS breaking, {_RANK} AS confidence, path, method, pointer AS from_name, pointer AS to_name, direction || ' field ' || pointer || ' changed from ' || a || ' to ' || b AS detail FROM j""")
def fields_type_changed(spark, sf_dir):
    return _out(_field_changes(spark, sf_dir, diff.MATCHED).filter(F.endswith("kind", F.lit(".type.changed"))))


@query(f"""WITH j AS (SELECT c.*, direction, pointer FROM ({_FIELD_BOTH}) f JOIN {V('contexts')} c ON c.op = f.op WHERE direction = 'request' AND NOT old_required AND new_required)
SELECT {_id(repr('request.field.became.required'), repr('body'), 'pointer', 'pointer')}, true AS breaking, {_RANK} AS confidence, path, method, pointer AS from_name, pointer AS to_name, 'request field ' || pointer || ' is now required' AS detail FROM j""")
def fields_became_required(spark, sf_dir):
    return _out(_field_changes(spark, sf_dir, diff.MATCHED).filter("kind = 'request.field.became.required'"))


# Fields that are in no class with several rows a side: there the renames are the sure ones alone.
_PLAIN_R = "NOT EXISTS (SELECT 1 FROM a WHERE {m}) OR (r.c = 1 AND (SELECT max(a.c) FROM a WHERE {m}) = 1)"
_FM = "a.op = r.op AND a.direction = r.direction AND a.parent = r.parent AND a.schema_fp = r.schema_fp"


@query(f"""WITH {_FR}, j AS (SELECT c.*, r.direction, r.pointer, r.type, r.required FROM r JOIN {V('contexts')} c ON c.op = r.op WHERE NOT EXISTS (SELECT 1 FROM a WHERE {_FM}))
SELECT {_id(_FKIND.format('removed'), _LOC, 'pointer', ft='type')}, direction = 'response' OR required AS breaking, {_RANK} AS confidence, path, method, pointer AS from_name, NULL AS to_name, direction || ' field ' || pointer || ' removed' AS detail FROM j""")
def fields_removed(spark, sf_dir):
    """Removed fields of classes to which nothing was added: no rename can claim them. fields_removed_all has the others too."""
    return _out(_field_changes(spark, sf_dir, diff.REMOVED_ALONE))


_FM2 = "r.op = a.op AND r.direction = a.direction AND r.parent = a.parent AND r.schema_fp = a.schema_fp"


@query(f"""WITH {_FR}, j AS (SELECT c.*, a.pointer, a.type FROM a JOIN {V('contexts')} c ON c.op = a.op WHERE a.direction = 'request' AND a.required AND NOT EXISTS (SELECT 1 FROM r WHERE {_FM2}))
SELECT {_id(repr('request.field.added.required'), repr('body'), to='pointer', tt='type')}, true AS breaking, {_RANK} AS confidence, path, method, NULL AS from_name, pointer AS to_name, 'new required request field ' || pointer || ' (' || type || ')' AS detail FROM j""")
def fields_added_required(spark, sf_dir):
    """Added required request fields of classes that lost nothing. fields_added_required_all has the others too."""
    return _out(_field_changes(spark, sf_dir, diff.ADDED_ALONE))


_PARAM_BOTH = f"SELECT c.path, c.method, c.rank, o.location, o.name, o.type AS a, n.type AS b, o.required AS old_required, n.required AS new_required FROM {V('params_old')} o JOIN {V('params_new')} n ON o.op = n.op AND o.location = n.location AND o.name = n.name JOIN {V('contexts')} c ON c.op = o.op"


@query(f"WITH j AS ({_PARAM_BOTH}) SELECT {_id(repr('param.type.changed'), 'location', 'name', 'name', 'a', 'b')}, {_BREAKS} AS breaking, {_RANK} AS confidence, path, method, name AS from_name, name AS to_name, location || ' parameter ' || name || ' changed from ' || a || ' to ' || b AS detail FROM j WHERE a <> b")
def params_type_changed(spark, sf_dir):
    return _out(_param_changes(spark, sf_dir, diff.MATCHED).filter("kind = 'param.type.changed'"))


@query(f"WITH j AS ({_PARAM_BOTH}) SELECT {_id(repr('param.became.required'), 'location', 'name', 'name')}, true AS breaking, {_RANK} AS confidence, path, method, name AS from_name, name AS to_name, location || ' parameter ' || name || ' is now required' AS detail FROM j WHERE NOT old_required AND new_required")
def params_became_required(spark, sf_dir):
    return _out(_param_changes(spark, sf_dir, diff.MATCHED).filter("kind = 'param.became.required'"))


_PM = "a.op = r.op AND a.location = r.location AND a.type = r.type"


@query(f"WITH {_PR}, j AS (SELECT c.path, c.method, c.rank, r.location, r.name FROM r JOIN {V('contexts')} c ON c.op = r.op WHERE NOT EXISTS (SELECT 1 FROM a WHERE {_PM})) SELECT {_id(repr('param.removed'), 'location', 'name')}, false AS breaking, {_RANK} AS confidence, path, method, name AS from_name, NULL AS to_name, location || ' parameter ' || name || ' removed, the server now ignores it' AS detail FROM j")
def params_removed(spark, sf_dir):
    """Removed parameters of classes that gained nothing. params_removed_all has the others too."""
    return _out(_param_changes(spark, sf_dir, diff.REMOVED_ALONE))


@query(f"WITH {_PR}, j AS (SELECT c.path, c.method, c.rank, a.location, a.name, a.type FROM a JOIN {V('contexts')} c ON c.op = a.op WHERE a.required AND NOT EXISTS (SELECT 1 FROM r WHERE {_PM})) SELECT {_id(repr('param.added.required'), 'location', to='name', tt='type')}, true AS breaking, {_RANK} AS confidence, path, method, NULL AS from_name, name AS to_name, 'new required ' || location || ' parameter ' || name || ' (' || type || ')' AS detail FROM j")
def params_added_required(spark, sf_dir):
    """Added required parameters of classes that lost nothing. params_added_required_all has the others too."""
    return _out(_param_changes(spark, sf_dir, diff.ADDED_ALONE))


# ---- whole outputs: what first fit leaves unpaired has no plain SQL form ----


@query()
def fields_removed_all(spark, sf_dir):
    """Every removed field that no rename claims."""
    return _out(_field_changes(spark, sf_dir).filter(F.endswith("kind", F.lit(".field.removed"))))


@query()
def fields_added_required_all(spark, sf_dir):
    """Every added required request field that no rename claims."""
    return _out(_field_changes(spark, sf_dir).filter("kind = 'request.field.added.required'"))


@query()
def params_removed_all(spark, sf_dir):
    """Every removed parameter that no rename claims."""
    return _out(_param_changes(spark, sf_dir).filter("kind = 'param.removed'"))


@query()
def params_added_required_all(spark, sf_dir):
    """Every added required parameter that no rename claims."""
    return _out(_param_changes(spark, sf_dir).filter("kind = 'param.added.required'"))


@query()
def field_diff(spark, sf_dir):
    """All field changes with cascades folded, in report order."""
    return changes.sort_changes(_field_changes(spark, sf_dir, folded=True))


# ---- rename inference of operations ----


def _shapes(spark, sf_dir, name: str) -> DataFrame:
    (o,) = _view(spark, sf_dir, name)
    tags = F.array(F.concat(F.lit("f"), (F.col("ord") % 3).cast("string")), F.lit("id"), F.when(F.col("deprecated"), "old").otherwise("new"))
    return o.withColumns({"request": tags, "response": F.array(F.lit("id"), F.lit("name"))})


def _lost_and_won(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    _, r, a = diff.match_operations(_shapes(spark, sf_dir, "ops_old"), _shapes(spark, sf_dir, "ops_new"))
    return r, a


@query(f"""WITH o AS {V('ops_old')}, n AS {V('ops_new')}, r AS (SELECT * FROM o WHERE op_key NOT IN (SELECT op_key FROM n)), a AS (SELECT * FROM n WHERE op_key NOT IN (SELECT op_key FROM o))
SELECT r.method, r.path AS from_path, a.path AS to_path FROM r JOIN a ON r.method = a.method AND r.operation_id = a.operation_id""")
def op_rename_by_id(spark, sf_dir):
    r, a = _lost_and_won(spark, sf_dir)
    pairs = matching.operation_renames(r, a, by_id=True)
    return pairs.join(r.select(F.col("ord").alias("from_ord"), F.col("path").alias("from_path")), "from_ord").join(a.select(F.col("ord").alias("to_ord"), F.col("path").alias("to_path")), "to_ord").select("method", "from_path", "to_path")


_STRIP = "regexp_replace({}, '\\{{[^}}]*\\}}', '{{}}', 'g')"


@query(f"""WITH o AS {V('ops_old')}, n AS {V('ops_new')}, r AS (SELECT * FROM o WHERE op_key NOT IN (SELECT op_key FROM n)), a AS (SELECT * FROM n WHERE op_key NOT IN (SELECT op_key FROM o)),
c AS (SELECT r.ord AS from_ord, a.ord AS to_ord, {_SIM.format(_STRIP.format('r.path'), _STRIP.format('a.path'))} AS s, (2 + CASE WHEN r.ord % 3 = a.ord % 3 THEN 0 ELSE 0 END) AS z, (1 + CASE WHEN r.ord % 3 = a.ord % 3 THEN 1 ELSE 0 END + CASE WHEN r.deprecated = a.deprecated THEN 1 ELSE 0 END) AS k FROM r JOIN a ON r.method = a.method WHERE NOT coalesce(r.operation_id = a.operation_id, false)),
d AS (SELECT *, (CAST(k AS DOUBLE) / (6 - k) + 1) / 2 AS m FROM c) SELECT from_ord, to_ord, round(s, 9) AS similarity, round(m, 9) AS resemblance FROM d WHERE s >= 0.5 AND m >= 0.6""")
def op_rename_by_similarity(spark, sf_dir):
    r, a = _lost_and_won(spark, sf_dir)
    found = matching.likely_pairs(r, a, digits=9)
    return found.select("from_ord", "to_ord", F.col("close").alias("similarity"), F.col("alike").alias("resemblance"))


@query()
def greedy_pairs(spark, sf_dir):
    """One-to-one choice among all operation candidates; the fold has no plain SQL form."""
    return matching.operation_renames(*_lost_and_won(spark, sf_dir)).select("method", "from_ord", "to_ord", "conf")


@query(f"""WITH o AS (SELECT op, list(DISTINCT pointer) AS s FROM {V('fields_old')} t GROUP BY op), n AS (SELECT op, list(DISTINCT pointer) AS s FROM {V('fields_new')} t GROUP BY op)
SELECT o.op, round(CAST(len(list_intersect(o.s, n.s)) AS DOUBLE) / len(list_distinct(list_concat(o.s, n.s))), 9) AS overlap FROM o JOIN n USING (op)""")
def field_overlap_jaccard(spark, sf_dir):
    o, n = _view(spark, sf_dir, "fields_old", "fields_new")
    sets = lambda d, c: d.groupBy("op").agg(F.collect_set("pointer").alias(c))
    return sets(o, "a").join(sets(n, "b"), "op").select("op", F.round(matching.overlap(F.col("a"), F.col("b")), 9).alias("overlap"))


@query(f"""WITH j AS (SELECT o.path AS f, n.path AS t, o.method, o.operation_id, o.ord, CASE WHEN o.ord % 2 = 0 THEN 2 ELSE 1 END AS rank, substr(o.path, 1, 3) AS fp, substr(n.path, 1, 4) AS tp FROM {V('ops_old')} o JOIN {V('ops_new')} n ON o.ord = n.ord WHERE o.ord % 7 = 0),
g AS (SELECT fp, tp, min(rank) AS rank, count(*) AS c, arg_min(method, ord) AS m FROM j WHERE fp <> tp GROUP BY fp, tp)
SELECT fp AS from_name, tp AS to_name, CASE rank WHEN 2 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN c = 1 THEN m END AS method, 'path ' || fp || ' renamed to ' || tp AS detail FROM g""")
def path_rename_grouped(spark, sf_dir):
    """Grouping alone, over shortened paths paired by ord, as SQL can state it. path_rename_all has whole paths of inferred renames."""
    o, n = _view(spark, sf_dir, "ops_old", "ops_new")
    j = o.filter("ord % 7 = 0").select("pair_id", "ord", "method", "operation_id", F.substring("path", 1, 3).alias("from_path"), F.when(F.col("ord") % 2 == 0, 2).otherwise(1).alias("rank")).join(n.select("ord", F.substring("path", 1, 4).alias("to_path")), "ord")
    return diff.path_renames(j).select("from_name", "to_name", "confidence", "method", "detail")


@query()
def path_rename_all(spark, sf_dir):
    """Path renames of the inferred operation renames, whole paths; the choice has no plain SQL form."""
    r, a = _lost_and_won(spark, sf_dir)
    moved = matching.operation_renames(r, a).select("pair_id", "from_ord", "to_ord", F.col("conf").alias("rank"))
    was = r.select("pair_id", F.col("ord").alias("from_ord"), "method", "operation_id", F.col("path").alias("from_path"))
    j = moved.join(was, ["pair_id", "from_ord"]).join(a.select("pair_id", F.col("ord").alias("to_ord"), F.col("path").alias("to_path")), ["pair_id", "to_ord"])
    return diff.path_renames(j.withColumn("ord", F.col("from_ord"))).select("from_name", "to_name", "confidence", "method", "detail")


# ---- cascades and groups ----

_CASC = f"""f AS (SELECT DISTINCT op, direction, pointer, a, b FROM ({_FIELD_BOTH}) j WHERE a <> b),
s AS (SELECT c.op, c.direction, c.pointer, c.a, c.b, arg_min(p.pointer, length(p.pointer)) AS shadow FROM f c LEFT JOIN f p ON p.op = c.op AND p.direction = c.direction AND p.pointer <> c.pointer AND (starts_with(c.pointer, p.pointer || '.') OR starts_with(c.pointer, p.pointer || '[]')) GROUP BY c.op, c.direction, c.pointer, c.a, c.b)"""


def _typed_changes(spark, sf_dir) -> DataFrame:
    o, n = _view(spark, sf_dir, "fields_old", "fields_new")
    keys = ["pair_id", "op", "direction", "pointer"]
    j = o.select(*keys, "type").join(n.select(*keys, F.col("type").alias("to")), keys).filter("type <> to").distinct()
    p, d = F.col("pointer"), F.col("direction")
    rows = j.withColumns({"path": F.col("op").cast("string"), "method": F.lit("get"), "operation_id": F.lit(None).cast("string")})
    return changes.make_changes(rows, F.concat(d, F.lit(".field.type.changed")), schema_types.is_type_change_breaking("type", "to"), F.concat(d, F.lit(" field "), p, F.lit(" changed from "), F.col("type"), F.lit(" to "), F.col("to")), direction=d, location="body", from_name=p, to_name=p, from_type=F.col("type"), to_type=F.col("to"))


@query(f"WITH {_CASC} SELECT CAST(op AS STRING) AS path, direction, pointer AS from_name, shadow FROM s WHERE shadow IS NOT NULL")
def cascade_suppressed(spark, sf_dir):
    return cascade.shadowed(_typed_changes(spark, sf_dir)).filter("shadow IS NOT NULL").select("path", "direction", "from_name", "shadow").distinct()


@query(f"WITH {_CASC}, h AS (SELECT op, direction, shadow, count(*) AS c FROM s WHERE shadow IS NOT NULL GROUP BY op, direction, shadow) SELECT CAST(s.op AS STRING) AS path, s.direction, s.pointer AS from_name, s.direction || ' field ' || s.pointer || ' changed from ' || s.a || ' to ' || s.b || CASE WHEN h.c > 0 THEN ', along with ' || CAST(h.c AS STRING) || ' nested fields below it' ELSE '' END AS detail FROM s LEFT JOIN h ON h.op = s.op AND h.direction = s.direction AND h.shadow = s.pointer WHERE s.shadow IS NULL")
def cascade_counts(spark, sf_dir):
    return cascade.suppress_cascades(_typed_changes(spark, sf_dir)).select("path", "direction", "from_name", "detail")


_LEAF = "nullif(replace(list_extract(string_split(pointer, '.'), -1), '[]', ''), '')"
_GKEY = f"direction, {_BREAKS} AS breaking, {_LEAF} AS leaf, a, b"


@query(f"WITH f AS (SELECT DISTINCT op, direction, pointer, a, b FROM ({_FIELD_BOTH}) j), g AS (SELECT op, {_GKEY} FROM f WHERE a <> b) SELECT direction || '.field.type.changed' AS kind, breaking, a AS from_type, b AS to_type, leaf, count(*) AS changes, count(DISTINCT op) AS endpoints FROM g GROUP BY direction, breaking, leaf, a, b")
def change_groups(spark, sf_dir):
    g = grouping.group_changes(_typed_changes(spark, sf_dir).withColumn("ord", F.struct("path", "from_name", "id")))
    return g.select("first.kind", "first.breaking", "first.from_type", "first.to_type", text.leaf_of("first.from_name").alias("leaf"), "changes", F.size("endpoints").cast("long").alias("endpoints"))


@query(f"WITH f AS (SELECT DISTINCT op, direction, pointer, a, b FROM ({_FIELD_BOTH}) j), g AS (SELECT {_GKEY} FROM f WHERE a <> b) SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM g) x) AS groups, count(*) AS total FROM g")
def grouping_summary(spark, sf_dir):
    return grouping.grouping_summary(_typed_changes(spark, sf_dir)).select("groups", "total")


@query(f"WITH f AS (SELECT DISTINCT op, direction, pointer, a, b FROM ({_FIELD_BOTH}) j) SELECT direction || '.field.type.changed' AS kind, count(*) AS n FROM f WHERE a <> b GROUP BY direction")
def summary_by_kind(spark, sf_dir):
    return grouping.kinds(_typed_changes(spark, sf_dir)).select("kind", "n")


@query(f"WITH g AS (SELECT {_BREAKS} AS br, {_RANK} AS conf FROM (SELECT DISTINCT f.op, f.direction, f.pointer, f.a, f.b, f.old_ord, f.new_ord, c.rank FROM ({_FIELD_BOTH}) f JOIN {V('contexts')} c ON c.op = f.op) j WHERE a <> b) SELECT count(*) AS total, count(*) FILTER (br) AS breaking, count(*) FILTER (NOT br) AS non_breaking, count(*) FILTER (conf = 'low') AS low, count(*) FILTER (conf = 'medium') AS medium, count(*) FILTER (conf = 'high') AS high FROM g")
def summary_by_confidence(spark, sf_dir):
    return grouping.summary(_field_changes(spark, sf_dir).filter(F.endswith("kind", F.lit(".type.changed")))).drop("pair_id")


@query("WITH p AS (SELECT p_brand, p_type, list_sort(list(DISTINCT p_name)) AS e FROM part GROUP BY p_brand, p_type) SELECT p_brand, p_type, array_to_string(CASE WHEN len(e) > 4 THEN list_append(e[1:4], 'and ' || CAST(len(e) - 4 AS STRING) || ' more') ELSE e END, '; ') AS listed FROM p")
def report_topk(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_set("p_name")).alias("e"))
    return p.select("p_brand", "p_type", F.array_join(grouping.listed_endpoints(F.col("e")), "; ").alias("listed"))


# ---- edits ----


@query("SELECT o_custkey, coalesce(min(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END), 2) AS lowest FROM orders GROUP BY o_custkey")
def confidence_min(spark, sf_dir):
    rank = changes.rank_of(F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.coalesce(F.min(rank), F.lit(2)).alias("lowest"))


def _planned(spark, sf_dir) -> DataFrame:
    (e,) = _view(spark, sf_dir, "edits")
    sites = e.select(F.col("file").cast("string").alias("file"), "change_id", "start_at", "end_at", F.col("action").alias("was"), "confidence", F.when(F.col("after_text").isNotNull(), "rename-path").alias("codemod"))
    ch = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, "high").when(F.col("p_size") > 5, "medium").otherwise("low").alias("confidence"))
    return edits.plan_edits(sites, ch)


_PLAN = f"SELECT e.file, e.change_id, e.start_at, least(CASE WHEN p.p_partkey IS NULL THEN 0 WHEN p.p_size > 25 THEN 2 WHEN p.p_size > 5 THEN 1 ELSE 0 END, CASE e.confidence WHEN 'high' THEN 2 ELSE 1 END, CASE WHEN after_text IS NOT NULL THEN 2 ELSE 0 END) AS r, after_text FROM {V('edits')} e LEFT JOIN part p ON p.p_partkey = e.change_id"


@query(f"SELECT CAST(file AS STRING) AS file, change_id, start_at, CASE r WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, CASE r WHEN 2 THEN 'apply' ELSE 'review' END AS action, CASE WHEN after_text IS NOT NULL THEN 'rename-path' ELSE 'review-note' END AS strategy FROM ({_PLAN}) t")
def plan_edits(spark, sf_dir):
    return _planned(spark, sf_dir).select("file", "change_id", "start_at", "confidence", "action", "strategy")


@query(f"SELECT count(*) FILTER (r = 2) AS applied, count(*) FILTER (r < 2) AS review, count(DISTINCT CASE WHEN r = 2 THEN file END) AS files_changed FROM ({_PLAN}) t")
def pr_counters(spark, sf_dir):
    return _planned(spark, sf_dir).agg(F.count_if(F.col("action") == "apply").alias("applied"), F.count_if(F.col("action") == "review").alias("review"), F.countDistinct(F.when(F.col("action") == "apply", F.col("file"))).alias("files_changed"))


_REASON = "CASE WHEN action <> 'apply' OR confidence <> 'high' THEN 'needs human review' WHEN after_text IS NULL THEN 'no replacement text' END"
_ROWS = f"SELECT *, row_number() OVER (ORDER BY file, start_at, end_at, change_id, action, confidence, after_text) AS k FROM {V('edits')} e"


@query(f"WITH e AS ({_ROWS}) SELECT a.file, a.start_at, a.end_at, a.change_id, EXISTS (SELECT 1 FROM e b WHERE b.file = a.file AND b.k <> a.k AND a.start_at < b.end_at AND b.start_at < a.end_at) AS overlaps FROM e a")
def edit_overlaps(spark, sf_dir):
    (e,) = _view(spark, sf_dir, "edits")
    return edits.mark_overlaps(e).select("file", "start_at", "end_at", "change_id", "overlaps")


@query(f"WITH e AS (SELECT *, {_REASON} AS reason FROM ({_ROWS}) t), o AS (SELECT * FROM e WHERE reason IS NULL) SELECT a.file, a.start_at, a.end_at, a.change_id, coalesce(reason, CASE WHEN EXISTS (SELECT 1 FROM o b WHERE b.file = a.file AND b.k <> a.k AND a.start_at < b.end_at AND b.start_at < a.end_at) THEN 'overlaps another edit at the same location' ELSE 'safe' END) AS reason FROM e a")
def edit_skip_reasons(spark, sf_dir):
    (e,) = _view(spark, sf_dir, "edits")
    return edits.route_edits(e).select("file", "start_at", "end_at", "change_id", F.coalesce("reason", F.lit("safe")).alias("reason"))


@query(f"WITH e AS (SELECT * FROM ({_ROWS}) t WHERE {_REASON} IS NULL) SELECT file, count(*) AS n FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.file = a.file AND b.k <> a.k AND a.start_at < b.end_at AND b.start_at < a.end_at) GROUP BY file")
def edits_safe(spark, sf_dir):
    (e,) = _view(spark, sf_dir, "edits")
    return edits.route_edits(e).filter("reason IS NULL").groupBy("file").agg(F.count("*").alias("n"))


@query(f"WITH e AS (SELECT file, start_at, end_at, action AS reason, after_text, row_number() OVER (PARTITION BY file, start_at, end_at, action ORDER BY after_text IS NULL, change_id) AS r, change_id FROM {V('edits')} t) SELECT file, start_at, end_at, reason, change_id FROM e WHERE r = 1")
def dedupe_sites(spark, sf_dir):
    (e,) = _view(spark, sf_dir, "edits")
    return edits.dedupe_sites(e.withColumnsRenamed({"action": "reason", "after_text": "replacement"}), "change_id").select("file", "start_at", "end_at", "reason", "change_id")


# ---- URLs ----


@query("SELECT page_id, regexp_extract(url, '^[^?#]*', 0) AS portion, regexp_replace(regexp_extract(url, '^[^?#]*', 0), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '') AS path FROM pages")
def url_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.path_portion("url").alias("portion"), urls.strip_origin(urls.path_portion("url")).alias("path"))


_SEGS = "list_filter(string_split(regexp_replace(regexp_extract(url, '^[^?#]*', 0), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '/'), lambda s: s <> '')"


@query(f"SELECT page_id, CAST(len({_SEGS}) AS BIGINT) AS n, array_to_string({_SEGS}, '|') AS joined FROM pages")
def url_segments(spark, sf_dir):
    s = urls.segments(urls.strip_origin(urls.path_portion("url")))
    return table(spark, sf_dir, "pages").select("page_id", F.size(s).cast("long").alias("n"), F.array_join(s, "|").alias("joined"))


@query(f"SELECT op_key, regexp_replace(path, '/\\{{.*$', '') AS prefix FROM {V('ops_old')} o")
def url_literal_prefix(spark, sf_dir):
    (o,) = _view(spark, sf_dir, "ops_old")
    return o.select("op_key", urls.literal_prefix(F.regexp_replace("path", r"\}\d+$", "}")).alias("prefix"))


_TEMPLATES = "(VALUES ('/{section}/{item}'), ('/{item}'), ('/page/{n}'), ('/a/{b}/c')) t(template)"


@query(f"WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[^?#]*', 0), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '') AS path, {_SEGS} AS s FROM pages), m AS (SELECT page_id, template, path, s, list_filter(string_split(template, '/'), lambda x: x <> '') AS w FROM p, {_TEMPLATES}) SELECT page_id, template, len(s) >= len(w) AND len(list_filter(range(1, len(w) + 1), lambda i: NOT starts_with(w[i], '{{') AND (s[len(s) - len(w) + i] IS NULL OR s[len(s) - len(w) + i] <> w[i]))) = 0 AND contains(path, CASE WHEN template = '/page/{{n}}' THEN '/page' WHEN template = '/a/{{b}}/c' THEN '/a' ELSE '/' END) AS matches FROM m")
def url_match_template(spark, sf_dir):
    t = spark.createDataFrame([("/{section}/{item}",), ("/{item}",), ("/page/{n}",), ("/a/{b}/c",)], "template string")
    return table(spark, sf_dir, "pages").select("page_id", "url").join(F.broadcast(t)).select("page_id", "template", urls.matches_template("url", "template").alias("matches"))


@query(f"""WITH j AS (SELECT o.ord, 'https://api.test' || o.path || '?x=1' AS u, regexp_replace(o.path, '\\}}.*$', '}}') AS a, regexp_replace(n.path, '\\}}.*$', '}}') AS b FROM {V('ops_old')} o JOIN {V('ops_new')} n USING (ord)),
k AS (SELECT *, regexp_replace(a, '/\\{{.*$', '') AS x, regexp_replace(b, '/\\{{.*$', '') AS y FROM j) SELECT ord, CASE WHEN x <> y AND strpos(u, x) > 0 THEN substr(u, 1, strpos(u, x) - 1) || y || substr(u, strpos(u, x) + length(x)) END AS rewritten FROM k""")
def url_rewrite(spark, sf_dir):
    o, n = _view(spark, sf_dir, "ops_old", "ops_new")
    cut = lambda c: F.regexp_replace(c, r"\}.*$", "}")
    j = o.select("ord", F.concat(F.lit("https://api.test"), "path", F.lit("?x=1")).alias("u"), cut("path").alias("a")).join(n.select("ord", cut("path").alias("b")), "ord")
    return j.select("ord", urls.rewrite_path("u", "a", "b").alias("rewritten"))


_HOSTED = "CASE page_id % 9 WHEN 0 THEN 'http://127.0.0.1/x' WHEN 1 THEN 'https://172.16.0.1/' WHEN 2 THEN 'https://172.32.0.1/' WHEN 3 THEN 'http://[::1]:80/' WHEN 4 THEN 'ftp://example.org/a' WHEN 5 THEN 'not a url' WHEN 6 THEN 'http://100.64.0.1' WHEN 7 THEN 'https://svc.internal/' ELSE url END"


@query(f"WITH p AS (SELECT page_id, {_HOSTED} AS u FROM pages) SELECT page_id, CASE WHEN u = 'not a url' THEN 'not absolute' WHEN u LIKE 'ftp%' THEN 'protocol' WHEN page_id % 9 IN (0, 1, 3, 6, 7) THEN 'private host' END AS problem FROM p")
def url_public_guard(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(_HOSTED).alias("u"))
    return p.select("page_id", urls.public_url_problem("u").alias("problem"))


# ---- call sites ----

# The dollar stands apart from its brace, which Spark's expression parser would take for a variable.
_CALLS = "CASE page_id % 4 WHEN 0 THEN 'https://api.test/v1/charges' WHEN 1 THEN '/v1/charges/' || page_id || '?x=1' WHEN 2 THEN '/v1/charges/a/b' ELSE '$' || '{BASE}/v1/charges/$' || '{id}' END"
_HEAD = "CASE WHEN page_id % 3 = 0 THEN 'client.post(' ELSE 'const r = await fetch(' END"


@query(f"""WITH c AS (SELECT page_id, page_id % 4 AS k, page_id % 3 = 0 AS posts, {_CALLS} AS u, {_HEAD} AS h FROM pages)
SELECT CAST(page_id AS STRING) AS file, CASE WHEN k = 0 THEN 'all' ELSE 'one' END AS change_id, CAST(length(h) + 1 AS INT) AS start_at, CAST(2 AS INT) AS line, '`' || replace(u, '/v1/charges', '/v1/payments') || '`' AS replacement
FROM c WHERE k = 0 OR (k IN (1, 3) AND NOT posts)""")
def site_path_renames(spark, sf_dir):
    content = F.concat(F.lit("\n"), F.expr(_HEAD), F.lit("`"), F.expr(_CALLS), F.lit("`);\n"))
    files = table(spark, sf_dir, "pages").select(F.lit("r").alias("repo"), F.col("page_id").cast("string").alias("file"), content.alias("content"))
    rows = [("all", "/v1/charges", None, "/v1/payments"), ("one", "/v1/charges/{id}", "get", "/v1/payments/{id}")]
    renamed = spark.createDataFrame(rows, "id string, path string, method string, to_name string")
    none = F.lit(None).cast("string")
    renamed = renamed.select("*", F.col("path").alias("from_name"), F.lit("path.renamed").alias("kind"), F.lit(True).alias("breaking"), none.alias("direction"), none.alias("operation_id"))
    return call_sites.find_sites(files, renamed).select("file", "change_id", "start_at", "line", "replacement")


def _change_rows(spark, *rows: dict) -> DataFrame:
    names = ("id", "kind", "direction", "path", "method", "operation_id", "from_name", "to_name", "detail")
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} string" for n in names)).withColumn("breaking", F.lit(True))


#: Source code around each page's URL. Of the fields named amount only the payload's own one is sent: in case 0 the call has no
#: semicolon, in 1 the field is nested, in 2 quoted under a URL in two parts, in 3 in a call by one object, in 4 in text that is
#: made JSON, in 5 in a comment and in a string.
_PAYLOADS = r"""CASE page_id % 6
WHEN 0 THEN 'http.post("/v1/charges", { note: "' || url || '", amount: 1 })' || chr(10) || 'const other = { amount: 2 }' || chr(10) || 'show({ amount: 3 })'
WHEN 1 THEN 'http.post("/v1/charges", { meta: { amount: 1 }, note: "' || url || '" });'
WHEN 2 THEN 'http.post("/v1/" + "charges", { note: "' || url || '", "amount": 1 })'
WHEN 3 THEN 'axios({ url: "/v1/charges", method: "POST", data: { note: "' || url || '", amount } })'
WHEN 4 THEN 'fetch(`/v1/charges`, { method: "POST", body: JSON.stringify({ note: `' || url || '`, amount: f({ amount: 2 }) }) })'
ELSE 'http.post("/v1/charges", { note: "' || url || '" /* amount: 1 */ }); // http.post("/v1/charges", { amount: 1 })' END"""


@query(f"""WITH c AS (SELECT page_id, page_id % 6 AS k, {_PAYLOADS} AS content FROM pages)
SELECT CAST(page_id AS STRING) AS file, CAST(CASE k WHEN 2 THEN strpos(content, '"amount"') ELSE strpos(content, 'amount') END - 1 AS INT) AS start_at,
CASE k WHEN 2 THEN '"amount_cents"' WHEN 3 THEN 'amount_cents: amount' ELSE 'amount_cents' END AS replacement, 'high' AS confidence
FROM c WHERE k IN (0, 2, 3, 4)""")
def site_payload_fields(spark, sf_dir):
    """Renamed request fields in the payload of a call, and nowhere else."""
    files = table(spark, sf_dir, "pages").select(F.lit("r").alias("repo"), F.col("page_id").cast("string").alias("file"), F.expr(_PAYLOADS).alias("content"))
    renamed = _change_rows(spark, {"id": "f", "kind": "request.field.renamed", "direction": "request", "path": "/v1/charges", "method": "post", "from_name": "amount", "to_name": "amount_cents"})
    return call_sites.find_sites(files, renamed).select("file", "start_at", "replacement", "confidence")


#: Two files a page: a caller that decodes a reply, and a reader. Pages of case 0 cast it to a type of the repository, those of
#: case 1 keep it in a variable, those of case 2 return a declared wrapper's reply, those of case 3 read another variable.
_CALLERS = r"""CASE page_id % 4
WHEN 0 THEN 'export interface Charge' || page_id || ' { url: string; amount: number }' || chr(10) || 'export async function load() { const r = await fetch("/v1/charges"); return (await r.json()) as Charge' || page_id || '; }'
WHEN 1 THEN 'async function load() { const r = await fetch("/v1/charges"); const body = await r.json(); log("' || url || '", body.amount); }'
WHEN 2 THEN 'type Charge' || page_id || ' = { amount: number };' || chr(10) || 'export const load = (): Promise<Charge' || page_id || '> => request("GET", "/v1/charges");'
ELSE 'async function load(wallet) { const r = await fetch("/v1/charges"); const body = await r.json(); log(wallet.amount, "' || url || ' body.amount"); }' END"""
_READERS = r"""'const show' || page_id || ' = (c: Charge' || page_id || ', w: Wallet) => `${' || 'c.amount} ${' || 'w.amount}`'"""


@query(f"""WITH c AS (SELECT page_id, page_id % 4 AS k, {_CALLERS} AS content, {_READERS} AS reader FROM pages)
SELECT 'a' || page_id AS file, CAST(strpos(content, CASE k WHEN 1 THEN 'body.amount' ELSE 'amount' END) - CASE k WHEN 1 THEN -4 ELSE 1 END AS INT) AS start_at,
CASE k WHEN 1 THEN 'response.member' ELSE 'response.type' END AS strategy, CASE k WHEN 1 THEN 'medium' ELSE 'high' END AS confidence FROM c WHERE k <> 3
UNION ALL SELECT 'b' || page_id, CAST(strpos(reader, 'c.amount') + 1 AS INT), 'response.member', 'high' FROM c WHERE k IN (0, 2)""")
def site_response_fields(spark, sf_dir):
    """Renamed response fields: of declared types in every file, of local variables in their scope."""
    p = table(spark, sf_dir, "pages").filter("url IS NOT NULL")
    one = lambda lead, content: p.select(F.lit("r").alias("repo"), F.concat(F.lit(lead), F.col("page_id").cast("string")).alias("file"), F.expr(content).alias("content"))
    renamed = _change_rows(spark, {"id": "f", "kind": "response.field.renamed", "direction": "response", "path": "/v1/charges", "method": "get", "from_name": "amount", "to_name": "amount_cents"})
    found = call_sites.find_sites(one("a", _CALLERS).unionByName(one("b", _READERS)), renamed, [call_sites.Wrapper("request", url_argument=1, method_argument=0)])
    return found.select("file", "start_at", "strategy", "confidence")


# ---- vendors ----

_TITLE = "CASE p_partkey % 6 WHEN 0 THEN 'Stripe API v2' WHEN 1 THEN 'GitHub REST API' WHEN 2 THEN 'Payment specification 1.0.3' WHEN 3 THEN 'Chat API' WHEN 4 THEN 'API' ELSE p_name || ' OpenAPI spec v3' END"
_SERVER = "CASE p_partkey % 4 WHEN 0 THEN 'https://api.slack.com/v1' WHEN 1 THEN 'https://api.example.org:8443/v1' WHEN 2 THEN NULL ELSE 'HTTPS://API.Twilio.com' END"
_CLEAN = "regexp_replace(regexp_replace(regexp_replace({}, '(?i)\\bopenapi\\b|\\bapi\\b|\\brest\\b|\\bspecification\\b|\\bspec\\b', ' ', 'g'), '\\bv?\\d+(\\.\\d+)*\\b', ' ', 'g'), '\\s+', ' ', 'g')"


@query(f"WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, p_partkey % 4 AS s, lower(p_name) AS n FROM part) SELECT p_partkey, CASE WHEN s = 0 THEN 'slack' WHEN s = 3 THEN 'twilio' WHEN k = 0 THEN 'stripe' WHEN k = 1 THEN 'github' ELSE 'unknown' END AS vendor, NOT (s IN (1, 2) AND k NOT IN (0, 1)) AS recognized FROM p")
def vendor_detect(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(_TITLE).alias("t"), F.expr(_SERVER).alias("u"))
    return p.select("p_partkey", vendor.detect_vendor("t", "u").alias("v")).select("p_partkey", F.col("v.id").alias("vendor"), F.col("v.recognized").alias("recognized"))


@query(f"WITH p AS (SELECT p_partkey, {_TITLE} AS t FROM part), c AS (SELECT *, trim({_CLEAN.format('t')}) AS s FROM p) SELECT p_partkey, CASE WHEN length(s) > 0 THEN s ELSE trim(t) END AS name FROM c")
def title_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", vendor.name_from_title(F.expr(_TITLE)).alias("name"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(t, '{w}') THEN '{d}'" for d, w in vendor.DOMAIN_WORDS) + " ELSE 'generic' END AS domain FROM (SELECT doc_id, lower(text) AS t FROM documents) d")
def title_domain(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", vendor.domain_from_text(F.lower("text")).alias("domain"))


@query(f"WITH p AS (SELECT p_partkey, {_TITLE} AS t, p_name AS u FROM part), c AS (SELECT *, trim({_CLEAN.format('t')}) AS s, trim({_CLEAN.format('u')}) AS v FROM p), n AS (SELECT p_partkey, regexp_replace(lower(CASE WHEN length(s) > 0 THEN s ELSE trim(t) END), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(CASE WHEN length(v) > 0 THEN v ELSE trim(u) END), '[^a-z0-9]', '', 'g') AS b FROM c) SELECT p_partkey, length(a) > 0 AND length(b) > 0 AND NOT contains(a, b) AND NOT contains(b, a) AS different FROM n")
def different_apis(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", vendor.looks_like_different_apis(F.expr(_TITLE), "p_name").alias("different"))


# ---- history ----


@query(f"WITH h AS (SELECT spec, seq, sha256(content) AS hash FROM {V('snaps')} s), l AS (SELECT *, lag(hash) OVER (PARTITION BY spec ORDER BY seq) AS p FROM h) SELECT spec, seq, hash, CASE WHEN p IS NULL THEN 'baseline' WHEN p = hash THEN 'unchanged' ELSE 'changed' END AS status FROM l")
def snapshot_status(spark, sf_dir):
    return history.snapshot_status(_view(spark, sf_dir, "snaps")[0])


@query(f"WITH h AS (SELECT spec, seq, sha256(content) AS hash FROM {V('snaps')} s), l AS (SELECT *, lag(hash) OVER (PARTITION BY spec ORDER BY seq) AS p FROM h) SELECT spec, CAST(seq AS BIGINT) AS seq, hash, CASE WHEN p IS NULL THEN 'baseline' WHEN p = hash THEN 'unchanged' ELSE 'changed' END AS status FROM l")
def stream_check_status(spark, sf_dir):
    snaps, path = written(_view(spark, sf_dir, "snaps")[0].select(F.col("spec").cast("string").alias("spec"), "seq", "content"), "stream-in")
    return checks.check_available(spark.readStream.schema(snaps.schema).parquet(path), work_dir(spark))


@query(f"SELECT spec, max(seq) AS seq, sha256(arg_max(content, seq)) AS hash FROM {V('snaps')} s GROUP BY spec")
def latest_snapshot(spark, sf_dir):
    (s,) = _view(spark, sf_dir, "snaps")
    return history.latest(s.select("spec", "seq", F.sha2("content", 256).alias("hash")), ["spec"], ["seq"]).select("spec", "seq", "hash")


def _runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("spec_id"), F.col("o_orderdate").alias("started_at"))
    specs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("spec_id"), F.col("c_name").alias("name"))
    return runs, specs


@query("SELECT o_orderkey AS run_id, o_custkey AS spec_id, c_name AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def run_history(spark, sf_dir):
    return history.run_history(*_runs(spark, sf_dir), 50).select("run_id", "spec_id", "name")


@query("SELECT c_nationkey, max(CASE WHEN o_orderstatus = 'P' THEN 2 WHEN o_totalprice > 400000 THEN 1 ELSE 0 END) AS exit_code FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey")
def check_rollup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    outcomes = o.select("c_nationkey", (F.col("o_orderstatus") == "P").alias("failed"), (F.col("o_totalprice") > 400000).cast("int").alias("breaking"))
    return history.exit_code(outcomes, "c_nationkey")


@query("SELECT c_custkey AS name, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS source FROM customer UNION ALL SELECT c_custkey + 100000000, 'new' FROM customer WHERE c_custkey % 5 = 0")
def upsert_specs(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.col("c_name").alias("source"))
    new = c.filter("name % 3 = 0").unionByName(c.filter("name % 5 = 0").withColumn("name", F.col("name") + 100000000)).withColumn("source", F.lit("new"))
    return history.upsert(c, new, ["name"])


@query("WITH g AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') SELECT 'specs' AS part, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM g) UNION ALL SELECT 'snapshots', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM g) UNION ALL SELECT 'runs', count(*) FROM orders UNION ALL SELECT 'orphans', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM g)")
def untrack_cascade(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("spec_id"), "c_mktsegment")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("spec_id"))
    specs, snaps, runs = history.untrack(c.select("name", "spec_id"), o, o, c.filter("c_mktsegment = 'BUILDING'").select("name").distinct())
    one = lambda df, part: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return one(specs, "specs").unionByName(one(snaps, "snapshots")).unionByName(one(runs, "runs")).unionByName(one(runs.filter("spec_id IS NULL"), "orphans"))


# ---- whole documents ----

_PARTS = part_contracts.parts_sql()
#: What becomes of a part: kind, whether it breaks, place, names and types, and wording; `c` is its case.
_PART_CHANGES = f"""SELECT *, substr(sha1(concat_ws('|', kind, method, path, coalesce(location, ''), coalesce(a, ''), coalesce(b, ''), coalesce(ta, ''), coalesce(tb, ''))), 1, 10) AS id FROM (
SELECT pair_id, k, p.c, method, path, kind, breaking, direction, location, a, b, ta, tb, replace(replace(words, 'OP', upper(method) || ' ' || path), '!', '') AS detail FROM {_PARTS} p JOIN (VALUES
(1, 'response.field.type.changed', true, 'response', 'response', 'size', 'size', 'integer', 'string', 'response field size changed from integer to string'),
(2, 'response.field.removed', true, 'response', 'response', 'price', NULL, 'number', NULL, 'response field price removed'),
(3, 'param.became.required', true, 'request', 'query', 'zone', 'zone', NULL, NULL, 'query parameter zone is now required'),
(4, 'operation.removed', true, NULL, NULL, NULL, NULL, NULL, NULL, 'OP removed'),
(5, 'operation.added', false, NULL, NULL, NULL, NULL, NULL, NULL, 'OP added'),
(6, 'operation.deprecated', false, NULL, NULL, NULL, NULL, NULL, NULL, 'OP is now deprecated'),
(7, 'response.field.renamed', true, 'response', 'response', 'price', 'priceCents', NULL, NULL, 'response field price renamed to priceCents')
) t(c, kind, breaking, direction, location, a, b, ta, tb, words) ON t.c = p.c) j"""


def _part_diff(spark, sf_dir) -> DataFrame:
    return contract_diff.diff_documents(part_contracts.specs(spark, sf_dir))


@query(f"SELECT pair_id, id, kind, method, path, breaking, location, a AS from_name, b AS to_name, ta AS from_type, tb AS to_type, detail FROM ({_PART_CHANGES}) c")
def document_changes(spark, sf_dir):
    """Whole documents parsed, normalised and compared."""
    return _part_diff(spark, sf_dir).select("pair_id", "id", "kind", "method", "path", "breaking", "location", "from_name", "to_name", "from_type", "to_type", "detail")


@query(f"SELECT pair_id, CAST(count(DISTINCT CASE WHEN c IN (4, 5, 6) THEN id ELSE CAST(c AS STRING) END) AS BIGINT) AS groups, CAST(count(*) AS BIGINT) AS total, substr(sha1(string_agg(id, '|' ORDER BY id)), 1, 7) AS digest FROM ({_PART_CHANGES}) c GROUP BY pair_id")
def document_groups(spark, sf_dir):
    """Changes that are alike across a document's operations are one group."""
    d, _ = written(_part_diff(spark, sf_dir), "document-changes")
    digest = d.groupBy("pair_id").agg(text.branch_digest(F.collect_list("id")).alias("digest"))
    return grouping.grouping_summary(d).join(digest, "pair_id")


_REPORT = f"""c AS (SELECT *, upper(method) || ' ' || path AS label, row_number() OVER (PARTITION BY pair_id ORDER BY breaking DESC, path, method, kind) AS ord,
CASE WHEN c IN (4, 5, 6) THEN id ELSE kind END AS g FROM ({_PART_CHANGES}) t),
g AS (SELECT pair_id, g, any_value(breaking) AS breaking, min(ord) AS ord, any_value(kind) AS kind, any_value(CASE WHEN a <> b THEN a || ' -> ' || b WHEN ta IS NOT NULL AND tb IS NOT NULL THEN a || ' ' || ta || ' -> ' || tb ELSE detail END) AS said, list(label ORDER BY ord) AS labels FROM c GROUP BY pair_id, g),
n AS (SELECT pair_id, count(*) AS total, count(*) FILTER (breaking) AS x, count(*) FILTER (NOT breaking) AS y FROM c GROUP BY pair_id),
m AS (SELECT pair_id, count(*) AS groups FROM g GROUP BY pair_id),
s AS (SELECT pair_id, CASE WHEN breaking THEN 2 ELSE 4 END AS section, ord,
  list_concat(['  ' || CASE WHEN len(labels) > 1 THEN len(labels) || ' endpoints' ELSE labels[1] END, '    ' || kind || '  [high]', '      ' || said],
  CASE WHEN len(labels) > 1 THEN list_concat(list_transform(labels[1:4], lambda l: '        ' || l), CASE WHEN len(labels) > 4 THEN ['        and ' || (len(labels) - 4) || ' more'] ELSE [] END) ELSE [] END, ['']) AS lines FROM g
UNION ALL SELECT pair_id, 0, 0, list_concat(['API diff: Parts of ' || pair_id, '  old  old.json (1.0)', '  new  new.json (2.0)', '', '  ' || x || ' breaking, ' || y || ' non breaking'],
  CASE WHEN groups < total THEN ['  ' || groups || ' distinct changes, some shared across endpoints'] ELSE [] END, ['']) FROM n JOIN m USING (pair_id)
UNION ALL SELECT pair_id, 1, 0, ['BREAKING (' || x || ')', ''] FROM n WHERE x > 0
UNION ALL SELECT pair_id, 3, 0, ['NON BREAKING (' || y || ')', ''] FROM n WHERE y > 0)"""


@query(f"WITH {_REPORT} SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY section, ord, place) - 1 AS INT) AS n, line FROM (SELECT pair_id, section, ord, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM s) t")
def document_report(spark, sf_dir):
    """The text report of every pair of documents, a row a line."""
    d = contract_diff.DocumentDiff(part_contracts.specs(spark, sf_dir))
    found, _ = written(d.changes(), "document-changes")
    lines = grouping.report_lines(found, d.header()).select("pair_id", "section", "ord", F.posexplode("lines").alias("place", "line"))
    order = Window.partitionBy("pair_id").orderBy("section", "ord", "place")
    return lines.select("pair_id", (F.row_number().over(order) - 1).alias("n"), "line")


@query(f"""SELECT pair_id, json_extract_string(j, '$.id') AS id, json_extract_string(j, '$.kind') AS kind, json_extract_string(j, '$.breaking') AS breaking, json_extract_string(j, '$.target.from') AS from_name, json_extract_string(j, '$.target.toType') AS to_type
FROM (SELECT pair_id, json_object('id', id, 'kind', kind, 'breaking', breaking, 'target', json_object('from', a, 'toType', tb)) AS j FROM ({_PART_CHANGES}) c) t""")
def document_json(spark, sf_dir):
    """The JSON lines of document changes, read again."""
    g = lambda p: F.get_json_object("json", p)
    return artifacts.change_lines(_part_diff(spark, sf_dir)).select("pair_id", g("$.id").alias("id"), g("$.kind").alias("kind"), g("$.breaking").alias("breaking"), g("$.target.from").alias("from_name"), g("$.target.toType").alias("to_type"))


# Of a part's caller: case 7 is rewritten at its type, the others that break are reviewed.
_PART_SITES = f"""SELECT pair_id, 'src/p' || k || '.ts' AS file, kind, CASE c WHEN 7 THEN 'apply' ELSE 'review' END AS action, CASE c WHEN 1 THEN 'size' WHEN 2 THEN 'price' WHEN 7 THEN 'price' ELSE chr(39) || path || chr(39) END AS text,
CASE c WHEN 7 THEN 'priceCents' END AS replacement, CAST(CASE WHEN c IN (3, 4) THEN 3 ELSE 1 END AS INT) AS line FROM ({_PART_CHANGES}) t WHERE breaking"""


@query(f"SELECT * FROM ({_PART_SITES}) s")
def document_edits(spark, sf_dir):
    """Edits of the callers of every part that breaks."""
    found, _ = written(_part_diff(spark, sf_dir).withColumn("repo", F.col("pair_id")).withColumn("id", F.concat_ws(":", "pair_id", "id")), "document-changes")
    planned = edits.plan_edits(call_sites.find_sites(part_contracts.files(spark, sf_dir), found), found)
    return planned.join(found.select(F.col("id").alias("change_id"), "kind"), "change_id").select(F.col("repo").alias("pair_id"), "file", "kind", "action", "text", "replacement", "line")


@query(f"""WITH d AS (SELECT pair_id, min(k - k % {part_contracts.SPAN}) // {part_contracts.SPAN} % 4 AS x FROM {_PARTS} p GROUP BY pair_id),
b AS (SELECT pair_id, count(*) AS breaking FROM ({_PART_CHANGES}) t WHERE breaking GROUP BY pair_id),
s AS (SELECT pair_id, count(*) AS sites, count(*) FILTER (action = 'apply') AS applied, count(*) FILTER (action = 'review') AS review FROM ({_PART_SITES}) t GROUP BY pair_id)
SELECT d.pair_id AS spec, CASE x WHEN 0 THEN 'changed' WHEN 1 THEN 'baseline' WHEN 2 THEN 'unchanged' ELSE 'failed' END AS status, CASE x WHEN 0 THEN '1.0' END AS old_version, CASE WHEN x IN (0, 1) THEN '2.0' END AS new_version,
CAST(CASE x WHEN 0 THEN coalesce(breaking, 0) END AS BIGINT) AS breaking, CAST(CASE x WHEN 0 THEN coalesce(sites, 0) END AS BIGINT) AS sites, CAST(CASE x WHEN 0 THEN coalesce(applied, 0) END AS BIGINT) AS applied, CAST(CASE x WHEN 0 THEN coalesce(review, 0) END AS BIGINT) AS review
FROM d LEFT JOIN b USING (pair_id) LEFT JOIN s USING (pair_id)""")
def document_checks(spark, sf_dir):
    """A whole check of tracked documents: changes with their edits, first sights, no change, failures."""
    return check_cycle.CheckCycle(*part_contracts.tracked(spark, sf_dir), part_contracts.files(spark, sf_dir)).outcomes().drop("error")


@query(f"""WITH d AS (SELECT pair_id, min(k - k % {part_contracts.SPAN}) // {part_contracts.SPAN} % 4 AS x FROM {_PARTS} p GROUP BY pair_id),
b AS (SELECT pair_id, count(*) AS changes, count(*) FILTER (breaking) AS breaking FROM ({_PART_CHANGES}) t GROUP BY pair_id),
s AS (SELECT pair_id, count(*) AS sites, count(*) FILTER (action = 'apply') AS applied FROM ({_PART_SITES}) t GROUP BY pair_id)
SELECT d.pair_id AS spec, CASE WHEN x IN (0, 1) THEN '2.0' ELSE '1.0' END AS baseline, CASE x WHEN 0 THEN 'success' END AS status, CAST(CASE x WHEN 0 THEN coalesce(breaking, 0) ELSE -1 END AS BIGINT) AS breaking,
CAST(CASE x WHEN 0 THEN coalesce(changes, 0) ELSE -1 END AS BIGINT) AS changes, CAST(CASE x WHEN 0 THEN coalesce(sites, 0) ELSE -1 END AS BIGINT) AS edits, CAST(CASE x WHEN 0 THEN coalesce(applied, 0) ELSE -1 END AS BIGINT) AS applied
FROM d LEFT JOIN b USING (pair_id) LEFT JOIN s USING (pair_id)""")
def document_runs(spark, sf_dir):
    """What a store holds after a check: each spec's baseline, and the run, changes and edits of those that changed (-1: no run)."""
    store = Store(spark, f"{work_dir(spark)}/store-{uuid.uuid4().hex}")
    snapshots, current = part_contracts.tracked(spark, sf_dir)
    store.commit({"snapshots": snapshots.withColumns({"version": F.lit("1.0"), "hash": text.content_hash("content"), "at": F.current_timestamp()})})
    version_checks.check_into(store, current.withColumn("seq", F.lit(1).cast("long")), part_contracts.files(spark, sf_dir))
    count = lambda t, n: store.table(t).groupBy("run_id").agg(F.count("*").alias(n))
    runs = store.runs().join(count("changes", "changes"), "run_id", "left").join(count("edits", "edits"), "run_id", "left")
    runs = runs.select("spec", "status", "breaking", F.coalesce("changes", F.lit(0)).alias("changes"), F.coalesce("edits", F.lit(0)).alias("edits"), "applied")
    none = lambda c: F.coalesce(c, F.lit(-1)).cast("long").alias(c)
    return store.snapshots().select("spec", F.col("version").alias("baseline")).join(runs, "spec", "left").select("spec", "baseline", "status", *map(none, ("breaking", "changes", "edits", "applied")))


_CALLER = f"""'interface Part' || k || ' {{ name: string; ' || CASE c WHEN 7 THEN 'priceCents' ELSE 'price' END || ': number; size: number }}' || chr(10) || 'export async function load() {{' || chr(10)
|| '  const r = await fetch(' || chr(39) || path || chr(39) || ', {{ method: ' || chr(39) || upper(method) || chr(39) || ' }});' || chr(10) || '  return (await r.json()) as Part' || k || ';' || chr(10) || '}}' || chr(10)"""


def _part_fix(spark, sf_dir) -> fix.Fix:
    found, _ = written(_part_diff(spark, sf_dir).withColumn("repo", F.col("pair_id")).withColumn("id", F.concat_ws(":", "pair_id", "id")), "document-changes")
    return fix.Fix(part_contracts.files(spark, sf_dir), found)


@query(f"SELECT pair_id AS repo, 'src/p' || k || '.ts' AS file, sha256({_CALLER}) AS sha FROM {_PARTS} p WHERE c = 7")
def document_patches(spark, sf_dir):
    """The callers that a renamed field changes, as they read afterwards."""
    return _part_fix(spark, sf_dir).patched.select("repo", "file", F.sha2("content", 256).alias("sha"))


@query(f"""WITH t AS (SELECT pair_id, count(*) AS total, count(*) FILTER (breaking) AS breaking FROM ({_PART_CHANGES}) c GROUP BY pair_id),
s AS (SELECT pair_id, count(*) FILTER (action = 'apply') AS applied, count(*) FILTER (action = 'review') AS review FROM ({_PART_SITES}) c GROUP BY pair_id)
SELECT pair_id AS repo, CAST(coalesce(applied, 0) AS BIGINT) AS applied, CAST(coalesce(review, 0) AS BIGINT) AS review, 'Update API usage for ' || breaking || ' breaking changes' AS title,
'## Spec change summary' || chr(10) || chr(10) || breaking || ' breaking changes across ' || total || ' total.' AS head FROM t LEFT JOIN s USING (pair_id)""")
def document_pull_requests(spark, sf_dir):
    """One pull request a repository: counters, title and the head of its body."""
    found = _part_fix(spark, sf_dir).pull_requests()
    return found.select("repo", F.col("applied").cast("long").alias("applied"), F.col("review").cast("long").alias("review"), "title", F.substring_index("body", "\n", 3).alias("head"))
