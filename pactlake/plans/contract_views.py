"""The driver's tables read as contracts: the same text is a Spark view and the head of the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pactlake.sources.tables import table

_LINES = "SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p, min(l_returnflag) AS rf, min(l_linestatus) AS ls FROM {lineitem} GROUP BY l_orderkey, l_linenumber"
_POINTER = "CASE n % 7 WHEN 1 THEN 'data' WHEN 2 THEN 'data.item' WHEN 3 THEN 'data.item.code' WHEN 4 THEN 'meta' WHEN 5 THEN 'meta.tags[].label' WHEN 6 THEN 'total' ELSE 'amount' END"
_NAME = "CASE n % 7 WHEN 1 THEN 'data' WHEN 2 THEN 'item' WHEN 3 THEN 'code' WHEN 4 THEN 'meta' WHEN 5 THEN 'label' WHEN 6 THEN 'total' ELSE 'amount' END"
_PARENT = "CASE n % 7 WHEN 2 THEN 'data' WHEN 3 THEN 'data.item' WHEN 5 THEN 'meta.tags[]' ELSE '' END"
_TYPE = "CASE rf WHEN 'R' THEN 'string' WHEN 'A' THEN 'integer' ELSE 'integer:int64' END"
_NEW_TYPE = f"CASE WHEN p % 7 = 0 THEN 'string:date-time' WHEN p % 7 = 1 AND rf = 'N' THEN 'integer:int32' WHEN p % 7 = 2 AND rf = 'A' THEN 'integer:int64' ELSE {_TYPE} END"
_SIDE = "CASE WHEN o % 2 = 0 THEN 'request' ELSE 'response' END"
_PATH = "'/v' || CAST(p_size % 3 + 1 AS STRING) || '/' || replace(p_name, ' ', '_') || '/' || CAST(p_partkey % 10 AS STRING) || '/{id}'"
_METHOD = "CASE p_partkey % 5 WHEN 0 THEN 'get' WHEN 1 THEN 'post' WHEN 2 THEN 'put' WHEN 3 THEN 'patch' ELSE 'delete' END"

#: View name: portable SQL over the tables named in braces.
VIEWS = {
    "fields_old": f"SELECT 'lines' AS pair_id, o AS op, {_SIDE} AS direction, {_POINTER} AS pointer, {_NAME} AS name, {_PARENT} AS parent, ls = 'O' AS required, {_TYPE} AS type, {_TYPE} AS schema_fp, n AS ord FROM ({_LINES}) t WHERE p % 9 <> 0",
    "fields_new": f"SELECT 'lines' AS pair_id, o AS op, {_SIDE} AS direction, {_POINTER} || CASE WHEN p % 11 = 0 THEN '_v2' ELSE '' END AS pointer, {_NAME} || CASE WHEN p % 11 = 0 THEN '_v2' ELSE '' END AS name, {_PARENT} AS parent, ls = 'O' OR p % 5 = 0 AS required, {_NEW_TYPE} AS type, {_NEW_TYPE} AS schema_fp, n AS ord FROM ({_LINES}) t WHERE p % 6 <> 0",
    "params_old": f"SELECT 'lines' AS pair_id, o AS op, CASE n % 3 WHEN 0 THEN 'query' WHEN 1 THEN 'header' ELSE 'path' END AS location, {_NAME} AS name, ls = 'O' AS required, {_TYPE} AS type, n AS ord FROM ({_LINES}) t WHERE p % 9 <> 0",
    "params_new": f"SELECT 'lines' AS pair_id, o AS op, CASE n % 3 WHEN 0 THEN 'query' WHEN 1 THEN 'header' ELSE 'path' END AS location, {_NAME} || CASE WHEN p % 11 = 0 THEN '_v2' ELSE '' END AS name, ls = 'O' OR p % 5 = 0 AS required, {_NEW_TYPE} AS type, n AS ord FROM ({_LINES}) t WHERE p % 6 <> 0",
    "contexts": "SELECT DISTINCT 'lines' AS pair_id, o_orderkey AS op, '/orders/' || CAST(o_orderkey AS STRING) AS path, CASE WHEN o_orderkey % 2 = 0 THEN 'post' ELSE 'get' END AS method, 'op' || CAST(o_orderkey AS STRING) AS operation_id, CAST(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS INT) AS rank FROM {orders}",
    "ops_old": f"SELECT 'parts' AS pair_id, upper({_METHOD}) || ' ' || {_PATH} || CAST(p_partkey AS STRING) AS op_key, {_PATH} || CAST(p_partkey AS STRING) AS path, {_METHOD} AS method, CASE WHEN p_partkey % 4 <> 0 THEN 'op' || CAST(p_partkey AS STRING) END AS operation_id, p_size > 40 AS deprecated, p_partkey AS ord FROM {{part}} WHERE p_partkey % 13 <> 0",
    "ops_new": f"SELECT 'parts' AS pair_id, upper({_METHOD}) || ' ' || CASE WHEN p_partkey % 7 = 0 THEN replace({_PATH}, '/v', '/api/v') ELSE {_PATH} END || CAST(p_partkey AS STRING) AS op_key, CASE WHEN p_partkey % 7 = 0 THEN replace({_PATH}, '/v', '/api/v') ELSE {_PATH} END || CAST(p_partkey AS STRING) AS path, {_METHOD} AS method, CASE WHEN p_partkey % 4 <> 0 THEN 'op' || CAST(p_partkey AS STRING) END AS operation_id, p_size > 30 AS deprecated, p_partkey AS ord FROM {{part}} WHERE p_partkey % 11 <> 0",
    "servers_old": "SELECT CAST(s_nationkey AS STRING) AS pair_id, CAST(s_suppkey % 4 AS INT) AS pos, 'https://' || lower(replace(s_name, '#', '-')) || '.test' AS url FROM {supplier} WHERE s_suppkey % 5 <> 0",
    "servers_new": "SELECT CAST(s_nationkey AS STRING) AS pair_id, CAST(s_suppkey % 4 AS INT) AS pos, 'https://' || lower(replace(s_name, '#', '-')) || CASE WHEN s_suppkey % 3 = 0 THEN '.example' ELSE '.test' END AS url FROM {supplier} WHERE s_suppkey % 7 <> 0",
    "security_old": "SELECT DISTINCT CAST(c_nationkey AS STRING) AS pair_id, lower(c_mktsegment) AS name FROM {customer} WHERE c_acctbal > 5000",
    "security_new": "SELECT DISTINCT CAST(c_nationkey AS STRING) AS pair_id, lower(c_mktsegment) AS name FROM {customer} WHERE c_acctbal < 6000 AND c_custkey % 3 = 0",
    "schemes_old": "SELECT CAST(n_regionkey AS STRING) AS pair_id, n_name AS name, 'apiKey in header named ' || n_name AS description FROM {nation}",
    "schemes_new": "SELECT CAST(n_regionkey AS STRING) AS pair_id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'http bearer' ELSE 'apiKey in header named ' || n_name END AS description FROM {nation} WHERE n_nationkey % 5 <> 0",
    "edits": "SELECT l_orderkey AS file, CAST(l_linenumber * 10 + l_partkey % 12 AS BIGINT) AS start_at, CAST(l_linenumber * 10 + l_partkey % 12 + 3 + l_suppkey % 9 AS BIGINT) AS end_at, l_partkey AS change_id, CASE WHEN l_returnflag = 'R' THEN 'review' ELSE 'apply' END AS action, CASE WHEN l_tax > 0.01 THEN 'x' END AS after_text, CASE l_linestatus WHEN 'O' THEN 'high' ELSE 'medium' END AS confidence FROM {lineitem}",
    "snaps": "SELECT source AS spec, doc_id AS seq, text AS content FROM {documents}",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = [t for t in ("lineitem", "orders", "part", "supplier", "customer", "nation", "documents") if "{" + t + "}" in text]
    return spark.sql(text.replace("{id}", "{{id}}"), **{t: table(spark, sf_dir, t) for t in used})


def sql(name: str) -> str:
    """The view's text for the oracle, in parentheses."""
    text = VIEWS[name]
    for t in ("lineitem", "orders", "part", "supplier", "customer", "nation", "documents"):
        text = text.replace("{" + t + "}", t)
    return f"({text})"
