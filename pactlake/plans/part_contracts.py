"""OpenAPI documents and calling source code made from the parts table: every part is an operation of its brand's contract.

A brand's parts are cut into documents by key, so that no document grows with the table. What happens to a part between its
old and its new document follows from its key modulo 8: nothing, a response field's type changes, a response field goes, a
parameter becomes required, the operation goes, the operation comes, it is deprecated, a response field is renamed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.sources.tables import table

#: Keys of one document.
SPAN = 500
#: Portable SQL over `part`: pair_id, k (the part's key), c (its case), method, path.
PARTS = f"""SELECT lower(replace(p_brand, '#', '-')) || '-' || CAST(p_partkey - p_partkey % {SPAN} AS STRING) AS pair_id, p_partkey AS k, p_partkey % 8 AS c,
CASE WHEN p_partkey % 3 = 0 THEN 'post' ELSE 'get' END AS method, CASE p_partkey % 8 WHEN 4 THEN '/gone/' WHEN 5 THEN '/come/' ELSE '/v1/' END || 'p' || CAST(p_partkey AS STRING) AS path FROM {{part}}"""


def parts_sql() -> str:
    return "(" + PARTS.replace("{part}", "part") + ")"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PARTS, part=table(spark, sf_dir, "part"))


def _text(*pieces) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in pieces])


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, side, source, content of both documents of every pair."""
    # Parts travel as they are; their texts are made, and read, where a document's parts have met. That costs far more than
    # the bytes of the parts say: a fixed number of tasks.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    met = parts(spark, sf_dir).repartition(n, "pair_id").groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("k", "c", "method", "path"))).alias("p"))
    sides = met.withColumn("side", F.explode(F.array(F.lit("old"), F.lit("new"))))
    new = F.col("side") == "new"
    held = sides.withColumn("p", F.filter("p", lambda x: ~((x["c"] == 4) & new) & ~((x["c"] == 5) & ~new))).filter(F.size("p") > 0)

    def texts(x: Column) -> tuple[Column, Column]:
        k, c = x["k"].cast("string"), x["c"]
        when = lambda case, a, b: F.when((c == case) & new, F.lit(a)).otherwise(F.lit(b))
        fields = _text(
            '"name": {"type": "string"}', F.when(new & c.isin(2, 7), "").otherwise(', "price": {"type": "number"}'), when(7, ', "priceCents": {"type": "number"}', ""),
            ', "size": {"type": "', when(1, "string", "integer"), '"}',
        )
        schema = _text('"P', k, '": {"type": "object", "required": ["name"], "properties": {', fields, "}}")
        # What goes has a request body and what comes a reply: the one can't be the other under a new path.
        reply = _text('{"200": {"description": "x", "content": {"application/json": {"schema": {"$ref": "#/components/schemas/P', k, '"}}}}}')
        body = '"requestBody": {"content": {"application/json": {"schema": {"type": "object", "properties": {"weight": {"type": "number"}}}}}}, "responses": {"204": {"description": "x"}}'
        zone = _text('"parameters": [{"name": "zone", "in": "query", "required": ', when(3, "true", "false"), ', "schema": {"type": "string"}}], "responses": ', reply)
        return _text('"', x["path"], '": {"', x["method"], '": {"operationId": "part', k, '", "deprecated": ', when(6, "true", "false"), ", ", F.when(c == 4, F.lit(body)).otherwise(zone), "}}"), schema

    joined = lambda i: F.array_join(F.transform("p", lambda x: texts(x)[i]), ", ")
    docs = held.select("pair_id", "side", joined(0).alias("ops"), joined(1).alias("schemas"))
    version = F.when(F.col("side") == "old", "1.0").otherwise("2.0")
    content = _text('{"openapi": "3.0.3", "info": {"title": "Parts of ', F.col("pair_id"), '", "version": "', version, '"}, "paths": {', F.col("ops"), '}, "components": {"schemas": {', F.col("schemas"), "}}}")
    return docs.select("pair_id", "side", _text(F.col("side"), ".json").alias("source"), content.alias("content"))


#: The caller of a part: it fetches it and casts the answer to a type of its own.
CALLER = "interface Part%s { name: string; price: number; size: number }\nexport async function load() {\n  const r = await fetch('%s', { method: '%s' });\n  return (await r.json()) as Part%s;\n}\n"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, file, content: one caller a part that the old documents have."""
    k = F.col("k").cast("string")
    return parts(spark, sf_dir).filter("c <> 5").select(F.col("pair_id").alias("repo"), _text("src/p", k, ".ts").alias("file"), F.format_string(CALLER, k, F.col("path"), F.upper("method"), k).alias("content"))


def tracked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(snapshots, current) of the documents: some pairs are seen first, some stand as they were, some can't be read now."""
    docs = specs(spark, sf_dir)
    case = (F.element_at(F.split("spec", "-"), -1).cast("long") / SPAN % 4).cast("int")
    old = docs.filter("side = 'old'").select(F.col("pair_id").alias("spec"), "content").withColumn("x", case)
    new = docs.filter("side = 'new'").select(F.col("pair_id").alias("spec"), "source", F.col("content").alias("new_content"))
    both = new.join(old, "spec", "left")
    now = F.when(F.col("x") == 2, F.col("content")).when(F.col("x") == 3, F.substr("new_content", F.lit(1), F.length("new_content") - 9)).otherwise(F.col("new_content"))
    return old.filter("x <> 1").select("spec", "content"), both.select("spec", "source", now.alias("content"))
