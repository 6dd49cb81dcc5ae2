"""A small parcel API in two versions, as documents and as calling source code."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

TEXT, COUNT = {"type": "string"}, {"type": "integer"}


def _record(required: str = "", **fields) -> dict:
    return {"type": "object", "properties": fields} | ({"required": required.split()} if required else {})


def _json(schema: dict) -> dict:
    return {"content": {"application/json": {"schema": schema}}}


def _reply(status: str, schema: dict) -> dict:
    return {status: {"description": "done"} | _json(schema)}


def _parameter(name: str, place: str) -> dict:
    return {"name": name, "in": place, "required": True, "schema": TEXT}


def documents() -> tuple[str, str]:
    """Between them: a resource gets another name, a payload field a unit, a time another type, an enum a value, a query
    parameter becomes needed, and one operation goes as another comes."""

    def book(weight: str, states: list[str]) -> dict:
        return {"operationId": "bookParcel", "requestBody": {"required": True} | _json(_record(weight, recipient=TEXT, **{weight: COUNT})), "responses": _reply("201", _record("ref", ref=TEXT, state={"enum": states} | TEXT))}

    def stops(time: dict, *more: dict) -> dict:
        return {"operationId": "listStops", "parameters": [_parameter("ref", "path"), *more], "responses": _reply("200", _record("events", events={"type": "array", "items": _record("at", at=time, place=TEXT)}))}

    def document(version: str, paths: dict) -> str:
        return json.dumps({"openapi": "3.0.3", "info": {"title": "Parcel desk", "version": version}, "servers": [{"url": "https://parcels.test"}], "paths": paths})

    void = {"operationId": "voidLabel", "parameters": [_parameter("label", "path")], "responses": {"204": {"description": "gone"}}}
    depots = {"operationId": "listDepots", "responses": _reply("200", {"type": "array", "items": TEXT})}
    old = {"/v2/parcels": {"post": book("weight", ["booked", "moving"])}, "/v2/parcels/{ref}/events": {"get": stops(TEXT)}, "/v2/labels/{label}": {"delete": void}}
    new = {"/v2/shipments": {"post": book("weight_grams", ["booked", "moving", "held"])}, "/v2/shipments/{ref}/events": {"get": stops(COUNT, _parameter("zone", "query"))}, "/v2/depots": {"get": depots}}
    return document("2.3.0", old), document("3.0.0", new)


#: A caller of the old version: a client's method with a payload, a fetch by template, a read of a field, a generated method.
CALLER = """\
import { http } from './http';

const HOST = 'https://parcels.test';

type Stop = { at: string; place: string };

export const book = (weight: number, recipient: string) =>
  http.post(`${HOST}/v2/parcels`, { weight: weight, recipient });

export async function lastStop(ref: string) {
  const reply = await fetch(`${HOST}/v2/parcels/${ref}/events`);
  const last = (await reply.json()) as Stop;
  return `${last.at} ${last.place}`;
}

export const cancel = (id: string, client: Labels) => client.voidLabel(id);
"""


def specs(spark: SparkSession) -> DataFrame:
    old, new = documents()
    return spark.createDataFrame([("demo", "old", "v2.json", old), ("demo", "new", "v3.json", new)], "pair_id string, side string, source string, content string")


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("demo", "src/parcels.ts", CALLER)], "repo string, file string, content string")


def tracked(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(snapshots, current, files) of five tracked documents: the demo's change, one seen first, one as before, two that can't
    be read, now or at first."""
    old, new = documents()
    snapshots = spark.createDataFrame([("parcels", old), ("same", old), ("torn", old)], "spec string, content string")
    now = [("parcels", "v3.json", new), ("first", "v2.json", old), ("same", "v2.json", old), ("torn", "v3.json", new[:-9]), ("never", "v1.json", '{"swagger": "2.0"}')]
    files = spark.createDataFrame([("parcels", "src/parcels.ts", CALLER), ("same", "src/other.ts", CALLER)], "repo string, file string, content string")
    return snapshots, spark.createDataFrame(now, "spec string, source string, content string"), files
