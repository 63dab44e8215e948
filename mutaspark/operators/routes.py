"""Routes of many operations: templates are a table, and a request looks its own up by the places that are literal."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mutaspark.contract import Contract, ContractError, load
from mutaspark.contract.document import PARAMETER, segments_of, specificity
from mutaspark.functions import columns as C

#: Templates up to which their table is sent to every task; a larger one is joined as Spark sees fit.
SENT = 100_000
ROUTE = "route_key string, template string, params array<struct<name:string,place:int>>, methods map<string,string>, allow array<string>"


def route_key(service: str, template: str) -> str:
    """A template's service, its mask and its literals, each with its length, so that no two run together."""
    literals = [s for s in segments_of(template) if not PARAMETER.fullmatch(s)]
    return f"{service}|{specificity(template)}|" + "".join(f"{len(s.encode())}:{s}" for s in literals)


def route_table(spark: SparkSession, contracts: list[Contract]) -> DataFrame:
    """One row a template of each service: its key, its parameters' places, and its operations by method."""
    own: dict[tuple[str, str], dict[str, str]] = {}
    for c in contracts:
        for o in c.operations:
            own.setdefault((c.service, o.template), {})[o.method] = o.id
    rows = []
    for (service, template), methods in own.items():
        params = [(m[1], i) for i, s in enumerate(segments_of(template)) if (m := PARAMETER.fullmatch(s))]
        rows.append((route_key(service, template), template, params, methods, sorted(methods)))
    return spark.createDataFrame(rows, ROUTE)


def masks_by_length(contracts: list[Contract]) -> dict[int, list[str]]:
    """The masks that templates of each number of segments have (l: literal, p: parameter), the most specific first. Few, however many templates there are."""
    found: dict[int, set[str]] = {}
    for c in contracts:
        for o in c.operations:
            found.setdefault(len(segments_of(o.template)), set()).add(specificity(o.template))
    return {n: sorted(masks) for n, masks in found.items()}


def looked_up(requests: DataFrame, contracts: list[Contract], service: str | None = None, method: str = "method", path: str = "path") -> DataFrame:
    """Requests with operation_id, template, path_params, route and allow, as `flows.resolved` gives them, by equi-joins with the table of templates.

    A request has a key for each mask of its number of segments, the most specific first, and the first that finds
    a template decides; two templates of one mask can't both fit. So the plan grows with the most masks of one
    length, not with the templates. service: the column of the service asked; without it, that of the one contract.
    """
    if service is None and len(contracts) != 1:
        raise ValueError("of several contracts, the requests' service must be told")
    masks = masks_by_length(contracts)
    table = route_table(requests.sparkSession, contracts)
    table = F.broadcast(table) if sum(len(c.operations) for c in contracts) <= SENT else table
    raw = F.when(F.col(path) == "/", F.array().cast("array<string>")).otherwise(F.split(F.substring(F.col(path), 2, 1 << 30), "/"))
    segments = F.when(F.col(path).startswith("/"), F.transform(raw, lambda s: F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))))
    usable = lambda x: F.forall(x, lambda s: F.coalesce(~s.isin("", ".", ".."), F.lit(False)))
    rows = requests.withColumn("route_segments", C.bound(segments, lambda x: F.when(usable(x), x)))
    known = F.create_map(*[x for n, m in masks.items() for x in (F.lit(n), F.array(*map(F.lit, m)))]) if masks else F.create_map().cast("map<int,array<string>>")
    rows = rows.withColumn("route_masks", F.try_element_at(known, F.size("route_segments")))
    of = F.lit(contracts[0].service) if service is None else F.col(service)

    def probe(k: int) -> Column:
        mask = F.try_element_at("route_masks", F.lit(k + 1))
        literals = F.filter("route_segments", lambda s, i: F.substr(mask, i + 1, F.lit(1)) == "l")
        return F.concat(of, F.lit("|"), mask, F.lit("|"), F.array_join(F.transform(literals, lambda s: F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)), ""))

    most = max(map(len, masks.values()), default=0)
    for k in range(most):
        route = table.select(F.col("route_key").alias(f"route_key_{k}"), F.struct("template", "params", "methods", "allow").alias(f"route_{k}"))
        rows = rows.withColumn(f"route_probe_{k}", probe(k)).join(route, F.col(f"route_probe_{k}") == F.col(f"route_key_{k}"), "left").drop(f"route_probe_{k}", f"route_key_{k}")
    none = F.lit(None).cast("struct<template:string,params:array<struct<name:string,place:int>>,methods:map<string,string>,allow:array<string>>")
    rows = rows.withColumn("routed", F.coalesce(*[F.col(f"route_{k}") for k in range(most)], none))
    params = F.map_from_entries(F.transform("routed.params", lambda p: F.struct(p["name"].alias("key"), F.get("route_segments", p["place"]).alias("value"))))
    rows = rows.withColumns({"template": F.col("routed.template"), "path_params": params, "operation_id": F.try_element_at("routed.methods", F.col(method))})
    route = F.when(F.col("template").isNull(), "not_found").when(F.col("operation_id").isNull(), "method_not_allowed").otherwise("found")
    rows = rows.withColumn("route", route).withColumn("allow", F.when(F.col("route") == "method_not_allowed", F.col("routed.allow")))
    return rows.drop("route_segments", "route_masks", "routed", *[f"route_{k}" for k in range(most)])


def compiled_documents(documents: DataFrame) -> DataFrame:
    """Contracts as a table (service, document and whatever else), each compiled where it lies: served, problem (why not, or null) and operations, an array of id, method, template, mutation and the event's topic, by template and method."""
    shape = "served boolean, problem string, operations array<struct<id:string,method:string,template:string,mutation:boolean,event_topic:string>>"

    def one(service: str, document: str):
        try:
            c = load(service or "", document or "")
        except ContractError as refused:
            return False, str(refused)[:500], []
        return True, None, [{"id": o.id, "method": o.method, "template": o.template, "mutation": o.mutation, "event_topic": o.event.topic if o.event else None} for o in sorted(c.operations, key=lambda o: (o.template, o.method))]

    def compile_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = pd.DataFrame([one(s, d) for s, d in zip(frame["service"], frame["document"], strict=True)], columns=["served", "problem", "operations"], index=frame.index)
            yield pd.concat([frame.drop(columns="document"), found], axis=1)

    kept = documents.drop("served", "problem", "operations")
    schema = T.StructType([f for f in kept.schema.fields if f.name != "document"] + T.StructType.fromDDL(shape).fields)
    return kept.mapInPandas(compile_all, schema)
