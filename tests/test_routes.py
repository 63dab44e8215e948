"""Routes by lookup against routes by conditions, and plans that don't grow with templates."""

import pytest
from pyspark.sql import functions as F

from mutaspark.contract import load
from mutaspark.operators import flows as W
from mutaspark.operators import routes
from mutaspark.plans.adapters import contract


def document(paths):
    lines = ["openapi: 3.0.3", "info: {title: T, version: '1'}", "paths:"]
    for path, methods in paths.items():
        lines.append(f"  {path}:")
        lines += [f"    {m}: {{operationId: {o}, responses: {{'200': {{description: ok}}}}}}" for m, o in methods.items()]
    return "\n".join(lines)


def many(n):
    """n templates in families of four shapes."""
    paths = {}
    for k in range(n // 4):
        paths |= {f"/f{k}": {"post": f"a{k}", "get": f"g{k}"}, f"/f{k}/{{id}}": {"put": f"b{k}"}, f"/f{k}/new": {"post": f"c{k}"}, f"/f{k}/{{id}}/x/{{part}}": {"delete": f"d{k}"}}
    return load("orders", document(paths))


def requests(spark, paths):
    rows = [(i, m, p) for i, (p, m) in enumerate((p, m) for p in paths for m in ("POST", "PUT", "DELETE"))]
    return spark.createDataFrame(rows, "i long, method string, path string")


COLUMNS = ("i", "template", "operation_id", "route", "allow", "path_params")


def told(df):
    return sorted((r.i, r.template, r.operation_id, r.route, tuple(r.allow or ()), tuple(sorted((r.path_params or {}).items())) if r.template else None) for r in df.select(*COLUMNS).collect())


def test_lookup_is_resolution(spark):
    paths = ["/", "/f0", "/f1/new", "/f1/n%65w", "/f2/a", "/f2/a%2Fb", "/f2/1:x", "/f3/a/x/b", "/f3/new/x/new", "/f3/a/y/b", "/f9", "", "x", "/f0/", "/f0//", "/f0/.", "/f0/..", "/f0/%zz", "/f0/a+b", "/f0/%2e", "/a/b/c/d/e/f", "/é/ü"]
    rows, c = requests(spark, paths), many(16)
    assert told(routes.looked_up(rows, [c])) == told(W.resolved(rows, c))
    assert told(routes.looked_up(rows, [contract()])) == told(W.resolved(rows, contract()))
    with_null = rows.withColumn("path", F.when(F.col("i") > 3, F.col("path")))
    assert told(routes.looked_up(with_null, [c])) == told(W.resolved(with_null, c))


def test_services_have_their_own_templates(spark):
    other = load("payments", document({"/f0": {"post": "pay"}}))
    rows = requests(spark, ["/f0", "/f1"]).crossJoin(spark.createDataFrame([("orders",), ("payments",), ("nobody",)], "s string"))
    got = {(r.path, r.method, r.s): r.operation_id for r in routes.looked_up(rows, [many(8), other], "s").collect()}
    assert got["/f0", "POST", "orders"] == "a0" and got["/f0", "POST", "payments"] == "pay" and got["/f0", "POST", "nobody"] is None and got["/f1", "POST", "payments"] is None
    with pytest.raises(ValueError, match="several"):
        routes.looked_up(rows, [many(8), other])


def test_five_thousand_templates_have_the_plan_of_fifty(spark):
    rows = requests(spark, ["/f0", "/f1249/new", "/f1249/7", "/f1249/7/x/8"])
    few, large = routes.looked_up(rows, [many(52)]), routes.looked_up(rows, [many(5000)])
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(large) < 1.1 * size(few) < 50_000
    assert [x[1:4] for x in told(large) if x[3] == "found"] == [("/f0", "a0", "found"), ("/f1249/new", "c1249", "found"), ("/f1249/{id}", "b1249", "found"), ("/f1249/{id}/x/{part}", "d1249", "found")]
