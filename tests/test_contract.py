"""Contracts: resolution, specificity, what is refused at load, expressions, credentials.

Documents are built as objects: one lending library that is accepted as it is, and for each rule of the loader one
change that breaks this rule alone.
"""

import copy
import json

import pytest

from mutaspark.contract import ContractError, load
from mutaspark.contract.document import METHODS, credential_problems, injected, parse_credentials
from mutaspark.contract.expressions import Exchange, ExpressionError, Unresolved, encode, decode, parse_expression, parse_template, render_key, render_value
from mutaspark.schema import HOP_HEADERS, NAMING, SECRET_HEADERS

DONE = {"200": {"description": "done"}}
LENT = {"on": 200, "topic": "library.loans", "type": "Loan.Opened", "key": "$.response.body.loan", "value": {"loan": "$.response.body.loan", "by": "$.request.pathParams.member"}}
LIBRARY = {
    "openapi": "3.1.0",
    "info": {"title": "library", "version": "2"},
    "components": {"securitySchemes": {"desk": {"type": "apiKey", "in": "header", "name": "X-Desk"}}},
    "paths": {
        "/members/{member}/loans": {"post": {"operationId": "lend", "responses": DONE, NAMING.event_extension: LENT}, "get": {"responses": DONE}},
        "/members/new/loans": {"put": {"operationId": "enrol", "responses": DONE}},
        "/members/{member}/{what}": {"patch": {"operationId": "amend", "responses": DONE, NAMING.retry_extension: True}},
        "/": {"delete": {"operationId": "close", "responses": DONE, "security": [{"desk": []}]}},
    },
}
LOANS = "/members/{member}/loans"


def changed(*steps, value=None, drop=False, of=LIBRARY):
    """The library with one place of it set to a value or dropped."""
    out = copy.deepcopy(of)
    at = out
    for step in steps[:-1]:
        at = at[step]
    if drop:
        del at[steps[-1]]
    else:
        at[steps[-1]] = value
    return out


def event(**over):
    return changed("paths", LOANS, "post", NAMING.event_extension, value=LENT | over)


def test_the_library_is_accepted():
    c = load("library", json.dumps(LIBRARY))
    assert c.operation("lend").event.type == "Loan.Opened" and not c.operation("lend").replayable
    assert c.operation("amend").replayable and c.operation("enrol").replayable and c.operation("close").replayable
    assert [o.method for o in c.operations if not o.mutation] == ["GET"] and c.secrets.headers == ("x-desk",)


def test_literals_go_before_parameters():
    """Of all templates of three segments over two literals and a parameter, each path finds the one that is literal furthest to the left."""
    shapes = [(x, y) for x in ("in", "out", "{x}") for y in ("in", "out", "{y}")]
    paths = {f"/shelf/{x}/{y}": {"post": {"operationId": f"{x}-{y}".replace("{", "").replace("}", ""), "responses": DONE}} for x, y in shapes}
    c = load("library", json.dumps(changed("paths", value=paths)))
    for x in ("in", "out", "attic"):
        for y in ("in", "out", "cellar"):
            op, params, allowed = c.resolve("POST", f"/shelf/{x}/{y}")
            assert op.id == f"{x if x != 'attic' else 'x'}-{y if y != 'cellar' else 'y'}" and allowed == []
            assert params == {k: v for k, v in (("x", x), ("y", y)) if v in ("attic", "cellar")}


@pytest.mark.parametrize("method", [m.upper() for m in METHODS])
def test_the_path_is_found_before_the_method(method):
    """/members/new/loans only knows PUT, though a template with a parameter there would take other methods."""
    op, _, allowed = load("library", json.dumps(LIBRARY)).resolve(method, "/members/new/loans")
    assert (op.id, allowed) == ("enrol", []) if method == "PUT" else (op, allowed) == (None, ["PUT"])


@pytest.mark.parametrize("path", ["", "members/1/loans", "/members//loans", "/members/../loans", "/members/%2e%2E/loans", "/members/%4/loans", "/members/1/loans/", "/members/1", "//"])
def test_paths_that_nothing_serves(path):
    assert load("library", json.dumps(LIBRARY)).resolve("POST", path) == (None, {}, [])


def test_escapes_are_decoded_within_segments():
    c = load("library", json.dumps(LIBRARY))
    assert c.resolve("POST", "/members/a%2Fb%20%C3%A9/loans")[1] == {"member": "a/b é"}
    assert c.resolve("PUT", "/members/n%65w/loans")[0].id == "enrol" and c.resolve("DELETE", "/")[0].id == "close"


BROKEN = [
    ("not an OpenAPI 3", changed("openapi", value="2.0")),
    ("not an OpenAPI 3", changed("paths", drop=True)),
    ("external reference", changed("info", "license", value={"$ref": "else.yaml#/x"})),
    ("starts with /", changed("paths", "members", value={})),
    ("segment", changed("paths", "/members/{member}s", value={})),
    ("segment", changed("paths", "/members/", value={})),
    ("occurs twice", changed("paths", "/{a}/by/{a}", value={})),
    ("ambiguous", changed("paths", "/members/{who}/loans", value={})),
    ("belongs to operations", changed("paths", LOANS, NAMING.event_extension, value=LENT)),
    ("needs an operationId", changed("paths", LOANS, "post", "operationId", drop=True)),
    ("lend occurs twice", changed("paths", "/", "delete", "operationId", value="lend")),
    ("unknown extension", changed("paths", LOANS, "post", NAMING.extensions + "evnt", value=LENT)),
    ("true or false", changed("paths", LOANS, "post", NAMING.retry_extension, value=1)),
    ("only mutations", changed("paths", LOANS, "get", NAMING.event_extension, value=LENT)),
    ("isn't declared", changed("paths", "/", "delete", "security", value=[{"door": []}])),
    ("key in", changed("components", "securitySchemes", "desk", "in", value="body")),
    ("type", changed("components", "securitySchemes", "desk", "type", value="stamp")),
    ("an object", changed("paths", LOANS, "post", NAMING.event_extension, value="Loan.Opened")),
    ("unknown field", event(unless="late")),
    ("on is a status", event(on=True)),
    ("isn't declared", event(on=204)),
    ("no success", changed("paths", LOANS, "post", "responses", value={"302": {}}, of=event(on=302))),
    ("topic", event(topic="library loans")),
    ("reserved", event(topic="http.library")),
    ("identifier", event(type="9lives")),
    ("key is an expression", event(key=7)),
    ("value is an object", event(value=["$.response.body.loan"])),
    ("answer", event(key="$.answer.body.loan")),
    ("no such path parameter", event(key="$.request.pathParams.shelf")),
    *[("never travels", event(value={"x": f"$.request.headers.{h.title()}"})) for h in (SECRET_HEADERS[0], HOP_HEADERS[0])],
    *[("no event data", event(value={"x": f"$.response.headers.{h}"})) for h in ("Set-Cookie", HOP_HEADERS[-1])],
]


@pytest.mark.parametrize("said, document", BROKEN)
def test_refused(said, document):
    with pytest.raises(ContractError, match=said):
        load("library", json.dumps(document))


@pytest.mark.parametrize("service", ["", "Library", "9", "a" * 49, "a_b"])
def test_service_names_refused(service):
    with pytest.raises(ContractError):
        load(service, json.dumps(LIBRARY))


def exchange(**over):
    """A loan: numbers beyond doubles and with trailing zeros, a null, text that HTML escapes, a query with a name twice and one without a value."""
    base = {
        "request_body": b'{"reader":"r7","until":null,"books":[{"title":"R<&>D","copies":3}]}', "response_body": b'{"loan":"l-1","number":36028797018963969,"fee":0.250}',
        "path_params": {"member": "m1"}, "raw_query": "desk=north&tag=a&tag=b&odd", "request_headers": {"x-branch": ["main", "side"]}, "response_headers": {"last-modified": ["today"]},
    }
    return Exchange(**(base | over))


def test_exact_rendering():
    template = {"number": "$.response.body.number", "fee": "$.response.body.fee", "until": "$.request.body.until", "title": "$.request.body.books[0].title", "fixed": "a>b", "from": {"desk": "$.request.query.desk"}, "branch": "$.request.headers.X-Branch"}
    problems = []
    want = '{"branch":"main","fee":0.250,"fixed":"a\\u003eb","from":{"desk":"north"},"number":36028797018963969,"title":"R<&>D","until":null}'
    assert render_value(exchange(), parse_template(template), problems) == want and not problems


@pytest.mark.parametrize(
    "text, said",
    [
        ("$.response.body.shelf", "absent"), ("$.request.body.books[1].title", "absent"), ("$.request.body.reader.name", "not an object"), ("$.request.body.books.title", "not an object"), ("$.response.body[0]", "not an array"),
        ("$.request.query.tag", "2 times"), ("$.request.query.shelf", "absent"), ("$.request.headers.x-shelf", "absent"), ("$.request.pathParams.shelf", "absent"),
    ],
)
def test_unresolved(text, said):
    with pytest.raises(Unresolved, match=said):
        exchange().evaluate(parse_expression(text))


@pytest.mark.parametrize("body, said", [(b"", "empty"), (None, "empty"), (b"<p>", "not JSON"), (b"NaN", "not JSON")])
def test_bodies_that_are_not_json(body, said):
    with pytest.raises(Unresolved, match=said):
        exchange(response_body=body).evaluate(parse_expression("$.response.body.loan"))


def test_keys():
    key = parse_expression("$.response.body.loan")
    assert render_key(exchange(), key) == "l-1" and render_key(exchange(), parse_expression("$.response.body.number")) == "36028797018963969"
    for value in ('""', "null", "false", "[]", "{}"):
        with pytest.raises(Unresolved):
            render_key(exchange(response_body=b'{"loan":%s}' % value.encode()), key)


@pytest.mark.parametrize("text", ["id", "$.nowhere.id", "$.request.body.", "$.request.body[01]", "$.request.body[1234567]", "$.request.query", "$.request.query.a.b", "$.request.headers[0]", "$.request.bodyx"])
def test_expressions_refused(text):
    with pytest.raises(ExpressionError):
        parse_expression(text)


def test_json_tokens_survive():
    raw = '{"b":1e400,"a":-0,"c":[1.0,true,null,"x\\u2028"]}'
    assert encode(decode(raw)) == '{"a":-0,"b":1e400,"c":[1.0,true,null,"x\\u2028"]}'


def test_credentials():
    secured = changed("paths", LOANS, "post", "security", value=[{"badge": [], "desk": []}, {"desk": []}])
    secured = changed("components", "securitySchemes", value={"desk": {"type": "apiKey", "in": "query", "name": "desk"}, "badge": {"type": "http", "scheme": "bearer"}}, of=secured)
    c = load("library", json.dumps(secured))
    assert c.secrets.headers == ("authorization",) and c.secrets.query == ("desk",)
    have = parse_credentials("library.desk=1, archive.desk=2", "library")
    assert have == {"desk": "1"} and credential_problems(c, have) == [] and credential_problems(c, {"x": "1"})[0] == "unknown scheme x"
    assert injected(c, c.operation("lend"), have) == ({}, {"desk": "1"}, {})
    assert injected(c, c.operation("lend"), {"desk": "1", "badge": "t"})[0] == {"authorization": "Bearer t"}
    with pytest.raises(ContractError):
        parse_credentials("nonsense", "library")
