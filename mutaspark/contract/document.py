"""OpenAPI documents: what is ambiguous or can never work is refused when a document is loaded."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

import yaml

from mutaspark.contract.expressions import Expression, ExpressionError, Template, parse_expression, parse_template
from mutaspark.schema import HOP_HEADERS, MUTATIONS, NAMING, SECRET_HEADERS, Naming

METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
SERVICE = re.compile(r"[a-z][a-z0-9-]{0,47}")
PARAMETER = re.compile(r"\{([A-Za-z_][A-Za-z0-9_.-]*)\}")
TOPIC = re.compile(r"[a-zA-Z0-9._-]{1,249}")
EVENT_TYPE = re.compile(r"[A-Za-z][A-Za-z0-9_.]*")


class _Loader(yaml.SafeLoader):
    """YAML with true and false as its only booleans, so that a field may be called on."""


_Loader.yaml_implicit_resolvers = {k: [(tag, r) for tag, r in v if tag != "tag:yaml.org,2002:bool"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


class ContractError(ValueError):
    """A document that can't be served without guessing."""


@dataclass(frozen=True)
class EventMapping:
    on: int
    topic: str
    type: str
    key: Expression
    value: Template


@dataclass(frozen=True)
class Operation:
    service: str
    id: str
    method: str
    template: str
    retry_safe: bool = False
    event: EventMapping | None = None
    security: tuple[tuple[str, ...], ...] = ()

    @property
    def mutation(self) -> bool:
        return self.method in MUTATIONS

    @property
    def replayable(self) -> bool:
        """Whether running it twice does no more than running it once."""
        return self.method in ("PUT", "DELETE") or self.retry_safe


@dataclass(frozen=True)
class Secrets:
    """Where the contract says that credentials travel."""

    headers: tuple[str, ...] = ()
    query: tuple[str, ...] = ()
    cookies: tuple[str, ...] = ()


@dataclass(frozen=True)
class Contract:
    service: str
    operations: tuple[Operation, ...]
    schemes: dict
    secrets: Secrets

    def operation(self, operation_id: str) -> Operation | None:
        return next((o for o in self.operations if o.id == operation_id), None)

    def resolve(self, method: str, escaped_path: str) -> tuple[Operation | None, dict, list[str]]:
        """(operation, parameters, allowed): the best template for a path is found first, whatever its methods; without the method, allowed says what it has."""
        segments = split_path(escaped_path)
        matching = [t for t in {o.template for o in self.operations} if segments is not None and fits(segments_of(t), segments)]
        if not matching:
            return None, {}, []
        best = min(matching, key=specificity)
        own = {o.method: o for o in self.operations if o.template == best}
        if method not in own:
            return None, {}, sorted(own)
        names = [PARAMETER.fullmatch(s) for s in segments_of(best)]
        return own[method], {m[1]: v for m, v in zip(names, segments, strict=True) if m}, []

    def drift(self, operation_id: str, method: str, template: str, path: str, params: dict) -> str | None:
        """Why a command isn't what this contract makes of its path, or None."""
        found, found_params, _ = self.resolve(method, path)
        if found is None:
            return "unresolved"
        if (found.id, found.template) != (operation_id, template):
            return "another_operation"
        return None if found_params == (params or {}) else "other_parameters"


def segments_of(template: str) -> list[str]:
    return [] if template == "/" else template[1:].split("/")


def split_path(path: str) -> list[str] | None:
    """Decoded segments; None for paths that match nothing: empty or dot segments, bad escapes."""
    if not path.startswith("/"):
        return None
    if path == "/":
        return []
    out = []
    for raw in path[1:].split("/"):
        if re.search(r"%(?![0-9A-Fa-f]{2})", raw):
            return None
        value = unquote(raw, errors="surrogateescape")
        if value in ("", ".", ".."):
            return None
        out.append(value)
    return out


def fits(template: list[str], segments: list[str]) -> bool:
    return len(template) == len(segments) and all(PARAMETER.fullmatch(t) or t == s for t, s in zip(template, segments, strict=True))


def specificity(template: str) -> str:
    """Sorts a literal before a parameter, from the left."""
    return "".join("p" if PARAMETER.fullmatch(s) else "l" for s in segments_of(template))


def load(service: str, text: str, naming: Naming = NAMING) -> Contract:
    """Compiles a document, YAML or JSON."""
    if not SERVICE.fullmatch(service):
        raise ContractError(f"service name {service!r}")
    try:
        doc = yaml.load(text, _Loader)
    except yaml.YAMLError as wrong:
        raise ContractError(f"{service}: {wrong}") from None
    if not isinstance(doc, dict) or not str(doc.get("openapi", "")).startswith("3.") or not isinstance(doc.get("paths"), dict):
        raise ContractError(f"{service}: not an OpenAPI 3 document")
    if external := re.search(r"\$ref['\"]?\s*:\s*['\"]?(?!#)([^\s'\",}]+)", text):
        raise ContractError(f"{service}: external reference {external[1]}")
    schemes, secrets = _security(doc)
    shapes, ids, operations = {}, set(), []
    for template, item in doc["paths"].items():
        where = f"{service} {template}"
        if ours := [k for k in item if k.startswith(naming.extensions)]:
            raise ContractError(f"{where}: {ours[0]} belongs to operations")
        shape = _shape(template, where)
        if shape in shapes:
            raise ContractError(f"{where}: ambiguous with {shapes[shape]}")
        shapes[shape] = template
        for method in METHODS:
            if method in item:
                op = _operation(service, method.upper(), template, item[method] or {}, doc, schemes, naming)
                if op.id:
                    if op.id in ids:
                        raise ContractError(f"{where}: operationId {op.id} occurs twice")
                    ids.add(op.id)
                operations.append(op)
    return Contract(service, tuple(sorted(operations, key=lambda o: f"{o.template} {o.method}")), schemes, secrets)


def _shape(template: str, where: str) -> str:
    if not template.startswith("/"):
        raise ContractError(f"{where}: starts with /")
    out, seen = [], set()
    for s in segments_of(template):
        m = PARAMETER.fullmatch(s)
        if s == "" or (not m and re.search("[{}]", s)):
            raise ContractError(f"{where}: segment {s!r}")
        if m and m[1] in seen:
            raise ContractError(f"{where}: parameter {m[1]} occurs twice")
        seen |= {m[1]} if m else set()
        out.append("{}" if m else s)
    return "/".join(out)


def _operation(service, method, template, o, doc, schemes, naming: Naming) -> Operation:
    where = f"{service} {method} {template}"
    name, mutation = o.get("operationId") or "", method in MUTATIONS
    if mutation and not name:
        raise ContractError(f"{where}: a mutation needs an operationId")
    ours = {naming.event_extension, naming.retry_extension}
    for key in o:
        if key.startswith(naming.extensions) and key not in ours:
            raise ContractError(f"{where}: unknown extension {key}")
    retry = o.get(naming.retry_extension, False)
    if not isinstance(retry, bool):
        raise ContractError(f"{where}: {naming.retry_extension} is true or false")
    event = None
    if naming.event_extension in o:
        if not mutation:
            raise ContractError(f"{where}: only mutations have results to derive events from")
        event = _event(o[naming.event_extension], template, o, where)
    required = o["security"] if o.get("security") is not None else doc.get("security") or []
    alternatives = tuple(tuple(sorted(r)) for r in required)
    for scheme in (s for a in alternatives for s in a):
        if scheme not in schemes:
            raise ContractError(f"{where}: security scheme {scheme} isn't declared")
    return Operation(service, name, method, template, retry, event, alternatives)


def _event(m, template: str, o: dict, where: str) -> EventMapping:
    def need(ok, what: str):
        if not ok:
            raise ContractError(f"{where}: {what}")

    need(isinstance(m, dict), "an event is an object")
    need(set(m) <= {"on", "topic", "type", "key", "value"}, "unknown field in event")
    on = m.get("on")
    need(isinstance(on, (int, float)) and not isinstance(on, bool) and on == int(on), "on is a status")
    need(str(int(on)) in {str(k) for k in o.get("responses") or {}}, f"status {on} isn't declared")
    need(200 <= on <= 299, f"status {on} is no success")
    topic = m.get("topic")
    need(isinstance(topic, str) and TOPIC.fullmatch(topic) and topic not in (".", ".."), "topic")
    need(not topic.startswith("http."), f"topic {topic} is reserved")
    need(isinstance(m.get("type"), str) and EVENT_TYPE.fullmatch(m["type"]), "type is an identifier")
    need(isinstance(m.get("key"), str), "key is an expression")
    need(isinstance(m.get("value"), dict), "value is an object")
    try:
        key, value = parse_expression(m["key"]), parse_template(m["value"])
    except ExpressionError as wrong:
        raise ContractError(f"{where}: {wrong}") from None
    params = {p[1] for p in map(PARAMETER.fullmatch, segments_of(template)) if p}
    for e in (key, *value.expressions()):
        name = e.steps[0] if e.steps else ""
        need(e.source != "request.pathParams" or name in params, f"{e.text}: no such path parameter")
        need(e.source != "request.headers" or name not in HOP_HEADERS + SECRET_HEADERS, f"{e.text}: header never travels")
        need(e.source != "response.headers" or name not in (*HOP_HEADERS, "set-cookie"), f"{e.text}: header is no event data")
    return EventMapping(int(on), topic, m["type"], key, value)


def _security(doc: dict) -> tuple[dict, Secrets]:
    schemes, places = (doc.get("components") or {}).get("securitySchemes") or {}, {"header": set(), "query": set(), "cookie": set()}
    for name, s in schemes.items():
        kind = (s or {}).get("type")
        if kind == "apiKey":
            if s.get("in") not in places:
                raise ContractError(f"security scheme {name}: key in {s.get('in')}")
            places[s["in"]].add(s["name"].lower() if s["in"] == "header" else s["name"])
        elif kind in ("http", "oauth2", "openIdConnect"):
            places["header"].add("authorization")
        elif kind != "mutualTLS":
            raise ContractError(f"security scheme {name}: type {kind}")
    return schemes, Secrets(*(tuple(sorted(places[p])) for p in ("header", "query", "cookie")))


def parse_credentials(text: str, service: str) -> dict[str, str]:
    """This service's entries of "service.scheme=value,…"."""
    out = {}
    for entry in filter(None, (e.strip() for e in text.split(","))):
        name, sep, value = entry.partition("=")
        owner, dot, scheme = name.partition(".")
        if not (sep and dot and owner and scheme and value):
            raise ContractError("a credential is service.scheme=value")
        if owner == service:
            out[scheme] = value
    return out


def credential_problems(contract: Contract, credentials: dict[str, str]) -> list[str]:
    """Unknown schemes, and operations of which no alternative can be met."""
    out = [f"unknown scheme {s}" for s in sorted(credentials) if s not in contract.schemes]
    for o in contract.operations:
        if o.security and not any(all(s in credentials or contract.schemes[s].get("type") == "mutualTLS" for s in a) for a in o.security):
            out.append(f"{o.id or o.method + ' ' + o.template}: no alternative can be met")
    return out


def injected(contract: Contract, operation: Operation, credentials: dict[str, str]) -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """(headers, query, cookies) that the first alternative that can be met adds to a call."""
    for alternative in operation.security:
        if all(s in credentials for s in alternative):
            out = {"header": {}, "query": {}, "cookie": {}}
            for s in alternative:
                scheme = contract.schemes[s]
                if scheme["type"] == "apiKey":
                    out[scheme["in"]][scheme["name"]] = credentials[s]
                else:
                    kind = str(scheme.get("scheme", "bearer")).lower()
                    out["header"]["authorization"] = f"{'Basic' if kind == 'basic' else 'Bearer'} {credentials[s]}"
            return out["header"], out["query"], out["cookie"]
    return {}, {}, {}
