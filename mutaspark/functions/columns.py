"""Column builders for records of the mutation stream. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from mutaspark.schema import FAULTS, HOP_HEADERS, MUTATIONS, NAMING, SECRET_HEADERS, Naming

ColumnOrName = Column | str
ULID = r"(?i)^[0-7][0-9A-HJKMNP-TV-Z]{25}$"
SERVICE_NAME = r"^[a-z][a-z0-9-]{0,47}\z"
TOKEN = r"^[a-z0-9!#$%&'*+.^_`|~-]+\z"


def _col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, however often f uses it. Without this, a filter on f copies the value's whole expression to each of its uses."""
    return F.transform(F.array(value), f)[0]


def empty_if_null(x: ColumnOrName) -> Column:
    return F.coalesce(_col(x), F.lit(""))


def hash_fields(*fields: ColumnOrName) -> Column:
    """SHA-256 over each field's length in bytes, a colon and its bytes, so that no two lists of fields run together; null is empty."""
    parts = []
    for f in fields:
        raw = F.coalesce(_col(f).cast("binary"), F.lit("").cast("binary"))
        parts += [F.concat(F.octet_length(raw).cast("string"), F.lit(":")).cast("binary"), raw]
    return F.sha2(F.concat(*parts), 256)


def dedup_key(request_id, application, service, operation_id, idempotency_key) -> Column:
    """One mutation's scope: the caller's application, service, operation and key where it gave one, else the request alone. Instances of one application share it."""
    key = empty_if_null(idempotency_key)
    scoped = F.concat(F.lit("i:"), hash_fields(application, service, operation_id, key))
    return F.when(key == "", F.concat(F.lit("r:"), _col(request_id))).otherwise(scoped)


def fingerprint(method, path, raw_query, content_type, body) -> Column:
    """Identity of a request's payload within its scope."""
    return hash_fields(method, path, raw_query, content_type, body)


def request_url(path, raw_query) -> Column:
    q = empty_if_null(raw_query)
    return F.when(q == "", _col(path)).otherwise(F.concat(_col(path), F.lit("?"), q))


def topic_of(kind: str, service: ColumnOrName, naming: Naming = NAMING) -> Column:
    return F.concat(F.lit(getattr(naming, f"{kind}_topics")), _col(service))


def service_of_topic(topic: ColumnOrName, naming: Naming = NAMING) -> Column:
    """The name after the topic's prefix; null for other topics."""
    t = _col(topic)
    out = F.lit(None).cast("string")
    for prefix in (naming.command_topics, naming.reply_topics, naming.result_topics):
        out = F.when(t.startswith(prefix), F.substring(t, len(prefix) + 1, 1 << 30)).otherwise(out)
    return out


def service_of_host(host: ColumnOrName) -> Column:
    """First label of a host without its port, in lower case."""
    return F.split_part(F.lower(F.regexp_replace(_col(host), r":[0-9]+$", "")), F.lit("."), F.lit(1))


def is_mutation(method: ColumnOrName) -> Column:
    """Whether a method goes through the log; case matters."""
    return _col(method).isin(*MUTATIONS)


def capitalised(text: ColumnOrName) -> Column:
    """An ASCII first letter in upper case; all else as it is. Letters are translated: upper() asks ICU, which was the most frequent place in samples of a signed log's derivation."""
    t = _col(text)
    return F.concat(F.translate(F.substring(t, 1, 1), ascii_lowercase, ascii_uppercase), F.substring(t, 2, 1 << 30))


def result_type(operation_id, outcome) -> Column:
    return F.concat(capitalised(empty_if_null(operation_id)), _col(outcome))


def event_source(service, operation_id) -> Column:
    return F.concat(F.lit("/services/"), _col(service), F.lit("/operations/"), _col(operation_id))


def is_ulid(text: ColumnOrName) -> Column:
    return F.coalesce(_col(text).rlike(ULID), F.lit(False))


def ulid(millis: ColumnOrName, high: ColumnOrName, low: ColumnOrName) -> Column:
    """A new id: 48 bits of time, then 80 bits of chance as two whole numbers of 40 bits, in digits of base 32."""
    digits = lambda x, n: F.lpad(F.translate(F.lower(F.conv(_col(x).cast("string"), 10, 32)), "abcdefghijklmnopqrstuv", "ABCDEFGHJKMNPQRSTVWXYZ"), n, "0")
    return F.concat(digits(millis, 10), digits(high, 8), digits(low, 8))


def ulid_millis(text: ColumnOrName) -> Column:
    """Milliseconds since 1970 in a ULID's first ten characters; null if it isn't one."""
    plain = F.translate(F.upper(F.substring(_col(text), 1, 10)), "ABCDEFGHJKMNPQRSTVWXYZ", "abcdefghijklmnopqrstuv")
    return F.when(is_ulid(text), F.conv(plain, 32, 10).cast("long"))


# Faults and outcomes.


def _by_fault(fault: ColumnOrName, at: int) -> Column:
    pairs = [F.lit(v) for row in FAULTS for v in (row[0], row[at])]
    return F.try_element_at(F.create_map(*pairs), _col(fault))


def fault_status(fault: ColumnOrName) -> Column:
    """The status that a caller gets for a fault; null for an unknown one."""
    return _by_fault(fault, 1)


def fault_execution(fault: ColumnOrName) -> Column:
    """none, unknown or done: whether the service ran."""
    return _by_fault(fault, 2)


def outcome_of(status, fault, upstream_status) -> Column:
    """What became of a mutation. A fault tells whether the service ran; where it did, its own status decides."""
    ran = fault_execution(fault)
    by = lambda s: F.when(s.between(200, 299), "Succeeded").otherwise("Failed")
    return (
        F.when(empty_if_null(fault) == "", by(_col(status)))
        .when(F.coalesce(ran, F.lit("none")) == "none", "NotExecuted")
        .when(ran == "unknown", "OutcomeUnknown")
        .otherwise(by(F.coalesce(_col(upstream_status), F.lit(0))))
    )


def problem_body(fault, title, status, detail, request_id, naming: Naming = NAMING) -> Column:
    """A problem document (RFC 9457) for a fault."""
    detail = F.when(empty_if_null(detail) != "", _col(detail))
    parts = [F.concat(F.lit(naming.problem_urn), _col(fault)).alias("type"), _col(title).alias("title"), _col(status).alias("status"), detail.alias("detail"), _col(request_id).alias("requestId")]
    return F.to_json(F.struct(*parts))


# Headers.


def record_header(headers: ColumnOrName, name: str) -> Column:
    """A record header's value as text, of the first one so named; empty if there is none."""
    found = F.filter(_col(headers), lambda h: h["key"] == name)
    return F.coalesce(F.try_element_at(found, F.lit(1))["value"].cast("string"), F.lit(""))


def first_header(headers: ColumnOrName, name: ColumnOrName) -> Column:
    """The first value of a header by its lower-case name; null if absent."""
    return F.try_element_at(F.try_element_at(_col(headers), _col(name) if isinstance(name, Column) else F.lit(name)), F.lit(1))


def transported(headers: ColumnOrName, request: bool = True) -> Column:
    """Headers fit to travel: names in lower case; without those of the connection, those that Connection names, those without values and, of requests, those with secrets."""
    entries = F.transform(F.map_entries(_col(headers)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    named = F.flatten(F.transform(F.filter(entries, lambda e: e["key"] == "connection"), lambda e: e["value"]))
    listed = F.transform(F.split(F.array_join(named, ","), ","), lambda n: F.lower(F.trim(n)))
    refused = F.array_union(_literals(HOP_HEADERS + (SECRET_HEADERS if request else ())), listed)
    kept = F.filter(entries, lambda e: ~F.array_contains(refused, e["key"]) & (F.size(e["value"]) > 0))
    return F.map_from_entries(kept)


def header_problems(headers: ColumnOrName, request: bool = True) -> Column:
    """What is wrong with transported headers, as an array of rule:name."""
    entries = F.map_entries(F.coalesce(_col(headers), F.create_map().cast("map<string,array<string>>")))

    def wrong(e: Column) -> Column:
        name = e["key"]
        out = F.when(~name.rlike(TOKEN), F.concat(F.lit("not_a_token:"), name)).when(name.isin(*HOP_HEADERS), F.concat(F.lit("hop_by_hop:"), name))
        if request:
            out = out.when(name.isin(*SECRET_HEADERS), F.concat(F.lit("caller_secret:"), name))
        out = out.when(F.coalesce(F.size(e["value"]), F.lit(0)) < 1, F.concat(F.lit("no_value:"), name))
        return out.when(F.exists(e["value"], lambda v: v.rlike("[\\r\\n\\x00]")), F.concat(F.lit("line_break:"), name))

    return F.array_sort(F.filter(F.transform(entries, wrong), lambda x: x.isNotNull()))


def caller_secrets(headers: ColumnOrName) -> Column:
    """Which of the headers that carry callers' secrets are there, in fixed order."""
    return F.filter(_literals(SECRET_HEADERS), lambda n: F.map_contains_key(_col(headers), n))


# Queries and text.


def is_json(text: ColumnOrName) -> Column:
    """Whether a text is one JSON value and nothing else. Spark's parsers stop after the first value; no text that goes on behind it closes both of these wrappers."""
    t = _col(text)
    alone = F.coalesce(F.json_array_length(F.concat(F.lit("["), t, F.lit("]"))) == 1, F.lit(False))
    return alone & F.try_parse_json(F.concat(F.lit('{"x":'), t, F.lit("}"))).isNotNull()


def query_values(raw_query: ColumnOrName, name: ColumnOrName) -> Column:
    """All decoded values of a query parameter, in order; malformed parts have a null."""
    plus = lambda x: F.try_url_decode(x)
    parts = F.filter(F.split(empty_if_null(raw_query), "&"), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(plus(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), plus(F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + 1)).otherwise("")).alias("v")))
    return F.transform(F.filter(pairs, lambda p: p["k"] == (_col(name) if isinstance(name, Column) else F.lit(name))), lambda p: p["v"])


def without_parameters(raw_query: ColumnOrName, names: list[str]) -> Column:
    """A raw query without the named parameters; what is left keeps its bytes and order."""
    parts = F.split(empty_if_null(raw_query), "&")
    return F.array_join(F.filter(parts, lambda p: ~F.coalesce(F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1))).isin(*names), F.lit(False))), "&")


def cut_bytes(text: ColumnOrName, most: int) -> Column:
    """The first bytes of a text, as bytes: a cut may fall inside a character."""
    return F.substring(_col(text).cast("binary"), 1, most)


def printable(raw: ColumnOrName, most: int = 16 * 1024) -> Column:
    """Bytes for display as (text, cut): as text where they are valid UTF-8, else base64; long ones cut at a character's end."""
    b = _col(raw).cast("binary")
    inside = lambda n: F.hex(F.substring(b, n + 1, 1)).between("80", "BF")  # noqa: E731  # a cut after n bytes is inside a character
    end = F.when(~inside(most), most).when(~inside(most - 1), most - 1).when(~inside(most - 2), most - 2).otherwise(most - 3)
    text = b.substr(F.lit(1), end).cast("string")
    whole = F.octet_length(b) <= most
    shown = F.when(F.is_valid_utf8(b.cast("string")), F.when(whole, b.cast("string")).otherwise(text)).otherwise(F.concat(F.lit("base64:"), F.base64(F.substring(b, 1, most))))
    return F.struct(shown.alias("text"), (~whole).alias("cut"))
