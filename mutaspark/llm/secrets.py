"""Secret scans by assignment-aware lexing."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import map_arrow, table

# Fixed patterns of the base scan.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{32,}")
#: Least length of what counts: the value of an assignment, the whole access key, the whole run of hex digits.
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "lexed")

#: A part of a name, and how sensitive a value under such a name is.
NAME_WEIGHT = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "private": 0.6, "access": 0.5, "auth": 0.6, "authorization": 0.8, "bearer": 0.9, "signing": 0.5, "encryption": 0.5, "client": 0.2, "session": 0.4,
    "key": 0.4, "api": 0.3, "cookie": 0.5, "salt": 0.4, "license": 0.1, "conn": 0.3, "dsn": 0.6,
}
#: Parts that say that the value only points at a secret, or isn't one.
HARMLESS = {"file", "path", "url", "uri", "name", "id", "type", "length", "len", "count", "expires", "expiry", "ttl", "timeout", "regex", "pattern", "policy", "field", "label", "hint", "public"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|_+|changeme|change_me|example|placeholder|your.*|todo|none|null|nil|true|false|undefined|test|dummy|sample|<.*>|\$\{.*\}|\{\{.*\}\}|%\(?\w+\)?s?)$", re.ASCII)
#: A literal is reported from this score on.
REPORT = 0.8
#: The longest joined value that is kept as text; of longer ones so many characters at either end, and counts of up to so many different ones.
LONGEST, ENDS, DISTINCT = 4096, 64, 256
KIND_PATTERNS = [re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")]

#: name = "literal", name: literal, "name": "literal", d["name"] = ..., name: type = ..., name := ..., NAME => ... Names have any length: what may follow one is none of its characters, so nothing is tried again. One statement's left side and operator.
LEFT = re.compile(r"""(?<![A-Za-z0-9_$.-])(?P<q>["'`]?)(?P<name>[A-Za-z_$][A-Za-z0-9_$.-]*+)(?P=q)(?:\x20*\])?(?:\x20*:\x20*[A-Za-z_][A-Za-z0-9_\[\]|]*(?=\x20*=))?\x20*(?P<op>:=|=>|=(?![=>])|:(?![:/]))[\x20\t]*""", re.ASCII)
#: The right side: quoted literals, in three quotes over several lines, and names, joined by + or . (string concatenation), or one bare word.
ATOM = re.compile(
    r"""(?:[bBfFrRuU]{0,2}(?P<lit>\"{3}(?:[^"\\]|\\.|"(?!""))*+"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3}|"(?!"")(?:[^"\\\n]|\\.)*"|'(?!'')(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`)|(?P<ref>\$?\{?[A-Za-z_$][A-Za-z0-9_$.-]*\}?)|(?P<bare>[^\s"'`,;(){}\[\]<>]+))""",
    re.ASCII | re.DOTALL,
)
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""", re.ASCII)
JOIN = re.compile(r"[\x20\t]*(?:\+|\.\.|\|\|)[\x20\t]*", re.ASCII)
#: What starts a comment, at a line's start or after white space.
COMMENT = re.compile(r"(?:^|\s)(?:#|//|--\s|;|/?\*|<!--|%)", re.ASCII)
#: Markup: <name>literal</name>, and key="name" value="literal".
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][A-Za-z0-9_.:-]*+)(?:\s[^<>]*+)?>\s*(?P<lit>[^<>\s](?:[^<>\n]*[^<>\s])?)\s*</(?P=name)\s*>", re.ASCII)
ENTRY = re.compile(r"""(?<![A-Za-z0-9_-])(?:key|name)\s*=\s*(?P<q>["'])(?P<name>[^"'<>\n]*+)(?P=q)\s+(?:value|content)\s*=\s*(?P<r>["'])(?P<lit>[^"'<>\n]*+)(?P=r)""", re.ASCII)
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.ASCII)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base scan; a match is leftmost among its kind and counts if it is long enough."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX_LONG.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def name_score(name: str) -> float:
    """How sensitive a target's name is, 0 to 1: the noisy or of its parts' weights, little if a part is harmless."""
    parts = [p.lower() for p in PARTS.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:], strict=False)}
    rest = 1.0
    for p in {*parts, *joined}:
        rest *= 1 - NAME_WEIGHT.get(p, 0.0)
    score = 1 - rest
    return score * 0.2 if parts and parts[-1] in HARMLESS or "public" in parts else score


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


@dataclass(frozen=True)
class Long:
    """What a score looks at of a value that is longer than LONGEST: names that are joined again and again would else double it with every line. counts: of its characters, or None for more than DISTINCT different ones, which count as high entropy."""

    length: float
    head: str
    tail: str
    counts: dict[str, float] | None
    kinds: int  # bits, see KIND_PATTERNS
    spaced: bool

    @staticmethod
    def of(piece: str | Long) -> Long:
        if isinstance(piece, Long):
            return piece
        counts = Counter(piece)
        kinds = sum(1 << k for k, p in enumerate(KIND_PATTERNS) if p.search(piece))
        return Long(float(len(piece)), piece[:ENDS], piece[-ENDS:], counts if len(counts) <= DISTINCT else None, kinds, any(c.isspace() for c in counts))

    def __add__(self, other: Long) -> Long:
        head = self.head + other.head if self.length < ENDS else self.head
        tail = self.tail + other.tail if other.length < ENDS else other.tail
        counts = None if self.counts is None or other.counts is None else Counter(self.counts) + Counter(other.counts)
        length = self.length + other.length
        if length > 1e60:  # only shares count by now
            length, counts = length / 1e40, counts and {c: n / 1e40 for c, n in counts.items()}
        return Long(length, head[:ENDS], tail[-ENDS:], counts if counts is not None and len(counts) <= DISTINCT else None, self.kinds | other.kinds, self.spaced or other.spaced)


def joined_value(pieces: list[str | Long]) -> str | Long:
    if all(isinstance(p, str) for p in pieces) and sum(map(len, pieces)) <= LONGEST:
        return "".join(pieces)
    total = Long.of(pieces[0])
    for p in pieces[1:]:
        total = total + Long.of(p)
    return total


def literal_score(value: str | Long) -> float:
    """How much a literal looks like a secret, 0 to 1."""
    if isinstance(value, Long):
        if value.spaced:
            return 0.0
        if value.counts is not None:  # stands for the value: its ends, and between them what else it holds
            middle = "".join(c for c in value.counts if c not in value.head and c not in value.tail)
            if PLACEHOLDER.match(value.head + middle + value.tail):
                return 0.0
        high = value.counts is None or -sum(c / value.length * math.log2(c / value.length) for c in value.counts.values()) >= 3
        return min(1.0, 0.25 + 0.07 * 12 / 2 + 0.1 * (value.kinds.bit_count() - 1) + 0.1 * high)
    if len(value) < 6 or PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return 0.0
    kinds = sum(bool(p.search(value)) for p in KIND_PATTERNS)
    return min(1.0, 0.25 + 0.07 * min(len(value), 12) / 2 + 0.1 * (kinds - 1) + 0.1 * (entropy(value) >= 3))


#: Where a name's value comes from: places of literals, and of what other names they were joined with.
Origin = tuple[tuple[tuple[int, int], ...], tuple["Origin", ...]]


def places(origins: Iterable[Origin]) -> list[tuple[int, int]]:
    """The places of all literals behind some names, each once; what is behind several names is walked once."""
    seen, out, left = set(), {}, list(origins)
    while left:
        node = left.pop()
        if id(node) not in seen:
            seen.add(id(node))
            out.update(dict.fromkeys(node[0]))
            left += node[1]
    return [*out]


def lex(text: str) -> list[tuple[str, int, int, str | Long, bool, tuple[Origin, ...]]]:
    """(name, start, end, value, own, behind) of each assignment, in order: the right side's place and the value after constants are propagated.

    A right side may join literals and earlier names; a name has the value last given to it above. Assignments in
    comments and those inside a literal are read, but give no name its value. own: the right side has a literal
    itself. behind: where the names on it have their values from. A value and its origin are held by reference, so
    memory follows the text's length, however names are joined.
    """
    known: dict[str, tuple[str | Long, Origin]] = {}
    out = []
    at = quoted = seen = 0
    commented = False
    while m := LEFT.search(text, at):
        line = text.rfind("\n", seen, m.start()) + 1
        commented = bool((commented and not line) or COMMENT.search(text[line or max(0, seen - 1) : m.start()]))
        seen = m.start()
        at, pieces, start, whole = m.end(), [], m.end(), True
        end, own, behind = at, [], {}
        while atom := ATOM.match(text, end):
            if atom["lit"] is not None:
                quotes = 3 if len(atom["lit"]) >= 6 and atom["lit"][:3] in ('"' * 3, "'" * 3) else 1
                pieces.append(atom["lit"][quotes:-quotes])
                own.append((atom.start("lit") + quotes, atom.end("lit") - quotes))
            elif atom["ref"] is not None and (ref := atom["ref"].strip("${}")) in known:
                pieces.append(known[ref][0])
                behind[id(known[ref][1])] = known[ref][1]
            elif start == end and atom["ref"] is not None and not JOIN.match(text, atom.end()):  # a bare word of a configuration file
                bare = BARE.match(text, end)
                value, end = (bare[0], bare.end()) if bare else (atom[0], atom.end())
                pieces = [value]
                own.append((atom.start(), end))
                break
            elif atom["bare"] is not None and start == end:
                pieces, end = [atom["bare"]], atom.end()
                own.append((atom.start(), end))
                break
            else:
                whole = False
                break
            end = atom.end()
            if not (more := JOIN.match(text, end)):
                break
            end = more.end()
        value = joined_value(pieces) if pieces else ""
        if end > start and whole and value:
            if m.start() >= quoted and not commented:
                known[m["name"]] = value, (tuple(own), tuple(behind.values()))
            literal = text[start:end].lstrip("bBfFrRuU")[:1] in ("'", '"', "`") and bool(own)
            if literal and len(own) == 1 and not behind:
                start, end = own[0]
            elif own and not behind and len(own) > 1:
                start, end = own[0][0], own[-1][1]
            else:
                start, end = start + (text[start] in "\"'`"), end - (text[end - 1] in "\"'`")
            out.append((m["name"], start, end, value, bool(own), tuple(behind.values())))
            if literal:  # what the literals hold is read next
                quoted = max(quoted, end)
            else:
                at = max(at, end)
    if "<" in text:
        out += [(x["name"], *x.span("lit"), x["lit"], True, ()) for p in (ELEMENT, ENTRY) for x in p.finditer(text)]
    return out


def likely(text: str) -> list[tuple[int, int, bool, tuple[Origin, ...]]]:
    """(start, end, own, behind) of the right sides that their targets' names and their value's look make likely secrets."""
    if "=" not in text and ":" not in text and "</" not in text:  # every operator and element has one of them
        return []
    return [(start, end, own, behind) for name, start, end, value, own, behind in lex(text) if (s := name_score(name)) >= 0.4 and s * 0.6 + literal_score(value) * 0.6 >= REPORT]


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    """Likely secrets: right sides with a literal of their own; of names alone, the literals that they stand for."""
    found = likely(text)
    own = [(start, end) for start, end, own, _ in found if own]
    return [(*place, "lexed") for place in dict.fromkeys([*own, *places(x for _, _, own, behind in found if not own for x in behind)])]


def joined_literals(text: str | None) -> list[tuple[int, int]]:
    """Literals that reach a likely secret by a name that is joined with others there; the secret's span is the joined expression."""
    return sorted(places(x for _, _, own, behind in likely(text or "") if own for x in behind))


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans in order: the base ones, and those of lexing that lie in none of them."""
    text = text or ""
    base = base_spans(text)
    extra = lexed_spans(text)
    if extra:
        reach, furthest = [], 0
        for _, e, _ in base:
            reach.append(furthest := max(furthest, e))
        starts = [b[0] for b in base]
        extra = [x for x in extra if x[0] < x[1] and not ((k := bisect_right(starts, x[0])) and reach[k - 1] >= x[1])]
    return sorted([*base, *extra], key=lambda x: (x[0], KINDS.index(x[2])))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every whole text: doc_id; spans, an array of (start, end, kind) by start, then kind; and joined, an array of (start, end).

    A secret joined of names and literals has the span of the joined expression; the literals given to those names
    elsewhere are in `joined`. One given to a name alone (K = "...", password = K) is in spans, where its literal is.

    Offsets are code points, ends exclusive. Kinds: assign, access and hex of the base scan, and lexed. One pass
    without a shuffle. Null and empty texts have none; repeated rows each have a row; other columns are ignored.
    """

    def found(batch: pa.RecordBatch):
        spans = [[dict(zip(("start", "end", "kind"), s, strict=True)) for s in scan(t)] for t in batch.column("text").to_pylist()]
        joined = [[{"start": s, "end": e} for s, e in joined_literals(t)] for t in batch.column("text").to_pylist()]
        yield {"doc_id": batch.column("doc_id"), "spans": spans, "joined": joined}

    return map_arrow(docs.select("doc_id", "text"), found, "doc_id long, spans array<struct<start: long, end: long, kind: string>>, joined array<struct<start: long, end: long>>")


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts of the base kinds, their digest, all spans as text, and the literals behind joined ones."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: f"array_join(transform({spans}, s -> concat_ws(':', s.kind, cast(s.start as string), cast(s.end as string))), ',')"
    base = "filter(spans, s -> s.kind <> 'lexed')"
    count = lambda kind: f"cast(size(filter(spans, s -> s.kind = '{kind}')) as long) as n_{kind}"
    return found.selectExpr("doc_id", count("assign"), count("access"), count("hex"), f"sha2({joined(base)}, 256) as base_sha256", f"{joined('spans')} as spans", "array_join(transform(joined, s -> concat_ws(':', cast(s.start as string), cast(s.end as string))), ',') as joined")


def brute_base(text: str | None) -> str:
    """The base digest by the plain definition, for tests."""
    text = text or ""
    every = [(m.start(), KINDS.index(k), k, m.end()) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)) for m in p.finditer(text) if len(m[2] if k == "assign" else m[0]) >= LEAST[k]]
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(every)).encode()).hexdigest()
