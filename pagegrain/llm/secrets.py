"""Secrets in source code, configuration and prose.

Fixed patterns find spans of known shape. Beyond them, text is lexed as assignments: names and
what they are set to (string literals in any quotes, also on the next line, other names, sums of both and neighbouring literals;
where a line starts with the name, as in configuration, also unquoted values and blocks). Type annotations between a name and its value are
skipped. Names get the path of braces, indented keys and sections that they stand in; elements and
attributes of markup, and pairs of a name entry and a value entry, are assignments too.

Names keep the literals they were last set to, so that a literal is also judged by every name that it reaches; what comments
set is judged, but not kept. A value is put together before it is judged. A value whose target's words say that it is
sensitive, and that looks like no placeholder, gives spans of kind ``literal``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import new_columns
from .words import slices

KINDS = ("assign", "access", "hex", "literal")

# The shapes of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a run of 16 characters in all
HEX = re.compile(r"[0-9a-f]{32,}")

# How far a word in a name tells that its value is secret, from 0 to 1.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "secrets": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "cred": 0.8, "creds": 0.8, "auth": 0.6, "authorization": 0.8, "bearer": 0.8, "private": 0.5, "signing": 0.5, "encryption": 0.5, "access": 0.4, "api": 0.4, "key": 0.4, "salt": 0.5, "pin": 0.5,
}
HARMLESS = {"name", "path", "file", "url", "uri", "type", "length", "size", "count", "id", "label", "field", "column", "public", "hash", "expiry", "timeout", "hint"}
PLACEHOLDER = re.compile(r"^(?:change.?me|example|sample|dummy|test|todo|none|null|true|false|undefined|password|secret|token|xxx+|\*+|\.+|your.*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s)$", re.I)

TYPE = r"""[&*?]?(?:'\w+[ \t]+)?(?:mut[ \t]+)?(?:\[\])?([A-Za-z_][\w.]*+)(?:::\w+)*+(?:\[[^\n=]{0,80}?\]|<[^\n=]{0,80}?>)?[?!*]?(?:[ \t]*+\|[ \t]*+[A-Za-z_][\w.\[\]]*+)*+"""
#: Groups: start of a line up to the name, name, type's name (name: type =), type's name (name type =), operator.
NAME = re.compile(
    r"""(?:(^[ \t]*+(?:(?:[-#;*]++|//|export|set|ENV|ARG)[ \t]++)*["']?)|(?<![\w.$-]))([A-Za-z_$][\w.$-]*+)["']?+\]?+"""
    rf"""(?:[?!]?[ \t]*+:[ \t]*+{TYPE}(?:[ \t]++(?==[ \t])|[ \t]*+(?==[ \t]*+[rbuf]*["']))|[ \t]++[*&]?(?:\[\])?(string|str|String|text|byte|char|rune)(?:\(\d+\))?[ \t]*+(?=:?=))?[ \t]*+(:=|=>|=|:)(?![=:])[ \t]*+""",
    re.ASCII | re.MULTILINE,
)
BARE = re.compile(r"""[^\s"'`]\S*+""")
REST = re.compile(r"[ \t]*+(?:(?<=[ \t])(?:#|;|//)[^\n]*+)?\r?(?:\n|\Z)")
#: Unquoted values that are code or point elsewhere: calls and subscripts, attributes, other names as statements, variables, type names.
CODE = re.compile(r"(?:[A-Za-z_$][\w$]*(?:(?:\.|->|::)[\w$]+)*)?[(\[{](?:.*(?:[)\]}][,;]?|,))?|[A-Za-z_$]+(?:(?:\.|->|::)[A-Za-z_$]+)+[,;]*|[A-Za-z_$]+;|\$\w+|\$[({].*|[*&]\w+|%\w+%|<.*>|(?:string|str|String|bytes|number|boolean|bool|integer|object|SecretStr|required|optional|enabled|disabled)[,;]?", re.ASCII)
#: Groups: what stands within triple, back, double and single quotes.
STRING = re.compile(r"""[rRbBuUfF]{0,2}(?:\"""((?:[^\\"]|\\.|"(?!""))*+)\"""|\'\'\'((?:[^\\']|\\.|'(?!''))*+)\'\'\'|`((?:[^`\\]|\\.)*+)`|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)')""", re.DOTALL)
TERM = re.compile(r"[A-Za-z_$][\w.$-]*+", re.ASCII)
JOIN = re.compile(r"[ \t]*+(?:\+|\.\.|\\\n)\s*+")
#: Behind an operator, up to a quoted value on a line to come.
AHEAD = re.compile(r"""[(]?[ \t]*+(?:\\?\r?\n[ \t]*+){1,2}[(]?(?=[rbuf]{0,2}["'`])|[(][ \t]*+(?=[rbuf]{0,2}["'`])""", re.IGNORECASE)
#: Neighbouring literals are one value, on other lines within parentheses.
NEXT = re.compile(r"""\s++(?=[rbuf]{0,2}["'])""", re.IGNORECASE)
#: A value in lines of its own below its name (groups: indentation, value).
BELOW = re.compile(r"[ \t]*+(?:[|>][+-]?[ \t]*+)?\r?\n([ \t]++)([^\s\"'`#:=]++)[ \t]*+(?=\r?\n|\Z)")
COMMENT = re.compile(r"""^[ \t]*+(?:#|//|;|--|/?\*|<!--|REM\b)|[ \t](?:#|//)[ \t]""")
QUOTED = re.compile(r"""\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'""")
BRACE = re.compile(r"""\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|[{}]|^[ \t]*+\[\[?([\w.\- \"']++)\]\]?[ \t]*+\r?$""", re.MULTILINE)
#: Groups of markup: element, attributes, content.
ELEMENT = re.compile(r"<([A-Za-z_][\w:.-]*+)((?:\s++[\w:.-]++\s*+=\s*+(?:\"[^\"<]*+\"|'[^'<]*+'))*+)\s*+(?:>([^<]*+)</\1\s*+>|/>)")
ATTRIBUTE = re.compile(r"([\w:.-]++)\s*+=\s*+(?:\"([^\"<]*+)\"|'([^'<]*+)')")
NAMING, VALUED = ("name", "key", "id"), ("value", "val", "content", "default")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def weigh(name: str) -> tuple[list[str], float]:
    """A name's words, and how far they say that its value is secret: their weights as independent hints."""
    return weighed(name) if len(name) <= 80 else weighed.__wrapped__(name)


@lru_cache(1 << 15)
def weighed(name: str) -> tuple[list[str], float]:
    parts = [p.lower() for p in PARTS.findall(name)]
    return parts, 1 - math.prod(1 - SENSITIVE.get(p, 0.0) for p in parts)


def sensitivity(path: tuple[str, ...]) -> float:
    """How far a name (last) and the path to it say that its value is secret. What it stands in only adds to what it says by itself."""
    return within(path[-1], math.prod(map(harmless, path[:-1])))


def within(name: str, around: float) -> float:
    """A name's sensitivity, ``around`` being what is left of doubt by the path to it."""
    parts, own = weigh(name)
    if not parts or parts[-1] in HARMLESS or not (own or parts[-1] in VALUED):
        return 0.0
    return 1 - (1 - own) * around


def harmless(name: str) -> float:
    """The doubt that a name leaves about what stands in it."""
    return 1 - 0.75 * weigh(name)[1]


def randomness(value: str) -> float:
    """Shannon entropy a character, in bits."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def plausibility(value: str) -> float:
    """From 0 to 1: how far a value may be a secret, less for those that are short, repetitive or prose."""
    if len(value) < 6 or PLACEHOLDER.match(value) or any(c.isspace() for c in value.strip()):
        return 0.0
    return min(1.0, randomness(value) / 2.5)


def bare(text: str, at: int, tight: bool) -> tuple[int, int] | None:
    """The unquoted value at a place: up to a blank behind a tight =, else all of the line but a comment; None if it is code or prose."""
    if not (m := BARE.match(text, at)) or CODE.fullmatch(m[0]) or not (tight or REST.match(text, m.end())):
        return None
    return at, at + len(m[0].rstrip(",;"))


Span = tuple[int, int]


class Value:
    """What a name is set to: spans of literals, and values of other names, which are put together only when they are judged."""

    def __init__(self) -> None:
        self.parts: list[Span | Value] = []

    def spans(self) -> tuple[Span, ...]:
        out, stack = {}, [self]
        while stack:
            top = stack.pop()
            if isinstance(top, Value):
                stack += reversed(top.parts)
            else:
                out[top] = None
        return tuple(out)


class Scopes:
    """Where a place in a text stands: open braces, indented keys above it, and the section. Braces and keys go with the doubt that is left by all of them so far."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.section = text, 0, 1.0
        self.braces: list[float] = []
        self.keys: list[tuple[int, float]] = []
        self.waiting = ""  # the name before a brace that may open
        self.nested = "{" in text or "\n[" in text or text.startswith("[")

    def to(self, place: int) -> None:
        if self.nested:
            for m in BRACE.finditer(self.text, self.at, place):
                if m[0] == "{":
                    self.braces.append((self.braces[-1] if self.braces else 1.0) * harmless(self.waiting))
                elif m[0] == "}":
                    del self.braces[-1:]
                elif m[1] is not None:
                    self.section = harmless(m[1])
                self.waiting = ""
        self.at = max(self.at, place)

    def line(self, name: str, indent: int, opens: bool) -> None:
        """A name at the start of a line; it opens a scope if its value is to come on lines that are indented more."""
        while self.keys and self.keys[-1][0] >= indent:
            self.keys.pop()
        if opens:
            self.keys.append((indent, (self.keys[-1][1] if self.keys else 1.0) * harmless(name)))

    def around(self) -> float:
        """The doubt that is left by all names on the path here."""
        return self.section * (self.keys[-1][1] if self.keys else 1.0) * (self.braces[-1] if self.braces else 1.0)


class Lines:
    """Where the comment of a line starts, line after line."""

    def __init__(self, text: str) -> None:
        self.text, self.end, self.comment = text, -1, 0

    def in_comment(self, place: int) -> bool:
        if place > self.end:
            start = self.text.rfind("\n", max(0, self.end), place) + 1
            self.end = self.text.find("\n", place)
            self.end = len(self.text) if self.end < 0 else self.end
            m = COMMENT.search(QUOTED.sub(lambda q: "'" * len(q[0]), self.text[start : self.end]))
            self.comment = start + m.start() if m else self.end + 1
        return place > self.comment


def pairs(text: str) -> Iterator[tuple[str, float, Value]]:
    """Name-literal pairs, in order: each name, the doubt that the path to it leaves, and the spans (within quotes) of all literals that make up its value, also through other names."""
    known: dict[str, Value] = {}
    scopes, lines, entry = Scopes(text), Lines(text), ("", 0)
    for m in NAME.finditer(text):
        inside = m.start(2) < scopes.at  # of a value that has been read
        scopes.to(m.start())
        comment = inside or lines.in_comment(m.start(2))
        at, found, wrapped = m.end(), Value(), False
        if ahead := AHEAD.match(text, at):
            at, wrapped = ahead.end(), "(" in ahead[0]
        begin = at
        while True:
            if s := STRING.match(text, at):
                found.parts.append(s.span(s.lastindex))
                if (more := NEXT.match(text, s.end())) and (wrapped or "\n" not in more[0]):
                    at = more.end()
                    continue
            elif (s := TERM.match(text, at)) and (s[0] in known or m[1] is None):
                if s[0] in known and known[s[0]].parts:
                    found.parts.append(known[s[0]])
            else:
                break
            at = s.end()
            if not (more := JOIN.match(text, at)):
                break
            at = more.end()
        indent = len(m[1]) - len(m[1].lstrip(" \t")) if m[1] is not None else 0
        opens = False
        if at == begin and m[1] is not None:
            below = BELOW.match(text, at) if m[5] == ":" else None
            if below and len(below[1]) > indent and not CODE.fullmatch(below[2]):
                found.parts.append(below.span(2))
                at = below.end()
            elif value := bare(text, at, m[5] == "=" and m.end(2) + 1 == at):
                found.parts.append(value)
                at = value[1]
            opens = m[5] == ":" and not found.parts and bool(REST.match(text, at))
        if not comment:
            if m[1] is not None:
                scopes.line(m[2], indent, opens)
            scopes.to(m.end())
            scopes.waiting = m[2] if at == begin else ""
            scopes.at = max(scopes.at, at)
        around = scopes.around() if found.parts and not inside else 1.0
        for name in filter(None, dict.fromkeys((m[2], m[3]))):  # what looks like a type may be a name behind a label
            if not comment:
                known[name] = found
            if found.parts:
                yield name, around, found
        if found.parts and m[2].lower() in VALUED and entry[0] and text.count("\n", entry[1], m.start()) <= 1:
            yield entry[0], 1.0, found
        entry = ("", 0)
        if found.parts and m[2].lower() in NAMING and not isinstance(named := found.parts[0], Value):
            entry = text[slice(*named)], named[1]


def marked_up(text: str) -> Iterator[tuple[str, float, Value]]:
    """The same of elements: content by element, or value attribute by the naming attribute."""
    for m in ELEMENT.finditer(text):
        named, value = m[1], m.span(3) if m[3] is not None else None
        for a in ATTRIBUTE.finditer(text, *m.span(2)):
            if a[1].lower() in NAMING:
                named = a[2] if a[2] is not None else a[3]
            elif a[1].lower() in VALUED:
                value = a.span(2) if a[2] is not None else a.span(3)
        if value and (inner := text[slice(*value)].strip()):
            at = text.index(inner, value[0])
            found = Value()
            found.parts.append((at, at + len(inner)))
            yield named, 1.0, found


def literals(text: str, threshold: float) -> list[Span]:
    """Parts of sensitive values. Of a value of several parts, those of six characters or more; if none is so long, all."""
    found: dict[Span, None] = {}
    judged: dict[tuple[Span, ...], float] = {}
    for source in (pairs, marked_up):
        for name, around, value in source(text):
            weight = within(name, around)
            if weight >= threshold:
                spans = value.spans()
                if spans not in judged:
                    judged[spans] = plausibility("".join(text[slice(*s)] for s in spans))
                if weight * judged[spans] >= threshold:
                    found |= dict.fromkeys([s for s in spans if s[1] - s[0] >= 6] or spans)
    return list(found)


def scan(text: str, threshold: float = 0.6) -> list[tuple[str, int, int]]:
    """Secret spans (kind, start, end) in code points, end exclusive, by start and then by kind.

    Base spans are the whole matches of the three shapes. A literal that lies within a base span
    isn't listed again.
    """
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if "=" in text or ":" in text else []
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "=" in text or ":" in text or "</" in text:
        base = sorted((a, b) for _, a, b in found)
        starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))
        own = [(a, b, bisect_right(starts, a)) for a, b in literals(text, threshold)]
        found += [("literal", a, b) for a, b, k in own if not k or reach[k - 1] < b]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by [kind] of its first."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.6, redacted: bool = False) -> DataFrame:
    """Secrets of every whole text: counts and spans of the base kinds, all spans and, if asked, the redacted text.

    Columns: those in ``keep``, n_assign, n_access, n_hex, n_literal, base_sha256 (of the base spans listed as
    kind:start:end, comma-joined), spans (all, listed likewise) and maybe redacted. Null and empty texts have
    no spans; a null text's redacted one is null. Rows are independent: repeated rows and null ids
    stay as they are. Columns not in ``keep`` are dropped; names in it that are made here raise. Texts of any length are read whole; time grows with
    the length, and where a sensitive name is appended to again and again, with the lengths of all its values. Needs no shuffle.
    """
    new_columns(keep, ["n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans", "redacted"])
    plain = df.select(*keep, df[text].cast("string").alias("__text"))
    names = [*keep, "n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans", *["redacted"] * redacted]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema[: len(keep)])
    schema += ", n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string" + ", redacted string" * redacted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = part.column("__text").to_pylist()
                spans = [scan(t or "", threshold) for t in texts]
                counts = [{k: len(list(g)) for k, g in groupby(sorted(x[0] for x in s))} for s in spans]
                columns = list(part.columns[: len(keep)])
                columns += [pa.array([c.get(k, 0) for c in counts], pa.int64()) for k in KINDS]
                columns += [pa.array([hashlib.sha256(listed([x for x in s if x[0] != "literal"]).encode()).hexdigest() for s in spans], pa.string()), pa.array(map(listed, spans), pa.string())]
                if redacted:
                    columns.append(pa.array([t if t is None else redact(t, s) for t, s in zip(texts, spans, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return plain.mapInArrow(run, schema)
