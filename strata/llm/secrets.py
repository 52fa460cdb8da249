"""Operator 7: secret scan with an assignment-aware lexer.

Base spans come from three fixed patterns. The method adds spans: source and configuration
text is lexed into name-literal pairs (``name = "literal"``, ``name: literal``, ``"name":
"literal"``, ``name=literal``, ``<name>literal</name>``); names bound to one literal are
constants, and ``other = name`` and ``"a" + "b"`` propagate them; ``map["name"] = "literal"``
and ``{"name": "n", "value": "literal"}`` bind too. A literal is scored by how sensitive its
target's name is and by its own form, and reported above a threshold, at the place where it
stands; of a joined one each part at its own place. Joined literals of more than 64 parts are
not put together and literals of over 4,096 characters not propagated (they are reported
where they are bound).

One row is one task's work at a time: no shuffle, memory is that of the longest text, and
time is linear in it, with or without line ends.

Cases: NULL text counts as empty (no spans); positions are code points, ends exclusive; a
name bound twice is propagated with its latest value above the use; a literal with a base
span over the same place is not reported again; repeated rows give repeated results; an
empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed by the contract: the base patterns (ASCII letters in either case in the first).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex")

# Words that make a name sensitive, with their weights.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9,
             "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "auth": 0.7, "bearer": 0.7, "private": 0.6,
             "key": 0.5, "access": 0.4, "signing": 0.4, "encryption": 0.4, "salt": 0.4, "session": 0.3,
             "client": 0.2, "api": 0.4}
HARMLESS = {"public": 0.6, "example": 0.6, "name": 0.5, "id": 0.3, "url": 0.4, "path": 0.4, "file": 0.4,
            "length": 0.6, "size": 0.6, "count": 0.6, "type": 0.5, "max": 0.4, "min": 0.4, "word": 0.3}
PLACEHOLDER = re.compile(r"(?i)^(changeme|example.*|your[-_].*|none|null|true|false|x+|\*+|test|todo|<.*>|\$\{.*|%\(.*)$")
LEAST = 0.75

NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*"
TOKEN = re.compile(
    r"(?P<comment>/\*)"
    r"|<(?P<tag>" + NAME + r")>(?P<tagged>[^<>\n]+)</(?P=tag)>"
    r"|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<name>" + NAME + r")"
    r"|(?P<op>:=|=>|==|!=|<=|>=|[=:+;,])"
    r"|(?P<line>\n)"
    r"|(?P<other>[^\s])", re.DOTALL)
BARE = re.compile(r"[^\s,;\"'()\[\]{}<>]+")
REST = re.compile(r"[ \t\r;,]*(?:\n|\Z)")
WHOLE_NAME = re.compile(NAME + r"\Z")
CALLED, HOLDS = {"name", "key"}, {"value", "val"}   # {"name": "...", "value": "..."}
PARTS, FOLLOWED, HELD = 64, 4096, 4096            # parts of a literal, characters of a constant, tokens held
SPLIT = re.compile(r"[_.\-\s]+|(?<=[a-z0-9])(?=[A-Z])")


def base_spans(text: str) -> list:
    """(start, kind, end) of the base spans, in order of start and kind."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def name_weight(name: str) -> float:
    words = [w.lower() for w in SPLIT.split(name) if w]
    joined = set(words) | {a + b for a, b in zip(words, words[1:])}
    good = [SENSITIVE[w] for w in joined if w in SENSITIVE]
    return min(1.0, sum(good)) - sum(HARMLESS.get(w, 0) for w in words)


def literal_weight(value: str) -> float:
    """0 to 1: long, mixed literals without blanks look like secrets."""
    if len(value) < 8 or PLACEHOLDER.match(value) or re.search(r"\s", value):
        return 0.0
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 4) * min(1.0, 0.55 + 0.15 * classes)


def joined(items: list, k: int, known: dict):
    """(literal, parts) of ``"a" + name + "b"`` from token k on, or None. A part is a place
    (start, end) in the text; a literal of over PARTS parts is not put together."""
    values, parts = [], []
    while True:
        kind, what, start, end = items[k]
        if kind == "string":
            got = what[1:-1], [(start + 1, end - 1)]
        elif kind == "name" and what in known:
            got = known[what]
        else:
            return None
        values.append(got[0])
        parts += got[1]
        if len(parts) > PARTS:
            return None
        if k + 2 >= len(items) or items[k + 1][1] != "+" or items[k + 1][0] != "op":
            return "".join(values), parts
        k += 2


def target(items: list, k: int) -> str | None:
    """The name that the operator at token k binds: ``name =``, ``"name":``, ``name: type =``
    or ``map["name"] =``."""
    left = items[k - 1]
    if items[k][1] == "=" and k > 2 and items[k - 2][1] == ":" and left[0] == "name":
        left = items[k - 3]
    elif left[1] == "]" and k > 3 and items[k - 3][1] == "[" and items[k - 4][0] == "name":
        left = items[k - 2]
    name = left[1] if left[0] == "name" else left[1][1:-1] if left[0] == "string" else None
    return name if name and WHOLE_NAME.match(name) else None


class Lexer:
    """Name-literal pairs of a text, token by token: what is held is the statement's last
    tokens (``HELD`` at most, also where a text has no line ends), the names bound to literals
    of up to ``FOLLOWED`` characters, and the last literal bound to ``name`` or ``key``."""

    def __init__(self, text: str):
        self.text, self.known, self.items, self.said, self.done = text, {}, [], None, 0

    def statement(self, last: bool):
        """Bindings of the tokens held; but at a statement's end the last few wait."""
        items = self.items
        stop = len(items) if last else len(items) - 2 * PARTS - 2
        for k in range(self.done, stop):
            kind, what, *_ = items[k]
            if what == "}" and kind == "other":
                self.said = None
            if kind == "op" and k and what in ("=", ":", ":=", "=>"):
                yield from self.binding(k)
        self.done = stop
        if last:
            self.items, self.done = [], 0
        else:
            gone = max(0, stop - 4)
            self.items, self.done = items[gone:], stop - gone

    def binding(self, k: int):
        items, text = self.items, self.text
        name = target(items, k)
        if not name or k + 1 >= len(items):
            return
        got = joined(items, k + 1, self.known)
        if got is None and items[k][1] in ("=", ":"):
            # an unquoted literal ends the line, as in configuration files
            m = BARE.match(text, items[k + 1][2])
            if m and REST.match(text, m.end()):
                got = m[0], [m.span()]
        if got is None:
            return
        word = name.lower()
        if word in CALLED and WHOLE_NAME.match(got[0]):
            self.said = got[0]
        elif word in HOLDS and self.said:
            name = self.said                      # {"name": "db_pwd", "value": "..."}
        if len(got[0]) >= 8:
            yield name, got[0], got[1]
        if len(got[0]) <= FOLLOWED:
            self.known[name] = got
        else:
            self.known.pop(name, None)

    def pairs(self):
        """(name, literal, places) of each binding; a propagated or joined literal has the
        places of its parts."""
        text, pos, last = self.text, 0, self.text.rfind("*/")
        while m := TOKEN.search(text, pos):
            kind, pos = m.lastgroup, m.end()
            if m["tag"]:
                yield m["tag"], m["tagged"], [m.span("tagged")]
            elif kind == "line" or m["op"] in (";", ","):
                yield from self.statement(True)
            elif kind == "comment" and pos <= last:
                pos = text.find("*/", pos) + 2
            else:
                self.items.append((kind, m[0], m.start(), m.end()))
                if len(self.items) >= HELD:
                    yield from self.statement(False)
        yield from self.statement(True)


# A sensitive word anywhere, also in parts that a name joins; no other text can reach LEAST.
CANDIDATE = re.compile("(?i)" + "|".join(r"[_.\-]*".join(w) for w in sorted(SENSITIVE)))


def method_spans(text: str, base: list) -> list:
    """(start, end) of literals bound to sensitive names that no base span holds already."""
    if not CANDIDATE.search(text) or not re.search("[=:>]", text):
        return []
    starts = [a for a, _, _ in base]              # in order
    reach = list(accumulate((b for _, _, b in base), max))
    out = set()
    for name, literal, places in Lexer(text).pairs():
        if name_weight(name) * 0.6 + literal_weight(literal) * 0.4 >= LEAST:
            for start, end in places:
                before = bisect_left(starts, end)     # base spans that start before its end
                if start < end and not (before and reach[before - 1] > start):
                    out.add((start, end))
    return sorted(out)


def scan(text: str):
    """Counts per base kind, the base spans, and all spans, as kind:start:end texts."""
    base = base_spans(text)
    counts = [0, 0, 0]
    for _, kind, _ in base:
        counts[kind] += 1
    named = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
    rows = [(a, k, b) for a, k, b in base] + [(a, 3, b) for a, b in method_spans(text, base)]
    every = [f"{(*KINDS, 'literal')[k]}:{a}:{b}" for a, k, b in sorted(rows)]
    return counts, ",".join(named), ",".join(every)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_spans and spans
    (kind:start:end by start and kind, comma-joined; ``literal`` is the method's kind)."""
    def run(batches):
        for batch in batches:
            found = [scan(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array([f[0][k] for f in found], pa.int64()) for k in range(3)]
                + [pa.array([f[1] for f in found], pa.string()),
                   pa.array([hashlib.sha256(f[1].encode()).hexdigest() for f in found], pa.string()),
                   pa.array([f[2] for f in found], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "base_sha256", "spans"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, base_sha256 string, spans string")
