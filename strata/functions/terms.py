"""Reading a transformation cell of a mapping into glossary terms.

A cell holds one term or several terms separated by ``;`` (applied left to right, SC-22).
Term names match case-insensitively, spaces in a name are ignored, and a trailing
parenthesised explanation is dropped (``Direct Pull (Directly maps X to Y)``).
Argument roles are decided per term by the builders, not by quoting alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# The glossary term names (lower case, spaces removed) and whether each takes
# a parenthesised argument list. Aliases map onto one canonical name.
TERM_ARGS = {
    "direct": False,
    "concatenate": True,
    "uppercase": False,
    "lowercase": False,
    "titlecase": False,
    "substring": True,
    "substring_col": True,
    "replace": True,
    "trim": False,
    "trimsymbols": True,
    "trimtrailingzeros": True,
    "trimleadingzeros": True,
    "dateformatting": True,
    "datecalculation": True,
    "dateextraction": True,
    "numericcalculation": True,
    "conditional": True,
    "casewhen": True,
    "nullhandling": True,
    "default": False,
    "etlauditcolumn": False,
}
ALIASES = {"directpull": "direct", "defaultvalue": "default", "auditcolumn": "etlauditcolumn"}


class TermError(ValueError):
    """An unknown or malformed term; always names the target column."""


@dataclass(frozen=True)
class Arg:
    kind: str  # "ident" (bare name), "lit" (quoted text), "num" (numeric literal)
    value: str

    @property
    def text(self) -> str:
        return self.value


@dataclass(frozen=True)
class Term:
    name: str
    args: tuple[Arg, ...] = ()
    raw: str = ""


def text_literal(value: str) -> str:
    """A text as a SQL expression whose bytes are spelled out: no quote, backslash or line end
    in it means anything to the parser, whatever its settings. The optimizer folds the cast."""
    return f"CAST(X'{value.encode('utf-8').hex()}' AS STRING)"


def unquoted(token: str) -> str:
    """The text of a quoted token; a quote inside it is written twice, a backslash is itself."""
    q = token[0]
    return token[1:-1].replace(q + q, q)


_QUOTED = re.compile(r"(?is)(\b(?:date|timestamp|timestamp_ntz|timestamp_ltz|interval|x|r)\s*)?('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")|`[^`]*`")


def plain_backslashes(sql: str) -> str:
    """A condition of a mapping with the backslashes in its quoted texts meant as themselves."""
    def spelled(m: re.Match) -> str:
        if m[1] or not m[2] or "\\" not in m[2]:
            return m[0]                           # a typed literal, a name, or a text without one
        return text_literal(unquoted(m[2]))

    return _QUOTED.sub(spelled, sql)


_NUM = re.compile(r"^[+-]?\d+(\.\d+)?$")
_NAME = re.compile(r"^\s*([A-Za-z_][A-Za-z_ ]*?)\s*(?=\(|:|$)")


def _split_top(text: str, sep: str) -> list[str]:
    """Split on ``sep`` outside quotes and parentheses."""
    out, buf, depth, quote = [], [], 0, None
    for ch in text:
        if quote:
            buf.append(ch)
            if ch == quote:
                quote = None
            continue
        if ch in "\"'":
            quote = ch
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == sep and depth == 0:
            out.append("".join(buf))
            buf = []
            continue
        buf.append(ch)
    out.append("".join(buf))
    return out


def _closing(text: str, start: int) -> int:
    """Index of the parenthesis closing the one at ``start`` (quote-aware)."""
    depth, quote = 0, None
    for i in range(start, len(text)):
        ch = text[i]
        if quote:
            if ch == quote:
                quote = None
        elif ch in "\"'":
            quote = ch
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
            if depth == 0:
                return i
    raise TermError(f"unbalanced parentheses in {text!r}")


def parse_arg(text: str) -> Arg:
    t = text.strip()
    if len(t) >= 2 and t[0] == t[-1] and t[0] in "\"'":
        return Arg("lit", unquoted(t))
    if _NUM.match(t):
        return Arg("num", t)
    return Arg("ident", t)


def _strip_explanation(text: str) -> str:
    """Drop a trailing ``( ... )`` that follows a value."""
    t = text.strip()
    if t.endswith(")"):
        depth = 0
        for i in range(len(t) - 1, -1, -1):
            if t[i] == ")":
                depth += 1
            elif t[i] == "(":
                depth -= 1
                if depth == 0:
                    if t[:i].strip():
                        return t[:i].strip()
                    break
    return t


def parse_term(text: str) -> Term:
    raw = text
    t = text.strip()
    if not t:
        return Term("direct", (), raw)
    m = re.match(r"(?i)^default\s*value\s*:\s*(.*)$", t, re.S)
    if m:
        value = _strip_explanation(m.group(1))
        return Term("default", (parse_arg(value),), raw)
    m = _NAME.match(t)
    if not m:
        raise TermError(f"unknown transformation {raw!r}")
    key = m.group(1).lower().replace(" ", "")
    key = ALIASES.get(key, key)
    if key not in TERM_ARGS:
        raise TermError(f"unknown transformation {raw!r}")
    rest = t[m.end():].lstrip()
    args: tuple[Arg, ...] = ()
    if TERM_ARGS[key] and rest.startswith("("):
        end = _closing(rest, 0)
        inner = rest[1:end]
        args = tuple(parse_arg(a) for a in _split_top(inner, ",")) if inner.strip() else ()
    return Term(key, args, raw)


def parse_cell(text: str | None) -> list[Term]:
    """All terms of one transformation cell, in application order."""
    if text is None or not str(text).strip():
        return [Term("direct", (), "")]
    return [parse_term(part) for part in _split_top(str(text), ";") if part.strip()]


_IDENT = re.compile(r"`[^`]+`|\"[^\"]*\"|'[^']*'|[A-Za-z_][A-Za-z_0-9]*")

# SQL words allowed inside Conditional / CaseWhen / NumericCalculation text.
SQL_WORDS = {"and", "or", "not", "is", "null", "in", "like", "between", "true", "false"}


def identifiers(expr: str) -> list[str]:
    """Bare identifiers referenced by an expression (quoted text and SQL words skipped)."""
    out = []
    for tok in _IDENT.findall(expr):
        if tok[0] in "\"'":
            continue
        name = tok.strip("`")
        if name.lower() in SQL_WORDS:
            continue
        out.append(name)
    return out


def term_references(term: Term) -> list[str]:
    """Column names a term reads (besides the row's own source field)."""
    if term.name == "concatenate":
        return [a.value for a in term.args if a.kind == "ident"]
    if term.name in ("substring_col", "trimsymbols", "trimtrailingzeros", "trimleadingzeros",
                     "dateextraction") and term.args:
        return [term.args[0].value] if term.args[0].kind in ("ident", "lit") else []
    if term.name == "nullhandling":
        return [a.value for a in term.args[:-1]]
    if term.name == "numericcalculation":
        return identifiers(",".join(a.value if a.kind != "lit" else a.value for a in term.args))
    if term.name == "conditional" and term.args:
        return identifiers(term.args[0].value)
    if term.name == "casewhen":
        conds = term.args[0:len(term.args) - (len(term.args) % 2):2]
        return [n for c in conds for n in identifiers(c.value)]
    return []
