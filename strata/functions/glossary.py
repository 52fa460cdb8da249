"""The transformation glossary (SC-1..SC-23) as ``Column`` builders.

Every builder returns a Spark SQL expression; nothing runs in Python per row. A builder
gets a :class:`TermContext` that resolves names (a name may be a source column or another
target column, PRJ-3), knows their types, and carries the value of the previous step.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.terms import SQL_WORDS, Arg, Term, TermError, text_literal, unquoted

# String formats tried, in order, when a date arrives as text and the
# mapping gives no format (the approved mapping carries yyMMdd dates).
DEFAULT_DATE_FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "yyMMdd")

# Whitespace as the glossary means it for Trim (Spark's trim only strips spaces).
TRIM_WS = r"^\s+|\s+$"
NON_ALNUM = r"[^\p{L}\p{N}]"


@dataclass
class TermContext:
    target: str
    target_type: str
    resolve: Callable[[str], Column]        # name -> Column
    sql_name: Callable[[str], str]          # name -> backticked name in the frame
    dtype: Callable[[str], T.DataType | None]
    current: Column
    current_type: T.DataType | None
    source_format: str | None = None
    default: str | None = None
    policy: str = "strict"                  # "reject": casts inside terms never fail

    def cast(self, c: Column, to) -> Column:
        return c.try_cast(to) if self.policy == "reject" else c.cast(to)

    def col_arg(self, a: Arg) -> tuple[Column, T.DataType | None]:
        """An argument naming a column, quoted or bare (e.g. ``trimsymbols("SPRAS")``)."""
        if a.kind == "num":
            raise TermError(f"{self.target}: expected a column name, got {a.value}")
        return self.resolve(a.value), self.dtype(a.value)


def _is_string(t: T.DataType | None) -> bool:
    return t is None or isinstance(t, (T.StringType, T.VarcharType, T.CharType))


def as_text(c: Column, t: T.DataType | None) -> Column:
    return c if _is_string(t) and t is not None else c.cast("string")


def as_date(c: Column, t: T.DataType | None, fmt: str | None = None) -> Column:
    """A DATE from a date, timestamp or text column; unparseable text gives NULL.

    A plain cast of ``'240305'`` would give year 240305, so text is parsed by format.
    """
    if isinstance(t, T.DateType):
        return c
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    fmts = (fmt,) if fmt else DEFAULT_DATE_FORMATS
    parsed = [F.to_date(F.try_to_timestamp(c.cast("string"), F.lit(f))) for f in fmts]
    return parsed[0] if len(parsed) == 1 else F.coalesce(*parsed)


def normalise_date_pattern(p: str) -> str:
    """``yyyy-mm-dd`` in a mapping means month; Spark's ``mm`` is minutes.

    A pattern with no hour or second letters is date-only, so ``mm`` becomes ``MM``.
    Upper-case year and day letters (week-year, day-of-year in Spark) become lower case.
    """
    if not re.search(r"[hHkKsS]", p):
        p = p.replace("mm", "MM")
    return p.replace("YYYY", "yyyy").replace("YY", "yy").replace("DD", "dd")


_TOKEN = re.compile(
    r"(?P<ws>\s+)|(?P<str>'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")|(?P<num>\d+(?:\.\d+)?)"
    r"|(?P<id>`[^`]+`|[A-Za-z_][A-Za-z_0-9]*)|(?P<op><=|>=|<>|!=|[-+*/%()<>=,])")
_CMP = {"<", ">", "<=", ">=", "=", "<>", "!="}


def sql_expression(text: str, ctx: TermContext, numeric: bool = False) -> Column:
    """Turn a condition or arithmetic text from a mapping into a Column.

    Only names, numbers, quoted text, arithmetic/comparison operators and a few SQL words
    are accepted. Names resolve to source or target columns. A text column compared with,
    or used in arithmetic as, a number goes through ``try_cast`` so bad values give NULL
    instead of failing the job (e.g. ``TXAMT > 1000`` on a STRING).
    """
    pos, toks = 0, []
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m:
            raise TermError(f"{ctx.target}: unsupported text in expression {text!r}")
        pos = m.end()
        if m.lastgroup != "ws":
            toks.append((m.lastgroup, m.group()))
    out = []
    for i, (kind, tok) in enumerate(toks):
        if kind == "str":
            out.append(text_literal(unquoted(tok)))
        elif kind == "id" and tok.lower() in SQL_WORDS:
            out.append(tok.upper())
        elif kind == "id":
            name = tok.strip("`")
            ref = ctx.sql_name(name)
            prev_ = toks[i - 1] if i > 0 else (None, None)
            near_number = (_meets_number(toks, i + 1)
                           or (prev_[1] in _CMP and i >= 2 and toks[i - 2][0] == "num"))
            if _is_string(ctx.dtype(name)) and (numeric or near_number):
                ref = f"try_cast({ref} AS DOUBLE)"
            out.append(ref)
        else:
            out.append("!=" if tok == "<>" else tok)
    if ctx.policy == "reject":
        out = _null_divisors(out)
    return F.expr(" ".join(out))


def _meets_number(toks: list, i: int) -> bool:
    """Is what starts at token ``i`` a comparison with a number: an operator, [NOT] BETWEEN or
    [NOT] IN (, then a number that may have a sign?"""
    def token(k):
        return toks[k][1].upper() if k < len(toks) else ""

    if token(i) == "NOT":
        i += 1
    if token(i) == "IN" and token(i + 1) == "(":
        i += 2
    elif token(i) == "BETWEEN" or token(i) in _CMP:
        i += 1
    else:
        return False
    if token(i) in ("-", "+"):
        i += 1
    return i < len(toks) and toks[i][0] == "num"


def _null_divisors(parts: list) -> list:
    """Divisors as NULLIF(divisor, 0): a division by zero gives NULL, which rejects the row,
    and does not fail the job."""
    out, k = [], 0
    while k < len(parts):
        out.append(parts[k])
        if parts[k] in ("/", "%") and k + 1 < len(parts):
            end = k + 2
            if parts[k + 1] == "(":
                depth = 1
                while end < len(parts) and depth:
                    depth += {"(": 1, ")": -1}.get(parts[end], 0)
                    end += 1
            inner = _null_divisors(parts[k + 1:end])
            out += ["NULLIF(", *inner, ", 0)"]
            k = end
        else:
            k += 1
    return out


def _lit_value(a: Arg) -> Column:
    return F.lit(a.value)


def _int(a: Arg, ctx: TermContext, what: str) -> int:
    try:
        return int(float(a.value))
    except ValueError as e:
        raise TermError(f"{ctx.target}: {what} must be a number, got {a.value!r}") from e


def _need(term: Term, ctx: TermContext, lo: int, hi: int | None = None) -> None:
    n = len(term.args)
    if n < lo or (hi is not None and n > hi):
        raise TermError(f"{ctx.target}: {term.name} takes {lo}..{hi or 'n'} arguments, got {n}")


def _on(term: Term, ctx: TermContext) -> tuple[Column, T.DataType | None]:
    """The column a one-column term works on: its explicit argument, else the current value."""
    if term.args:
        return ctx.col_arg(term.args[0])
    return ctx.current, ctx.current_type


def t_direct(term, ctx):
    return ctx.current


def t_concatenate(term, ctx):
    _need(term, ctx, 1)
    parts = []
    for a in term.args:
        if a.kind == "ident":
            c, t = ctx.col_arg(a)
            parts.append(as_text(c, t))
        else:
            parts.append(F.lit(a.value))
    return F.concat(*parts)


def t_uppercase(term, ctx):
    return F.upper(as_text(ctx.current, ctx.current_type))


def t_lowercase(term, ctx):
    return F.lower(as_text(ctx.current, ctx.current_type))


def t_titlecase(term, ctx):
    return F.initcap(as_text(ctx.current, ctx.current_type))


def t_substring(term, ctx):
    _need(term, ctx, 2, 2)
    s = as_text(ctx.current, ctx.current_type)
    return F.substring(s, _int(term.args[0], ctx, "start"), _int(term.args[1], ctx, "length"))


def t_substring_col(term, ctx):
    _need(term, ctx, 3, 3)
    c, t = ctx.col_arg(term.args[0])
    return F.substring(as_text(c, t), _int(term.args[1], ctx, "start"),
                       _int(term.args[2], ctx, "length"))


def t_replace(term, ctx):
    """Literal (not regex) replacement of every occurrence."""
    _need(term, ctx, 2, 2)
    return F.replace(as_text(ctx.current, ctx.current_type), _lit_value(term.args[0]),
                     _lit_value(term.args[1]))


def t_trim(term, ctx):
    return F.regexp_replace(as_text(ctx.current, ctx.current_type), TRIM_WS, "")


def t_trimsymbols(term, ctx):
    c, t = _on(term, ctx)
    return F.regexp_replace(as_text(c, t), NON_ALNUM, "")


def t_trimtrailingzeros(term, ctx):
    c, t = _on(term, ctx)
    return F.regexp_replace(as_text(c, t), "0+$", "")


def t_trimleadingzeros(term, ctx):
    c, t = _on(term, ctx)
    return F.regexp_replace(as_text(c, t), "^0+", "")


def t_dateformatting(term, ctx):
    _need(term, ctx, 1, 1)
    pattern = normalise_date_pattern(term.args[0].value)
    t = ctx.current_type
    src = ctx.current if isinstance(t, (T.TimestampType, T.TimestampNTZType)) else \
        as_date(ctx.current, t, ctx.source_format)
    return F.date_format(src, pattern)


def t_datecalculation(term, ctx):
    _need(term, ctx, 1, 1)
    return F.date_add(as_date(ctx.current, ctx.current_type, ctx.source_format),
                      _int(term.args[0], ctx, "days"))


def t_dateextraction(term, ctx):
    _need(term, ctx, 2, 2)
    c, t = ctx.col_arg(term.args[0])
    src = c if isinstance(t, (T.TimestampType, T.TimestampNTZType)) else as_date(c, t)
    return F.date_format(src, normalise_date_pattern(term.args[1].value))


def t_numericcalculation(term, ctx):
    _need(term, ctx, 1, 1)
    return sql_expression(term.args[0].value, ctx, numeric=True)


def t_conditional(term, ctx):
    _need(term, ctx, 3, 3)
    cond = sql_expression(term.args[0].value, ctx)
    return F.when(cond, _lit_value(term.args[1])).otherwise(_lit_value(term.args[2]))


def t_casewhen(term, ctx):
    """First true condition wins; an odd argument count makes the last one the default."""
    _need(term, ctx, 2)
    args = list(term.args)
    default = args.pop() if len(args) % 2 else None
    expr = None
    for cond, val in zip(args[0::2], args[1::2]):
        c = sql_expression(cond.value, ctx)
        expr = F.when(c, _lit_value(val)) if expr is None else expr.when(c, _lit_value(val))
    return expr.otherwise(_lit_value(default)) if default is not None else expr


def t_nullhandling(term, ctx):
    """All but the last argument are columns; the last is the literal fallback."""
    _need(term, ctx, 2)
    cols = [ctx.cast(ctx.col_arg(a)[0], ctx.target_type) for a in term.args[:-1]]
    return F.coalesce(*cols, ctx.cast(F.lit(term.args[-1].value), ctx.target_type))


def t_default(term, ctx):
    if term.args:
        return F.lit(term.args[0].value)
    if ctx.default is None:
        raise TermError(f"{ctx.target}: 'Default' needs a default value in the mapping")
    return F.lit(ctx.default)


def t_etlauditcolumn(term, ctx):
    """Audit columns pass through from the source when it has them (PRJ-5), else NULL
    until the load stamps them (PRJ-6)."""
    return ctx.current


BUILDERS: dict[str, Callable[[Term, TermContext], Column]] = {
    "direct": t_direct,
    "concatenate": t_concatenate,
    "uppercase": t_uppercase,
    "lowercase": t_lowercase,
    "titlecase": t_titlecase,
    "substring": t_substring,
    "substring_col": t_substring_col,
    "replace": t_replace,
    "trim": t_trim,
    "trimsymbols": t_trimsymbols,
    "trimtrailingzeros": t_trimtrailingzeros,
    "trimleadingzeros": t_trimleadingzeros,
    "dateformatting": t_dateformatting,
    "datecalculation": t_datecalculation,
    "dateextraction": t_dateextraction,
    "numericcalculation": t_numericcalculation,
    "conditional": t_conditional,
    "casewhen": t_casewhen,
    "nullhandling": t_nullhandling,
    "default": t_default,
    "etlauditcolumn": t_etlauditcolumn,
}

# Output type of a term when it is not the identity of its input.
_RESULT_TYPE = {
    "direct": None, "etlauditcolumn": None, "datecalculation": T.DateType(),
    "numericcalculation": T.DoubleType(),
}


def apply_term(term: Term, ctx: TermContext) -> tuple[Column, T.DataType | None]:
    """Apply one term; returns the new value and its (best known) type."""
    fn = BUILDERS.get(term.name)
    if fn is None:
        raise TermError(f"{ctx.target}: unknown transformation {term.raw!r}")
    out = fn(term, ctx)
    if term.name in ("direct", "etlauditcolumn"):
        return out, ctx.current_type
    if term.name == "nullhandling":  # operands are cast to the target type
        from strata.operators.project import parse_type
        return out, parse_type(ctx.target_type)
    return out, _RESULT_TYPE.get(term.name, T.StringType())


def null_if_negative(c: Column) -> Column:
    """FIL-4: a negative value becomes NULL (NULL stays NULL)."""
    return F.when(c >= 0, c)


def null_safe(c: Column, default=0) -> Column:
    """FIL-5: NULL-safe numeric operand."""
    return F.coalesce(c, F.lit(default))


def mixed_coalesce(number: Column, text: Column, to: str = "decimal(18,6)") -> Column:
    """SC-23: a number column, else the number parsed from a text column.

    ``COALESCE(ValueNumber, ValueText)`` fails under ANSI on non-numeric text, so the text
    side goes through ``try_cast``.
    """
    return F.coalesce(number.cast(to), text.try_cast(to))
