"""Glossary term reader (no Spark)."""

import pytest

from strata.functions.terms import TermError, parse_cell, parse_term, term_references


def test_explanation_is_dropped():
    t = parse_term("Direct Pull (Directly maps MANDT to ClientId with casting to target type)")
    assert t.name == "direct" and t.args == ()


def test_default_value_with_explanation():
    t = parse_term("Default Value: 420 (Uses the hardcoded value 420)")
    assert t.name == "default" and t.args[0].value == "420"
    assert parse_term("Default Value: 'PL'").args[0].kind == "lit"


def test_concatenate_roles():
    t = parse_term('Concatenate(a,"|",b) (Joins columns with the \'|\' delimiter)')
    assert [(a.kind, a.value) for a in t.args] == [("ident", "a"), ("lit", "|"), ("ident", "b")]
    assert term_references(t) == ["a", "b"]


def test_case_insensitive_and_spaces():
    assert parse_term("Trim Symbols(\"SPRAS\")").name == "trimsymbols"
    assert parse_term("UPPERCASE").name == "uppercase"
    assert parse_term("Case When(\"x > 1\", \"a\", \"b\")").name == "casewhen"


def test_multi_step_and_blank():
    assert [t.name for t in parse_cell("Trim; Uppercase; Substring(1, 5)")] == [
        "trim", "uppercase", "substring"]
    assert [t.name for t in parse_cell("")] == ["direct"]
    assert [t.name for t in parse_cell(None)] == ["direct"]


def test_quoted_comma_and_paren_inside_argument():
    t = parse_term('replace("a, (b)", "c")')
    assert [a.value for a in t.args] == ["a, (b)", "c"]


def test_unknown_term_is_an_error():
    with pytest.raises(TermError):
        parse_term("Frobnicate(x)")


def test_condition_references():
    t = parse_term("CaseWhen(\"score > 90\", \"A\", \"score > 75 AND bonus IS NULL\", \"B\", \"C\")")
    assert term_references(t) == ["score", "score", "bonus"]
