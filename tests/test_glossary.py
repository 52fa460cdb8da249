"""Glossary terms on hand-built rows: NULL, empty, Unicode and bad input."""

import datetime as dt
from decimal import Decimal

import pytest

from strata.functions.terms import TermError
from strata.operators.project import order_by_dependency, project, split_rejects
from strata.spec import ColumnMapping as M

ROWS = [
    ("1", "  Ab c\t\n", "240305", "1000", "00120", "100", "ÉTé-42**", None),
    ("2", None, "bad", "1,234", "000", "0", "x**y", "z"),
    ("3", "", "20240301", "abc", "7", "1200", "ok", "w"),
    ("4", "DE fr", "2024-03-01", "1000.5", None, None, None, None),
]
COLS = "id string, s string, d string, amt string, lead string, trail string, code string, alt string"


@pytest.fixture(scope="module")
def src(spark):
    return spark.createDataFrame(ROWS, COLS)


def run(src, *maps, **kw):
    rows = project(src, [M("id", "STRING", "id"), *maps], **kw).orderBy("id").collect()
    return [r.asDict() for r in rows]


def col(rows, name):
    return [r[name] for r in rows]


def test_trim_whitespace_not_only_spaces(src):
    assert col(run(src, M("v", "STRING", "s", transformation="Trim")), "v") == [
        "Ab c", None, "", "DE fr"]


def test_case_terms(src):
    r = run(src, M("u", "STRING", "s", transformation="Trim; Uppercase"),
            M("l", "STRING", "s", transformation="Trim; lowercase"),
            M("t", "STRING", "s", transformation="Trim; titlecase"))
    assert col(r, "u") == ["AB C", None, "", "DE FR"]
    assert col(r, "l") == ["ab c", None, "", "de fr"]
    assert col(r, "t") == ["Ab C", None, "", "De Fr"]


def test_zeros(src):
    r = run(src, M("a", "STRING", transformation='trimleadingzeros("lead")'),
            M("b", "STRING", transformation='trimtrailingzeros("trail")'))
    assert col(r, "a") == ["120", "", "7", None]
    assert col(r, "b") == ["1", "", "12", None]


def test_trimsymbols_keeps_letters_beyond_ascii(src):
    r = run(src, M("c", "STRING", transformation='trimsymbols("code")'))
    assert col(r, "c") == ["ÉTé42", "xy", "ok", None]


def test_replace_is_literal(src):
    r = run(src, M("c", "STRING", "code", transformation='replace("**", "US1")'))
    assert col(r, "c") == ["ÉTé-42US1", "xUS1y", "ok", None]


def test_date_calculation_parses_text_dates(src):
    r = run(src, M("d2", "DATE", "d", transformation="DateCalculation(-20)"))
    assert col(r, "d2") == [dt.date(2024, 2, 14), None, dt.date(2024, 2, 10),
                            dt.date(2024, 2, 10)]


def test_date_formatting_month_not_minutes(src):
    r = run(src, M("f", "STRING", "d", transformation='DateFormatting("yyyy-mm-dd")'))
    assert col(r, "f") == ["2024-03-05", None, "2024-03-01", "2024-03-01"]


def test_conditional_on_text_amount(src):
    r = run(src, M("cur", "STRING", transformation='Conditional("amt > 1000", "US", "IND")'))
    # exactly 1000 is not > 1000; '1,234' and 'abc' are not numbers -> else branch
    assert col(r, "cur") == ["IND", "IND", "IND", "US"]


def test_casewhen_default_and_no_default(src):
    r = run(src, M("a", "STRING", transformation='CaseWhen("amt > 1000", "hi", "amt > 0", "lo", "none")'),
            M("b", "STRING", transformation='CaseWhen("amt > 1000", "hi")'))
    assert col(r, "a") == ["lo", "none", "none", "hi"]
    assert col(r, "b") == [None, None, None, "hi"]


def test_concatenate_null_in_null_out(src):
    r = run(src, M("k", "STRING", transformation='Concatenate(id, "|", alt)'))
    assert col(r, "k") == [None, "2|z", "3|w", None]


def test_null_handling_and_defaults(src):
    r = run(src, M("n", "STRING", transformation='NullHandling("alt", "s", "PL")'),
            M("sys", "INT", transformation="Default Value: 420"),
            M("flag", "STRING", transformation="Default", default="Y"))
    assert col(r, "n") == ["  Ab c\t\n", "z", "w", "DE fr"]
    assert set(col(r, "sys")) == {420} and set(col(r, "flag")) == {"Y"}


def test_numeric_calculation_bad_text_is_null(src):
    r = run(src, M("x", "DOUBLE", transformation="NumericCalculation(amt * 2)"))
    assert col(r, "x") == [2000.0, None, None, 2001.0]


def test_derived_on_derived_and_cycle(src):
    r = run(src, M("short", "STRING", transformation='Substring_col("key", 1, 3)'),
            M("key", "STRING", transformation='Concatenate(code, "-", id)'))
    assert col(r, "short") == ["ÉTé", "x**", "ok-", None]
    with pytest.raises(TermError):
        order_by_dependency([M("a", transformation="Substring_col(b, 1, 1)"),
                             M("b", transformation="Substring_col(a, 1, 1)")])


def test_unknown_column_names_the_target(src):
    with pytest.raises(TermError, match="bad_target"):
        project(src, [M("bad_target", "STRING", transformation="Concatenate(nope)")])


def test_reject_policy_quarantines_bad_casts(src):
    df = project(src, [M("id", "STRING", "id"), M("a", "DECIMAL(18,2)", "amt")], policy="reject")
    good, bad = split_rejects(df)
    assert sorted(r.id for r in good.collect()) == ["1", "4"]
    assert sorted(r.id for r in bad.collect()) == ["2", "3"]
    assert [r.a for r in good.orderBy("id").collect()] == [Decimal("1000.00"), Decimal("1000.50")]


def test_travel_tax_mapping(spark):
    """The approved travel-tax mapping shape: derived ids, yyMMdd dates, defaults."""
    rows = [("240305", "ab agency", "0102", " 7 ", "1200", "**", "1500.50", "0USD", "usd", "Ax", None, "PLX")]
    src = spark.createDataFrame(rows, "TXIDTE string, TXMCID string, TXACBR string, TXINV string, "
                                      "TXSEQN string, TXCODE string, TXAMT string, TXOCUR string, "
                                      "TXCCUR string, TXTRNR string, TXFIL1 string, TXFIL2 string")
    maps = [
        M("SystemId", "INT", transformation="Default Value: 420 (Uses the hardcoded value 420)"),
        M("BusinessTravelInvoiceUniqueId", "STRING", transformation=(
            'Concatenate(BusinessTravelAgencyUniqueId,"|",TravelAgencyAccountingBranchCode,"|",'
            'TravelInvoiceId,"|",TravelInvoiceLineId)')),
        M("BusinessTravelTaxDetailUniqueId", "STRING",
          transformation='Substring_col("BusinessTravelInvoiceUniqueId", 1, 3)'),
        M("TravelInvoiceDate", "DATE", "TXIDTE", source_type="STRING",
          transformation="DateCalculation(-20)"),
        M("InvoiceDateDirect", "DATE", "TXIDTE", transformation="Direct"),
        M("BusinessTravelAgencyUniqueId", "STRING", "TXMCID", transformation="TitleCase"),
        M("TravelAgencyAccountingBranchCode", "STRING", "TXACBR", transformation="Substring(1, 2)"),
        M("TravelInvoiceId", "STRING", transformation='DateExtraction("TravelInvoiceDate", "yyyy")'),
        M("TravelInvoiceLineId", "STRING", "TXINV", transformation="Trim"),
        M("TaxDetailLineId", "STRING", transformation='trimtrailingzeros("TXSEQN")'),
        M("TaxCode", "STRING", "TXCODE", transformation='replace("**", "US1")'),
        M("TaxAmount", "DECIMAL(18,2)", "TXAMT", transformation="Direct"),
        M("OriginalCurrencyCode", "STRING", transformation='trimleadingzeros("TXOCUR")'),
        M("CurrencyCode", "STRING", transformation='Conditional("TXAMT > 1000", "US", "IND")'),
        M("MaximumTransactionNumberValue", "STRING", "TXTRNR", transformation="Uppercase"),
        M("CompanyCode", "STRING", transformation='NullHandling("TXFIL1", "TXFIL2", "PL")'),
    ]
    r = project(src, maps).collect()[0].asDict()
    assert r["TravelInvoiceDate"] == dt.date(2024, 2, 14)
    assert r["InvoiceDateDirect"] == dt.date(2024, 3, 5)
    assert r["BusinessTravelInvoiceUniqueId"] == "Ab Agency|01|2024|7"
    assert r["BusinessTravelTaxDetailUniqueId"] == "Ab "
    assert r["TaxDetailLineId"] == "12" and r["TaxCode"] == "US1"
    assert r["TaxAmount"] == Decimal("1500.50") and r["CurrencyCode"] == "US"
    assert r["OriginalCurrencyCode"] == "USD" and r["CompanyCode"] == "PLX"
    assert r["SystemId"] == 420 and r["MaximumTransactionNumberValue"] == "AX"


def test_reject_policy_covers_casts_inside_terms(src):
    df = project(src, [M("id", "STRING", "id"),
                       M("n", "INT", transformation='NullHandling("amt", "lead", "0")')],
                 policy="reject")
    got = {r.id: (r.n, r._rejected) for r in df.collect()}
    assert got["1"] == (1000, False) and got["2"] == (0, False)


def test_date_pattern_normalisation():
    from strata.functions.glossary import normalise_date_pattern
    assert normalise_date_pattern("yyyy-mm-dd") == "yyyy-MM-dd"
    assert normalise_date_pattern("YYYY/DD/mm") == "yyyy/dd/MM"
    assert normalise_date_pattern("yyyy-MM-dd HH:mm") == "yyyy-MM-dd HH:mm"  # minutes stay


def test_casewhen_quoted_commas_and_text_compare(spark):
    df = spark.createDataFrame([("a,b", 5), ("x", 50), (None, None)], "s string, n int")
    r = project(df, [M("k", "STRING", transformation=(
        "CaseWhen(\"s = 'a,b'\", \"comma, kept\", \"n >= 50\", \"big\", \"other\")"))]).collect()
    assert [x.k for x in r] == ["comma, kept", "big", "other"]


def test_expression_rejects_unsupported_text(spark):
    df = spark.createDataFrame([(1,)], "n int")
    with pytest.raises(TermError):
        project(df, [M("x", "INT", transformation="NumericCalculation(n; DROP TABLE t)")])


def test_text_against_signed_numbers_and_zero_divisors(spark):
    df = spark.createDataFrame([("-3", 0), ("x", 2), ("7", 4)], "t string, z int")

    def one(text, policy="strict", kind="STRING"):
        out = project(df, [M("o", kind, transformation=text)], policy=policy)
        return [r.o for r in out.collect()]

    assert one('Conditional("t > -5", "y", "n")') == ["y", "n", "y"]
    assert one('Conditional("t BETWEEN -5 AND 5", "y", "n")') == ["y", "n", "n"]
    assert one('Conditional("t IN (7, 8)", "y", "n")') == ["n", "n", "y"]
    assert one('Conditional("t NOT IN (7, 8)", "y", "n")') == ["y", "n", "n"]
    assert one("NumericCalculation(8 / z)", "reject", "DOUBLE") == [None, 4.0, 2.0]
    assert one("NumericCalculation(8 / (z * 1) + 1)", "reject", "DOUBLE") == [None, 5.0, 3.0]


TEXTS = ["C:\\temp", "it's", 'say "hi"', "a\\'b", "two\nlines", "end\\", "\\\\host\\n", "') OR ('1'='1", "é\t'", "%_"]


def test_quoted_text_in_conditions_is_plain_text(spark):
    """A backslash, quotes of both kinds (doubled inside their own) and line ends mean themselves."""
    src_ = spark.createDataFrame([(str(i), x) for i, x in enumerate(TEXTS)], "id string, p string")
    for i, x in enumerate(TEXTS):
        single, double = x.replace("'", "''"), x.replace('"', '""')
        for cond in (f"p = '{single}'", f'p = "{double}"', f"p IN ('{single}', 'none')", f"not p <> '{single}'"):
            quoted = cond.replace('"', '""')
            for cell in (f'Conditional("{quoted}", "yes", "no")', f'CaseWhen("{quoted}", "yes", "no")'):
                out = run(src_, M("v", "STRING", transformation=cell))
                assert [r["id"] for r in out if r["v"] == "yes"] == [str(i)], (cell, out)


def test_filters_and_join_conditions_keep_backslashes(spark):
    from strata.operators.project import apply_filters
    from strata.plans.documents import joined_sources
    src_ = spark.createDataFrame([(str(i), x) for i, x in enumerate(TEXTS)], "id string, p string")
    for i, x in enumerate(TEXTS):
        if "\\" in x:
            for text in ("'" + x.replace("'", "''") + "'", '"' + x.replace('"', '""') + '"'):
                assert [r.id for r in apply_filters(src_, [f"p = {text} AND DATE '2024-01-01' > DATE'2023-01-01'"]).collect()] == [str(i)]
    other = spark.createDataFrame([("0", "k")], "key string, w string")
    maps = [M("a", "STRING", "p", source_table="main"), M("w", "STRING", "w", source_table="other",
                                                          join_condition="main.id = other.key AND main.p = 'C:\\temp'")]
    frame, _ = joined_sources({"main": src_, "other": other}, maps)
    assert [tuple(r) for r in frame.select("p", "w").collect()] == [("C:\\temp", "k")]
