"""Text metrics over documents, pages, conversations and SQL texts (TX-1..TX-8).

SQL-like texts (for clause counts, version comparison and the SQL lint) are derived from
``orders`` rows: each order renders one generated query / notebook text whose joins,
validations and defects follow the order's priority and status.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.catalog import query
from strata.catalog.common import t
from strata.operators.textmetrics import (DATAFRAME_CALLS, blocks, clause_counts, code_metrics, compare_versions,
                                          est_tokens, lint_sql_texts, sections, strip_fences)

# ---- derived SQL texts ------------------------------------------------------------


def _sql_versions(spark, sf):
    o = t(spark, sf, "orders")
    n = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    big = F.col("o_totalprice") > 250000
    status = F.col("o_orderstatus")

    def render(alias_o, alias_c, joins, coalesce):
        return F.concat(
            F.lit(f"SELECT {alias_o}.o_orderkey, "),
            F.when(coalesce, F.lit(f"COALESCE({alias_o}.v, {alias_o}.w) AS v, ")).otherwise(F.lit("")),
            F.lit(f"{alias_o}.k FROM orders {alias_o} "),
            F.repeat(F.lit(f"LEFT JOIN customer {alias_c} ON {alias_o}.k = {alias_c}.k "), joins),
            F.when(status == "F", F.lit(f"WHERE {alias_o}.k IS NOT NULL"))
            .when(status == "O", F.lit(f"WHERE {alias_o}.k IS NULL AND CASE WHEN {alias_o}.v > 0 "
                                       "THEN 1 END = 1"))
            .otherwise(F.lit("")))

    return o.select("o_orderkey",
                    render("tbl_orders", "tbl_customer", n, big).alias("sql_v1"),
                    render("a", "c", F.greatest(n - 1, F.lit(0)), F.lit(True)).alias("sql_v2"))


def _render_sql(o, c, joins, coalesce):
    return (f"'SELECT {o}.o_orderkey, ' || CASE WHEN {coalesce} THEN 'COALESCE({o}.v, {o}.w) AS v, ' "
            f"ELSE '' END || '{o}.k FROM orders {o} ' || "
            f"repeat('LEFT JOIN customer {c} ON {o}.k = {c}.k ', {joins}) || "
            f"CASE o_orderstatus WHEN 'F' THEN 'WHERE {o}.k IS NOT NULL' "
            f"WHEN 'O' THEN 'WHERE {o}.k IS NULL AND CASE WHEN {o}.v > 0 THEN 1 END = 1' "
            f"ELSE '' END")


_N = "(CAST(substring(o_orderpriority, 1, 1) AS INTEGER) - 1)"
SQL_VERSIONS = f"""sqlv AS (
  SELECT o_orderkey,
         {_render_sql('tbl_orders', 'tbl_customer', _N, 'o_totalprice > 250000')} AS sql_v1,
         {_render_sql('a', 'c', f'greatest({_N} - 1, 0)', 'true')} AS sql_v2
  FROM orders)"""


def _count(pattern, col):
    return f"CAST(len(regexp_extract_all({col}, '{pattern}')) AS BIGINT)"


_VALIDATION = " + ".join(_count(p, "{c}") for p in (
    r"(?i)\bCASE\b", r"(?i)\bWHERE\b", r"(?i)\bCOALESCE\b", r"(?i)\bIS NOT NULL\b",
    r"(?i)\bIS NULL\b"))


def _clauses(c):
    return (f"{_count(r'(?i)\bJOIN\b', c)} AS joins, "
            f"{_count(r'(?i)\b(?:FROM|JOIN)\s+\w+\s+(\w+)\b', c)} AS table_aliases, "
            f"({_VALIDATION.format(c=c)}) AS validation_clauses, "
            f"{_count('(?i)CURRENT_TIMESTAMP|ETL_USER', c)} AS audit_clauses")


# ---- queries ----------------------------------------------------------------------


@query("tx01_est_tokens", """
SELECT doc_id, lang, CAST(length(text) AS BIGINT) AS length,
       CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM documents""")
def tx01(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", "lang", F.length("text").cast("bigint").alias("length"),
                    est_tokens(F.col("text")).alias("tokens"))


PAGE_MARKS = (("head", "<head>", "</head>"), ("nav", "<nav>", "</nav>"),
              ("article", "<article>", "</article>"), ("script", "<script>", "</script>"),
              ("footer", "<footer", "</footer>"), ("main", "<main", "</main>"))


def _section_sql(name, start, end):
    rest = f"substring(html, greatest(instr(html, '{start}'), 1))"
    body = (f"CASE WHEN instr(html, '{start}') = 0 THEN '' "
            f"WHEN instr({rest}, '{end}') = 0 THEN {rest} "
            f"ELSE substring({rest}, 1, instr({rest}, '{end}') - 1) END")
    return (f"SELECT page_id, '{name}' AS section, CAST(length({body}) AS BIGINT) AS length, "
            f"CAST(floor(length({body}) / 4) AS BIGINT) AS tokens FROM pages")


@query("tx02_sections", "WITH s AS (" + " UNION ALL ".join(_section_sql(*m) for m in PAGE_MARKS)
       + ") SELECT *, CAST(sum(tokens) OVER (PARTITION BY page_id) AS BIGINT) AS total_tokens FROM s")
def tx02(spark, sf):
    return sections(t(spark, sf, "pages"), "page_id", "html", PAGE_MARKS)


@query("tx03_clause_counts", f"WITH {SQL_VERSIONS} SELECT o_orderkey, {_clauses('sql_v1')} FROM sqlv")
def tx03(spark, sf):
    v = _sql_versions(spark, sf)
    c = clause_counts(F.col("sql_v1"))
    return v.select("o_orderkey", *[x.alias(k) for k, x in c.items()])


@query("tx04_code_metrics", f"""
SELECT doc_id, {_count('(?m)#.*$', 'text')} AS comments, {_count(r'def\s+\w+', 'text')} AS functions,
       {_count(r'\w+\s*=', 'text')} AS variables,
       {_count(r'if\s+|for\s+|while\s+', 'text')} AS complexity
FROM documents""")
def tx04(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", *[x.alias(k) for k, x in code_metrics(F.col("text")).items()])


@query("tx05_compare_versions", f"""WITH {SQL_VERSIONS},
m AS (SELECT o_orderkey, CAST(length(sql_v1) AS BIGINT) AS length_a,
             CAST(length(sql_v2) AS BIGINT) AS length_b,
             CAST(floor(length(sql_v1) / 4) AS BIGINT) AS tokens_a,
             CAST(floor(length(sql_v2) / 4) AS BIGINT) AS tokens_b,
             {_count(r'(?i)\bJOIN\b', 'sql_v1')} AS joins_a,
             {_count(r'(?i)\bJOIN\b', 'sql_v2')} AS joins_b,
             {_count(r'(?i)\b(?:FROM|JOIN)\s+\w+\s+(\w+)\b', 'sql_v1')} AS al_a,
             {_count(r'(?i)\b(?:FROM|JOIN)\s+\w+\s+(\w+)\b', 'sql_v2')} AS al_b,
             ({_VALIDATION.format(c='sql_v1')}) AS va_a, ({_VALIDATION.format(c='sql_v2')}) AS va_b
      FROM sqlv)
SELECT o_orderkey, length_a, length_b,
       CAST(length_a - length_b AS DOUBLE) / CAST(length_a AS DOUBLE) * 100 AS length_reduction_pct,
       tokens_a, tokens_b,
       CAST(tokens_a - tokens_b AS DOUBLE) / CAST(tokens_a AS DOUBLE) * 100 AS token_reduction_pct,
       joins_a, joins_b, al_b - al_a AS alias_improvement, va_b - va_a AS validation_improvement
FROM m""")
def tx05(spark, sf):
    return compare_versions(_sql_versions(spark, sf), "o_orderkey", "sql_v1", "sql_v2")


@query("tx06_strip_fences", r"""
SELECT conv_id, turn,
       regexp_replace(replace(regexp_replace(
         '```' || CASE WHEN role = 'assistant' THEN 'sql' ELSE '' END || chr(10) || text
           || chr(10) || '```  ', '```[a-zA-Z]*\n', '', 'g'), '```', ''), '^\s+|\s+$', '', 'g')
         AS text
FROM conversations""")
def tx06(spark, sf):
    c = t(spark, sf, "conversations")
    fenced = F.concat(F.lit("```"), F.when(F.col("role") == "assistant", F.lit("sql"))
                      .otherwise(F.lit("")), F.lit("\n"), F.col("text"), F.lit("\n```  "))
    return c.select("conv_id", "turn", strip_fences(fenced).alias("text"))


def _notebooks(spark, sf):
    """A silver or gold text per order (status F -> silver), defects by priority."""
    o = t(spark, sf, "orders")
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    nl = F.lit("\n")
    silver = F.concat(
        F.lit('transform_sql_query_dict = {\n  "tgt": {\n    "sql": """SELECT * FROM bronze_data"""'),
        F.when(pr == "4-NOT SPECIFIED", F.lit(" }}")).otherwise(F.concat(
            F.lit(",\n"),
            F.when(pr == "5-LOW", F.lit("")).otherwise(F.lit('    "merge_key": "k",\n')),
            F.lit('    "merge_type": "upsert"\n  }\n}'))))
    defect = (F.when(pr == "1-URGENT", F.lit('x = orders_df.select("a")\n'))
              .when(pr == "2-HIGH", F.lit("-- a comment\n"))
              .when(pr == "3-MEDIUM", F.lit("print(orders_df)\n"))
              .when(pr == "5-LOW", F.lit("/* block */\n")).otherwise(F.lit("")))
    gold = F.concat(
        F.lit("# gold load\n"),
        F.lit('orders_df = spark.sql("""SELECT * FROM orders_temp_vw -- keep""")\n'),
        F.lit('orders_df.createOrReplaceTempView("orders_vw")\n'), defect,
        F.when(st == "P", F.lit("")).otherwise(
            F.lit('gold_final_df = spark.sql("""\n  SELECT *\n  FROM orders_vw\n""")\n')),
        F.lit(")"), nl)
    return o.select("o_orderkey", F.when(st == "F", "silver").otherwise("gold").alias("layer"),
                    F.when(st == "F", silver).otherwise(gold).alias("text"))


NOTEBOOK_SQL = r"""nb AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'silver' ELSE 'gold' END AS layer,
    CASE WHEN o_orderstatus = 'F' THEN
      'transform_sql_query_dict = {' || chr(10) || '  "tgt": {' || chr(10)
        || '    "sql": <TQ>SELECT * FROM bronze_data<TQ>'
        || CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ' }}' ELSE
             ',' || chr(10) || CASE WHEN o_orderpriority = '5-LOW' THEN ''
                                    ELSE '    "merge_key": "k",' || chr(10) END
             || '    "merge_type": "upsert"' || chr(10) || '  }' || chr(10) || '}' END
    ELSE
      '# gold load' || chr(10)
        || 'orders_df = spark.sql(<TQ>SELECT * FROM orders_temp_vw -- keep<TQ>)' || chr(10)
        || 'orders_df.createOrReplaceTempView("orders_vw")' || chr(10)
        || CASE o_orderpriority WHEN '1-URGENT' THEN 'x = orders_df.select("a")' || chr(10)
                                WHEN '2-HIGH' THEN '-- a comment' || chr(10)
                                WHEN '3-MEDIUM' THEN 'print(orders_df)' || chr(10)
                                WHEN '5-LOW' THEN '/* block */' || chr(10) ELSE '' END
        || CASE WHEN o_orderstatus = 'P' THEN '' ELSE
             'gold_final_df = spark.sql(<TQ>' || chr(10) || '  SELECT *' || chr(10)
             || '  FROM orders_vw' || chr(10) || '<TQ>)' || chr(10) END
        || ')' || chr(10)
    END AS text
  FROM orders),
s AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS st FROM nb),
o AS (SELECT *, regexp_replace(st, '[frFR]*<TQ>[\s\S]*?<TQ>|[frFR]*''''''[\s\S]*?''''''', '', 'g')
              AS outside,
             length(st) - length(replace(st, chr(10), '')) AS newlines FROM s),
l AS (SELECT *, list_filter(list_filter(list_transform(string_split(outside, chr(10)),
                  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''),
                  lambda x: NOT (starts_with(x, '#') OR regexp_matches(x, '^\w+_df\s*=')
                     OR regexp_matches(x, '^\w+_temp_vw\s*=')
                     OR contains(x, '.createOrReplaceTempView') OR x IN (')', '))', ')))')))
              AS stray FROM o)""".replace("<TQ>", '"' * 3)

_GOLD_CALLS = "\n".join(f"      WHEN contains(outside, '{c}') THEN 'frame_call {c.strip('.(')}'" for c in DATAFRAME_CALLS)


@query("tx07_lint_sql_texts", f"""WITH {NOTEBOOK_SQL},
r AS (SELECT layer, CASE WHEN layer = 'silver' THEN
    CASE WHEN COALESCE(text, '') = '' THEN 'empty'
         WHEN NOT (contains(text, '"sql"') OR contains(text, '''sql''')) THEN 'no_sql_key'
         WHEN NOT (contains(text, '"merge_key"') OR contains(text, '''merge_key'''))
           THEN 'no_merge_key'
         WHEN newlines < 5 THEN 'too_few_lines'
         ELSE 'ok' END
  ELSE
    CASE WHEN COALESCE(text, '') = '' THEN 'empty'
      WHEN NOT regexp_matches(st, '(?m)^\\s*\\w+_df\\s*=')
        THEN 'no_frame_assigned'
      WHEN NOT regexp_matches(st, 'gold_final_df\\s*=')
        THEN 'no_final_frame'
      WHEN newlines < 5 THEN 'too_few_lines'
{_GOLD_CALLS}
      WHEN contains(outside, '--')
        THEN 'sql_comment'
      WHEN contains(outside, '/*') OR contains(outside, '*/')
        THEN 'block_comment'
      WHEN len(stray) > 0
        THEN 'stray_line ' || stray[1]
      ELSE 'ok' END END AS reason FROM l)
SELECT layer, reason, count(*) AS texts FROM r GROUP BY ALL""")
def tx07(spark, sf):
    return lint_sql_texts(_notebooks(spark, sf), "layer", "text")


@query("tx08_blocks", r"""
SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS block_no,
       regexp_replace(unnest(parts), '^\s+|\s+$', '', 'g') AS block
FROM (SELECT doc_id, string_split(regexp_replace(text, '\.\s', '.' || chr(10) || chr(10), 'g'),
                                  chr(10) || chr(10)) AS parts FROM documents)""")
def tx08(spark, sf):
    d = t(spark, sf, "documents").select(
        "doc_id", F.regexp_replace("text", r"\.\s", ".\n\n").alias("text"))
    return blocks(d, "doc_id", "text")
