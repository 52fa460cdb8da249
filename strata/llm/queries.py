"""The registered queries of this subpackage, one per operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query("op1_minhash_near_dedup")
def op1(spark, sf_dir):
    """Whole ``documents``; classes of documents linked at 0.85 on three-word shingles."""
    from strata.llm.minhash import near_duplicates
    return near_duplicates(_read(spark, sf_dir, "documents"))


@_query("op5_suffix_array_dedup")
def op5(spark, sf_dir):
    """Whole ``documents``; 50-byte strings that a document with a smaller doc_id has too go."""
    from strata.llm.suffix_array import dedup_bytes
    return dedup_bytes(_read(spark, sf_dir, "documents")).drop("kept")


@_query("op6_substring_dedup")
def op6(spark, sf_dir):
    """Whole ``documents``; 50-word runs that a document with a smaller doc_id has too go."""
    from strata.llm.suffix_automaton import dedup_words
    return dedup_words(_read(spark, sf_dir, "documents")).drop("kept")


@_query("op8_embedding_near_dedup")
def op8(spark, sf_dir):
    """Whole ``embeddings``; links and classes at cosine 0.95."""
    from strata.llm.embeddings import cosine_links
    return cosine_links(_read(spark, sf_dir, "embeddings"))


LINES_SQL = """
WITH d AS (SELECT doc_id, coalesce('h' || source, 'n') AS h, text, row_number() OVER () AS r FROM documents),
t AS (SELECT r, h, string_split(text, chr(10)) AS x FROM d WHERE text IS NOT NULL),
l AS (SELECT r, h, unnest(x) AS line, generate_subscripts(x, 1) AS p FROM t),
c AS (SELECT h, line, count(DISTINCT r) AS c FROM l
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY h, line),
n AS (SELECT h, count(*) AS n FROM d GROUP BY h),
bad AS (SELECT h, line FROM c JOIN n USING (h) WHERE c >= 5 AND 100 * c > 10 * n),
m AS (SELECT l.r, l.p, l.line, bad.h IS NOT NULL AS gone
      FROM l LEFT JOIN bad ON l.h = bad.h AND l.line = bad.line),
g AS (SELECT r, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') AS kept
      FROM m GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       sha256(kept) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""


@_query("op10_line_dedup", LINES_SQL)
def op10(spark, sf_dir):
    """Whole ``documents``, their ``source`` as host: lines on over a tenth of a host's pages go."""
    from strata.llm.lines import drop_site_lines
    out = drop_site_lines(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source")
    return out.select("page.doc_id", "n_lines", "n_dropped",
                      F.sha2(F.col("page.text").cast("binary"), 256).alias("kept_sha256"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(b)) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS least FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, q.payload_digest,
       CASE WHEN least < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN least < page_id THEN least END AS refers_to
FROM q LEFT JOIN f ON q.payload_digest = f.payload_digest AND payload_bytes >= 100
"""


@_query("op9_warc", WARC_SQL)
def op9(spark, sf_dir):
    """Whole ``pages``: archived as ARC, converted to WARC with revisits, and read back."""
    from strata.llm.warc import pages_to_warc
    return pages_to_warc(_read(spark, sf_dir, "pages")).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op7_secret_scan")
def op7(spark, sf_dir):
    """Whole ``documents``: base spans and those of literals bound to sensitive names."""
    from strata.llm.secrets import find_secrets
    return find_secrets(_read(spark, sf_dir, "documents")).drop("base_spans")


@_query("op2_language_id")
def op2(spark, sf_dir):
    """Whole ``documents``; machines fitted on up to 400 documents of each language that are
    not held out."""
    from strata.llm.language import held_out, identify, train
    docs = _read(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score")


def tokenizer_path() -> str:
    """The default tokenizer file of the registered queries."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@_query("op3_bpe")
def op3(spark, sf_dir):
    """Whole ``documents`` through word_bpe_49k.json and back."""
    from strata.llm.bpe import encode_decode
    out = encode_decode(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(),
                        columns=("n_tokens", "ids_sha256", "decoded_sha256"))
    return out.select("doc.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@_query("op4_decontamination")
def op4(spark, sf_dir):
    """Whole ``documents`` against the whole ``benchmark``: items of which tiles cover half."""
    from strata.llm.tiling import find_items
    found = find_items(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc.doc_id", (F.size("hits") > 0).alias("contaminated"),
                        (F.size("hits") == 0).alias("kept"),
                        F.transform("hits", lambda h: h["item_id"]).alias("item_ids"),
                        F.coalesce(F.array_max(F.transform("hits", lambda h: h["coverage"])), F.lit(0.0)).alias("coverage"))


@_query("op13_embedding_whitening")
def op13(spark, sf_dir):
    """Whole ``embeddings``: up to 16 whitened components of each row."""
    from strata.llm.whitening import whiten
    out = whiten(_read(spark, sf_dir, "embeddings"))
    return (out.select("row.vec_id", "n", "deviation", "explained", "identity_error",
                       F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
                    F.element_at("explained", F.col("at") + 1).alias("explained"), "identity_error"))


@_query("op12_conversation_repair")
def op12(spark, sf_dir):
    """Whole ``conversations``, damaged by a checksum of conversation and turn, and repaired."""
    from strata.llm.conversations import damage, repair
    rows, left = damage(_read(spark, sf_dir, "conversations"))
    return repair(rows, copies=left)


@_query("op11_best_fit_packing")
def op11(spark, sf_dir):
    """Whole ``documents`` through word_bpe_49k.json, in sequences of 4096 ids."""
    from strata.llm.packing import pack
    out = pack(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), by_word=True)
    return out.select("doc.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
