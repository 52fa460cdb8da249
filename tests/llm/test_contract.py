"""The registered queries over whole small tables, and the pipeline, against brute force."""
import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from strata.llm.queries import QUERIES, tokenizer_path
from tests.llm.test_near import brute as near_brute, cosine_brute
from tests.llm.test_repeats import bytes_of, words_of
from tests.llm.test_text_ops import naive_tiles, plain_base, plain_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def rows(spark, name, *columns):
    return sorted((tuple(r) for r in QUERIES[name](spark, SF).select(*columns).collect()), key=str)


def texts(docs):
    return [(r.doc_id, r.text) for r in docs]


def test_op1(spark, docs):
    got = rows(spark, "op1_minhash_near_dedup", "doc_id", "n_shingles", "component_id", "kept")
    assert sorted(got) == near_brute(texts(docs), 3, 85)


def test_op2(spark, docs):
    lang = {r.doc_id: r.lang for r in docs}
    got = QUERIES["op2_language_id"](spark, SF).collect()
    out = [r for r in got if r.held_out]
    assert len(got) == len(docs) and out
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) >= 0.95


def test_op3(spark, docs, library):
    want = []
    for i, t in texts(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows(spark, "op3_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)


def leaked(text, items):
    words = lambda t: re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
    w = words(text)
    runs = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    out = []
    for i, t in items:
        x = words(t)
        if any(tuple(x[k:k + 5]) in runs for k in range(len(x) - 4)):
            near = [k for k in range(len(w) - 4) if tuple(w[k:k + 5]) in {tuple(x[j:j + 5]) for j in range(len(x) - 4)}]
            part = w[max(0, near[0] - 5):near[-1] + 10]
            if 2 * naive_tiles(part, x, 5) >= len(x):
                out.append(i)
    return sorted(out)


def test_op4(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = QUERIES["op4_decontamination"](spark, SF).collect()
    assert sorted((r.doc_id, sorted(r.item_ids)) for r in got) == sorted((i, leaked(t, items)) for i, t in texts(docs))


def test_op5_op6(spark, docs):
    assert rows(spark, "op5_suffix_array_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == bytes_of(texts(docs))
    assert rows(spark, "op6_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == words_of(texts(docs))


def test_op7(spark, docs):
    got = {r.doc_id: r.base_sha256 for r in QUERIES["op7_secret_scan"](spark, SF).collect()}
    assert got == {i: hashlib.sha256(plain_base(t).encode()).hexdigest() for i, t in texts(docs)}


def test_op8(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = rows(spark, "op8_embedding_near_dedup", "vec_id", "n_links", "component_id", "kept")
    assert sorted(got) == cosine_brute(vectors, 0.95)


def test_pipeline(spark, docs, library):
    kept = [(r.doc_id, r.text, r.source) for r in docs if re.search(r"[^\W\d_]", r.text or "")]
    source = {r.doc_id: r.source for r in docs}
    kept = [(i, t, source[i]) for i, t, _, _ in plain_lines(kept)]
    stay = {i for i, _, _, k in near_brute([(i, t) for i, t, _ in kept], 5, 80) if k}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted((i, t, library.encode(t, add_special_tokens=False).ids) for i, t, _ in kept if i in stay and not leaked(t, items))
    out = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.text, r.ids) for r in out.collect()) == want
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert out.filter("n_chars <> length(text)").isEmpty()


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, tokens string, doc string"
    odd = spark.createDataFrame([
        (None, None, None, None, None, "t", "d"), (1, "", "en", None, 0, None, None), (2, "123", "en", "s", 3, None, None),
        (3, "the end of the line is here", "en", "s", 1, None, None), (3, "the end of the line is here", "en", "s", 1, None, None),
        (None, "words without an id at all", None, "s", 1, None, None)], schema)
    for name, stage in corpus_pipeline.STAGES:
        for frame in (odd, odd.filter("doc_id > 99")):
            out = stage(spark, frame, SF)
            assert out.columns[:7] == odd.columns
            n = {r.doc_id for r in out.collect()}
            if frame is odd:
                assert 3 in n
            else:
                assert not n


def plain_features(text):
    """The features of one text, string by string."""
    from strata.llm.language import DIMENSIONS
    letters = [b if 97 <= b < 123 or b >= 128 else 32 for b in (text or "").lower().encode()]
    out = [0] * DIMENSIONS
    for n in (2, 3):
        for k in range(len(letters) - n + 1):
            code = 0
            for b in letters[k:k + n]:
                code = (code * 257 + b) % 2**32
            out[(code * 2654435761 % 2**32) >> 20] += 1
    size = sum(out) ** 0.5
    return np.array([c ** 0.5 / max(size, 1e-9) for c in out])


def plain_choice(x, machines, names):
    """The name that wins most duels; of equal ones the one with the larger margins."""
    wins, margins = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
    for (a, b), w in machines.items():
        m = float(x @ w[:-1].astype(float) + w[-1])
        wins[a if m >= 0 else b] += 1
        margins[a] += m
        margins[b] -= m
    return max(names, key=lambda c: (wins[c], margins[c]))


def test_op2_predictions_duel_by_duel(spark, docs):
    """The same weights, applied by a version that knows no arrays: family first, then its languages."""
    from strata.llm.language import identify, train
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(frame)
    got = {r.doc_id: r.lang_pred for r in identify(frame.select("doc_id", "text"), model).select("doc.doc_id", "lang_pred").collect()}
    for r in docs:
        want = "und"
        if re.search(r"[^\W\d_]", r.text or ""):
            x = plain_features(r.text)
            family = plain_choice(x, model["families"], list(model["members"]))
            want = plain_choice(x, model["pairs"][family], model["members"][family])
        assert got[r.doc_id] == want
