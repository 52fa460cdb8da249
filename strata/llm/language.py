"""Operator 2: language identification by family, then by pairwise linear classifiers.

A text is the hashed counts of its two- and three-byte strings (lower case, all but letters
as blanks). Linear support vector machines first separate each two language families; then,
within the family chosen, each two of its languages (one versus one); the most votes win,
ties go to the larger sum of margins. Machines are fitted on at most ``SAMPLE`` labelled
texts of each language, chosen by a hash of their ids, so the fit's cost and what reaches
the driver (SAMPLE x DIMENSIONS numbers a language) do not grow with the table. Prediction
is one pass over whole texts without a shuffle; only the weights are sent out.

Cases: text that is NULL or has no letter gives ``und`` with score 0; documents without a
language, or whose id is NULL, are not learned from; without any labelled text every
prediction is ``und``; a single language wins alone with score 1; a NULL id is not held
out; repeated rows get equal predictions; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from strata.llm._text import slices, with_results

SAMPLE, DIMENSIONS, ROWS = 400, 4096, 256
SURE = 0.8                                        # of the least sure of the texts learned from

# Language families by ISO 639-1 code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl".split(),
    "uralic": "fi et hu".split(),
    "indic": "hi ur bn mr gu pa ne si".split(),
    "semitic": "ar he mt am".split(),
    "turkic": "tr az kk uz ky tt".split(),
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
LETTER = np.full(256, 32, np.uint32)
LETTER[97:123] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)


def features(column: pa.Array):
    """(first row, last row + 1, unit-length feature rows) of parts of a text column."""
    column = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    for i, j, data, offsets in slices(column):
        for a in range(0, j - i, ROWS):
            b = min(a + ROWS, j - i)
            part, off = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
            x = LETTER[part]
            row = np.repeat(np.arange(b - a), np.diff(off))
            out = np.zeros((b - a) * DIMENSIONS)
            for n in (2, 3):
                if len(x) >= n:
                    m = len(x) - n + 1
                    code = x[:m].copy()
                    for k in range(1, n):
                        code = code * np.uint32(257) + x[k:m + k]
                    code = (code * np.uint32(2654435761)) >> np.uint32(20)
                    ok = row[:m] == row[n - 1:]
                    out += np.bincount(row[:m][ok] * DIMENSIONS + code[ok], minlength=len(out))
            out = np.sqrt(out.reshape(b - a, DIMENSIONS)).astype(np.float32)
            size = np.linalg.norm(out, axis=1, keepdims=True)
            yield i + a, i + b, out / np.maximum(size, 1e-9)


def fit_pair(x: np.ndarray, y: np.ndarray, cost: float = 20.0, steps: int = 150) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine with squared hinge
    loss, by accelerated gradient steps; y holds 1 and -1, both weighted alike."""
    x = np.hstack((x, np.ones((len(x), 1), np.float32)))
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate = 1 / (1 / cost + 2 * 2.0)
    for t in range(1, steps + 1):
        short = np.maximum(0, 1 - y * (x @ v))
        after = v - rate * (v / cost - 2 * (x.T @ (share * y * short)))
        v = after + (t - 1) / (t + 2) * (after - w)
        w = after
    return w


def fit(x: np.ndarray, langs: list) -> dict:
    """The machines of both levels, {"families": {...}, "pairs": {...}}, and ``least``: a score
    that the texts learned from keep clear of (SURE times what one in a thousand of those
    predicted right stays under). Texts in no learned language score below it, most of them."""
    langs = np.array(langs)
    family = np.array([FAMILY.get(c, c) for c in langs])

    def machines(labels, among):
        out = {}
        for a, b in combinations(among, 2):
            on = (labels == a) | (labels == b)
            out[a, b] = fit_pair(x[on], np.where(labels[on] == a, 1, -1).astype(np.float32))
        return out

    names = sorted(set(family))
    members = {f: sorted(set(langs[family == f])) for f in names}
    model = {"members": members, "families": machines(family, names),
             "pairs": {f: machines(langs, members[f]) for f in names}}
    found, score = predict(model, x)
    right = score[found == langs]
    return model | {"least": SURE * float(np.quantile(right, 0.001)) if len(right) else 0.0}


def _elect(x: np.ndarray, machines: dict, names: list):
    """Per row the index of the name with the most votes, and its least sure win as 0 to 1."""
    votes, margin = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
    sure = np.ones((len(x), len(names)))
    for (a, b), w in machines.items():
        i, j = names.index(a), names.index(b)
        m = x @ w[:-1] + w[-1]
        p = 1 / (1 + np.exp(-4 * m.astype(np.float64)))
        votes[:, i] += m >= 0
        votes[:, j] += m < 0
        margin[:, i] += m
        margin[:, j] -= m
        sure[:, i] = np.minimum(sure[:, i], p)
        sure[:, j] = np.minimum(sure[:, j], 1 - p)
    best = (votes + 0.5 * np.tanh(margin / (1 + len(names)))).argmax(axis=1)
    return best, sure[np.arange(len(x)), best]


def predict(model: dict, x: np.ndarray):
    """Per row the language and a score: sureness of the family times that of the language."""
    families = list(model["members"])
    family, score = _elect(x, model["families"], families)
    lang = np.empty(len(x), object)
    for k, f in enumerate(families):
        at = np.flatnonzero(family == k)
        if len(at):
            names = model["members"][f]
            best, sure = _elect(x[at], model["pairs"][f], names)
            lang[at] = np.array(names, object)[best]
            score[at] *= sure
    return lang, score


def held_out(doc_id: Column) -> Column:
    """The documents that are not learned from: crc32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample: int = SAMPLE) -> dict | None:
    """Fits the machines on at most ``sample`` documents of each language; None without any."""
    docs = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    usable = docs.filter(F.col("i").isNotNull() & F.col("l").isNotNull() & ~held_out(F.col("i")))
    order = Window.partitionBy("l").orderBy(F.xxhash64("i"), "i")
    # a rank limit: only the first ones of each language leave a task
    chosen = (usable.select("i", "l").withColumn("k", F.row_number().over(order))
              .filter(F.col("k") <= sample).select("i").distinct())

    def rows(batches):
        for batch in batches:
            for i, j, x in features(batch.column(0)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).slice(i, j - i)], names=["x", "l"])

    got = (usable.join(F.broadcast(chosen), "i", "left_semi").filter(F.col("t").rlike(r"\p{L}"))
           .select("t", "l").mapInArrow(rows, "x binary, l string").collect())
    if not got:
        return None
    return fit(np.stack([np.frombuffer(r.x, np.float32) for r in got]), [r.l for r in got])


def identify(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """Columns ``doc`` (a struct of the input's columns), lang_pred and score."""
    def run(texts):
        for text in texts:
            text = text.cast(pa.large_string())
            letters = pc.match_substring_regex(text, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
            lang, score = np.full(len(text), "und", object), np.zeros(len(text))
            if model:
                for i, j, x in features(text):
                    lang[i:j], score[i:j] = predict(model, x)
            lang[~letters], score[~letters] = "und", 0.0
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=["lang_pred", "score"])

    return with_results(docs, text_col, run, StructType([StructField("lang_pred", StringType()),
                                                         StructField("score", DoubleType())]))
