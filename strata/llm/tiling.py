"""Operator 4: benchmark decontamination by greedy string tiling.

A benchmark item is found in a document when tiles cover enough of it: tiles are the longest
common runs of words that no earlier tile of the pair has taken, of at least ``MATCH``
words, marked longest first. Runs are found by running Karp-Rabin fingerprints, so a passage
whose parts were reordered is still covered. Only documents that share a seed (``MATCH``
words in a row) with an item are tiled against it.

The benchmark is the stated query set: it is dealt into blocks of about ``BLOCK`` words by a
hash of the item, and only one block's seeds are sent out at a time, so their size is
bounded whatever the benchmark's; each block is one pass over the documents without a
shuffle (with several blocks, each pass is written before the next).

Cases: words are runs of letters and digits, in lower case, so punctuation and layout do not
matter (every byte above 127 counts as a letter); a NULL or empty text matches nothing; an
item of three or four words is found where it stands whole; one of fewer words (which clean
documents hold by chance), or a NULL one, matches nothing; items of equal text all
match; an item with a NULL id counts and is listed as NULL; repeated documents get equal
results; empty tables give no rows, or no matches; extra columns pass through in ``doc``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (ArrayType, DoubleType, LongType, StructField,
                               StructType)

from strata.llm._text import BYTE_UNITS, LOWER, Rolling, U, slices, with_results
from strata.session import materialize

MATCH, COVERAGE, BLOCK = 5, 0.5, 500_000
SHORT = 3                                         # words of the shortest item that is looked for
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of(column: pa.Array, rolling: Rolling):
    """(first row, word fingerprints, first word of each row) of parts of a text column."""
    for i, j, data, offsets in slices(column):
        inside = LETTERS[data]
        n = len(data)
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | cut[1:n]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | cut[1:n]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        words = rolling.spans(rolling.sums(BYTE_UNITS[LOWER[data]]), s, e) if n else np.zeros(0, U)
        yield i, words, np.searchsorted(s, offsets)


def tiles(doc: np.ndarray, item: np.ndarray, least: int, rolling: Rolling) -> list:
    """Greedy string tiling: (place in doc, place in item, length), longest tiles first."""
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    sums = rolling.sums(doc), rolling.sums(item)

    def common(size):
        """Places of unmarked windows of ``size`` words whose fingerprints both texts have."""
        out = []
        for s, free in zip(sums, (free_doc, free_item)):
            prints = rolling.windows(s, size)
            taken = np.concatenate(([0], np.cumsum(~free)))
            out.append((prints, np.flatnonzero(taken[size:] == taken[:len(prints)])))
        (a, p), (b, q) = out
        values, first = np.unique(b[q], return_index=True)
        if not len(values) or not len(p):
            return ()
        k = np.minimum(np.searchsorted(values, a[p]), len(values) - 1)
        ok = values[k] == a[p]
        return a, p[ok], b, q

    found, most = [], min(len(doc), len(item))
    while most >= least:
        low, high = least - 1, most               # the longest common run, by bisection
        while low < high:
            mid = (low + high + 1) // 2
            got = common(mid)
            low, high = (mid, high) if len(got) and len(got[1]) else (low, mid - 1)
        if low < least:
            break
        a, p, b, q = common(low)
        places: dict = {}
        for y in q.tolist():
            places.setdefault(int(b[y]), []).append(y)
        for x in p.tolist():
            if not free_doc[x:x + low].all():
                continue
            for y in places[int(a[x])]:
                if free_item[y:y + low].all():
                    free_doc[x:x + low] = False
                    free_item[y:y + low] = False
                    found.append((x, y, low))
                    break
        most = low - 1 if not found or found[-1][2] != low else low
    return found


def _seeds(items: list, chosen: list, least: int, rolling: Rolling):
    """Sorted seed fingerprints of the chosen items and, in parallel, the item that each is from."""
    prints, owner = [], []
    for k in chosen:
        words = items[k]
        w = np.unique(rolling.windows(rolling.sums(words), least))
        prints.append(w)
        owner.append(np.full(len(w), k))
    prints, owner = np.concatenate(prints), np.concatenate(owner)
    order = np.argsort(prints, kind="stable")
    return prints[order], owner[order]


def _find(block: list, least: int, coverage: float):
    """Arrays of texts to arrays of the block's hits in each."""
    def run(texts):
        rolling = Rolling()
        ids = [i for i, _ in block]
        items = [np.frombuffer(w, U) for _, w in block]
        seeds = {}
        for size in sorted({min(least, len(w)) for w in items}):    # a short item is one run of its own length
            seeds[size] = _seeds(items, [k for k, w in enumerate(items) if min(least, len(w)) == size], size, rolling)
        for text in texts:
            hits: list = [[] for _ in range(len(text))]
            for first, words, cut in words_of(text, rolling):
                sums = rolling.sums(words)
                for size, (prints, owner) in seeds.items():
                    windows = rolling.windows(sums, size)
                    if not len(windows):
                        continue
                    k = np.minimum(np.searchsorted(prints, windows), len(prints) - 1)
                    places = np.flatnonzero(prints[k] == windows)
                    row = np.searchsorted(cut, places, "right") - 1
                    ok = places + size <= cut[row + 1]
                    places, row = places[ok], row[ok]
                    for r in np.unique(row):
                        here = words[cut[r]:cut[r + 1]]
                        seen = windows[places[row == r]]
                        left, right = np.searchsorted(prints, seen), np.searchsorted(prints, seen, "right")
                        for item in np.unique(np.concatenate([owner[x:y] for x, y in zip(left, right)])):
                            got = sum(n for _, _, n in tiles(here, items[item], size, rolling))
                            if got >= coverage * len(items[item]):
                                hits[first + int(r)].append((ids[item], got / len(items[item])))
            yield pa.StructArray.from_arrays([pa.array(hits, hit_type)], names=["found"])
    hit_type = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64())]))
    return run


HITS = ArrayType(StructType([StructField("item_id", LongType()), StructField("coverage", DoubleType())]))


def find_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text", least: int = MATCH, coverage: float = COVERAGE,
               block_words: int = BLOCK) -> DataFrame:
    """Columns ``doc`` (a struct of the input's columns) and ``hits``: (item_id, coverage) of
    each item of which tiles of at least ``least`` words cover at least ``coverage``."""
    def fingerprints(batches):
        rolling = Rolling()
        for batch in batches:
            out = [b""] * batch.num_rows
            for first, words, cut in words_of(batch.column(1), rolling):
                for r in range(len(cut) - 1):
                    out[first + r] = words[cut[r]:cut[r + 1]].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["i", "w"])

    listed = (items.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).alias("t"))
              .mapInArrow(fingerprints, "i long, w binary").filter(F.length("w") >= 8 * min(least, SHORT)))
    listed = materialize(listed)
    total = listed.agg(F.sum(F.length("w") / 8)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_words))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.array().cast(HITS).alias("hits"))
    for b in range(blocks):
        part = listed.filter(F.pmod(F.xxhash64("i", "w"), F.lit(blocks)) == b)
        block = sorted(((r.i, bytes(r.w)) for r in part.collect()), key=lambda x: (x[0] is None, x))
        if block:
            out = with_results(out.select("doc", "hits", F.col(f"doc.`{text_col}`").alias("t")), "t",
                               _find(block, least, coverage), StructType([StructField("found", HITS)]))
            out = out.select("doc.doc", F.concat("doc.hits", "found").alias("hits"))
            if b + 1 < blocks:
                out = materialize(out)
    return out.select("doc", F.array_sort("hits").alias("hits"))
