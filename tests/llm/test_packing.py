"""Operator 11: whole tables against the tokenizer, a plain best fit, and a plain sweep."""
import bisect
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from strata.llm.packing import Ids, across, best_fit, buckets, matched, pack, pieces
from strata.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def best_fit_decreasing(lengths, size):
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, x)
        if k == len(gaps):
            gaps.append(size)
            n += 1
        bisect.insort(gaps, gaps.pop(k) - x)
    return n


def stack_sweep(size, gap):
    stack, pairs, free = [], [], []
    for i, g in enumerate(gap):
        if not g:
            stack.append(i)
        elif stack:
            pairs.append((stack.pop(), i))
        else:
            free.append(i)
    return sorted(pairs), stack, free


@pytest.mark.parametrize("seed", range(5))
def test_sweep_of_ranges_is_the_sweep_of_all(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 300))
    size = np.sort(rng.permutation(10 * n)[:n])
    gap = rng.random(n) < rng.choice([0.2, 0.5, 0.8])
    pairs, left, free = stack_sweep(size, gap)
    a, b, c, d = matched(size, gap)
    assert (sorted(zip(a.tolist(), b.tolist())), c.tolist(), d.tolist()) == (pairs, left, free)
    cuts = [0, *sorted(rng.integers(0, n + 1, 6).tolist()), n]
    got, rest = [], {}
    for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
        a, b, c, d = (x + i for x in matched(size[i:j], gap[i:j])) if j > i else [np.zeros(0, int)] * 4
        got += zip(a.tolist(), b.tolist())
        rest[k] = c, d
    taken, taking = across({k: (len(c), len(d)) for k, (c, d) in rest.items()})
    key = {k - rank: int(rest[x][0][rank]) for x, lo, hi, k in taken for rank in range(lo, hi)}
    got += [(key[k + rank], int(rest[x][1][rank])) for x, lo, hi, k in taking for rank in range(lo, hi)]
    assert sorted(got) == pairs


def test_buckets():
    dealt, n = buckets({1: 5, 2: 4, 3: 25, 4: 9, 5: 1}, 10)
    assert dealt == {1: (0, 1), 2: (0, 1), 3: (1, 3), 4: (4, 1), 5: (4, 1)} and n == 5


LENGTHS = {
    "mixed": lambda r: [min(64, max(1, int(r.expovariate(1 / 12)))) for _ in range(900)],
    "equal": lambda r: [7] * 500 + [64] * 20,
    "halves": lambda r: [r.choice([21, 22, 31, 33, 34, 40]) for _ in range(600)],
    "ones": lambda r: [1] * 1000,
}


@pytest.mark.parametrize("kind", LENGTHS)
@pytest.mark.parametrize("most", [100_000, 40])
def test_best_fit(spark, kind, most):
    lengths = LENGTHS[kind](random.Random(len(kind)))
    if most < 100 and kind in ("equal", "ones"):
        lengths = lengths[:200]
    frame = spark.createDataFrame(list(enumerate(lengths)), "p long, length long").repartition(5)
    got = best_fit(frame, 64, most).collect()
    assert sorted(r.p for r in got) == list(range(len(lengths)))
    full = Counter()
    for r in got:
        full[r.sequence] += lengths[r.p]
    assert max(full.values()) <= 64
    least = best_fit_decreasing(lengths, 64)
    assert len(full) <= least * 1.03 + 1


def check(rows, texts, size, closing=1):
    tokenizer = library()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts)
    total = 0
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, closing], "<u4")
        total += len(ids)
        want = [(k // size, k, len(ids[k:k + size]), zlib.crc32(ids[k:k + size].tobytes())) for k in range(0, len(ids), size)]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]) == want
    where = {}
    for r in rows:
        where.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for part in where.values():
        at = 0
        for offset, length in sorted(part):
            assert offset == at
            at += length
        assert at <= size
    return len(where), total, [r.length for r in rows]


def test_words_encode_as_whole_texts():
    ids = Ids(open(tokenizer_path(), encoding="utf-8").read(), True)
    texts = ["", " ", "one  Two\nthree's\tFOUR\r\n", "ΟΔΟΣ ΣΑΣ x y", "é ́e\ń", "a<|endoftext|>b <|startoftext|> c",
             "\x1c\x1fq\x85z w", "don't we'll 12345 ###", "word " * 3000, "x" * 20000, "日本語 テキスト\n한국어"]
    tokenizer = library()
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(ids.of(texts)) == want and list(ids.of(texts[::-1])) == want[::-1]


def test_pack(spark):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["alpha", "beta", "Gamma,", "delta."]) for _ in range(rng.choice([0, 1, 5, 40, 90, 300])))
             for i in range(300)} | {900: None, 901: "", 902: "x " * 5000}
    frame = spark.createDataFrame([(i, t, 1, 2, "s") for i, t in texts.items()], "doc_id long, text string, p int, length int, doc string")
    out = pack(frame.repartition(4), tokenizer_path(), size=128, by_word=True, most=50)
    assert out.select("doc.*").columns == ["doc_id", "p", "length", "doc"]
    n, total, lengths = check(out.select("doc.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect(), texts, 128)
    assert n <= best_fit_decreasing(lengths, 128) * 1.03 + 1
    assert pack(frame.limit(0), tokenizer_path()).collect() == []
    both = frame.where("doc_id in (7, 900)").unionByName(frame.where("doc_id = 7")).select("text")
    rows = pieces(both, tokenizer_path(), 4096, 1, ids=True).collect()
    assert sorted(len(r.pieces[0].ids) for r in rows)[0] == 1 and len(rows) == 3


def test_op11(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n, total, lengths = check(QUERIES["op11_best_fit_packing"](spark, SF).collect(), texts, 4096)
    assert n <= best_fit_decreasing(lengths, 4096)
