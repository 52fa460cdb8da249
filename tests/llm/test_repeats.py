"""Operators 5 and 6 against brute force over all windows."""
import hashlib
import random
import re

import numpy as np
import pytest

import strata.llm._repeats as engine
import strata.llm.suffix_array as suffix_array_module
import strata.llm.suffix_automaton as suffix_automaton_module
from strata.llm._text import sliding
from strata.llm.suffix_array import common_prefixes, dedup_bytes, suffix_array
from strata.llm.suffix_automaton import Automaton, dedup_words
from tests.llm.conftest import sentence

LAST = 1 << 62
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, split, join, length):
    first, out = {}, []
    rows = [(LAST if i is None else i, split(t or "")) for i, t in rows]
    for i, units in rows:
        for k in range(len(units) - length + 1):
            w = tuple(units[k:k + length])
            first[w] = min(first.get(w, i), i)
    for i, units in rows:
        gone = np.zeros(len(units), bool)
        for k in range(len(units) - length + 1):
            if first[tuple(units[k:k + length])] < i:
                gone[k:k + length] = True
        kept = join([u for u, g in zip(units, gone) if not g])
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0
        out.append((None if i == LAST else i, len(units), int(gone.sum()), spans,
                    hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def bytes_of(rows, length=50):
    return brute(rows, lambda t: list(t.encode()), bytes, length)


def words_of(rows, length=50):
    return [(a, b, c, e) for a, b, c, _, e in
            brute(rows, BLANK.findall, lambda w: " ".join(w).encode(), length)]


def got(df, *columns):
    return sorted((tuple(r) for r in df.select("doc_id", *columns).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    shared = [sentence(rng, 70) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [sentence(rng, rng.randrange(1, 60)) for _ in range(rng.randrange(1, 4))]
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(0, len(s) // 2)
            parts.insert(rng.randrange(len(parts) + 1), s[a:a + rng.randrange(30, len(s))])
        rows.append((rng.randrange(1000), rng.choice(["\n", " ", "\t "]).join(parts)))
    rows += [(2000 + k, rows[0][1]) for k in range(20)]          # copies
    rows += [(5, ""), (6, None), (7, " \n"), (8, "é" * 80), (9, "é" * 80), (10, "a" * 300), (11, "a" * 299),
             (None, rows[1][1]), (12, rows[2][1]), (12, rows[2][1]), (12, rows[3][1])]
    return rows


@pytest.mark.parametrize("crowded, fan, seed", [(2000, 8, 1), (1, 8, 1), (1, 1, 1), (1, 3, 4)])
def test_both_match_brute_force(frame, monkeypatch, crowded, fan, seed):
    monkeypatch.setattr(suffix_array_module, "CROWDED", crowded)
    monkeypatch.setattr(suffix_automaton_module, "CROWDED", crowded)
    monkeypatch.setattr(engine, "FAN", fan)
    rows = corpus(seed)
    docs = frame(rows)
    assert got(dedup_bytes(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == bytes_of(rows)
    assert got(dedup_words(docs), "n_words", "n_removed", "kept_sha256") == words_of(rows)


def test_many_small_chunks(frame, monkeypatch):
    monkeypatch.setattr(engine, "CHUNK", 3000)
    rows = corpus(2)
    docs = frame(rows, 7)
    assert got(dedup_bytes(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == bytes_of(rows)
    assert got(dedup_words(docs, length=20, seed=8), "n_words", "n_removed", "kept_sha256") == words_of(rows, 20)


def test_seeds_are_dealt_evenly():
    """Seeds are the smallest hashes of their windows; no part may get more for that."""
    hashes = np.random.default_rng(1).integers(0, 1 << 64, 400_000, np.uint64)
    seeds = np.unique(sliding(hashes, 31))
    for count in (64, 500):
        got = np.bincount(engine._dealt(seeds, count), minlength=count)
        assert len(got) == count and got.max() < 2 * got.mean()


def test_a_shard_is_resolved_in_parts(frame, monkeypatch):
    sizes = []
    monkeypatch.setattr(engine, "AT_ONCE", 100)
    job = engine.Repeats(2, 1, None, lambda symbols, offsets, owner, seeds, length: sizes.append(
        (len(symbols), len(set(seeds.tolist())))) or owner.astype(np.uint64) + symbols[offsets[:-1]], None, "", 0)
    seeds = np.array([7, 3, 9, 7, 3, 7] * 20, np.uint64)
    size = np.arange(120) % 5 + 1
    offsets = np.concatenate(([0], np.cumsum(size)))
    symbols = np.repeat(np.arange(120, dtype=np.uint8), size)
    assert engine._hits(job, symbols, offsets, np.arange(120), seeds).tolist() == [2 * i for i in range(120)]
    assert len(sizes) == 3 and {n for _, n in sizes} == {1}
    assert not len(engine._hits(job, symbols[:0], offsets[:1], seeds[:0], seeds[:0])) and len(sizes) == 3
    rows = corpus(6)
    docs = frame(rows)
    assert got(dedup_bytes(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == bytes_of(rows)
    assert got(dedup_words(docs), "n_words", "n_removed", "kept_sha256") == words_of(rows)


def test_long_text_and_kept_text(frame):
    rng = random.Random(3)
    long = sentence(rng, 60_000)
    rows = [(1, long), (2, "before " + long[1000:200_000] + " after"), (3, "short")]
    out = {r.doc_id: r for r in dedup_bytes(frame(rows)).collect()}
    assert out[2].n_removed >= 199_000 and out[2].n_spans == 1
    assert bytes(out[2].kept).startswith(b"before") and bytes(out[2].kept).endswith(b"after")
    assert out[1].n_removed == 0 and bytes(out[3].kept) == b"short"


def test_empty_table(frame):
    docs = frame([(1, "x")]).filter("doc_id < 0")
    assert dedup_bytes(docs).count() == 0 and dedup_words(docs).count() == 0


def test_suffix_array_is_exact():
    rng = random.Random(1)
    for _ in range(200):
        n, k = rng.randint(1, 300), rng.choice([1, 2, 3, 26, 250])
        text = np.array([rng.randint(1, k) for _ in range(n)] + [0], np.uint16)
        raw = text.astype(">u2").tobytes()
        sa = suffix_array(text)
        assert sa.tolist() == sorted(range(n + 1), key=lambda i: raw[2 * i:])
        lcp = common_prefixes(text, sa, 1000)
        for a, b in zip(sa[:-1], sa[1:]):
            same = 0
            while max(a, b) + same <= n and text[a + same] == text[b + same]:
                same += 1
            assert lcp[b] == same


def test_automaton_knows_first_owner():
    rng = random.Random(2)
    texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 40))] for _ in range(12)]
    machine = Automaton()
    for i, t in enumerate(texts):
        machine.add(t, i)
    for t in texts:
        for length in (1, 3, 6):
            for k, owner in enumerate(machine.matches(t, length)):
                if k + 1 < length:
                    assert owner is None
                    continue
                w = t[k + 1 - length:k + 1]
                assert owner == min(i for i, s in enumerate(texts)
                                    if any(s[x:x + length] == w for x in range(len(s))))
