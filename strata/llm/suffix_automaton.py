"""Operator 6: removal of repeated word runs by streaming documents through suffix automata.

``_repeats`` deals reference shards: all segments whose windows could be equal come to one
shard. There a suffix automaton of the shard's segments is built in order of their
documents, so each state knows the smallest document its strings occur in; every segment is
then streamed through it for matching statistics, and a window whose match is as long as
the threshold and first occurs in a smaller document is marked. Maximal marked runs of
words are removed. A shard goes to the documents that share a seed with it and to no other;
an automaton of the whole corpus, broadcast to every task, would have no size bound.

Cases: NULL text has no words; an empty table gives no rows; documents of fewer words than
the length lose nothing; a NULL doc_id stands after all others; rows that share a doc_id
are one document (none removes the other); extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm._repeats import Repeats, repeats
from strata.llm._text import BYTE_UNITS, U, ranges, word_bounds

LENGTH, SEED, CROWDED = 50, 25, 2_000


class Automaton:
    """A suffix automaton of several word sequences, added in ascending order of owner."""

    def __init__(self):
        self.next, self.link, self.len, self.owner = [{}], [-1], [0], [-1]

    def _state(self, edges, link, length, owner) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.len.append(length)
        self.owner.append(owner)
        return len(self.len) - 1

    def _split(self, p: int, word, q: int) -> int:
        """A copy of q for the strings up to p's length plus the word; q's owner holds them."""
        copy = self._state(dict(self.next[q]), self.link[q], self.len[p] + 1, self.owner[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words, owner: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:                     # an earlier sequence has it already
                last = q if self.len[q] == self.len[last] + 1 else self._split(last, word, q)
                continue
            state = self._state({}, 0, self.len[last] + 1, owner)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[state] = q if self.len[q] == self.len[p] + 1 else self._split(p, word, q)
            last = state

    def matches(self, words, length: int):
        """For each word, the smallest owner of the ``length`` words that end there, or None."""
        state, size = 0, 0
        nexts, links, lens, owner = self.next, self.link, self.len, self.owner
        for word in words:
            while state and word not in nexts[state]:
                state = links[state]
                size = lens[state]
            if word in nexts[state]:
                state = nexts[state][word]
                size += 1
            while state and lens[links[state]] >= length:
                state = links[state]
            size = min(size, length, lens[state])
            yield owner[state] if size == length else None


def resolve(symbols: np.ndarray, offsets: np.ndarray, owners: np.ndarray, seeds: np.ndarray,
            length: int) -> np.ndarray:
    """Per segment a bitmap of the window starts whose window a smaller owner has too. Equal
    windows share their seed, so a shard holds one automaton per seed at a time."""
    hits = np.zeros(len(owners), U)
    if not len(owners):
        return hits
    order = np.lexsort((owners, seeds))
    cuts = np.flatnonzero(np.r_[True, np.diff(seeds[order]) != 0, True])
    for x, y in zip(cuts[:-1], cuts[1:]):
        group = order[x:y].tolist()
        if owners[group[0]] == owners[group[-1]]:
            continue                              # one document only: nothing is smaller
        automaton = Automaton()
        words = {k: symbols[offsets[k]:offsets[k + 1]].tolist() for k in group}
        for k in group:
            automaton.add(words[k], int(owners[k]))
        for k in group:
            own, bits = int(owners[k]), 0
            for i, least in enumerate(automaton.matches(words[k], length)):
                if least is not None and least < own:
                    bits |= 1 << (i + 1 - length)
            hits[k] = bits
    return hits


def _units(data, offsets, rolling):
    start, end, row = word_bounds(data, offsets)
    words = rolling.spans(rolling.sums(BYTE_UNITS[data]), start, end)
    at = np.searchsorted(row, np.arange(len(offsets)))
    return words, at, words, (start, end)


def _output(data, offsets, at, extra, flags):
    start, end = extra
    rows = len(offsets) - 1
    removed = np.concatenate(([0], np.cumsum(flags)))[at]
    # kept words joined by one space: mark the kept bytes and one more place after each word
    kept = np.flatnonzero(~flags)
    size = end[kept] - start[kept] + 1
    place = ranges(start[kept], size)
    stop = np.cumsum(size)
    padded = np.append(data, np.uint8(32))[place]
    if len(stop):
        padded[stop - 1] = 32
    body = padded.tobytes()
    cut = np.concatenate(([0], stop))[np.searchsorted(kept, at)]
    texts = [body[cut[i]:max(cut[i], cut[i + 1] - 1)] for i in range(rows)]
    return {"n_words": pa.array(np.diff(at)), "n_removed": pa.array(np.diff(removed)),
            "kept": pa.array(texts, pa.binary()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())}


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Removes each word covered by a run of ``length`` words that also starts in a document
    with a smaller id. Returns doc_id, n_words, n_removed, kept (UTF-8 bytes of the words
    left, joined by one space) and kept_sha256. ``length - seed`` must be under 64."""
    job = Repeats(length, seed, _units, resolve, _output,
                  "doc_id long, n_words long, n_removed long, kept binary, kept_sha256 string", CROWDED)
    return repeats(job, docs, id_col, text_col)
