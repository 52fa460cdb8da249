"""Operator 3: BPE encoding as a bounded-lookahead streaming transducer, and decoding.

The tokenizer file's steps (added tokens, normalizers, word pattern, bytes as characters,
merges, word ends) are followed so that ids equal those of the public tokenizers library.

Within a word the transducer computes, from the merge list alone, a lookahead that is
sufficient: how many symbols to the right can still change a token (``lookahead``). It reads
symbols, and emits a token as soon as that many symbols lie behind it, so its memory does
not grow with the word. Every word goes through it; results of words of up to 64 bytes are
kept in a bounded table of a task, in front of it. Beside a text itself, a task holds the
ids of a few thousand words at a time, and digests grow with them.

Decoding is an incremental machine from ids to text. The tokenizer file names no decoder, so
the library's decode() joins token texts by one blank: ``Names`` pushes ids into that text,
``decoded``. ``Decoder`` makes the plain text: a token's characters become bytes, a word end
becomes a blank, and bytes become characters once a UTF-8 sequence is complete.
(``merge_many``, which merges words side by side as arrays, serves operator 11.)

Cases: NULL text counts as empty (no tokens, empty texts); added tokens inside a text give
their ids; a lone byte sequence that is not UTF-8 decodes to U+FFFD; repeated rows give
equal results; an empty table gives no rows; extra columns pass through in ``doc``. Code points that the
interpreter's Unicode version does not assign yet may be split in another way than by the
library's; all assigned ones agree.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from array import array
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import (ArrayType, IntegerType, LongType, StringType, StructField,
                               StructType)

from strata.llm._text import with_results

WORDS = 400_000            # results of words that a task keeps
KEPT, SHORT = 64, 64       # bytes of a word that is kept, ids of a list that needs no heap
NONE = 1 << 30             # the rank of no merge


def byte_symbols() -> list:
    """The character that stands for each byte: printable ones for themselves, the others
    from U+0100 on (fixed by byte-level BPE)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Merges:
    """A tokenizer file's vocabulary and merge list, with array lookup of merges."""

    SLOTS = 1 << 18

    def __init__(self, spec: dict):
        import regex
        model = spec["model"]
        self.vocab = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        for name in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"):
            if model.get(name):
                raise ValueError(f"the tokenizer's {name} is not supported")
        size = max(self.vocab.values()) + 1
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * max(size, max(added.values(), default=0) + 1)
        for t, i in (*self.vocab.items(), *added.items()):
            self.names[i] = t
        self.added = added
        self.added_pattern = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        pattern = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.word_pattern = regex.compile(pattern[0])
        self.steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[s] for s in symbols], np.int64)
        self.last = np.array([self.vocab[s + self.end] for s in symbols], np.int64)
        pairs = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in map(self._pair, model["merges"])]
        self.rank = {(a, b): (r, c) for r, (a, b, c) in reversed(list(enumerate(pairs)))}
        self.rank_of = {p: r for p, (r, _) in self.rank.items()}.get
        self.into = [c for _, _, c in pairs]
        self.inner_of, self.last_of = self.inner.tolist(), self.last.tolist()
        self.lookahead = self._lookahead(pairs)
        self._build(pairs)

    @staticmethod
    def _pair(merge):
        return merge.split(" ") if isinstance(merge, str) else merge

    def _lookahead(self, pairs) -> int:
        """The most symbols right of a token's start that can still change it. A merge (u, v)
        can be upset if a right end y of v is taken by an earlier merge (y, w) first, which
        can itself be upset by what follows w; the ranks fall, so the chain is finite."""
        length = {int(i): 1 for i in (*self.inner, *self.last)}
        made: dict = {}                           # token -> (its right part, rank)
        reach_of: dict = {}                       # left token -> lists (ranks, largest reach)
        most = 1
        from bisect import bisect_left
        for r, (a, b, c) in enumerate(pairs):
            far, y, before = 0, b, r
            while True:
                ranks, reaches = reach_of.get(y, ((), ()))
                k = bisect_left(ranks, before)
                if k:
                    far = max(far, reaches[k - 1])
                if y not in made:
                    break
                y, before = made[y]
            reach = length[b] + far
            ranks, reaches = reach_of.setdefault(a, ([], []))
            ranks.append(r)
            reaches.append(max(reach, reaches[-1] if reaches else 0))
            if c not in length:
                length[c] = length[a] + length[b]
                made[c] = (b, r)
            most = max(most, length[a] + reach)
        return most

    def _build(self, pairs):
        """An open-addressing table of the merges, for lookup of whole arrays of pairs."""
        key = np.full(self.SLOTS, -1, np.int64)
        rank = np.full(self.SLOTS, 1 << 30, np.int64)
        into = np.zeros(self.SLOTS, np.int64)
        for r, (a, b, c) in enumerate(pairs):
            k = (a << 20) | b
            s = self._slot(k)
            while key[s] >= 0 and key[s] != k:
                s = (s + 1) % self.SLOTS
            if key[s] < 0:
                key[s], rank[s], into[s] = k, r, c
        self.table = key, rank, into

    @classmethod
    def _slot(cls, k):
        return ((k * 0x9E3779B97F4A7C15) >> 40) & (cls.SLOTS - 1)

    def find(self, left: np.ndarray, right: np.ndarray):
        """(rank, merged id) of each pair; the rank is 1 << 30 where there is no merge."""
        key, rank, into = self.table
        k = (left << 20) | right
        with np.errstate(over="ignore"):
            s = (((k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)
                 & (self.SLOTS - 1))
        live = np.flatnonzero((key[s] != k) & (key[s] >= 0))
        while len(live):
            s[live] = (s[live] + 1) % self.SLOTS
            at = s[live]
            live = live[(key[at] != k[live]) & (key[at] >= 0)]
        hit = key[s] == k
        return np.where(hit, rank[s], 1 << 30), into[s]

    def merge_many(self, words: list) -> list:
        """The ids of many short words (each as bytes), merged side by side as arrays."""
        out: list = [None] * len(words)
        size = np.array([len(w) for w in words])
        for low, high in ((1, 4), (5, 8), (9, 12), (13, 20), (21, 32), (33, 64)):
            group = np.flatnonzero((size >= low) & (size <= high))
            for x in range(0, len(group), 20_000):
                at = group[x:x + 20_000]
                for i, ids in zip(at.tolist(), self._merged([words[i] for i in at], size[at], high)):
                    out[i] = ids
        return out

    def _merged(self, words, size, width):
        n = len(words)
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        ids = np.where(np.arange(width) < size[:, None], self.inner[flat], 0)
        rows = np.arange(n)
        ids[rows, size - 1] = self.last[flat[rows, size - 1]]
        size = size.copy()
        live = rows[size > 1]
        columns = np.arange(width - 1)
        while len(live):
            x = ids[live]
            rank, into = self.find(x[:, :-1].ravel(), x[:, 1:].ravel())
            rank = rank.reshape(len(live), -1)
            rank[columns >= (size[live] - 1)[:, None]] = 1 << 30
            p = rank.argmin(axis=1)
            can = rank[np.arange(len(live)), p] < 1 << 30
            live, p, x = live[can], p[can], x[can]
            made = into.reshape(len(can), -1)[np.flatnonzero(can), p]
            moved = np.where(columns > p[:, None], x[:, 1:], x[:, :-1])
            moved[np.arange(len(live)), p] = made
            ids[live, :-1] = moved
            size[live] -= 1
            keep = size[live] > 1
            live = live[keep]
        return [r[:k] for r, k in zip(ids.astype(np.int32), size.tolist())]

    def _merge(self, ids: list) -> list:
        """Merges one list of ids: always the earliest merge of the list, leftmost first. A
        long list keeps its candidates in a heap, a short one looks for the least rank."""
        if len(ids) > SHORT:
            return self._merge_long(ids)
        get, into = self.rank_of, self.into
        ranks = [get(p, NONE) for p in zip(ids, ids[1:])]
        while ranks:
            r = min(ranks)
            if r == NONE:
                break
            i = ranks.index(r)
            ids[i:i + 2] = [into[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NONE)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NONE)
        return ids

    def _merge_long(self, ids: list) -> list:
        n, get, into = len(ids), self.rank_of, self.into
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, p in enumerate(zip(ids, ids[1:])) if (r := get(p, NONE)) != NONE]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if ids[i] is None or j >= n or get((ids[i], ids[j]), NONE) != r:
                continue                          # one of the two has merged meanwhile
            ids[i], ids[j], after[i] = into[r], None, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (q := get((ids[i], ids[after[j]]), NONE)) != NONE:
                    heappush(heap, (q, i))
            if before[i] >= 0 and (q := get((ids[before[i]], ids[i]), NONE)) != NONE:
                heappush(heap, (q, before[i]))
        return [t for t in ids if t is not None]

    def stream(self, symbols):
        """The transducer: tokens of one word from an iterator over its bytes. A token goes
        out once ``lookahead`` symbols lie behind its end; then the rest merges anew, which
        gives the same tokens, as no merge crosses the cut."""
        hold, before, inner = [], None, self.inner_of
        block = 4 * self.lookahead + 64
        if isinstance(symbols, bytes) and 0 < len(symbols) < block:   # the block does not fill
            yield from self._merge([*map(inner.__getitem__, symbols[:-1]), self.last_of[symbols[-1]]])
            return
        for b in symbols:
            if before is not None:
                hold.append(inner[before])
                if len(hold) >= block:
                    done, at, cut = [], 0, len(hold) - self.lookahead
                    for t in self._merge(list(hold)):
                        size = self.sizes[t]
                        if at + size > cut:
                            break
                        done.append(t)
                        at += size
                    yield from done
                    hold = hold[at:]
            before = b
        if before is not None:
            hold.append(self.last_of[before])
            yield from self._merge(hold)

    @property
    def sizes(self) -> list:
        if not hasattr(self, "_sizes"):
            self._sizes = [len(n.removesuffix(self.end)) if self.end else len(n) for n in self.names]
        return self._sizes

    def chunks(self, text: str, most: int = 4096):
        """The words of a text in lists of at most ``most``; an added token's id is a list of
        its own. Beside the text itself only one list is held."""
        pieces = [text]
        if self.added_pattern and any(a in text for a in self.added):
            pieces, at = [], 0
            for m in self.added_pattern.finditer(text):
                pieces += [text[at:m.start()], self.added[m[0]]]
                at = m.end()
            pieces.append(text[at:])
        for piece in pieces:
            if isinstance(piece, int):
                yield [piece]
                continue
            found = self.word_pattern.finditer(self.normal(piece))
            while words := [m[0] for m in islice(found, most)]:
                yield words

    def words(self, text: str):
        """Lists of words (str), with the ids of added tokens (int) between them."""
        pieces = [text]
        if self.added_pattern and any(a in text for a in self.added):
            pieces, at = [], 0
            for m in self.added_pattern.finditer(text):
                pieces += [text[at:m.start()], self.added[m[0]]]
                at = m.end()
            pieces.append(text[at:])
        out: list = []
        for piece in pieces:
            out += [piece] if isinstance(piece, int) else self.word_pattern.findall(self.normal(piece))
        return out

    def normal(self, text: str) -> str:
        # white space only separates words, so replacing it by blanks changes nothing more
        if text.isascii():
            return text.lower() if "Lowercase" in self.steps else text
        if "NFC" in self.steps:
            text = unicodedata.normalize("NFC", text)
        if "Lowercase" in self.steps:
            # character by character: a final sigma is no special case
            text = text.replace("Σ", "σ").lower()
        return text


class Decoder:
    """Ids to text, one id at a time; holds at most one incomplete UTF-8 sequence."""

    def __init__(self, merges: Merges):
        self.names, self.end = merges.names, merges.end
        self.special = set(merges.added.values())
        self.byte = {c: b for b, c in enumerate(byte_symbols())}
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, i: int) -> str:
        name = self.names[i]
        if i in self.special:
            return self.utf8.decode(b"", True) + name
        ends = self.end and name.endswith(self.end)
        body = bytes(self.byte[c] for c in (name[:-len(self.end)] if ends else name))
        return self.utf8.decode(body, bool(ends)) + (" " if ends else "")

    def close(self) -> str:
        return self.utf8.decode(b"", True)


class Names:
    """Ids to the text of the library's decode(), one id after the other: the tokens' names
    with one blank between them. The state is whether a token has come yet."""

    def __init__(self, merges: Merges):
        self.spaced, self.begun = [" " + n for n in merges.names], False

    def push(self, i: int) -> str:
        return self.feed([i])

    def feed(self, ids: list) -> str:
        out = "".join(map(self.spaced.__getitem__, ids))
        if not self.begun and ids:
            self.begun, out = True, out[1:]
        return out


class Encoder:
    """Encodes texts, each word through the transducer; words of up to KEPT bytes are kept in
    a bounded table."""

    def __init__(self, merges: Merges, most: int = WORDS):
        self.merges, self.most, self.known = merges, most, {}

    def _learn(self, word) -> bytes:
        if isinstance(word, int):
            return array("i", [word]).tobytes()
        raw = word.encode("utf-8", "surrogatepass")
        ids = array("i", self.merges.stream(raw)).tobytes()
        if len(raw) <= KEPT:
            if len(self.known) >= self.most:
                self.known.clear()                # a full table starts anew
            self.known[word] = ids
        return ids

    def encode(self, text: str):
        """The ids of a text, as bytes of 32-bit numbers, chunk by chunk."""
        for words in self.merges.chunks(text):
            found = list(map(self.known.get, words))
            yield b"".join([self._learn(w) if ids is None else ids for w, ids in zip(words, found)])


def load_merges(path: str) -> Merges:
    with open(path, encoding="utf-8") as f:
        return Merges(json.load(f))


#: The columns that can be asked for.
COLUMNS = {"n_tokens": LongType(), "ids": ArrayType(IntegerType()), "decoded": StringType(),
           "plain_text": StringType(), "ids_sha256": StringType(), "decoded_sha256": StringType()}


def encode_decode(docs: DataFrame, tokenizer: str, text_col: str = "text",
                  columns: tuple = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Column ``doc`` (a struct of the input's columns) and the asked ``columns`` of each
    text: the ids, the text that the library decodes from them, the plain text, digests of
    the decimal ids joined by blanks and of the decoded text.

    ``tokenizer`` is the path of a tokenizer file; its content (a bounded vocabulary) is read
    here and sent to the tasks."""
    with open(tokenizer, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(texts):
        merges = Merges(json.loads(source.value))
        encoder, digits = Encoder(merges), [str(i) for i in range(len(merges.names))]
        names, want = Names(merges), set(columns)

        def one(text):
            """The asked columns of a text; digests and decoded texts grow chunk by chunk."""
            out = {c: [] for c in ("ids", "decoded", "plain_text")}
            told, said, count = hashlib.sha256(), hashlib.sha256(), 0
            machine = Decoder(merges)
            names.begun = False
            for raw in encoder.encode(text):
                ids = np.frombuffer(raw, np.int32).tolist()
                if "ids" in want:
                    out["ids"].append(raw)
                if "ids_sha256" in want and ids:
                    told.update(((" " if count else "") + " ".join(map(digits.__getitem__, ids))).encode())
                if want & {"decoded", "decoded_sha256"}:
                    part = names.feed(ids)
                    said.update(part.encode("utf-8", "surrogatepass"))
                    if "decoded" in want:
                        out["decoded"].append(part)
                if "plain_text" in want:
                    out["plain_text"] += map(machine.push, ids)
                count += len(ids)
            return {"n_tokens": count, "ids": b"".join(out["ids"]), "decoded": "".join(out["decoded"]),
                    "plain_text": "".join(out["plain_text"]) + machine.close(),
                    "ids_sha256": told.hexdigest(), "decoded_sha256": said.hexdigest()}

        for text in texts:
            parts = []
            for i, j in _blocks(text):
                made = [one(t or "") for t in text.slice(i, j - i).to_pylist()]
                arrays = []
                for c in columns:
                    if c == "n_tokens":
                        arrays.append(pa.array([r[c] for r in made], pa.int64()))
                    elif c == "ids":
                        offsets = pa.array(np.concatenate(([0], np.cumsum([r["n_tokens"] for r in made]))).astype(np.int32))
                        arrays.append(pa.ListArray.from_arrays(
                            offsets, pa.array(np.frombuffer(b"".join([r[c] for r in made]), np.int32))))
                    else:
                        arrays.append(pa.array([r[c] for r in made], pa.string()))
                parts.append(pa.StructArray.from_arrays(arrays, names=list(columns)))
            yield pa.concat_arrays(parts)

    return with_results(docs, text_col, run, StructType([StructField(c, COLUMNS[c]) for c in columns]))


def _blocks(text: pa.Array, limit: int = 1 << 20):
    """Row ranges of about ``limit`` bytes (one of no rows for an empty array)."""
    size = pa.compute.binary_length(text.cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    i = 0
    if not len(size):
        yield 0, 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield i, j
        i = j
