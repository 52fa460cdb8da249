"""Operator 11: packing of documents into sequences by bulk-synchronous best fit.

Texts become token ids once; what is packed are pieces (a number and a length). As many empty
sequences are opened as the tokens need at least. Then pieces are taken in classes of falling
length. Each round sorts the class's pieces and the gaps of the open sequences into ranges of
size, and each range is swept in its own task: from small to large, a gap takes the largest
piece below it that no smaller gap has taken, so every piece gets its least successor that is
still free. A gap that holds several of the class's pieces stands in the sweep that many
times. Pieces and gaps that a range has left over are matched across ranges by their ranks:
per range only two counts go to the driver, which pairs runs of ranks as a stack of brackets.
Gaps shrink by what they have taken, and the next round begins; where none of a class's
pieces fits any gap, sequences are opened for them.

Counts by length or gap (at most the sequence length of them) steer the rounds, so a length
that a third of all pieces have is dealt over as many tasks as its rows need. A round costs a
shuffle of one class's (number, length) rows; there are about fifteen rounds, more only with
the logarithm of the sequence length.

Cases: NULL and empty texts have the closing id alone; repeated rows are packed each; equal
lengths are ordered by the pieces' numbers; a text longer than a sequence is cut into whole
sequences and a rest; an empty table gives no rows; extra columns pass through in ``doc``,
the text does not.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import types
import zlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import (ArrayType, IntegerType, LongType, StructField, StructType)

from strata.llm._text import with_results
from strata.llm.bpe import Merges, _blocks
from strata.session import materialize

RANGE = 100_000                                   # rows of a range that one task sweeps
RATIO, COARSE = 1.5, 4.0                          # class widths: of long pieces, of short ones
WORDS = 500_000                                   # results that a task keeps
LONG = 64                                         # bytes of a word that merges as a row of arrays

BLOCK = 4 << 20                                   # bytes of text encoded together
MARK, BETWEEN = "\0", " \0 "                      # a word of its own

PIECE = StructType([StructField("piece", IntegerType()), StructField("start", LongType()),
                    StructField("length", LongType()), StructField("ids_crc32", LongType())])


class Ids:
    """Token ids of texts, as little-endian 32-bit bytes. By word, each part of a text between
    blanks and line ends is looked up in a bounded table; what is new is cut into words, whose
    merges run side by side as arrays (``Merges``); long words, and texts with added tokens or
    NUL characters, go to the tokenizers library."""

    def __init__(self, source: str, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = Merges(json.loads(source)) if by_word else None
        self.parts, self.words = {}, {}

    def _encoded(self, texts: list) -> list:
        made = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in made]

    def _learn(self, parts: list) -> None:
        # all parts as one text, a mark behind each: blanks and marks keep words apart
        words = self.merges.word_pattern.findall(BETWEEN.join([*parts, ""]))
        if len(self.words) > WORDS:
            self.words.clear()
        self.words[MARK] = b""
        new = list(set(words).difference(self.words))
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        short = [k for k, r in enumerate(raw) if len(r) <= LONG]
        for k, ids in zip(short, self.merges.merge_many([raw[k] for k in short])):
            self.words[new[k]] = ids.astype("<u4").tobytes()
        far = [w for w, r in zip(new, raw) if len(r) > LONG]
        self.words.update(zip(far, self._encoded(far)))
        made = list(map(self.words.__getitem__, words))
        ends = np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))
        marks = np.fromiter(map(MARK.__eq__, words), bool, len(words))
        cuts = [0, *ends[marks].tolist()]
        whole = b"".join(made)
        self.parts.update(zip(parts, [whole[i:j] for i, j in zip(cuts, cuts[1:])]))

    def of(self, texts: list):
        if self.merges is None:
            yield from self._encoded(texts)
            return
        odd = [MARK in t or any(a in t for a in self.merges.added) for t in texts]
        split = [[] if o else self.merges.normal(t).replace("\n", " ").split(" ") for t, o in zip(texts, odd)]
        known = self.parts
        if len(known) > WORDS:
            known.clear()
        found = [list(map(known.get, parts)) for parts in split]
        new = {p for parts, ids in zip(split, found) if None in ids for p, i in zip(parts, ids) if i is None}
        if new:
            self._learn(list(new))
        for t, o, parts, ids in zip(texts, odd, split, found):
            yield self._encoded([t])[0] if o else b"".join([known[p] if i is None else i for p, i in zip(parts, ids)])


def worker_ids(source: str, by_word: bool) -> Ids:
    """The encoder of this worker process: Spark runs many tasks in one, and functions sent by
    value find no module of ours there, so the tables hang on one that is made for them."""
    kept = sys.modules.setdefault("_strata_worker", types.ModuleType("_strata_worker")).__dict__
    key = (hashlib.sha256(source.encode()).digest(), by_word)
    if key not in kept:
        kept[key] = Ids(source, by_word)
    return kept[key]


def pieces(docs: DataFrame, tokenizer: str, size: int, closing: int, text_col: str = "text",
           by_word: bool = False, ids: bool = False) -> DataFrame:
    """``doc`` (a struct of the input's other columns) and its ``pieces`` of up to ``size`` ids, the
    closing id last: their number, start, length and checksum, with ``ids`` the ids too.

    ``by_word`` says that the tokenizer drops white space and that no token depends on what
    lies beyond a blank or line end, so each such part of a text is encoded once a task."""
    with open(tokenizer, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(json.dumps(json.load(f)))
    kind = StructType([*PIECE.fields, StructField("ids", ArrayType(LongType()))]) if ids else PIECE

    def run(texts):
        encoder, end = worker_ids(source.value, by_word), np.array([closing], "<u4").tobytes()
        for text in texts:
            out = []
            for i, j in _blocks(text, BLOCK):
                for whole in encoder.of([t or "" for t in text.slice(i, j - i).to_pylist()]):
                    whole += end
                    rows = []
                    for at in range(0, len(whole), 4 * size):
                        part = whole[at:at + 4 * size]
                        row = {"piece": at // (4 * size), "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
                        rows.append(row | ({"ids": np.frombuffer(part, "<u4").tolist()} if ids else {}))
                    out.append({"pieces": rows})
            yield pa.array(out, pa.struct([("pieces", pa.list_(pa.struct(
                [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
                + ([("ids", pa.list_(pa.int64()))] if ids else []))))]))

    made = with_results(docs, text_col, run, StructType([StructField("pieces", ArrayType(kind))]))
    names = [c for c in docs.columns if c != text_col] or docs.columns
    return made.select(F.struct(*[F.col("doc")[c].alias(c) for c in names]).alias("doc"), "pieces")


def matched(size: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sweeps sorted items (at equal sizes pieces before gaps): the matched (piece, gap)
    positions, and those of the pieces and gaps left over.

    A piece opens a bracket and a gap closes the last open one, which is the largest piece
    not taken yet; brackets match where their levels agree."""
    step = np.where(gap, -1, 1)
    level = np.cumsum(step)
    level = level - np.minimum(np.minimum.accumulate(level), 0)
    before = np.concatenate(([0], level[:-1]))
    free = gap & (before == 0)
    depth = np.where(gap, before, level)
    order = np.flatnonzero(~free)
    order = order[np.argsort(depth[order], kind="stable")]
    pair = np.flatnonzero((depth[order[:-1]] == depth[order[1:]]) & ~gap[order[:-1]] & gap[order[1:]])
    taken, by = order[pair], order[pair + 1]
    open_ = ~gap
    open_[taken] = False
    return taken, by, np.flatnonzero(open_), np.flatnonzero(free)


SWEPT = "bucket long, rank long, p long, length long, s long"


def _sweep(table: pa.Table) -> pa.Table:
    size, gap, item = (table.column(c).to_numpy() for c in ("size", "gap", "id"))
    order = np.lexsort((item, gap, size))
    size, gap, item = size[order], gap[order].astype(bool), item[order]
    taken, by, left, free = matched(size, gap)
    at = np.concatenate((taken, left, free))
    n, u, g = len(taken), len(left), len(free)
    rank = pa.array(np.concatenate((np.zeros(n, np.int64), np.arange(u), np.arange(g))), pa.int64(), mask=np.arange(n + u + g) < n)
    is_gap, is_left = np.arange(n + u + g) >= n + u, (np.arange(n + u + g) >= n) & (np.arange(n + u + g) < n + u)
    s = np.concatenate((item[by], item[left], item[free]))
    return pa.table([pa.array(np.full(len(at), table.column("bucket")[0].as_py() if len(table) else 0, np.int64)), rank,
                     pa.array(item[at], pa.int64(), mask=is_gap), pa.array(size[at], pa.int64(), mask=is_gap),
                     pa.array(s, pa.int64(), mask=is_left)], names=["bucket", "rank", "p", "length", "s"])


def buckets(counts: dict, most: int) -> tuple[dict, int]:
    """For each size its first bucket and how many it is dealt over, in order of size."""
    out, bucket, filled = {}, 0, 0
    for size in sorted(counts):
        n = counts[size]
        if filled and filled + n > most:
            bucket, filled = bucket + 1, 0
        out[size] = (bucket, max(1, ceil(n / most)))
        bucket, filled = bucket + out[size][1] - 1, filled + n if out[size][1] == 1 else most
    return out, bucket + 1


def across(left: dict) -> tuple[list, list]:
    """Matches between ranges from what each, by bucket, has left over (pieces, gaps): runs
    of ranks (bucket, from, to, k) whose k - rank, for pieces, and k + rank, for gaps, agree."""
    stack, taken, taking, base = [], [], [], 0
    for bucket in sorted(left):
        pieces_left, gaps_left = left[bucket]
        rank = 0
        while stack and rank < gaps_left:
            owner, n = stack.pop()
            m = min(n, gaps_left - rank)
            taken.append((owner, n - m, n, base + n - 1))
            taking.append((bucket, rank, rank + m, base - rank))
            rank, base = rank + m, base + m
            if n > m:
                stack.append((owner, n - m))
        if pieces_left:
            stack.append((bucket, pieces_left))
    return taken, taking


def _counted(frame: DataFrame, column: str) -> dict:
    return {r[0]: r[1] for r in frame.groupBy(column).count().collect()}


def best_fit(items: DataFrame, size: int, most: int = RANGE) -> DataFrame:
    """(p, sequence) of the pieces (p, length): lengths 1 to ``size``, at most ``size`` in a
    sequence. ``items`` is read once a class, so it should be a written table."""
    spark = items.sparkSession
    left = _counted(items, "length")
    left.pop(size, None)
    placed = [items.where(F.col("length") == size).select("p", (-1 - F.col("p")).alias("sequence"))]
    opened = max(ceil(sum(k * n for k, n in left.items()) / size), sum(n for k, n in left.items() if 2 * k > size))
    gaps, rooms = spark.range(opened).select(F.col("id").alias("s"), F.lit(size).cast("long").alias("room")), {size: opened}
    over, lengths = None, {}
    while left:
        if over is None:                          # the next class
            top = max(left)
            low = int(top / (RATIO if 16 * top > size else COARSE))
            over, lengths = items.where(F.col("length").between(low + 1, top)), {k: n for k, n in left.items() if k > low}
        top, least = max(lengths), min(lengths)
        if not rooms or max(rooms) < least:       # nothing fits: open what the class needs
            more = ceil(round(sum(n / (size // k) for k, n in lengths.items()), 6))
            new = spark.range(opened, opened + more).select(F.col("id").alias("s"), F.lit(size).cast("long").alias("room"))
            gaps, opened, rooms = gaps.unionByName(new), opened + more, rooms | {size: more}
        # how often a gap stands in the sweep: no more in all than there are pieces
        need, cut, last = sum(lengths.values()), size, 1
        for room in sorted(r for r in rooms if r >= top):
            times = room // top
            cut, last = room, min(times, ceil(need / rooms[room]))
            need -= times * rooms[room]
            if need <= 0:
                break
        room = F.col("room")
        times = F.when(room < cut, F.greatest(F.lit(1), F.floor(room / top))).when(room == cut, last).otherwise(0).cast("int")
        slots = (gaps.where(room >= least).select(F.col("s").alias("id"), room.alias("size"), times.alias("times"))
                 .where("times > 0").withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times"))
        both = (over.select(F.col("p").alias("id"), F.col("length").alias("size"), F.lit(0).alias("gap"))
                .unionByName(slots.withColumn("gap", F.lit(1))))
        sizes = dict(lengths)
        for r, n in rooms.items():
            if least <= r <= cut:
                sizes[r] = sizes.get(r, 0) + n * (last if r == cut else max(1, r // top))
        dealt, width = buckets(sizes, most)
        if width == 1:
            both = both.withColumn("bucket", F.lit(0).cast("long"))
        else:                                     # at most one row a size: bounded by the sequence length
            of = spark.createDataFrame([(k, *v) for k, v in dealt.items()], "size long, first long, over int")
            both = (both.join(F.broadcast(of), "size")
                    .withColumn("bucket", F.col("first") + F.pmod(F.xxhash64("id"), F.col("over"))).drop("first", "over"))
        swept = materialize(both.groupBy("bucket").applyInArrow(_sweep, SWEPT).coalesce(width))
        pairs, rest = swept.where("rank is null"), swept.where("rank is not null and s is null")
        if width > 1:
            counts = swept.where("rank is not null").groupBy("bucket").agg(F.count("p"), F.count("s")).collect()
            taken, taking = across({b: (u, g) for b, u, g in counts})
            if taken:
                kind = "bucket long, lo long, hi long, k long"
                inside = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
                of, by = spark.createDataFrame(taken, kind).alias("r"), spark.createDataFrame(taking, kind).alias("r")
                rest = rest.alias("x").join(of, (F.col("x.bucket") == F.col("r.bucket")) & inside, "left")
                free = swept.where("rank is not null and p is null").alias("x")
                free = free.join(by, (F.col("x.bucket") == F.col("r.bucket")) & inside).select((F.col("k") + F.col("rank")).alias("m"), "s")
                met = rest.where("k is not null").select((F.col("k") - F.col("rank")).alias("m"), "p", "length")
                pairs = materialize(pairs.select("p", "length", "s").unionByName(met.join(free, "m").select("p", "length", "s")))
                rest = materialize(rest.where("k is null").select("p", "length"))
        placed.append(pairs.select("p", F.col("s").alias("sequence")))
        over = rest.select("p", "length")
        after = _counted(over, "length")
        for k in lengths:
            left[k] = after.get(k, 0)
        left, lengths = {k: n for k, n in left.items() if n}, after
        over = over if after else None
        if left:
            used = pairs.groupBy("s").agg(F.sum("length").alias("used"))
            gaps = (gaps.join(used, "s", "left").select("s", (room - F.coalesce("used", F.lit(0))).alias("room"))
                    .where(room >= min(left)))
            gaps = materialize(gaps.coalesce(ceil(opened / most)))
            rooms = _counted(gaps, "room")
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, closing: int = 1, text_col: str = "text",
         by_word: bool = False, ids: bool = False, most: int = RANGE) -> DataFrame:
    """One row a piece: ``doc`` (a struct of the input's other columns), ``piece``, ``start``,
    ``length``, ``ids_crc32`` (and ``ids``), ``sequence_id`` and ``offset`` in the sequence."""
    made = pieces(docs, tokenizer, size, closing, text_col, by_word, ids)
    rows = materialize(made.select("doc", F.inline("pieces")).withColumn("p", F.monotonically_increasing_id()))
    where = best_fit(rows.select("p", "length"), size, most)
    earlier = Window.partitionBy("sequence").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.join(where, "p").withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
            .withColumnRenamed("sequence", "sequence_id").drop("p"))
