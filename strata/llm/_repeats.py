"""Exact cross-document repeats of a fixed length, found shard by shard.

A document is a sequence of units (bytes or words). Every window of ``length`` units holds
a *seed*: its smallest ``seed``-unit fingerprint. Equal windows hold equal seeds at equal
places, so all copies of a window meet where their seed is dealt:

1. ``_entries``: each run of documents (a *chunk*) sends, per bucket of seeds, packed arrays
   of (seed, fingerprint of the segment that spans all windows with that seed, smallest
   doc_id). An entry is sent once per chunk however often it occurs.
2. ``_reduce``: per bucket, a segment that a smaller document holds whole is a repeat;
   where a seed stands in segments that differ, all of those are asked for.
3. ``_segments`` deals the differing segments into shards, and ``resolve`` (a suffix array
   or a suffix automaton) finds in a shard which windows of a segment a smaller document
   has too. A seed with very many segments is dealt in parts instead: ``FAN`` neighbouring
   windows together, by the fingerprint of what they have in common, so that its segments
   spread over shards.
4. ``_finish`` marks the repeated spans in each chunk and makes the output rows.

Seeds and segments travel as packed arrays, one row per (chunk, bucket). No step holds all
occurrences of a seed: bucket and shard tasks see a key once per chunk.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from strata.llm._text import SLICE, Rolling, U, covered, mix, ranges, release, slices, sliding
from strata.session import materialize

CHUNK = 4 << 20          # bytes of text in a chunk
FAN = 8                   # windows of a crowded seed's segment that are dealt together
LAST = np.iinfo(np.int64).max
DEALT = U(0xA0761D6478BD642F)
AT_ONCE = 1 << 19         # symbols that are resolved at a time, or one seed's


@dataclass
class Repeats:
    """What the job is about: window and seed length in units, how rows become units, how a
    shard is resolved, and which output a chunk gives."""
    length: int
    seed: int
    units: Callable           # (bytes, offsets, Rolling) -> (uint64 units, unit offsets, symbols, extra)
    resolve: Callable         # (symbols, segment offsets, owners, seeds, length) -> uint64 bitmaps
    output: Callable          # (bytes, offsets, unit offsets, extra, flags) -> dict of columns
    schema: str
    crowded: int              # distinct segments of a seed beyond which they are dealt in parts

    @property
    def reach(self) -> int:
        return self.length - self.seed + 1


def _pack(*arrays) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 1)


def _unpack(blob) -> tuple:
    return pickle.loads(zstandard.decompress(blob))


def _planes(values: np.ndarray) -> np.ndarray:
    """The bytes of sorted values, most significant plane together, which compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T)


def _values(planes: np.ndarray, dtype) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _chunks(batches):
    """Runs of rows: (doc ids, binary texts) of about CHUNK bytes."""
    ids, texts, held = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(1).cast(pa.large_binary()).fill_null(b"")
        doc = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
        for i, j, data, offsets in slices(column, CHUNK):
            ids.append(doc[i:j])
            texts.append((data.tobytes(), offsets.copy()))
            held += len(data)
            if held >= CHUNK:
                yield np.concatenate(ids), texts
                ids, texts, held = [], [], 0
    if ids:
        yield np.concatenate(ids), texts


def _chunk_id(ids: np.ndarray, texts: list) -> int:
    """Names a chunk by its content, so that a task that runs again names it alike."""
    import xxhash
    h = xxhash.xxh3_64(ids.tobytes())
    for data, _ in texts:
        h.update(data)
    return h.intdigest() - (1 << 63)


def _occurrences(job: Repeats, texts: list, rolling: Rolling):
    """Per array step: the rows' bytes and units, and every seed with its segment."""
    row = 0
    for data, offsets in texts:
        data = np.frombuffer(data, np.uint8)
        for i, j, part, off in _parts(data, offsets):
            units, at, symbols, extra = job.units(part, off, rolling)
            found = _seeds(job, units, at, rolling)
            yield row + i, row + j, part, off, at, symbols, extra, found
        row += len(offsets) - 1


def _parts(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE):
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def _seeds(job: Repeats, units: np.ndarray, at: np.ndarray, rolling: Rolling):
    """(seed, segment, row, segment start, segment end, place) of each chosen seed."""
    s, w, length = job.seed, job.reach, job.length
    none = np.zeros(0, np.int64)
    if len(units) < length:
        return none.view(U), none.view(U), none, none, none, none
    sums = rolling.sums(units)
    seeds = rolling.windows(sums, s)
    low = sliding(seeds, w)                       # the seed of the window at each place
    high = sliding(low, w, np.maximum)            # the largest of those over a seed's windows
    chosen = np.zeros(len(seeds), bool)
    chosen[w - 1:w - 1 + len(high)] = high == seeds[w - 1:w - 1 + len(high)]
    edge = np.r_[0:min(w - 1, len(seeds)), max(0, len(low)):len(seeds)]
    for p in edge:                                # the few places with fewer windows
        span = low[max(0, p - w + 1):p + 1]
        chosen[p] = len(span) and (span == seeds[p]).any()
    p = np.flatnonzero(chosen)
    row = np.searchsorted(at, p, "right") - 1
    start = np.maximum(p - (w - 1), at[row])
    end = np.minimum(p + length, at[row + 1])
    ok = (p + s <= at[row + 1]) & (end - start >= length)
    p, row, start, end = p[ok], row[ok], start[ok], end[ok]
    segment = rolling.spans(sums, start, end)
    segment = mix(segment ^ ((p - start).astype(U) * U(0xD6E8FEB86659FD93)))
    return seeds[p], segment, row, start, end, p


def _dealt(hashes: np.ndarray, count: int) -> np.ndarray:
    """The part of ``count`` that each 64-bit hash is dealt to. Seeds are the smallest of their
    windows, so equal ranges of them would not do: the lowest held sixteen times their share."""
    return ((mix(hashes ^ DEALT) >> U(32)) * U(count) >> U(32)).astype(np.int64)


def _table(job: Repeats, ids: np.ndarray, texts: list, buckets: int, rolling: Rolling):
    """The chunk's occurrences, and its distinct entries in (bucket, segment) order.

    Rows of a chunk compare by doc id; of an entry the smallest counts as the owner."""
    keep, found = [], []
    for i, j, part, off, at, symbols, extra, f in _occurrences(job, texts, rolling):
        keep.append((i, part, off, at, symbols, extra, len(f[0])))
        found.append((f[0], f[1], f[2] + i, f[3], f[4], f[5]))
    seed, segment, row, start, end, at = (np.concatenate(x) for x in zip(*found))
    bucket = _dealt(seed, buckets).astype(np.int32)
    order = np.argsort(segment)                   # a fingerprint of the segment and the seed's place
    order = order[np.argsort(bucket[order], kind="stable")]
    sorted_segment = segment[order]
    first = np.ones(len(order), bool)
    first[1:] = sorted_segment[1:] != sorted_segment[:-1]
    head = np.flatnonzero(first)
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(first) - 1
    doc = ids[row]
    owner = np.minimum.reduceat(doc[order], head) if len(head) else doc[:0]
    mine = np.flatnonzero(doc == owner[entry])    # an occurrence of each entry in its owner
    place = np.empty(len(head), np.int64)
    place[entry[mine]] = mine
    return (keep, row, start, end, at, entry, seed[order][head], sorted_segment[head], owner,
            bucket[order][head].astype(np.int64), place)


def repeats(job: Repeats, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row by ``job.output`` (whose flags mark the repeated units)."""
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))

    def packed(batches):
        for ids, texts in _chunks(batches):
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([_chunk_id(ids, texts)], pa.int64()),
                "body": pa.array([_pack(ids, texts)], pa.binary())})
        release()

    def entries(batches):
        rolling = Rolling()
        for ids, texts in _chunks(batches):
            chunk = _chunk_id(ids, texts)
            _, _, _, _, _, _, seed, segment, owner, bucket, _ = _table(job, ids, texts, buckets, rolling)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            out = []
            for b in np.flatnonzero(np.diff(cuts)):
                at = slice(cuts[b], cuts[b + 1])
                own = owner[at]
                near = own - own.min()
                if near.max() < 1 << 32:
                    near = near.astype(np.uint32)
                out.append((int(b), _pack(_planes(seed[at] >> U(16)), segment[at],
                                          int(own.min()), near)))
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([b for b, _ in out], pa.int32()),
                "chunk": pa.array([chunk] * len(out), pa.int64()),
                "body": pa.array([x for _, x in out], pa.binary())})
        release()

    answers = "chunk long, bucket int, kind string, body binary"
    # written once: two later steps read the answers, and a lost executor costs no bucket
    found = materialize(rows.mapInArrow(entries, "bucket int, chunk long, body binary")
                        .groupBy("bucket").applyInArrow(_reduce(job.crowded), answers))
    text = rows.mapInArrow(packed, "chunk long, body binary")

    def segments(left: pa.Table, right: pa.Table) -> pa.Table:
        shards: dict[int, list] = {}
        _known(left, right)
        asked = _answers(right, "many"), _answers(right, "crowded")
        if left.num_rows and any(asked):
            ids, texts = _unpack(left.column("body")[0].as_py())
            keep, row, start, end, at, _, seed, _, _, bucket, place = _table(job, ids, texts, buckets, Rolling())
            base = np.searchsorted(bucket, np.arange(buckets + 1))
            for want, in_parts in zip(asked, (False, True)):
                wanted = np.sort(np.concatenate([base[b] + x for b, x in want] or [np.zeros(0, np.int64)]))
                _collect(job, shards, ids, keep, row, (start, end, at), place, seed, wanted, in_parts, 2 * buckets)
        chunk = left.column("chunk")[0].as_py() if left.num_rows else 0
        release()
        return pa.table({"shard": pa.array(list(shards), pa.int32()),
                         "chunk": pa.array([chunk] * len(shards), pa.int64()),
                         "body": pa.array([_pack(*(np.concatenate(x) for x in zip(*v)))
                                           for v in shards.values()], pa.binary())})

    def resolved(table: pa.Table) -> pa.Table:
        parts = [_unpack(x.as_py()) for x in table.column("body")]
        _, key, often = np.unique(np.concatenate([p[4] for p in parts]), return_inverse=True, return_counts=True)
        met = np.split(often[key] > 1, np.cumsum([len(p[0]) for p in parts])[:-1])
        # a window that came alone has no equal; seeds always come more than once
        parts = [(p[0][m], p[1][m], p[2][m], p[3][m], p[4][m], p[5][np.repeat(m, p[0])]) for p, m in zip(parts, met)]
        size = np.concatenate([p[0] for p in parts])
        owner = np.concatenate([p[1] for p in parts])
        seeds = np.concatenate([p[4] for p in parts])
        symbols = np.concatenate([p[5] for p in parts])
        offsets = np.concatenate(([0], np.cumsum(size)))
        hits = _hits(job, symbols, offsets, owner, seeds)
        out, i = [], 0
        for p in parts:
            n = len(p[0])
            h = hits[i:i + n]
            some = np.flatnonzero(h)
            out.append(_pack(p[2][some], h[some] << p[3][some].astype(U)))
            i += n
        return pa.table({"chunk": table.column("chunk"),
                         "bucket": pa.array([-1] * len(out), pa.int32()),
                         "kind": pa.array(["windows"] * len(out), pa.string()),
                         "body": pa.array(out, pa.binary())})

    windows = (text.groupBy("chunk").cogroup(found.filter("kind <> 'repeat'").groupBy("chunk"))
               .applyInArrow(segments, "shard int, chunk long, body binary")
               .groupBy("shard").applyInArrow(resolved, answers))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        _known(left, right)
        for body in left.column("body"):
            ids, texts = _unpack(body.as_py())
            tables.append(_finish(job, ids, texts, right, buckets))
            release()
        return pa.concat_tables(tables)

    return (text.groupBy("chunk").cogroup(found.unionByName(windows).groupBy("chunk"))
            .applyInArrow(finish, job.schema))


def _reduce(most: int):
    """One bucket: which entries of each chunk a smaller document holds too ('repeat'), and
    which segments share a seed with other segments ('many', or 'crowded' over ``most``)."""
    def run(table: pa.Table) -> pa.Table:
        seeds, segs, docs, row, idx = [], [], [], [], []
        for r, body in enumerate(table.column("body")):
            planes, segment, least, near = _unpack(body.as_py())
            seeds.append(_values(planes, np.uint64))
            segs.append(segment)
            docs.append(near.astype(np.int64) + least)
            row.append(np.full(len(segment), r, np.int32))
            idx.append(np.arange(len(segment), dtype=np.uint32))
        seeds, segs, docs, row, idx = (np.concatenate(x) for x in (seeds, segs, docs, row, idx))
        order = np.lexsort((segs, seeds))
        seeds, segs, docs, row, idx = seeds[order], segs[order], docs[order], row[order], idx[order]
        new_seed = np.r_[True, seeds[1:] != seeds[:-1]]
        new_seg = new_seed | np.r_[True, segs[1:] != segs[:-1]]
        head = np.flatnonzero(new_seg)
        owner = np.repeat(np.minimum.reduceat(docs, head), np.diff(np.r_[head, len(docs)]))
        group = np.cumsum(new_seed) - 1
        many = np.bincount(group, weights=new_seg).astype(np.int64)
        cut = np.flatnonzero(new_seed)
        differ = np.maximum.reduceat(owner, cut) != np.minimum.reduceat(owner, cut)
        asked = ((many > 1) & differ)[group] & (docs == owner)
        crowded = asked & (many > most)[group]
        out = {"chunk": [], "bucket": [], "kind": [], "body": []}
        chunks = table.column("chunk").to_pylist()
        bucket = table.column("bucket")[0].as_py()
        for kind, flag in (("repeat", docs > owner), ("many", asked & ~crowded), ("crowded", crowded)):
            r, x = row[flag], idx[flag]
            o = np.lexsort((x, r))
            r, x = r[o], x[o]
            cuts = np.searchsorted(r, np.arange(len(chunks) + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                out["chunk"].append(chunks[k])
                out["bucket"].append(bucket)
                out["kind"].append(kind)
                out["body"].append(_pack(x[cuts[k]:cuts[k + 1]]))
        release()
        return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "bucket": pa.array(out["bucket"], pa.int32()),
                         "kind": pa.array(out["kind"], pa.string()), "body": pa.array(out["body"], pa.binary())})

    return run


def _hits(job: Repeats, symbols: np.ndarray, offsets: np.ndarray, owner: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """What ``job.resolve`` tells of a shard's segments, for about ``AT_ONCE`` symbols at a time:
    equal windows have one seed, so only segments of a seed must meet."""
    size = np.diff(offsets)
    hits = np.zeros(len(size), U)
    if not len(size):
        return hits
    order = np.argsort(seeds, kind="stable")
    new = np.r_[True, np.diff(seeds[order]) != 0]
    before = (np.cumsum(size[order]) - size[order])[new]
    part = (before // AT_ONCE)[np.cumsum(new) - 1]
    cuts = np.flatnonzero(np.r_[True, np.diff(part) != 0, True])
    for a, b in zip(cuts[:-1], cuts[1:]):
        at = np.sort(order[a:b])
        n = size[at]
        hits[at] = job.resolve(symbols[ranges(offsets[at], n)], np.concatenate(([0], np.cumsum(n))),
                               owner[at], seeds[at], job.length)
    return hits


def _known(left: pa.Table, right: pa.Table) -> None:
    """Answers name a chunk by its content; they must never meet other rows, or none."""
    if right.num_rows and not left.num_rows:
        raise RuntimeError("the input gave other rows when it was read again")


def _answers(table: pa.Table, kind: str) -> list:
    """(bucket, unpacked arrays) of a chunk's answers of one kind, each bucket once."""
    seen, out = set(), []
    if table.num_rows:
        for k, b, body in zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(),
                              table.column("body")):
            if k == kind and (b < 0 or b not in seen):
                seen.add(b)
                x = _unpack(body.as_py())
                out.append((b, x if b < 0 else x[0].astype(np.int64)))
    return out


def _collect(job, shards, ids, keep, row, spans, place, seed, wanted, in_parts, count):
    """Adds the wanted segments (sizes, owners, entries, shifts, keys, symbols) to their shards.
    Whole segments have their seed as key. In parts, windows are taken by their places before
    the seed, which are alike in all copies, and the key is what all windows of a part share."""
    if not len(wanted):
        return
    occurrence = place[wanted]                    # one of each wanted entry, in its owner
    base = np.concatenate(([0], np.cumsum([k[6] for k in keep])))
    step = np.searchsorted(base, occurrence, "right") - 1
    length, reach = job.length, job.reach
    for k in np.unique(step):
        here = step == k
        entry, occ = wanted[here], occurrence[here]
        start, end, at = (x[occ] for x in spans)
        owner, symbols = ids[row[occ]], keep[k][4]
        if not in_parts:
            _deal(shards, symbols, start, end, owner, entry, start * 0, seed[entry], count, 0)
            continue
        rolling = Rolling()
        sums = rolling.sums(symbols.astype(U) + U(1))
        for low in range(1 - reach, 1, FAN):
            high = min(low + FAN, 1)              # windows that start at places low .. high - 1
            a, b = np.maximum(start, at + low), np.minimum(end, at + high - 1 + length)
            ok = b - a >= length
            core = rolling.spans(sums, at[ok] + high - 1, at[ok] + low + length)
            _deal(shards, symbols, a[ok], b[ok], owner[ok], entry[ok], (a - start)[ok],
                  mix(core ^ U(low + reach)), count, count)


def _deal(shards, symbols, start, end, owner, entry, shift, key, count, first):
    shard = _dealt(key, count) + first
    order = np.argsort(shard, kind="stable")
    if not len(order):
        return
    cuts = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0, True])
    for x, y in zip(cuts[:-1], cuts[1:]):
        o = order[x:y]
        size = end[o] - start[o]
        shards.setdefault(int(shard[o[0]]), []).append(
            (size, owner[o], entry[o], shift[o], key[o], symbols[ranges(start[o], size)]))


def _finish(job, ids, texts, right, buckets) -> pa.Table:
    keep, row, start, end, _, entry, _, _, owner, bucket, _ = _table(job, ids, texts, buckets, Rolling())
    base = np.searchsorted(bucket, np.arange(buckets + 1))
    whole = np.zeros(len(owner), bool)
    for b, x in _answers(right, "repeat"):
        whole[base[b] + x] = True
    part = np.zeros(len(owner), U)
    for _, (e, hits) in _answers(right, "windows"):
        np.bitwise_or.at(part, e, hits)
    full = whole[entry] | (ids[row] > owner[entry])
    some = ~full & (part[entry] != 0)
    tables, first = [], 0
    for i, body, off, at, _, extra, n in keep:
        occ = slice(first, first + n)
        first += n
        f, s = full[occ], some[occ]
        a, b = start[occ][f], end[occ][f]
        hits, a2 = part[entry[occ][s]], start[occ][s]
        for k in range(job.reach):
            on = a2[(hits >> U(k)) & U(1) == 1] + k
            a, b = np.concatenate((a, on)), np.concatenate((b, on + job.length))
        flags = covered(int(at[-1]), a, b)
        doc = ids[i:i + len(off) - 1]
        columns = {"doc_id": pa.array(doc, mask=doc == LAST)} | job.output(body, off, at, extra, flags)
        tables.append(pa.table(columns))
    return pa.concat_tables(tables)
