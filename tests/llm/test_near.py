"""Operators 1 and 8 against all pairs on small tables."""
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import strata.llm.embeddings as embeddings
from corpus_pipeline import near_dedup
from strata.llm._graph import components
from strata.llm.embeddings import cosine_links
from strata.llm.minhash import near_duplicates
from strata.session import materialize
from tests.llm.conftest import sentence

LOW = {i: i + 32 for i in range(65, 91)}


def classes(ids, links):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(rows, size, percent):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size
                    else {tuple(w)} if w else set())
    links = [(rows[x][0], rows[y][0]) for x in range(len(rows)) for y in range(x) if sets[x]
             and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y])]
    c = classes([i for i, _ in rows], links)
    return sorted((i, len(s), c[i], c[i] == i) for (i, _), s in zip(rows, sets))


def corpus(seed, n=80):
    rng = random.Random(seed)
    base = [sentence(rng, rng.randrange(20, 120)) for _ in range(n // 8)]
    rows = []
    for i in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = "changed" + str(rng.randrange(9))
        rows.append((3 * i + 1, " ".join(words).upper() if rng.random() < 0.3 else "\n".join(words)))
    return rows + [(900, ""), (901, None), (902, "one"), (903, "ONE"), (904, "two words"), (905, " \t"),
                   (906, "é É"), (907, "é É")]


@pytest.mark.parametrize("size, percent, node", [(3, 85, 512), (5, 80, 512), (3, 85, 6)])
def test_near_duplicates(frame, size, percent, node):
    rows = corpus(size + node)
    out = near_duplicates(frame(rows), shingle=size, percent=percent, node_size=node)
    assert sorted(tuple(r) for r in out.collect()) == brute(rows, size, percent)


def test_large_group_of_copies_and_near_copies(frame):
    rng = random.Random(5)
    words = sentence(rng, 200).split()
    rows = [(i, " ".join(words)) for i in range(100, 400)]
    for i in range(400, 1100):                   # more than one node holds
        w = list(words)
        w[rng.randrange(200)] = f"w{i}"
        rows.append((i, " ".join(w)))
    out = near_duplicates(frame(rows)).collect()
    assert {r.component_id for r in out} == {100} and sum(r.kept for r in out) == 1


def test_links_that_surer_pairs_shadow_are_found_in_every_tree(frame):
    rows = []
    for g in (61, 190, 284):                      # their pair meets in none of the first four trees
        common = [f"g{g}c{k}" for k in range(47)]
        sets = [common + [f"g{g}{x}{k}" for k in range(53)] for x in "ab"]         # just above the threshold
        for x in range(5):                        # just below it, to both
            sets.append(common[:x] + common[x + 1:] + [f"g{g}x{x}n{k}" for k in range(54)])
        rows += [(100 * g + i, " ".join(w)) for i, w in enumerate(sets)]
    out = near_duplicates(frame(rows), shingle=1, percent=30)
    assert sorted(tuple(r) for r in out.collect()) == brute(rows, 1, 30)


def test_near_duplicates_nulls_and_repeats(frame):
    text = "a b c d e f g h"
    out = near_duplicates(frame([(5, text), (5, text), (5, "other words stand here now"), (None, text),
                                 (7, text), (None, "lonely text of five words")])).collect()
    by = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or -1, r.kept) for r in out)
    assert by == sorted([(False, 5, 6, 5, True), (False, 5, 6, 5, True), (False, 5, 3, 5, True), (False, 7, 6, 5, False),
                         (True, 0, 6, 5, False), (True, 0, 3, -1, True)])
    assert near_duplicates(frame([(1, "x")]).filter("doc_id < 0")).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a long, b long")
    got = {r.v: r.c for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99}


def estimate(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def test_size_estimates_do_not_grow_with_the_rounds(spark):
    """A join's estimate is the product of its sides'; the rounds must not multiply it on."""
    names = list(range(60))
    random.Random(3).shuffle(names)
    found = components(spark.createDataFrame(list(zip(names, names[1:])), "a long, b long"))
    assert {r.v: r.c for r in found.collect()} == dict.fromkeys(names, 0)
    assert estimate(found) < 2 ** 64


def test_pipeline_stage_on_a_chain_of_near_duplicates(spark, frame):
    """Classes whose ends share nothing take rounds; the stage's plan must not grow with them."""
    words, names = [f"w{k}" for k in range(200)], list(range(10, 60))
    random.Random(4).shuffle(names)
    rows = [(i, " ".join(words[2 * k:2 * k + 60])) for k, i in enumerate(names)] + [(3, "apart from all of these")]
    out = near_dedup(spark, frame(rows), "")
    assert sorted(r.doc_id for r in out.collect()) == [3, 10]
    assert estimate(out) < 2 ** 2000


def test_a_known_size_is_kept_and_an_outgrown_one_forgotten(spark):
    small = materialize(spark.range(100))
    assert estimate(small) == 800
    wide = small
    for k in range(9):
        wide = wide.join(small.withColumnRenamed("id", f"x{k}"), F.col("id") == F.col(f"x{k}"))
    kept = materialize(wide.repartition(3, "id").sortWithinPartitions("id"))
    assert estimate(wide) > 2 ** 64 > estimate(kept)
    assert sorted(tuple(r) for r in kept.collect()) == [(i,) * 10 for i in range(100)]
    assert kept.dtypes == wide.dtypes and kept.rdd.getNumPartitions() == 3
    assert kept.join(kept.select("id"), "id").count() == 100


def cosine_brute(rows, least):
    unit = []
    for _, v in rows:
        good = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) / max(map(abs, v)) if good else None
        unit.append(x / np.linalg.norm(x) if good else None)
    links = [(x, y) for x in range(len(rows)) for y in range(x)
             if unit[x] is not None and unit[y] is not None and len(unit[x]) == len(unit[y])
             and float(unit[x] @ unit[y]) >= least]
    count = [0] * len(rows)
    for x, y in links:
        count[x] += 1
        count[y] += 1
    c = classes([i for i, _ in rows], [(rows[x][0], rows[y][0]) for x, y in links])
    return sorted((i, n, c[i], c[i] == i) for (i, _), n in zip(rows, count))


@pytest.mark.parametrize("per_pivot, block", [(2048, 4096), (20, 7)])
def test_cosine_links(spark, monkeypatch, per_pivot, block):
    monkeypatch.setattr(embeddings, "PER_PIVOT", per_pivot)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    rows = [(int(i) * 2, (centres[i % 12] + rng.normal(size=8) * 0.15).tolist()) for i in range(200)]
    rows += [(1001 + 2 * k, rows[3][1]) for k in range(30)]                    # copies
    rows += [(2001, None), (2003, []), (2005, [0.0] * 8), (2007, [1.0, None] + [0.0] * 6), (2009, [math.inf] * 8),
             (2011, [math.nan] * 8), (2013, [1.0, 0.0]), (2015, [2.0, 0.0]), (2017, [1e-300] * 8), (2019, [1e300] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in cosine_links(df.repartition(4)).collect()) == cosine_brute(rows, 0.95)


def test_cosine_links_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01])],
                               "vec_id long, embedding array<float>")
    out = {r.vec_id: tuple(r)[1:] for r in cosine_links(df).collect()}
    assert out == {1: (1, 1, True), 2: (1, 1, False), None: (0, None, True)}
    assert cosine_links(df.filter("vec_id > 5")).count() == 0


def test_cosine_links_with_the_default_constants(spark):
    """Enough clustered vectors for several pivots and blocks, against all pairs."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 9000)] + 0.12 * rng.normal(size=(9000, 16))
    x[8000:8500] = x[0] + 0.01 * rng.normal(size=(500, 16))
    assert len(x) // embeddings.PER_PIVOT > 1 and len(x) > 2 * embeddings.BLOCK
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = {r.vec_id: (r.n_links, r.component_id) for r in cosine_links(frame).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    assert [got[i][0] for i in range(9000)] == links.sum(1).tolist()
    label = np.arange(9000)
    while True:
        new = np.minimum(label, np.where(links, label[None, :], 9000).min(1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    assert [got[i][1] for i in range(9000)] == label.tolist()
