"""Operator 12 against a search over all edits."""
import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from strata.llm.conversations import Tables, repair
from strata.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain_damage(rows):
    out = []
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen
                   else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def search(rows, marks, rerole=1, delete=2, insert=5, truncated=5):
    """The least (cost, audit), with its rows, over all edits of one conversation."""
    @lru_cache(None)
    def best(i, state, put):
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def add(cost, initial, row, rest):
            options.append((cost + rest[0], initial + rest[1], row + rest[2]))

        need = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[need]
        if put < 3:
            add(insert, "I", ((name, ""),), best(i, need, put + 1))
        if i < len(rows):
            role, text = rows[i]
            add(delete, "D", (), best(i + 1, state, 0))
            if marks[i] not in ("blank", "duplicate"):
                more = truncated * (marks[i] == "truncated")
                if (state, role[:1]) in NEXT:
                    add(more, "K", ((role, text),), best(i + 1, NEXT[state, role[:1]], 0))
                add(more + rerole, "R", ((name, text),), best(i + 1, need, 0))
        return min(options, default=(10 ** 9, "", ()))

    return best(0, "", 0)


def brute(rows, ids, **costs):
    groups = {i: [] for i in ids}
    for c, turn, role, text in rows:
        groups[c].append((turn, role, text))
    out = []
    for c, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        turns = [r[0] for r in group if r[0] is not None]
        plain = [(r, t) for _, r, t in group]
        marks = faults(plain)
        cost, audit, kept = search(tuple(plain), marks, **costs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[marks.count(m) for m in ("blank", "duplicate", "truncated")],
                    illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
    return sorted(out, key=str)


def result(frame):
    return sorted(map(tuple, frame.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=str)


@pytest.mark.parametrize("costs", [(1, 2, 5, 5), (3, 4, 1, 2), (2, 2, 2, 0), (5, 9, 1, 1)])
def test_tables_against_search(costs):
    t, rng = Tables(*costs), random.Random(5)
    marks = {0: "blank"} | {1 + 2 * i + x: "truncated" * x for i in range(4) for x in (0, 1)}
    for _ in range(150):
        symbols = [rng.choice([0, 1, 3, 3, 5, 5, 7, rng.randrange(9)]) for _ in range(rng.randrange(0, 12))]
        rows = [("?" if not s else "suax"[(s - 1) // 2], "t") for s in symbols]
        cost, audit, _ = search(tuple(rows), [marks[s] for s in symbols], *costs)
        found, total = t.behind(symbols, t.end)
        state, letters = 0, ""
        for letter, state in t.trace(symbols, t.end, 0):
            letters += letter
        letters += "".join(x for x, _ in t.finish(state))
        assert (total + t.vectors[found[0]][0], letters) == (cost, audit)
        # the matrix of a run composes with what follows
        cut = rng.randrange(len(symbols) + 1)
        behind, more = t.behind(symbols[cut:], t.end)
        m, v = t.matrix(symbols[:cut]), t.vectors[behind[0]]
        assert min(m[j] + v[j] for j in range(4)) + more == cost


def talk(rng, c, n):
    out = []
    for k in range(n):
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
        text = rng.choice(["One.", "Two?", "no end", "", " \t", None, f"Row {rng.randrange(40)}!", "x. \n"])
        out.append((c, rng.choice([None, k, k, k, 3 * k]), role, text))
    return out


@pytest.mark.parametrize("chunk", [4096, 3])
def test_repair_of_damaged_rows(spark, chunk):
    from strata.llm.conversations import damage
    rng = random.Random(chunk)
    rows = [r for c in range(60) for r in talk(rng, c, rng.randrange(1, 9))] + talk(rng, None, 5) + talk(rng, 777, 120)
    turns = {}                                    # one row a turn: rows of one turn have no order in the search
    rows = [r for r in rows if turns.setdefault((r[0], r[1]), r) is r]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, c int, kind string")
    damaged, left = damage(frame.repartition(5))
    assert result(repair(damaged, copies=left, chunk=chunk)) == brute(plain_damage(rows), {r[0] for r in rows})


def test_repair_without_damage(spark):
    schema = "conv_id string, turn int, role string, text string"
    rows = [("a", 1, "user", "Hi."), ("a", 1, "user", "Hi."), ("a", 9, "assistant", "Yes!"), ("b", None, None, None),
            ("c", 1, "assistant", "first?"), ("c", 2, "user", "né" * 70000 + ".")]
    frame = spark.createDataFrame(rows, schema)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert result(repair(frame)) == brute(plain, {"a", "b", "c"})
    assert result(repair(frame, insert=1, delete=9)) == brute(plain, {"a", "b", "c"}, insert=1, delete=9)
    assert result(repair(frame.limit(0))) == []
    named = repair(frame.withColumnsRenamed({"conv_id": "x"}), conv="x")
    assert named.columns[0] == "x"


def test_one_conversation_over_all_tasks(spark):
    rng = random.Random(9)
    rows = [(1, k, rng.choice(["user", "assistant"]), rng.choice(["One.", f"Number {k}.", "cut"])) for k in range(4000)]
    frame = spark.createDataFrame(rows + [(2, 0, "user", "a."), (0, 0, "user", "b.")], "conv_id int, turn int, role string, text string")
    got = {r.conv_id: r for r in repair(frame.repartition(7), chunk=100).collect()}
    marks = faults([r[2:] for r in rows])
    t = Tables()
    from strata.llm.conversations import Writer, symbol
    code = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
    symbols = [(symbol(r[2][:1], code[m]), r[2], "" if m == "duplicate" else r[3]) for r, m in zip(rows, marks)]
    w = Writer()
    w.run(t, symbols, t.end)
    assert (got[1].audit, got[1].repaired_sha256) == w.close(t)
    assert got[1].duplicate == marks.count("duplicate") and got[2].audit == got[0].audit


def test_op12(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op12_conversation_repair"](spark, SF)) == brute(plain_damage(rows), {r[0] for r in rows})
