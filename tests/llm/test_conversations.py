"""Conversation repair against a search over edits, by cost and then by audit."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from lectern.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, place long, own string, segment long, _kind int"


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        r, x = (" " if v is None else v for v in (r, x))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    return out


def order(row):
    t, r, x = row
    return (t is not None, t or 0, r, x[:64], hashlib.sha256(x.encode()).digest())


def searched(rows):
    rows = sorted(rows, key=order)
    faults, seen = [], set()
    for _, r, x in rows:
        bare = x.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (r, x) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen |= {(r, x)} if bare else set()
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    first = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    heap, done = [(0, "", 0, "e", ())], set()
    while True:
        cost, audit, k, state, lines = heapq.heappop(heap)
        if k == len(rows) and state in "ea":
            return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, "\n".join(lines))
        if (k, state) in done:
            continue
        done.add((k, state))
        turn = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[turn]
        heapq.heappush(heap, (cost + 3, audit + "I", k, turn, (*lines, name + ":")))
        if k == len(rows):
            continue
        _, r, x = rows[k]
        heapq.heappush(heap, (cost + 4, audit + "D", k + 1, state, lines))
        if faults[k] not in ("blank", "duplicate"):
            late = 3 if faults[k] else 0
            heapq.heappush(heap, (cost + late + 3, audit + "R", k + 1, turn, (*lines, f"{name}:{x}")))
            if r[:1] == turn or (r[:1] == "s" and state == "e"):
                heapq.heappush(heap, (cost + late, audit + "K", k + 1, r[:1], (*lines, f"{r}:{x}")))


def made(seed, n=40, most=14):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(n)]:
        for t in range(rng.randrange(1, most)):
            turn = rng.choice([None, t, t, t, max(0, t - 1), t + 3])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No!", "why", "", " \t\n", None, "a. ", "x\x0b\x0c", "\x1f", "é?", f"w{rng.random()}.", f"w{rng.random()}", "long " * 40 + "end.", "long " * 40 + "and."])
            rows.append((c, turn, role, text))
    rng.shuffle(rows)
    return rows


def grouped(rows):
    by = defaultdict(list)
    for c, *row in rows:
        by[c].append(tuple(row))
    return by


@pytest.mark.parametrize("bits", [0, 1, 8])
def test_same_as_search(spark, monkeypatch, bits):
    monkeypatch.setattr(C, "SEGMENT_BITS", bits)
    rows = made(3)
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(5)
    found = {r.conv_id: tuple(r)[1:] for r in C.repair(df).collect()}
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert found == {c: searched(own) for c, own in grouped(clean).items()}


def test_a_hot_conversation(spark, monkeypatch):
    """One conversation that has most rows, some of them alike, over many segments and partitions."""
    monkeypatch.setattr(C, "SEGMENT_BITS", 4)
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice([f"{t}.", "Same.", f"{t}", ""])) for t in range(900)]
    rows += [(1, None, "user", "Same.")] * 50 + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    found = {r.conv_id: tuple(r)[1:] for r in C.repair(df).collect()}
    assert found == {c: searched(own) for c, own in grouped(rows).items()}


def test_damage(spark):
    rows = made(5)
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)
    found = sorted(map(repr, map(tuple, C.damage(df).collect())))
    assert found == sorted(map(repr, damaged(rows)))


def test_query_keeps_every_conversation(spark, tmp_path):
    """Also one whose rows are all dropped, and one without rows."""
    lost = [(c, t) for c in range(1000, 1400) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    rows = made(9) + [(c, t, "user", "Hi.") for c, t in lost]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: tuple(r)[1:] for r in C._query(spark, str(tmp_path)).collect()}
    by = grouped(damaged(rows))
    want = {}
    for c in {r[0] for r in rows}:
        *figures, text = searched(by[c]) if c in by else (0, 0, 0, 0, 0, 0, "", "")
        want[c] = (*figures, hashlib.sha256(text.encode()).hexdigest())
    assert found == want and all(found[c][:7] == (0, 0, 0, 0, 0, 0, "") for c, _ in lost)


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert C.repair(C.damage(df)).count() == 0
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert C._query(spark, str(tmp_path)).count() == 0


def test_a_very_long_text(spark):
    text = "word " * 400_000 + "end"
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text + ".")], "conv_id long, turn long, role string, text string")
    assert tuple(C.repair(df).first())[1:] == searched([(0, "user", text), (1, "assistant", text + ".")])
