"""Conversation repair against the cheapest of all edit strings, on conversations of one stretch and of many."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import conversation_repair as C

WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired) by a search over (cost, audit) in order; rows: (role, text, must go, cut)."""
    seen, heap = set(), [(0, "", 0, "")]
    kept = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    other = {"": "u", "s": "u", "u": "a", "a": "u"}
    while True:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(rows) and last in ("", "a"):
            break
        heapq.heappush(heap, (cost + 2, audit + "I", i, other[last]))
        if i < len(rows):
            role, _, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last))
            if not gone:
                if (last, role[:1]) in kept:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, kept[last, role[:1]]))
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, other[last]))
    out, i, last = [], 0, ""
    names = {"u": "user", "a": "assistant"}
    for letter in audit:
        if letter in "IR":
            last = other[last]
            out.append((names[last], "" if letter == "I" else rows[i][1]))
        elif letter == "K":
            last = rows[i][0][:1]
            out.append(rows[i][:2])
        i += letter != "I"
    return cost, audit, out


def brute(table):
    by = defaultdict(list)
    for conv, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
        by[conv] += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = []
    for conv in by:
        rows = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen, marked = [], set(), []
        for _, role, text in rows:
            bare = text.rstrip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for t, _, _ in rows if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        cost, audit, repaired = cheapest(marked)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest))
    return sorted(out, key=str)


def made(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "and so on", "", " \n", "Why?", "é…", "x. \t", "y", None, "a. "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sage", "ünder"]
    out = []
    for c in range(convs):
        for t in range(rng.randrange(most)):
            text = rng.choice(texts) if rng.random() < 0.4 else f"Text {rng.randrange(10**6)}" + rng.choice([".", ".", ""])
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            out.append((c if c else None, rng.choice([t, t, t, t * 3, None]) if rng.random() < 0.3 else t, role, text))
    return out


@pytest.mark.parametrize("block", [512, 3])
def test_against_search(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    table = made(block, 150, 14)
    # turns of one conversation that are all dropped
    table += [(1000, t, "user", "Gone.") for t in range(200) if zlib.crc32(f"1000:{t}".encode()) % 20 == 0][:2]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit("k"), "block": F.lit(1), "cost": F.lit("c")})
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in C.op12_conversation_repair(spark, str(tmp_path)).collect()), key=str)
    expected = brute(table)
    assert len(got) == len({r[0] for r in table}) == len(expected)
    assert got == expected
    assert (1000, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got


def test_one_long_conversation(spark, tmp_path, monkeypatch):
    """A conversation of most rows is cut into many stretches in several tasks, with the same result."""
    monkeypatch.setattr(C, "BLOCK", 16)
    table = [(7, t, r, x) for _, t, r, x in made(3, 300, 12)] + made(4, 20, 6) + [(7, 3, "user", "Same row.")] * 400
    spark.createDataFrame(table, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = C.damaged(spark.read.parquet(f"{tmp_path}/conversations.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = C.stretches(rows).where("key = '7'").groupBy(F.spark_partition_id()).agg(F.sum(F.size("kinds"))).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 3 and max(p[1] for p in parts) < 0.6 * sum(p[1] for p in parts)
    got = sorted((tuple(r) for r in C.op12_conversation_repair(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(table)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert C.op12_conversation_repair(spark, str(tmp_path)).count() == 0
