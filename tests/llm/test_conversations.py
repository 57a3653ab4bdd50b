"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from cartlight.llm import conversation_repair as module
from cartlight.llm.conversation_repair import conversation_repairs, damage, repaired_messages

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, cost int, present string, later int, place string"
LEGAL = re.compile("(s?(ua)+)?")


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "p", 2, "x") for r in rows], SCHEMA)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def cheapest(rows):
    """The least (cost, audit) by trying edits in order of cost, and its lines. Rows: (role, text, gone, cut)."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, roles, lines = heapq.heappop(queue)
        if at == len(rows) and LEGAL.fullmatch(roles):
            return cost, audit, "\n".join(lines)
        state = (at, roles if len(roles) < 2 else roles[-1] + "+")
        if (state, cost, audit) in done or cost > 3 * len(rows) + 4:
            continue
        done.add((state, cost, audit))
        options = [("I", 2, 0, r, f"{r}:") for r in ("user", "assistant")]
        if at < len(rows):
            role, text, gone, cut = rows[at]
            options.append(("D", 3, 1, None, None))
            if not gone:
                options += [("K", cut, 1, role, f"{role}:{text}")]
                options += [("R", 2 + cut, 1, r, f"{r}:{text}") for r in ("user", "assistant")]
        for edit, price, used, role, line in options:
            after = roles if role is None else roles + (role[:1] or "?")
            if LEGAL.fullmatch(after) or LEGAL.fullmatch(after + "a") or LEGAL.fullmatch(after + "ua"):
                heapq.heappush(queue, (cost + price, audit + edit, at + used, after, lines if line is None else (*lines, line)))
    raise AssertionError


def expected(rows, ids):
    talks = defaultdict(list)
    for r in rows:
        talks[r[0]].append(r)
    out = {}
    for conv in ids:
        talk = sorted(talks[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[1] for r in talk if r[1] is not None]
        seen, judged, counts = set(), [], [0, 0, 0]
        for _, _, role, text in talk:
            shown = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            judged.append((role, text, fault in (0, 1), int(fault == 2)))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))
        cost, audit, lines = cheapest(judged)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def random_rows(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", "  \n", "Ünder é?", None, "Yes. ", "a.b"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "support", "agent"]
    weights = [8, 8, 2, 1, 1, 1, 1, 1, 1]
    rows = []
    for conv in range(n):
        for _ in range(rng.randint(1, 7)):
            turn = rng.choice([None, *range(9)])
            rows.append((rng.choice([conv, conv, conv, None]) if conv < 2 else conv, turn, rng.choices(roles, weights)[0],
                         rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}."))
    return rows


def repairs(frame, **more):
    got = conversation_repairs(frame, **more).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r)[1:] for r in got}


@pytest.mark.parametrize("held", [8 << 20, 10])
def test_same_as_trying_all_edits(spark, monkeypatch, held):
    monkeypatch.setattr(module, "_HELD", held)
    rows = random_rows(held, 120)
    frame = damage(table(spark, rows).repartition(3))
    got = repairs(frame, present=frame["present"])
    assert got == expected(damaged(rows), {r[0] for r in rows})
    assert {"D", "I", "K", "R"} <= set("".join(r[6] for r in got.values()))


def test_damage(spark):
    rows = [(k, t, r, f"{r} says. Is it? It is!") for k in range(60) for t, r in enumerate(["system", "user", "assistant"])]
    rows += [(None, None, None, None), (5, None, "user", "x."), (5, 1 << 40, None, "y")]
    frame = damage(table(spark, rows))
    kept = sorted((tuple(r)[:4] for r in frame.filter("present").collect()), key=repr)
    assert kept == sorted(damaged(rows), key=repr) and frame.filter("not present").count() > 0


def test_a_conversation_of_dropped_rows(spark):
    rows = [(k, 0, "user", "hi.") for k in range(200)]
    frame = damage(table(spark, rows))
    got = repairs(frame, present=frame["present"])
    gone = [k for k in range(200) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    assert gone and len(got) == 200
    assert all(got[k] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in gone)


def test_long_conversations_across_batches(spark, monkeypatch):
    monkeypatch.setattr(module, "_HELD", 3000)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(9001)]
    rows += [(2, t, "user", "same words.") for t in range(4000)]
    rows += [(3, None, "user", "a?"), (3, -(1 << 62), "assistant", "b!"), (3, (1 << 63) - 1, "user", "c")]
    got = repairs(table(spark, rows))
    assert got[1][:6] == (0, 0, 0, 0, 0, 2) and got[1][6] == "K" * 9001 + "I"
    lines = "\n".join(f"{r[2]}:{r[3]}" for r in rows[:9001]) + "\nassistant:"
    assert got[1][7] == hashlib.sha256(lines.encode()).hexdigest()
    assert got[2][:7] == (0, 0, 3999, 0, 3999, 3999 * 3 + 2, "K" + "D" * 3999 + "I")
    assert got[3][:7] == ((1 << 63) - 1, 0, 0, 1, 0, 3, "KKD")


def test_repaired_messages(spark):
    rows = [(7, 2, "user", "b."), (7, 1, "system", "a."), (7, 3, "user", "c"), (7, 4, "assistant", " "), (None, 1, "tool", "x.")]
    frame = table(spark, rows)
    done = sorted((tuple(r) for r in repaired_messages(frame).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    audits = repairs(frame)
    assert "".join(r[2] for r in done if r[0] == 7) == audits[7][6]
    text = "\n".join(f"{r[4]}:{r[5]}" for r in done if r[0] == 7 and r[2] != "D")
    assert hashlib.sha256(text.encode()).hexdigest() == audits[7][7]
    assert [r[1] for r in done if r[0] == 7] == list(range(len(audits[7][6])))
    assert all(r[5] is None for r in done if r[2] == "D") and all(r[3] is None for r in done if r[2] == "I")
    assert audits == expected(rows, {7, None})


def test_nothing_to_repair(spark):
    assert repairs(table(spark, [])) == {} and repaired_messages(table(spark, [])).collect() == []
