"""Structure repair against a plain search over whole conversations."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from shopmetrics.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, pos long, n string, kind int, block long"
GOOD = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def search(turns):
    """Cheapest, then ASCII-least edits by Dijkstra over (turns done, roles so far modulo pairs)."""
    seen, faults = set(), []
    for role, text in turns:
        core = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = None if core else "blank"
        if not fault and (role, text) in seen:
            fault = "duplicate"
        if not fault and core[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        faults.append(fault)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, roles, lines = heapq.heappop(heap)
        if (k, roles) in done:
            continue
        done.add((k, roles))
        if k == len(turns) and GOOD.fullmatch(roles):
            return faults, cost, audit, lines

        def push(extra, letter, step, initial, line):
            text = roles + initial
            if any(GOOD.fullmatch(text + more) for more in ("", "a", "ua")):
                while text.endswith("uaua"):  # what went before the last pairs doesn't matter
                    text = text[:-2]
                heapq.heappush(heap, (cost + extra, audit + letter, k + step, text, lines + ((line,) if line is not None else ())))

        if len(roles) < 6:
            for name in ("user", "assistant"):
                push(3, "I", 0, name[0], f"{name}:")
        if k < len(turns):
            role, text = turns[k]
            push(4, "D", 1, "", None)
            if faults[k] not in ("blank", "duplicate"):
                more = 3 if faults[k] == "truncated" else 0
                if role:
                    push(more, "K", 1, role[0], f"{role}:{text}")
                for name in ("user", "assistant"):
                    push(3 + more, "R", 1, name[0], f"{name}:{text}")


def brute(conversations, rows):
    out = {}
    for conv in {r[0] for r in conversations}:
        turns = [r for r in rows if r[0] == conv]
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        numbers = [r[1] for r in turns if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        pairs = [(a[2][:1] + b[2][:1]) for a, b in zip(turns, turns[1:], strict=False)]
        faults, cost, audit, lines = search([r[2:] for r in turns])
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return out


def reported(spark, conversations, rows):
    df = lambda x: spark.createDataFrame([(*r, 7, "n", 1, 2) for r in x], SCHEMA).repartition(3)
    got = repair.report(df(conversations), df(rows)).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


def conversations_of(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(60), None]:
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13, 30])):
            turn = rng.choice([None, *range(12)])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "svc", "été"])
            text = rng.choice(["Hi.", "Hi.", "so", "ok!\n", "", " \t\n", None, "wait... ", "a?  ", "no. end", "x" * 30, "é."])
            rows.append((conv, turn, role, text))
    return rows


def test_equals_search(spark):
    for seed in (1, 2):
        rows = conversations_of(seed)
        spaced = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
        assert reported(spark, rows, spaced) == brute(rows, spaced)


def test_damage(spark):
    rows = [(c, t, r, x) for c in (1, 2, 77, None) for t in [None, *range(40)] for r, x in [("user", f"What? {t}."), (None, None)]]
    df = spark.createDataFrame([(*r, 7, "n", 1, 2) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in repair.damaged(df).collect()), key=str)
    assert got == sorted(damage(rows), key=str)


def test_all_turns_dropped_and_empty_tables(spark):
    rows = conversations_of(3)
    some = [(c, t, r or " ", x or " ") for c, t, r, x in rows if c is not None and c % 2]
    got = reported(spark, rows, some)
    assert got == brute(rows, some)
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got.values()
    assert reported(spark, [], []) == {}


def test_long_conversation_in_blocks(spark):
    rng = random.Random(9)
    roles = ["user", "assistant"] * 700
    rows = [(5, k, rng.choice(["user", "system", r, r, r]), rng.choice(["Yes.", f"{k}.", f"{k}"])) for k, r in enumerate(roles)]
    got = reported(spark, rows, rows)[5]
    kinds = [repair.block_table("u")]  # a block's table is the product of its turns'
    assert len(kinds[0]) == 16
    turns = [r[2:] for r in rows]
    assert got == brute_linear(rows, turns)


def brute_linear(rows, turns):
    """Costs of all states for every turn at once, instead of checkpoints."""
    faults, seen = [], set()
    for role, text in turns:
        faults.append("duplicate" if (role, text) in seen else "truncated" if text[-1] not in ".!?" else None)
        seen.add((role, text))
    kinds = ["d" if f == "duplicate" else r[0].upper() if f else r[0] for (r, _), f in zip(turns, faults, strict=True)]
    edits, roles, _, _ = repair.block_edits("".join(kinds), repair.final_vector(), True)[0]
    vector = repair.final_vector()
    for kind in reversed(kinds):
        vector = repair._step(kind, vector)[0]
    lines, k = [], 0
    for letter, role in zip(edits, roles, strict=True):
        name = repair.ROLES.get(role)
        if letter == "I":
            lines.append(f"{name}:")
            continue
        if letter != "D":
            lines.append(f"{name or turns[k][0]}:{turns[k][1]}")
        k += 1
    pairs = [a[0][0] + b[0][0] for a, b in zip(turns, turns[1:], strict=False)]
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return (0, *counts, illegal, vector[0], edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.mark.parametrize("seed", range(3))
def test_tables_compose(seed):
    rng = random.Random(seed)
    kinds = "".join(rng.choice("suaxdSUAX") for _ in range(20))
    vector = repair.final_vector()
    for kind in reversed(kinds):
        vector = repair._step(kind, vector)[0]
    tables = [repair.block_table(kinds[k : k + 3]) for k in range(0, 20, 3)]
    assert repair.checkpoints(tables)[0] == vector
