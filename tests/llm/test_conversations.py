import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from tablescribe.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, fault int, copies string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        role, text, how = s(role), s(text), zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def cheapest(rows, faults):
    """Every way of editing, as a search over (turns passed, initials so far); returns cost, audit, repaired lines."""

    @lru_cache(maxsize=None)
    def best(i, made):
        ways = []
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", made):
                ways.append((0, "", ()))
        else:
            (_, role, text), fault = rows[i], faults[i]
            cost, audit, lines = best(i + 1, made)
            ways.append((cost + 4, "D" + audit, lines))
            if fault not in (1, 2):
                for price, edit, name in ((0, "K", role), (3, "R", "user"), (3, "R", "assistant")):
                    if name and possible(made + name[:1]):  # a role without an initial can't stay
                        cost, audit, lines = best(i + 1, made + name[:1])
                        ways.append((cost + price + 3 * (fault == 3), edit + audit, (f"{name}:{text}", *lines)))
        if len(made) < 2 * len(rows) + 3:
            for name in ("user", "assistant"):
                if possible(made + name[:1]):
                    cost, audit, lines = best(i, made + name[:1])
                    ways.append((cost + 3, "I" + audit, (f"{name}:", *lines)))
        return min(ways, key=lambda w: w[:2], default=(10**6, "", ()))

    def possible(made):
        return any(re.fullmatch("(s?(ua)+)?", made + rest) for rest in ("", "a", "ua"))

    return best(0, "")


def expected(rows):
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    out = {}
    for conv, own in by_conv.items():
        left = damage(own)
        seen, faults = set(), []
        for _, role, text in left:
            solid = text.rstrip(" \t\n\v\f\r")
            faults.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = [t for t, *_ in left if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:]))
        cost, audit, lines = cheapest(left, faults)
        out[conv] = (gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.fixture(scope="module")
def turns():
    r = random.Random(11)
    texts = ["Hello.", "Why?", "Because!", "no end", "", " \t\n", None, "A. B", "Good.  \n", "é."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "sysop", ""]
    rows = []
    for conv in range(400):
        style = r.random()
        n = r.randint(1, 7)
        for k in range(n):
            turn = None if r.random() < 0.05 else k + (r.random() < 0.2) * r.randint(0, 4)
            role = ("user", "assistant")[k % 2] if style < 0.5 and r.random() < 0.8 else r.choice(roles)
            rows.append((conv if conv else None, turn, role, r.choice(texts) if style < 0.3 else f"{r.choice(texts)} {r.randint(0, 9)}."))
    rows += [(1000, 1, "user", "same."), (1000, 1, "user", "same."), (1000, None, "user", "same."), (9007199254740993, 1, "user", "Hi.")]
    return rows


def test_repair_against_all_ways(spark, turns):
    assert result(conversations.repair(spark.createDataFrame([(*t, 7, "x") for t in turns], SCHEMA))) == expected(turns)


def test_no_rows_and_nothing_left(spark):
    assert conversations.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next((c, 0) for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = result(conversations.repair(spark.createDataFrame([(*gone, "user", "Hi.", 1, "x")], SCHEMA)))
    assert got == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_long_conversations_keep_little():
    """The states' edits are settled on the way; the result is that of the same turns in one go."""
    r = random.Random(3)
    program, rows, faults = conversations.Repair(), [], []
    for k in range(5000):
        role, fault = r.choice(["user", "assistant", "assistant", "user", "system"]), r.choice([0, 0, 0, 0, 1, 2, 3])
        program.add(k, role, f"turn {k}.", 1, fault)
        rows.append((k, role, f"turn {k}."))
        faults.append(fault)
        assert sum(len(s[1]) for s in program.states.values()) < 2000
    *_, cost, audit, digest = program.row()
    whole = conversations.Repair()
    whole._settle = lambda: None
    for (turn, role, text), fault in zip(rows, faults):
        whole.add(turn, role, text, 1, fault)
    assert whole.row()[-3:] == (cost, audit, digest)
    lines, made = [], ""
    at = iter(zip(rows, faults))
    price = 0
    for k, edit in enumerate(audit):  # the audit says how the conversation was repaired
        if edit == "I":
            made += "u" if not made or made[-1] in "sa" else "a"
            lines.append({"u": "user:", "a": "assistant:"}[made[-1]])
            price += 3
            continue
        (_, role, text), fault = next(at)
        if edit == "D":
            price += 4
            continue
        assert fault in (0, 3)
        made += role[0] if edit == "K" else "u" if not made or made[-1] in "sa" else "a"
        lines.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[made[-1]]}:{text}")
        price += 3 * (edit == "R") + 3 * (fault == 3)
    assert re.fullmatch("s?(ua)+", made) and price == cost and digest == hashlib.sha256("\n".join(lines).encode()).hexdigest()
