"""Conversation repair against a search over all edits, from the last row back."""

import hashlib
import random
import zlib
from functools import cache

from shelfwise.llm import conversations, queries
from shelfwise.llm.common import table
from tests.conftest import SMALL

SPACE = " \t\n\x0b\x0c\r"
AFTER = {"": "su", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, repaired roles) of rows (role, must go, penalty if kept)."""

    @cache
    def rest(i, state, added):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if added < 3:
            for role in AFTER[state].replace("s", ""):
                cost, audit, kept = rest(i, role, added + 1)
                found.append((cost + 3, "I" + audit, ((NAMES[role], None), *kept)))
        if i < len(rows):
            role, gone, penalty = rows[i]
            cost, audit, kept = rest(i + 1, state, 0)
            found.append((cost + 4, "D" + audit, kept))
            if not gone:
                if role[:1] and role[:1] in AFTER[state]:
                    cost, audit, kept = rest(i + 1, role[:1], 0)
                    found.append((cost + penalty, "K" + audit, ((role, i), *kept)))
                for new in AFTER[state].replace("s", ""):
                    cost, audit, kept = rest(i + 1, new, 0)
                    found.append((cost + penalty + 3, "R" + audit, ((NAMES[new], i), *kept)))
        return min(found, default=(10**9, "", ()))

    return rest(0, "", 0)


def plain_report(conv, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, kept = cheapest(tuple((r[1], f in ("blank", "duplicate"), 3 * (f == "truncated")) for r, f in zip(rows, faults)))
    text = "\n".join(f"{role}:{'' if i is None else rows[i][2]}" for role, i in kept)
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def one_space(value):
    return " " if value is None else str(value)


def plain(rows):
    by_conv = {}
    for conv, turn, role, text in rows:
        kept = by_conv.setdefault(conv, [])
        role, text = one_space(role), one_space(text)
        kind = zlib.crc32(f"{one_space(conv)}:{one_space(turn)}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted((plain_report(c, kept) for c, kept in by_conv.items()), key=str)


def drawn(draw, n):
    roles = ["system", "user", "assistant", "tool", " ", ""]
    return [(draw.choices(roles, (2, 5, 5, 1, 1, 1))[0], draw.choices((0, 1, 2, 3), (6, 1, 1, 2))[0]) for _ in range(n)]


def test_blocks_of_any_size_give_the_cheapest_least_audit():
    draw = random.Random(12)
    for n in [0, 1, 2, 3, *range(200)]:
        rows = drawn(draw, n % 17)
        want = cheapest(tuple((role, fault in (1, 2), 3 * (fault == 3)) for role, fault in rows))
        for size in (1, 2, 5, 100):
            chain = conversations.Chain()
            for at in range(0, len(rows), size):
                chain.add(conversations.block_audits([(role[:1], fault) for role, fault in rows[at : at + size]]))
            assert chain.finish() == want[:2], rows


def test_prefixes_compare_like_strings_and_survive_equal_hashes(monkeypatch):
    draw = random.Random(5)
    for modulus in ((1 << 61) - 1, 3):  # with the second nearly all hashes collide
        monkeypatch.setattr(conversations, "_MOD", modulus)
        held = conversations.Prefixes()
        nodes = [0]
        for _ in range(400):
            nodes.append(held.add(draw.choice(nodes), draw.choice("DIK")))
        strings = {node: held.text(node) for node in nodes}
        assert len(set(strings.values())) == len(strings)
        for _ in range(2_000):
            a, b = draw.choice(nodes), draw.choice(nodes)
            assert held.less(a, b) == (strings[a] < strings[b])


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, queries.op12_conversation_repair(spark, SMALL).collect()), key=str)
    assert got == plain(rows)
    assert any(r[6] for r in got)


def odd_rows():
    draw = random.Random(3)
    texts = ["Yes.", "No!", "cut", "", " \n", None, "What? \t\r\n", "é.", "end.\x1c"]
    rows = [(c, draw.choice([0, 1, 2, 3, 5, 9, None]), draw.choice(["system", "user", "assistant", None, "tool"]), draw.choice(texts)) for c in range(60) for _ in range(draw.randrange(1, 9))]
    rows += [(None, t, "user", "a." * t) for t in range(4)] + [(77, None, None, None)] * 3
    return rows + [(99, t, ("user", "assistant")[t % 2], f"row {t // 3}." * (1 + 5_000 * (t == 7))) for t in range(40)]


def test_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, place int")
    assert sorted(map(tuple, conversations.digests(df).collect()), key=str) == plain(rows)
    small = conversations.diagnose(conversations.damaged(df), block=2).collect()
    want = {r[0]: r[1:8] for r in plain(rows)}
    assert {r.conv_id: tuple(r)[1:] for r in small}.items() <= want.items()
    assert conversations.digests(df.limit(0)).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Well?"), (1, 2, "user", "Well?"), (1, 3, "assistant", "Good.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    reports, kept = conversations.repair(df)
    assert reports.first().audit == "IKKDK" and reports.first().cost == 7
    got = [(r.place, r.role, r.text, r.edit) for r in kept.orderBy("place").collect()]
    assert got == [(0, "user", "", "I"), (1, "assistant", "Hello.", "K"), (2, "user", "Well?", "K"), (3, "assistant", "Good.", "K")]
