"""Conversation repair against an exhaustive search, and linked audits against plain strings."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from stintwise.llm import conversations as own
from stintwise.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            out.append((conv, None))
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        out += [(conv, (turn, role, text))] * (2 if fault == 3 else 1)
    return out


def by_hand(rows):
    """Every state's cheapest and least audit as a plain string, with the repaired rows beside it."""
    conversations = defaultdict(list)
    for conv, row in damaged(rows):
        conversations[conv] += [row] if row else []
    want = []
    for conv, turns in conversations.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha256(r[2].encode()).digest()))
        seen, counts, faults = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in turns:
            fault = None
            if not text.strip(SPACES):
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif text.rstrip(SPACES)[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            faults.append(fault)
            if fault:
                counts[fault] += 1
        initials = [r[1][:1] for r in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        numbers = [r[0] for r in turns if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        best = {"": (0, "", ())}

        def inserts(best):
            for _ in range(3):
                for state, (cost, audit, made) in list(best.items()):
                    for role in FOLLOWS[state]:
                        if role != "s":
                            name = {"u": "user", "a": "assistant"}[role]
                            new = (cost + 2, audit + "I", made + (f"{name}:",))
                            best[role] = min(best.get(role, new), new)
            return best

        best = inserts(best)
        for (_, role, text), fault in zip(turns, faults):
            after = {}
            for state, (cost, audit, made) in best.items():
                options = [(state, cost + 3, "D", ())]
                if fault not in ("blank", "duplicate"):
                    extra = fault == "truncated"
                    for follow in FOLLOWS[state]:
                        if role[:1] == follow:
                            options.append((follow, cost + extra, "K", (f"{role}:{text}",)))
                        if follow != "s":
                            name = {"u": "user", "a": "assistant"}[follow]
                            options.append((follow, cost + 2 + extra, "R", (f"{name}:{text}",)))
                for to, price, edit, row in options:
                    new = (price, audit + edit, made + row)
                    after[to] = min(after.get(to, new), new)
            best = inserts(after)
        cost, audit, made = min(best[s] for s in ("", "a") if s in best) if turns else (0, "", ())
        want.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
                     sha256("\n".join(made).encode()).hexdigest()))
    return sorted(want, key=repr)


def random_rows(rng, conversations, longest):
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            text = rng.choice(["a.", "b!", "c?", "d", "e. \n", " \t", "", None, "f", "g.", "long text. " * 3, f"t{rng.random()}."])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn + 2, None]),
                         rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "sys"]), text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("chosen", [{}, {"chunk_rows": 3, "partition_rows": 20}, {"chunk_rows": 1, "partition_rows": 9}])
def test_digests_equal_brute_force(spark, chosen):
    rows = random_rows(random.Random(5), 60, 14)
    rows += rows[:7] * 3
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"copies": F.lit(7), "chunk": F.lit("x"), "digest": F.lit(1)}).repartition(5)
    got = own.digests(own.damaged(df), **chosen)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand(rows)


def test_one_conversation_has_most_rows(spark):
    rng = random.Random(8)
    rows = [(7, k, rng.choice(["user", "assistant"]), rng.choice(["x.", "y", f"z{k}.", f"w{k}"])) for k in range(700)]
    rows += random_rows(rng, 10, 5)
    got = own.digests(own.damaged(spark.createDataFrame(rows, SCHEMA)), chunk_rows=16, partition_rows=50)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand(rows)


def test_a_row_repeated_very_often(spark):
    rows = [(1, 3, "user", "same.")] * 300 + [(1, 4, "assistant", "other.")]
    got = own.digests(own.damaged(spark.createDataFrame(rows, SCHEMA)), chunk_rows=2)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand(rows)


def test_empty_and_registered(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert own.digests(own.damaged(none)).count() == 0 and own.repaired(own.undamaged(none)).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_conversation_repair"](spark, SMALL).collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_hand(rows)


def test_repaired_rows_have_the_structure(spark):
    rows = random_rows(random.Random(2), 25, 9)
    made = own.repaired(own.damaged(spark.createDataFrame(rows, SCHEMA)), chunk_rows=4).orderBy("conv_id", "place").collect()
    want = {w[0]: w for w in by_hand(rows)}
    for conv, group in groupby(made, key=lambda r: r.conv_id):
        group = list(group)
        roles = "".join(r.role[:1] for r in group)
        assert roles.lstrip("s").replace("ua", "") == "" and roles.count("s") <= 1
        assert [r.place for r in group] == list(range(len(group)))
        assert sha256("\n".join(f"{r.role}:{r.text}" for r in group).encode()).hexdigest() == want[conv][-1]


@pytest.mark.parametrize("modulus", [own.MODULUS, 7, 1])
def test_linked_audits_compare_as_strings(monkeypatch, modulus):
    """Also where the rolling hash collides all the time."""
    monkeypatch.setattr(own, "MODULUS", modulus)
    rng = random.Random(modulus)
    nodes = [(own.Node(None, ""), "")]
    for _ in range(600):
        node, text = rng.choice(nodes[-40:])
        piece = "".join(rng.choice("DIK") for _ in range(rng.choice([1, 1, 1, 2, 3])))
        nodes.append((own.Node(node, piece), text + piece))
    for _ in range(4000):
        (a, x), (b, y) = rng.choice(nodes), rng.choice(nodes)
        assert a.after(0) == x and own.before(a, b) == (x < y)
