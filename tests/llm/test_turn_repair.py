"""Conversation repair against a brute force over all rows of a conversation at once."""

import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from terseframe.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, kind string, place long"
BLANK = " \t\n\v\f\r"


def brute_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(key.encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        out[conv] += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    for conv in out:
        out[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    return out


def brute_path(rows, faults):
    """(cost, audit, repaired lines), least in that order, over all edits."""

    def follow(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    @lru_cache(None)
    def best(i, state, written):
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if written < 2:
            for name in ("user", "assistant"):
                if to := follow(state, name[0]):
                    c, a, lines = best(i, to, written + 1)
                    options.append((c + 3, "I" + a, (name + ":",) + lines))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, lines = best(i + 1, state, 0)
            options.append((c + 4, "D" + a, lines))
            if faults[i] not in ("blank", "duplicate"):
                dirt = 3 * (faults[i] == "truncated")
                for letter, name, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if to := follow(state, name[:1]):
                        c, a, lines = best(i + 1, to, 0)
                        options.append((c + price + dirt, letter + a, (f"{name}:{text}",) + lines))
        return min(options, key=lambda o: o[:2], default=(10**9, "", ()))

    sys.setrecursionlimit(20_000)
    return best(0, "", 0)


def brute(rows):
    out = {}
    for conv, kept in brute_damage(rows).items():
        seen, faults = set(), []
        for _, role, text in kept:
            solid = text.strip(BLANK)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, lines = brute_path(kept, faults)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def random_rows(seed, convs, longest):
    rnd = random.Random(seed)
    texts = ["Good day.", "Why?", "no end", "", " \t", None, "Done! ", "x\nWell.\n", "ünï?", " ", "a" * 300 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "admin", "superuser", "User"]
    rows = []
    for conv in [None, *range(convs)]:
        for i in range(rnd.randrange(1, longest)):
            rows.append((conv, rnd.choice([i, i, i, i + 3, None, 10**15]), rnd.choice(roles[: rnd.choice([3, 11])]), rnd.choice(texts + [f"Text {i}."] * 8)))
    return rows + rows[:7]


@pytest.mark.parametrize("block", [1024, 3])
def test_against_brute_force(spark, block):
    rows = random_rows(3, 150, 14)
    df = spark.createDataFrame([(*r, "k", 5) for r in rows], SCHEMA)
    assert got(turn_repair.repair(df, block)) == brute(rows)


def test_one_long_conversation(spark):
    rnd = random.Random(8)
    rows = [(7, i, rnd.choice(["user", "assistant", "assistant", "system"]), rnd.choice(["Well.", "no end", "", f"Line {i}."])) for i in range(400)]
    df = spark.createDataFrame([(*r, "k", 5) for r in rows], SCHEMA)
    assert got(turn_repair.repair(df, 16)) == brute(rows)


def test_ranks_order_nodes_by_their_audits():
    kinds = ["ABCAB", "MBNCAEIB", "B", "AAAA"]
    paths = turn_repair.Paths(kinds, turn_repair.np.tile(turn_repair.END, (4, 1)))
    rank = paths._ranks(paths.letter, paths.jumps[0])

    def audit(node):
        out = ""
        while paths.letter[node] >= 0:
            out, node = out + "DIKR"[paths.letter[node]], paths.jumps[0][node]
        return out

    texts = [audit(v) for v in range(len(rank))]
    assert all((texts[i] < texts[j]) == (rank[i] < rank[j]) for i in range(len(rank)) for j in range(len(rank)))


def test_empty_and_all_dropped(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repair(df).count() == 0
    turns = [t for t in range(300) if zlib.crc32(f"1:{t}".encode()) % 20 == 0]
    df = spark.createDataFrame([(1, t, "user", "Hi.", "k", 1) for t in turns], SCHEMA)
    assert got(turn_repair.repair(df)) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert got(turn_repair.repair(df)) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
