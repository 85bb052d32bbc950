"""Conversation repair against a search of all edits, and its blocks."""

import hashlib
import random
from collections import defaultdict
from functools import lru_cache
from zlib import crc32

import pytest

pytest.importorskip("pagewright.llm")

from pagewright.llm import queries, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\f\r"


def broken(rows):
    """Rows after damage, with None for rows that are dropped."""
    say = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        role, text = say(role), say(text)
        fault = crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        if fault == 0:
            yield conv, None
            continue
        if fault == 1:
            text = ""
        elif fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif fault == 4:
            role = "user"
        for _ in range(1 + (fault == 3)):
            yield conv, (turn, role, text)


def cheapest(kinds, forced, cut):
    """(cost, edits) by trying every edit; edits are (letter, written role or None)."""
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, last, inserts):
        options = []
        if i == len(kinds) and last in ("", "a"):
            options.append((0, "", ()))
        written = "a" if last == "u" else "u"

        def then(cost, letter, role, i, last, inserts):
            rest = best(i, last, inserts)
            if rest:
                options.append((cost + rest[0], letter + rest[1], ((letter, role), *rest[2])))

        if inserts:
            then(2, "I", written, i, written, inserts - 1)
        if i < len(kinds):
            then(3, "D", None, i + 1, last, 2)
            if not forced[i]:
                then(2 + cut[i], "R", written, i + 1, written, 2)
                if (last, kinds[i]) in follows:
                    then(cut[i], "K", None, i + 1, follows[last, kinds[i]], 2)
        return min(options) if options else None

    for i in range(len(kinds), 0, -1):  # from the end, so that no call goes deep
        for last in ("", "s", "u", "a"):
            best(i, last, 2)
    return best(0, "", 2)


def expected(rows):
    groups = defaultdict(list)
    for conv, row in rows:
        groups[conv] += [row] if row else []
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            visible = text.rstrip(SPACE)
            faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "" if visible[-1] in ".!?" else "truncated")
            seen.add((role, text))
        known = [t[0] for t in turns if t[0] is not None]
        kinds = [t[1][:1] for t in turns]
        cost, audit, edits = cheapest(tuple(kinds), tuple(f in ("blank", "duplicate") for f in faults), tuple(f == "truncated" for f in faults))
        lines, at, full = [], 0, {"u": "user", "a": "assistant"}
        for letter, role in edits:
            if letter == "I":
                lines.append(f"{full[role]}:")
                continue
            if letter != "D":
                lines.append(f"{full[role] if letter == 'R' else turns[at][1]}:{turns[at][2]}")
            at += 1
        yield (conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def key(row):
    return tuple((x is not None, x) for x in row)


def conversations(rng, n):
    texts = ["Yes.", "No!", "Why?", "so", "and then ", "ok. \n", "", " \t", None, "日本。", "x" * 3000 + "."]
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(0, 9)):
            roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "sage"]
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv if conv else None, turn + rng.randrange(2) if rng.random() < 0.9 else None, role, rng.choice(texts)))
    return rows


def test_all_edits_are_searched(spark):
    rows = conversations(random.Random(8), 260)
    rows += rows[:40]
    got = turn_repair.repair(turn_repair.damage(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(broken(rows)), key=key)


def test_its_sql_is_the_search_of_all_edits():
    import duckdb

    rows = conversations(random.Random(21), 200)
    rows += rows[:60]
    db = duckdb.connect()
    db.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(db.execute(queries.oracle_sql()["op11_turn_repair"]).fetchall(), key=key) == sorted(expected(broken(rows)), key=key)


def test_long_conversations_in_blocks_and_segments(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for conv, n in ((1, 300), (2, 3), (3, 170), (4, 1), (5, 600)):
        for turn in range(n):
            rows.append((conv, turn // 2 if conv == 3 else turn, rng.choice(["user", "assistant", "user", "assistant", "system", "x"]), rng.choice(["a.", "b", "c!", f"{rng.randrange(60)}."])))
    rows += [(5, 600 + k // 3, "user", "again.") for k in range(300)]
    want = sorted(expected(broken(rows)), key=key)
    for rows_of, segment in ((10_000, 128), (37, 8)):
        monkeypatch.setattr(turn_repair, "BATCH_ROWS", rows_of)
        monkeypatch.setattr(turn_repair, "SEGMENT", segment)
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = turn_repair.repair(turn_repair.damage(df)).collect()
        assert sorted(map(tuple, got), key=key) == want


def test_small_batches_of_solve_agree(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    sizes = np.array([0, 1, 5, 40, 41, 3])
    n = sizes.sum()
    kind, fault = rng.integers(0, 4, n).astype(np.uint8), rng.integers(0, 4, n)
    args = kind, fault == 1, fault == 3, sizes
    ends = np.tile(turn_repair._FINISH, (len(sizes), 1))
    whole = turn_repair.Turns(*args).solve(ends, (0, 1, 2, 3))
    reach = turn_repair.Turns(*args).whole_reaches()
    monkeypatch.setattr(turn_repair, "SEGMENT", 7)
    assert turn_repair.Turns(*args).solve(ends, (0, 1, 2, 3)) == whole
    assert (turn_repair.Turns(*args).whole_reaches() == reach).all()


def test_nothing_dropped_and_extra_columns(spark):
    assert turn_repair.repair(turn_repair.damage(spark.createDataFrame([], SCHEMA))).collect() == []
    rows = spark.createDataFrame([(7, 0, "user", "Hi.", 1, 2, "x"), (7, 1, "assistant", "Ho.", 1, 2, "x"), (8, 0, "user", "Hi.", 1, 2, "x")], SCHEMA + ", part long, same int, fault string")
    got = {r.conv_id: r for r in turn_repair.repair(rows).collect()}
    assert got[7].audit == "KK" and got[7].cost == 0 and got[8].audit == "KI" and got[8].cost == 2
    gone = rows.selectExpr("conv_id", "turn", "role", "text", "conv_id = 8 as gone")
    got = {r.conv_id: r for r in turn_repair.repair(gone).collect()}
    assert tuple(got[8])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op11_turn_repair(spark, sf_dir).collect())) == sorted(expected(broken(rows)))
