"""The trie of conversations against brute force, with one shard and with many."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from clientela.llm import prefix_trie
from clientela.llm.queries import SQL

SCHEMA = "conv_id long, turn int, role string, text string, node string, depth int, salt long"
EXTRA = ("x", 7, 1)


def expected(rows):
    """All nodes, from whole prefixes as keys."""
    said = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in said.items()}
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = said.get(c - c % 5, [])[:h] + own[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    leaves, saved, found = {}, {}, set()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        own = len(p[-1][1].encode()) if p else 0
        saved[p] = (len(members[p]) - 1) * own + sum(saved[x] for x in children[p])
        ends = ",".join(str(c) for c in members[p] if len(built[c]) == len(p))
        found.add((
            members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]),
            len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return found


def rows_of_many_kinds():
    rng = random.Random(3)
    words = ["yes", "no", "é中😀", "", "perhaps so"]
    rows = []
    for c in range(160):
        for t in range(rng.randint(1, 12)):
            text = rng.choice(words) if t else "hello"
            rows.append((c, t, rng.choice(["user", "assistant"]) if t else "user", text, *EXTRA))
    for c in [*range(1000, 1040), 10_000, 20_001]:  # copies, ids far apart
        rows += [(c, t, "user", f"turn {t}", *EXTRA) for t in range(30)]
    rows += [(2000 + i, None, None, None, *EXTRA) for i in range(6)]  # of single turns
    rows += [(3005, t, "user", str(t), *EXTRA) for t in range(9000)]  # over several spans
    rows += [(4001, t, "user", "own", *EXTRA) for t in range(3)]  # without the first of its family
    rows += [(None, 1, "user", "lost", *EXTRA), (4010, None, "user", "first", *EXTRA),
             (4010, 0, None, "then", *EXTRA), (4010, 1, "user", None, *EXTRA)]
    return rows


def nodes(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("reach", [prefix_trie.LEAST_REACH, 8, 10**9])
def test_all_nodes_as_by_brute_force(spark, monkeypatch, reach):
    monkeypatch.setattr(prefix_trie, "LEAST_REACH", reach)
    rows = rows_of_many_kinds()
    random.Random(1).shuffle(rows)
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    assert nodes(found) == expected(rows)
    assert found.count() == len(expected(rows))


def test_the_sql_agrees(spark):
    rows = [r[:4] for r in rows_of_many_kinds() if r[0] != 3005]
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
                 .astype({"conv_id": "Int64", "turn": "Int64"}))
    found = con.sql(SQL["op12_prefix_trie"]).fetchall()
    assert set(found) == expected(rows) and len(found) == len(expected(rows))


def test_conversations_at_the_edges(spark):
    assert nodes(prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == set()
    assert nodes(prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", *EXTRA)], SCHEMA))) == set()
    for rows in (
        [(5, 0, "user", "a", *EXTRA)],
        [(6, 0, "user", "a", *EXTRA)],  # h turns of nothing, then nothing
        [(5, 1, "user", "a", *EXTRA)] * 4,  # repeated rows are turns of their own
        [(1, 0, "us", "er", *EXTRA), (2, 0, "use", "r", *EXTRA), (10, 0, "us", "er", *EXTRA)],
    ):
        assert nodes(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_equal_turns_in_any_order_give_one_result(spark):
    rows = [(15, 1, "user", "b", *EXTRA), (15, 1, "user", "a", *EXTRA), (15, 1, None, "c", *EXTRA)]
    first = nodes(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert first == nodes(prefix_trie.prefix_trie(spark.createDataFrame(rows[::-1], SCHEMA)))


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 50_000])
def test_slots_are_minimal_perfect_and_checked(n):
    digests = np.unique(np.random.default_rng(n).integers(0, 2**63, (n, 2), dtype=np.uint64), axis=0)
    table = prefix_trie.SlotTable(digests)
    assert sorted(table.find(digests)) == list(range(len(digests)))
    assert set(table.find(digests + np.uint64(1))) == {-1}
    with pytest.raises(ValueError):
        prefix_trie.SlotTable(np.concatenate([digests, digests[:1]]))
