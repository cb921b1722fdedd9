"""The burst trie against a plain trie of dictionaries."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from lexistat.llm import trie

FIELDS = "conv_id bigint, turn bigint, role string, text string, box string, salt int, `odd.name` string, depth int"


def frame(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "b", 1, "o", 2) for c, t, r, x in rows], FIELDS)


def record(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), len(text)


def sequences(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, *record(role, text)))
    return {c: [x[2:] for x in sorted(v)] for c, v in by.items()}


def rebuilt(seqs):
    out = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = seqs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    return out


def brute(seqs):
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * (node[-1][1] if node else 0)
    return sorted(
        (min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children[node]), leaves[node],
         saved[node], hashlib.sha256(",".join(map(str, sorted(c for c in cs if len(seqs[c]) == len(node)))).encode()).hexdigest(),
         node[-1][0] if node else None)
        for node, cs in members.items()
    ) if seqs else []


def planted():
    rng = random.Random(5)
    rows = [
        (None, 0, "user", "no conversation"), (-7, 0, None, None), (-7, None, "user", "first"), (-7, 0, None, None),
        (1, 5, "user", "ünï 😀"), (1, 5, "assistant", "tie"), (0, 0, "user", "base"), (0, 1, "assistant", "same"),
        (0, 2, "user", "end"), (700, 0, "user", ""), (701, 0, "user", "x" * 40000),
    ]
    for c in range(100, 160):  # a family that shares first turns and branches at each of them
        depth = rng.randrange(1, 8)
        rows += [(c, t, "user" if t % 2 else "assistant", f"t{t}" if t < depth else f"own {c} {t}") for t in range(8)]
    for c in range(200, 290):  # copies, in ids that are far apart
        rows += [(c * 1000, t, "user", f"copy {t}") for t in range(3)]
    rows += [(c, 0, "user", "alone") for c in range(5001, 5010)]  # without a conversation to borrow from
    for c in (900, 901, 902):  # long conversations with one long common head
        rows += [(c, t, "user", f"long {t}" if t < 250 else f"{c} {t}") for t in range(300)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return planted()


@pytest.mark.parametrize("limit", [2, 10, 4096])
def test_nodes_match_a_plain_trie(spark, rows, limit):
    found = trie.conversation_trie(frame(spark, rows).repartition(3), limit).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute(sequences(rows)), key=repr)


@pytest.mark.parametrize("limit", [3, 4096])
def test_rebuilt_conversations(spark, rows, limit):
    listed = trie.rebuild(trie.conversation_records(frame(spark, rows)))
    found = trie.prefix_trie(listed, limit).collect()
    expected = rebuilt(sequences(rows))
    assert any(not s for s in expected.values())  # some conversations end up without turns
    assert sorted(map(tuple, found), key=repr) == sorted(brute(expected), key=repr)


def test_small_tables(spark):
    assert trie.conversation_trie(frame(spark, [])).collect() == []
    for rows in ([(3, 0, "user", "hi")], [(3, 0, "user", "hi"), (2, 0, "user", "hi")], [(1, 0, "", "a"), (2, 0, "a", "")]):
        assert sorted(map(tuple, trie.conversation_trie(frame(spark, rows)).collect()), key=repr) == sorted(
            brute(sequences(rows)), key=repr)


def test_common_turns():
    a = bytes(range(20)) * 7
    assert trie.common_turns(a, a[:60], 0) == 3 and trie.common_turns(a, a, 2) == 7
    assert trie.common_turns(a, a[:100] + b"x" * 40, 1) == 5 and trie.common_turns(b"", a, 0) == 0
