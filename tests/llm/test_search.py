"""Ranked search against scores of every document in plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from lexistat.llm import search
from lexistat.llm.frames import settle

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=20):
    """(item, rank, doc, score), and ties by id with nulls last."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, long = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 100 - 25 + ((25 * sum(b.values()) * n) // long)
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 12 * m))
                for t in terms(text) if t in b
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if x else i, -s) for r, (s, x, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def corpus(n=3000, seed=1):
    rng = random.Random(seed)
    names = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    rows = [(i, " ".join(rng.choices(names, weights, k=rng.choice((3, 20, 20, 60))))) for i in range(n)]
    rows += [(10 * n + i, "w399 tie tie") for i in range(50)]  # equal scores beyond the twentieth
    return rows


ODD = [
    (1, "Straße, STRASSE! über-all x1y2 ÀB"), (2, None), (3, ""), (4, " .,;:'\"\t\n"), (5, "alpha beta ALPHA"), (5, "alpha beta ALPHA"),
    (None, "alpha beta alpha"), (6, "漢字かな alpha\x00beta\x7fgamma"), (7, "alpha " * 30000 + "rare"), (8, "rare"), (9, "ſeries K"),
    (10, "a_b`c{d}e~f@g[h]"), (11, "beta " * 3),
]
ODD_ITEMS = [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, "unknownword"), (4, "rare RARE alpha"), (None, "straße über"),
             (6, "漢字かな k K ſeries àb ÀB"), (7, "b g h"), (8, "")]


def run(spark, docs, items, parts=3):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, term int, shard string")
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id bigint, text string, rank int")
    return sorted((tuple(r) for r in search.ranked_search(d.repartition(parts), q).collect()), key=repr)


def test_odd_texts(spark):
    assert run(spark, ODD, ODD_ITEMS) == brute(ODD, ODD_ITEMS)


def test_many_documents(spark):
    docs = corpus()
    items = [(k, t) for k, (_, t) in enumerate(docs[::151])] + [(900, "tie"), (901, "w0 w1 w2 w0"), (902, "w399 w398 w5")]
    assert run(spark, docs, items, 4) == brute(docs, items)


def test_empty_sides(spark):
    assert run(spark, [], ODD_ITEMS) == [] and run(spark, ODD, []) == [] and run(spark, [(1, None)], ODD_ITEMS) == []


def test_index_is_written_once_and_answers_again(spark):
    docs = spark.createDataFrame(corpus(500), "doc_id bigint, text string")
    index = settle(search.index_documents(docs))
    items = spark.createDataFrame([(1, "w3 w7 w200")], "item_id bigint, text string")
    few = search.search(index, items, top=3).collect()
    assert sorted(map(tuple, few), key=repr) == brute(corpus(500), [(1, "w3 w7 w200")], 3)


@pytest.mark.parametrize("window", [7, 64, 100_000])
def test_shard_answers_exactly_and_skips_blocks(monkeypatch, window):
    monkeypatch.setattr(search, "WINDOW", window)
    monkeypatch.setattr(search, "BLOCK", 8)
    docs = corpus(2000, 3)
    shard = search.Shard()
    for i, t in docs:
        shard.add(i, t)
    rows = list(shard.rows(0))
    n, long = rows[0][2], rows[0][3]
    ids, known = np.frombuffer(rows[0][4], np.int64).reshape(2, -1)
    m = search.norms(np.frombuffer(rows[0][5], np.int64), n, long)
    blocks = skipped = 0
    for item in ("w0 w30", "w1 w2 w300 w0", "tie w0", "w0"):
        asked = Counter(terms(item))
        lists = [(search.weight(n, r[2]) * asked[r[1]], search.PostingList(r[4], r[5], n, long)) for r in rows[1:] if r[1] in asked]
        found = search.best_of_shard(lists, m, ids, 1 - known, 20)
        assert sorted((int(ids[d]), s) for d, s in found) == sorted((d, s) for _, _, d, s in brute(docs, [(0, item)]))
        if item == "w0 w30":  # the frequent term cannot lift a document without the rare one
            blocks += sum(len(x.last) for _, x in lists)
            skipped += sum(len(x.last) - len(x.read) for _, x in lists)
    assert window == 100_000 or skipped > blocks // 4


def test_codes_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**31, 2**40, 5], np.int64)
    code, starts = search.encode(values)
    assert search.decode(code).tolist() == values.tolist() and starts[-1] == len(code)
    assert len(search.encode(np.empty(0, np.int64))[0]) == 0 and len(search.decode(np.empty(0, np.uint8))) == 0
