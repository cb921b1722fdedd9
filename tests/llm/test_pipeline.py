"""The rows of every pipeline stage against plain Python, on documents with planted copies, lines, passages, leaks."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import corpus_pipeline
import pytest
from lexistat.llm.tokens import vocabulary_path
from tokenizers import Tokenizer

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean"
RNG = random.Random(11)
WORDS = [f"word{k}" for k in range(5000)]
ITEM = " ".join(f"item{k}" for k in range(25))
MENU = "menu of this host with home and contact\nlegal notes and terms of this host"
PASSAGE = " ".join(f"shared{k}" for k in range(60))


def fresh(n):
    return " ".join(RNG.choices(WORDS, k=n))


def planted():
    rows = {i: fresh(60) for i in range(1, 31)}
    rows[31] = rows[4]  # an exact copy
    rows[32] = rows[5] + " tail"  # a near copy
    rows[33], rows[34] = f"{fresh(40)} {PASSAGE} {fresh(30)}", f"{fresh(20)} {PASSAGE} {fresh(50)}"
    rows[35] = f"{fresh(30)} {ITEM} {fresh(30)}"
    edited = ITEM.split()
    edited[12] = "changed"  # no thirteen words in a row are shared with the other leak
    rows[36] = f"{fresh(30)} {' '.join(edited)}"
    rows[37], rows[38], rows[39] = "too short", "", None
    rows[40] = "again and " * 40
    rows |= {100 + i: f"{MENU}\nown {i}" for i in range(30)}  # almost only lines of the host
    rows[200] = fresh(9000)  # longer than a sequence
    made = [(i, t, "en", f"h{i // 100}" if i < 200 else None, len(t or ""), False) for i, t in rows.items()]
    again = [(6, rows[6], "en", "h0", 5, True), (7, fresh(60), "en", "h0", 9, True), (None, fresh(50), "en", None, 1, None)]
    return made + again


def words(text):
    return (text or "").split()


def good(rows):
    pages = {}  # host: the distinct pages, as their lines
    for _, t, _, h, *_ in rows:
        pages.setdefault(h, set()).add(tuple(x.strip().lower() for x in (t or "").split("\n") if x.strip()))
    out = []
    for r in rows:
        w = words(r[1])
        at = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = {k + j for k in range(len(w) - 4) if at[tuple(w[k : k + 5])] > 1 for j in range(5)}
        holders = Counter(x for p in pages[r[3]] for x in set(p))
        lost = sum(len(x.split()) for x in (r[1] or "").split("\n")
                   if holders[x.strip().lower()] > 20 and 100 * holders[x.strip().lower()] > 2 * len(pages[r[3]]))
        if len(w) >= 10 and 100 * len(inside) <= 20 * len(w) and 100 * lost <= 70 * len(w):
            out.append(r)
    return out


def one_of_each(rows):
    sets = [{tuple(words(r[1])[k : k + 5]) for k in range(len(words(r[1])) - 4)} for r in rows]
    root = {r[0]: r[0] for r in rows if r[0] is not None}
    for _ in rows:
        for r, a in zip(rows, sets):
            for q, b in zip(rows, sets):
                if r[0] is not None and q[0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                    root[r[0]] = min(root[r[0]], root[q[0]])
    first = {}
    for r in sorted(rows, key=repr):
        if r[0] is None or root[r[0]] == r[0]:
            first.setdefault((r[0], r[1]), r)
    return list(first.values())


def without_repeats(rows):
    held = {}
    for r in rows:
        if r[0] is not None:
            for k in range(len(words(r[1])) - 12):
                g = tuple(words(r[1])[k : k + 13])
                held[g] = min(held.get(g, r[0]), r[0])
    out = []
    for r in rows:
        w, gone = words(r[1]), set()
        for k in range(len(w) - 12):
            if r[0] is not None and held.get(tuple(w[k : k + 13]), r[0]) < r[0]:
                gone |= set(range(k, k + 13))
        out.append((r[0], tuple(x for k, x in enumerate(w) if k not in gone)))
    return out


def distance(a, b):
    """The least word edits that turn a into some part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        before, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(before[j - 1] + (x != y), before[j] + 1, row[j - 1] + 1)
    return min(row)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame(planted(), FIELDS).repartition(3)
    out = {"documents": docs.collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        out[name] = [tuple(r) for r in docs.collect()]
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_quality_rules(stages):
    assert ordered(stages["quality_rules"]) == ordered(good(stages["documents"]))
    gone = {r[0] for r in stages["documents"]} - {r[0] for r in stages["quality_rules"]}
    assert gone == {37, 38, 39, 40} | set(range(100, 130))


def test_one_document_of_each_group_stays(stages):
    assert ordered(stages["ngram_jaccard"]) == ordered(one_of_each(stages["quality_rules"]))
    ids = Counter(r[0] for r in stages["ngram_jaccard"])
    assert ids[6] == 1 and ids[7] == 2 and ids[None] == 1 and not ids[31] and not ids[32]
    assert [r[4] for r in stages["ngram_jaccard"] if r[0] == 6] == [5]


def test_repeated_passages_go(stages):
    found = sorted(((r[0], tuple(words(r[1]))) for r in stages["substring_dedup"]), key=repr)
    assert found == sorted(without_repeats(stages["ngram_jaccard"]), key=repr)
    assert all(r[4] == len(r[1]) for r in stages["substring_dedup"])
    assert [sum(w.startswith("shared") for w in words(r[1])) for r in stages["substring_dedup"] if r[0] in (33, 34)] in (
        [60, 0], [0, 60])


def test_leaking_documents_go(stages):
    limit = len(words(ITEM)) // 5
    expected = [r for r in stages["substring_dedup"] if distance(words(ITEM), words(r[1])) > limit]
    assert ordered(stages["decontamination"]) == ordered(expected)
    assert {r[0] for r in stages["substring_dedup"]} - {r[0] for r in stages["decontamination"]} == {35, 36}


def test_packed_pieces(spark, stages):
    own = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    expected = []
    for r in stages["decontamination"]:
        ids = [*own.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for p, a in enumerate(range(0, len(ids), 4096)):
            piece = ids[a : a + 4096]
            raw = b"".join(x.to_bytes(4, "little") for x in piece)
            expected.append((r[0], p, a, len(piece), zlib.crc32(raw)))
    found = stages["best_fit_packing"]
    assert ordered(r[:5] for r in found) == ordered(expected)
    by = {}
    for r in found:
        by.setdefault(r[5], []).append((r[6], r[3]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r[3] for r in found)
    assert len(by) <= -(-total // 4096) + 1
