"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, against brute force."""

from __future__ import annotations

import hashlib
import math
import pathlib
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from lexistat.llm import decontaminate, jaccard, lmscore, packing, quality, sharding, substrings, tokenfiles
from lexistat.llm.frames import arrow_rows, shared_path
from lexistat.llm.tokens import vocabulary_path

WORD = re.compile("[^\x20\x09-\x0D]+")
FIELDS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "quality string, words int, `odd.name` string, shard int, _spans string")
BASE = " ".join(f"w{i}" for i in range(60))
NEAR = BASE.replace("w30", "changed")
LONG = " ".join(f"x{i % 977} y{i}" for i in range(9000))
TEXTS = [
    (1, BASE), (2, BASE), (3, NEAR), (4, None), (5, ""), (6, " \t\n "), (7, "one two"), (8, "one two"),
    (9, LONG), (10, "head " + " ".join(BASE.split()[5:40]) + " tail"), (11, "the " * 400), (12, "the " * 420),
    (13, "Ünïcode straße 漢字   x"), (2, BASE), (None, BASE), (None, None), (15, BASE.upper()),
    (16, "a\x0bb\x0cc\rd\te\nf"), (17, LONG + " end"), (18, " ".join(reversed(BASE.split()))),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i == 3 else "h", 0, "q", 1, "o", 2, "s") for i, t in rows], FIELDS)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}) if lower else text)


def test_substrings(docs, none):
    first = {}
    for i, t in TEXTS:
        w = words(t)
        for k in range(len(w) - 12):
            if i is not None:
                g = tuple(w[k : k + 13])
                first[g] = min(first.get(g, i), i)
    expected = Counter()
    for i, t in TEXTS:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        expected[i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in substrings.repeat_digests(docs).collect()) == expected
    assert substrings.repeat_digests(none).count() == 0
    stripped = substrings.strip_repeats(docs)
    assert stripped.columns == docs.columns and stripped.count() == len(TEXTS)
    assert [r.text for r in stripped.where("doc_id = 4 or doc_id = 6").orderBy("doc_id").collect()] == [None, " \t\n "]


def test_runs_of_a_frequent_anchor_are_spread_and_none_is_lost(spark, docs):
    """A passage among different neighbours: its anchor's shard would hold a run of each document."""
    passage = [f"p{k}" for k in range(15)]
    texts = [" ".join([*(f"a{i}x{k}" for k in range(9)), *passage, *(f"b{i}x{k}" for k in range(9))]) for i in range(200)]
    found = substrings.Words(*substrings.text_bytes(substrings.pa.array(texts)))
    hashed = found.hashes()
    whole = substrings.runs(found, hashed)
    anchors, times = np.unique(whole[3], return_counts=True)
    assert times.max() == 200
    cut = substrings.cut_hot(whole, np.isin(whole[3], anchors[times > 20]), hashed, 13)
    size = {a: set() for a in cut[3].tolist()}
    for first, number, anchor in zip(*(x.tolist() for x in cut[1:])):
        size[anchor].add(hashed[first : first + number + 12].tobytes())
    assert max(map(len, size.values())) <= 20 and cut[2].sum() == whole[2].sum()
    rows = frame(spark, [*TEXTS, *((100 + i, t) for i, t in enumerate(texts))]).repartition(3)
    spread = Counter(tuple(r) for r in substrings.repeat_digests(rows, hot=1).collect())
    assert spread == Counter(tuple(r) for r in substrings.repeat_digests(rows).collect())
    assert sum(n for (i, _, gone, _), n in spread.items() if i and i > 100 and gone == 15) == 199


def test_similar_groups(docs, none):
    sets = []
    for i, t in TEXTS:
        w = words(t, True)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(TEXTS)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(len(TEXTS)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both and 100 * both >= 80 * either and TEXTS[a][0] is not None and TEXTS[b][0] is not None:
                root[find(a)] = find(b)
    low = defaultdict(list)
    for a, (i, _) in enumerate(TEXTS):
        if i is not None:
            low[find(a)].append(i)
    expected = Counter((i, len(sets[a]), min(low[find(a)]) if i is not None else None) for a, (i, _) in enumerate(TEXTS))
    assert Counter(tuple(r) for r in jaccard.similar_groups(docs).collect()) == expected
    assert jaccard.similar_groups(none).count() == 0


def test_large_group_of_near_copies_is_searched_in_blocks(spark):
    """More near copies than a frequent shingle has, in two groups that only long lists can join."""
    rng = np.random.default_rng(5)
    base = [f"v{i}" for i in range(80)]
    rows = []
    for i in range(90):
        own = list(base)
        for _ in range(int(rng.integers(0, 4))):
            own[int(rng.integers(0, 80))] = f"n{rng.integers(0, 1000)}"
        rows.append((i, " ".join(own)))
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(76)) for _, t in rows]
    root = list(range(90))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(90):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    found = {r.doc_id: r.component_id for r in jaccard.similar_groups(frame(spark, rows)).collect()}
    assert found == {i: find(i) for i in range(90)}


def test_index_probes_long_lists():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(200)]
    index = jaccard.Index(sets)
    for query in sets[:40]:
        exact = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, query)) >= 80 * len(np.union1d(s, query))]
        assert index.partners(query).tolist() == exact


def test_quality(docs, none):
    judged, name = quality.quality_rules(docs)
    assert name == "quality_" and judged.columns == [*docs.columns, name]
    found = {(r.doc_id, r.text): r[name] for r in judged.collect()}
    assert judged.count() == len(TEXTS)
    for (i, t), q in found.items():
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        at = defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].append(k)
        inside = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(5)}
        assert (q.n_words, q.word_chars, q.n_repeat_words) == (len(w), sum(map(len, w)), len(inside)), i
        assert q.n_dup_lines == len(lines) - len(set(lines))
        assert q.base_failed == (len(w) < 10 or 100 * len(inside) > 20 * len(w))
        assert q.kept == (not q.base_failed)
    assert quality.quality_rules(none)[0].count() == 0


def test_a_line_of_many_documents_goes_and_its_documents_with_it(spark):
    text = {i: "\n".join(f"own words of page {i} line {k} a b c d" for k in range(3)) + "\nmenu home about contact"
            for i in range(40)}
    text |= {100 + i: f"menu home about contact\nMenu  home about contact\n{i} x\nmenu home about contact" for i in range(30)}
    rows = spark.createDataFrame([(i, t, "h") for i, t in text.items()], "doc_id bigint, text string, source string")
    judged, name = quality.quality_rules(rows, max_repeat_percent=100)
    kept = {r.doc_id: r[name].kept for r in judged.collect()}
    assert all(v == (i < 100) for i, v in kept.items())
    copies = spark.createDataFrame([(i, text[0] + f"\nlast {i % 2}", "h") for i in range(60)], rows.schema)
    judged, name = quality.quality_rules(copies, max_repeat_percent=100)
    assert all(r[name].kept for r in judged.collect())  # near copies count once


def test_pages_of_stock_lines_count_as_distinct_documents(spark):
    """Pages that share several stock lines, or one footer and one own line, are counted one by one."""
    pool = [f"stock line number {k} of this host" for k in range(8)]
    rng = np.random.default_rng(7)
    text = {i: "\n".join(pool[k] for k in rng.permutation(8)[: 3 + i % 3]) for i in range(60)}
    text |= {100 + i: f"footer of the whole site {i % 2}\nown {i}" for i in range(60)}
    text |= {200 + i: "\n".join(f"own words {i} {k} a b c d" for k in range(4)) for i in range(60)}
    text |= {300 + i: "a page held forty times by one host\nwith this second line" for i in range(40)}
    rows = spark.createDataFrame([(i, t, "h") for i, t in text.items()], "doc_id bigint, text string, source string")
    pages, holders = set(text.values()), Counter()
    for t in pages:
        holders.update(set(t.split("\n")))
    frequent = {x for x, n in holders.items() if n > 20 and 100 * n > 2 * len(pages)}
    assert set(pool) < frequent and len(frequent) == 10
    judged, name = quality.quality_rules(rows, min_words=1, max_repeat_percent=100)
    for r in judged.collect():
        lost = sum(len(x.split()) for x in text[r.doc_id].split("\n") if x in frequent)
        assert r[name].n_shared_words == lost and r[name].kept == (100 * lost <= 70 * r[name].n_words), r.doc_id
    assert {r.doc_id for r in judged.where(f"{name}.kept").select("doc_id").collect()} == {i for i in text if i >= 200}


def test_shards(docs, none):
    def jump(key, n):
        key, b, j = key % 2**64, -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
        return b

    found = sharding.shard_layout(docs, 5).collect()
    for r in found:
        assert (r.shard, r.grown_shard) == (jump(r.doc_id or 0, 5), jump(r.doc_id or 0, 6))
        assert r.grown_shard in (r.shard, 5)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == expected
    assert sharding.shard_layout(none, 5).count() == 0
    placed = sharding.shard_rows(docs, 3)
    assert placed.columns == [*docs.columns, "shard_", "slot", "grown_shard"]


def test_packing(docs, none):
    path = vocabulary_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    coder, expected = Tokenizer.from_file(path), Counter()
    for i, t in TEXTS:
        ids = coder.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            own = ids[k : k + 4096]
            expected[i, k // 4096, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    found = packing.pack_documents(docs, path).collect()
    assert Counter(tuple(r)[:5] for r in found) == expected
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 4096
    assert len(bins) == math.ceil(sum(r.length for r in found) / 4096)
    assert packing.pack_documents(none, path).count() == 0


def test_bins_are_the_fullest_ones():
    rng = np.random.default_rng(3)
    for _ in range(60):
        counts = Counter(int(x) for x in rng.integers(1, 25, 12))
        room = int(rng.integers(1, 50))
        sums = {0}
        for n, c in counts.items():
            for _ in range(c):
                sums |= {s + n for s in sums if s + n <= room}
        chosen = packing.fullest(counts, room)
        assert sum(n * k for n, k in chosen.items()) == max(sums)
        assert all(counts[n] >= k for n, k in chosen.items())


def test_token_files(spark, docs, none):
    path, where = vocabulary_path("byte_bpe_50k.json"), shared_path(spark, "tokens")
    from tokenizers import Tokenizer

    coder, expected, start = Tokenizer.from_file(path), [], 0
    for i, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = coder.encode(t or "", add_special_tokens=False).ids + [0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    tokenfiles.write_tokens(docs, path, where)
    read = tokenfiles.checksum(tokenfiles.read_tokens(spark, where))
    found = tokenfiles.token_index(read, tokenfiles.read_layout(spark, where)).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found] == expected
    some = tokenfiles.read_tokens(spark, where, 7, 9)
    assert sorted(r.doc_id for r in some.collect()) == [7, 8, 9]
    assert "GreaterThanOrEqual(doc_id,7)" in some._jdf.queryExecution().executedPlan().toString()
    empty = shared_path(spark, "tokens")
    tokenfiles.write_tokens(none, path, empty)
    assert tokenfiles.read_tokens(spark, empty).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    import pyarrow as pa
    from lexistat.llm.tokens import Encoder
    from tokenizers import Tokenizer

    texts = ["a   b", "x \n  y<|endoftext|> z", "Σίσυφος ΣΑΣ  ok", "", None, "  lead", "trail  ", "don't  I'm 12 345?!",
             "é ́x", "   abc", "a  b", "<|startoftext|>a ,b", "tab\tsep\r\nnew", "é, è! ñ."]
    ids, first = Encoder(vocabulary_path(name)).encode(pa.array(texts, pa.string()))
    coder = Tokenizer.from_file(vocabulary_path(name))
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == coder.encode(t or "", add_special_tokens=False).ids


def test_leaks(spark, docs, none):
    passage = [f"q{i}" for i in range(30)]
    edited = [*passage[:8], "new", *passage[8:15], *passage[17:]]
    far = [w if k % 3 else "zz" for k, w in enumerate(passage)]
    items = spark.createDataFrame(
        [(1, " ".join(passage), "x"), (2, None, "x"), (None, "w1 w2 w3 w4 w5 w6", "x"), (3, "one two", "x")],
        "item_id bigint, text string, leaks string")
    rows = frame(spark, [*TEXTS, (50, "a b " + " ".join(passage) + " c"), (51, " ".join(edited).upper().replace("Q", "q")),
                         (52, " ".join(far)), (53, " ".join(passage)), (53, " ".join(passage))])
    found = sorted(tuple(r) for r in decontaminate.leak_rows(rows, items).collect())
    short = [(d, 3, 0, 0, 2) for d, t in TEXTS if t and t.split()[:2] == ["one", "two"]]  # exact: no edit is allowed
    assert short and found == sorted([*short, (50, 1, 0, 2, 30), (51, 1, 3, 0, 29), (53, 1, 0, 0, 30), (53, 1, 0, 0, 30)])
    assert decontaminate.leak_rows(none, items).count() == 0
    assert decontaminate.leak_rows(rows, items.limit(0)).count() == 0
    kept = decontaminate.remove_leaking(rows, items)
    assert kept.columns == rows.columns and kept.count() == len(TEXTS) + 1
    blocks = decontaminate.item_blocks(items, "item_id", "text", 40)
    assert len(blocks) > 1 and sum(map(len, blocks)) == 2


def test_best_match_is_the_exact_edit_distance():
    rng = np.random.default_rng(2)
    for _ in range(200):
        item, text = rng.integers(0, 4, rng.integers(1, 8)), rng.integers(0, 4, rng.integers(0, 12))

        def distance(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                row, old = [i], row
                for j, y in enumerate(b, 1):
                    row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
            return row[-1]

        best = min(distance(item, text[a:b]) for a in range(len(text) + 1) for b in range(a, len(text) + 1))
        found, a, b = decontaminate.best_match(item, text)
        assert found == best == distance(item, text[a:b])


def test_recall_of_edited_passages():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    vocabulary = [f"word{i}" for i in range(400)]
    items = [[vocabulary[k] for k in rng.integers(0, 400, n)] for n in rng.integers(12, 60, 60)]
    known = decontaminate.Items(list(range(60)), [" ".join(w) for w in items], 20)
    texts, expected = [], []
    for n in range(400):
        i = n % 60
        own = list(items[i])
        for _ in range(len(own) * 20 // 100):
            own[int(rng.integers(0, len(own)))] = f"edit{rng.integers(0, 10**9)}"
        other = [vocabulary[k] for k in rng.integers(0, 400, 200)]
        at = int(rng.integers(0, 200))
        texts.append(" ".join([*other[:at], *own, *other[at:]]))
        expected.append(i)
    found = known.leaks(pa.array(texts))
    assert np.mean([any(h["item_id"] == e for h in f) for f, e in zip(found, expected)]) >= 0.95


def test_leaks_of_nested_overlapping_short_and_repeated_items():
    """Each item is looked for by its own groups, also inside a longer run that other items hold."""
    import pyarrow as pa

    b = [f"b{i}" for i in range(200)]
    items = {1: b[90:110], 2: b, 3: b[100:130], 4: "s1 s2 s3 s4 s5".split(), 5: ["ha"] * 12}
    known = decontaminate.Items(list(items), [" ".join(w) for w in items.values()], 20)
    around = [f"z{i}" for i in range(30)]
    texts = [
        [*around, *b[65:135], *around], [*around, *b, *around], [*around, "s1", "s2", "new", "s4", "s5", *around],
        ["x", *["ha"] * 12, "y"], [*around, *b[:89], *around], [*around, *b[50:97], "new", *b[98:150], *around],
        b[92:110], ["s1", "s2", "s3", "s4"],
    ]
    found = known.leaks(pa.array([" ".join(t) for t in texts]))
    for text, hits in zip(texts, found):
        best = {i: decontaminate.best_match(np.array([hash(x) for x in w]), np.array([hash(x) for x in text]))[0]
                for i, w in items.items()}
        assert {h["item_id"]: h["distance"] for h in hits} == {i: d for i, d in best.items() if d <= len(items[i]) // 5}
    assert [[h["item_id"] for h in hits] for hits in found] == [[1, 3], [1, 2, 3], [4], [5], [], [1, 3], [1], [4]]


def test_scores(docs, none):
    counts, total = Counter(), sum(len(words(t)) for _, t in TEXTS)
    for _, t in TEXTS:
        w = words(t)
        for n in (1, 2, 3):
            counts.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))

    def log_score(gram):
        if len(gram) == 1:
            return math.log(counts[gram] / total), 1
        if counts[gram] >= 2:
            return math.log(counts[gram] / counts[gram[:-1]]), len(gram)
        value, used = log_score(gram[1:])
        return value + math.log(0.4), used

    expected = []
    for i, t in TEXTS:
        w = words(t)
        scored = [(log_score(tuple(w[max(0, k - 2) : k + 1])), min(k + 1, 3)) for k in range(len(w))]
        expected.append((-1 if i is None else i, len(w), round(sum(s for (s, _), _ in scored), 5), sum(u < m for (_, u), m in scored)))
    found = [(-1 if r.doc_id is None else r.doc_id, r.n_words, round(r.log_score, 5) + 0.0, r.n_backed_off)
             for r in lmscore.score_documents(docs).collect()]
    assert sorted(found) == sorted(expected)
    assert lmscore.score_documents(none).count() == 0


def test_pipeline_stages(spark, docs, none, tmp_path):
    passage = " ".join(f"q{i}" for i in range(30))
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(i, " ".join(f"c{i}x{k}" for k in range(40))) for i in range(60, 70)]
    made = frame(spark, [*TEXTS, *clean, (71, passage + " " + clean[0][1][:40])])
    for start in (none, made):
        rows = start
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, str(tmp_path))
            assert name == corpus_pipeline.STAGES[-1][0] or rows.columns == start.columns
        ids = {r.doc_id for r in rows.collect()}
        if start is none:
            assert ids == set()
    assert {i for i, _ in clean} | {1, 9, 10, 18} <= ids
    assert not ids & {2, 3, 4, 5, 6, 7, 11, 12, 15, 17, 71}


def test_lm_scoring_sends_few_bytes_for_a_key():
    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(0, 2**48, 20_000, dtype=np.uint64))
    gaps, times = np.diff(keys, prepend=np.uint64(0)), rng.geometric(0.8, 20_000).astype(np.uint64)
    packed = lmscore.squeeze(gaps), lmscore.squeeze(times)
    assert len(packed[0]) < 5 * len(keys) and len(packed[1]) < len(keys) // 2
    assert (np.cumsum(lmscore.widen(packed[0], 20_000), dtype=np.uint64) == keys).all()
    assert (lmscore.widen(packed[1], 20_000) == times).all()
    edge = np.array([0, 1, 255, 256, 2**32 - 1, 2**48 - 1], np.uint64)
    assert (lmscore.widen(lmscore.squeeze(edge), 6) == edge).all()
    assert len(lmscore.widen(lmscore.squeeze(edge[:0]), 0)) == 0


def test_few_encodings_are_held_together():
    import pyarrow as pa

    from lexistat.llm.tokens import Encoder

    encoder = Encoder(vocabulary_path("word_bpe_49k.json"))
    texts = pa.array([f"a{i} b{i * 7}" for i in range(6000)])
    whole, first = encoder.encode(texts)

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.most = tokenizer, 0

        def encode_batch_fast(self, pieces, **options):
            self.most = max(self.most, len(pieces))
            return self.tokenizer.encode_batch_fast(pieces, **options)

    again = Encoder(vocabulary_path("word_bpe_49k.json"))
    again.tokenizer = Counted(again.tokenizer)
    ids, ends = again.encode(texts)
    assert (ids == whole).all() and (ends == first).all() and again.tokenizer.most <= 4096


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_fresh_pieces_share_few_encodings(name):
    import pyarrow as pa

    from lexistat.llm.tokens import Encoder

    tail = " x\u0301 a\u0301~ \u0130b \u6f22~\n\ny <|endoftext|> it's, don't.\x0b 12"
    texts = [f"W{i} a{i} thing{i * 7}~ {i}.{tail}{i}" for i in range(3000)]
    encoder = Encoder(vocabulary_path(name))
    plain = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]

    class Counted:
        def __init__(self, encode):
            self.encode, self.texts, self.most = encode, 0, 0

        def __call__(self, texts, **options):
            self.texts, self.most = self.texts + len(texts), max(self.most, len(texts))
            return self.encode(texts, **options)

    class Alone:
        def __init__(self, tokenizer):
            self.encode_batch_fast = Counted(tokenizer.encode_batch_fast)

    encoder.with_offsets, encoder.tokenizer = Counted(encoder.with_offsets), Alone(encoder.tokenizer)
    ids, ends = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == plain
    # Each text starts with a piece of its own and ends with one of its own; about 9,000 others lie between.
    assert 9000 < len(encoder.known) and encoder.with_offsets.most <= 4096
    assert encoder.with_offsets.texts + encoder.tokenizer.encode_batch_fast.texts < 6000


def test_anchors_are_counted_in_small_batches():
    import sys
    import tracemalloc
    from types import ModuleType

    import pyarrow as pa

    given = []

    class Frame:
        def select(self, *columns):
            return self

        def groupBy(self, *columns):
            return self

        def collect(self):
            return []

        def mapInArrow(self, function, fields):
            given.append(function)
            return self

        def applyInArrow(self, function, fields):
            return self

    substrings.anchor_filter(Frame(), 13, 4, substrings.HOT)
    texts = [" ".join(f"w{(i * 7919 + j * j) % 50021}" for j in range(1500)) for i in range(800)]
    part = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    sys.modules["_kept_by_worker"] = ModuleType("_kept_by_worker")
    tracemalloc.start()
    try:
        total = sum(len(times) // 4 for out in given[0](iter([part])) for times in out.column("times").to_pylist())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total > 100_000 and peak < 60_000_000  # 8 MB of text at once took twice as much
    assert "_kept_by_worker" not in sys.modules  # what packing kept goes first


def test_places_are_planned_without_python_workers(spark):
    pieces = spark.range(5).selectExpr("id doc_id", "id * 700 + 300 length")
    packed = packing.pack(pieces, "length", ["doc_id"])
    assert "PythonRDD" not in packed._jdf.queryExecution().toRdd().toDebugString()
    rows = packed.collect()
    assert len(rows) == 5 and len({r["sequence_id"] for r in rows}) == 3


def test_text_goes_to_the_encoder_in_small_parts(spark):
    name, held = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    with pytest.raises(ValueError), arrow_rows(spark, 1000):
        held.append(int(spark.conf.get(name)))
        raise ValueError
    assert held == [min(1000, int(before))] and spark.conf.get(name) == before
    settled = packing.settle
    packing.settle = lambda df: held.append(int(spark.conf.get(name))) or settled(df)
    try:
        docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
        assert packing.pack_documents(docs, vocabulary_path("word_bpe_49k.json")).count() == 2
    finally:
        packing.settle = settled
    assert held[1] <= packing.HELD_ROWS


def test_a_worker_gives_back_what_a_task_has_freed():
    program = r'''
import re
from lexistat.llm.tokens import release_unused
def held():
    return int(re.search(r"^Rss:\s+(\d+)", open("/proc/self/smaps_rollup").read(), re.M)[1])
parts = [bytes(20_000) for _ in range(6_000)]
kept = [bytes(100_000) for _ in range(3)]
full = held()
del parts
release_unused()
print(full - held())
'''
    root = pathlib.Path(packing.__file__).parents[2]
    done = subprocess.run([sys.executable, "-c", program], cwd=root, capture_output=True, text=True, check=True)
    assert int(done.stdout) > 80_000
