"""N-grams are counted inside batches and shuffled once."""

from collections import Counter

import numpy as np
import pyarrow as pa

from lexistat.operators import grams, topics


def test_counts_of_grams_equal_plain_counts():
    rows = [(1, ["a", "b", "a", "b"]), (None, ["a", "b"]), (2, []), (1, ["b", "a", "b"]), (None, ["a", "b", "c"])]
    want = Counter()
    for group, words in rows:
        for n in (2, 3):
            want.update((group, " ".join(words[i:i + n])) for i in range(len(words) - n + 1))
    got = Counter()
    groups, words = pa.array([g for g, _ in rows], pa.int32()), pa.array([w for _, w in rows], pa.list_(pa.string()))
    for owners, terms, counts in grams.count_grams(groups, words, 2, 3):
        for owner, term, n in zip(owners.to_pylist(), terms.to_pylist(), counts.tolist()):
            assert (owner, term) not in got
            got[owner, term] = n
    assert got == want


def test_runs_hold_every_row_and_few_words():
    sizes = np.array([3, 0, 9, 2, 2, 1, 0])
    runs = list(grams.word_runs(sizes, 4))
    assert [r for first, many in runs for r in range(first, first + many)] == list(range(len(sizes)))
    assert all(many == 1 or sizes[first:first + many].sum() <= 4 for first, many in runs)


def test_terms_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(grams, "BATCH_WORDS", 3)
    docs = spark.createDataFrame(
        [(1, "red fish blue fish"), (2, "red fish"), (None, "red fish"), (1, None), (3, "")], "topic_id int, text string")
    counts = topics.topic_terms_count(docs, topics.TermOptions(min_df=1, max_df=None))
    assert sorted(((r.topic_id or 0, r.term, r.n, r.topics) for r in counts.collect())) == [
        (0, "fish", 1, 3), (0, "red", 1, 3), (0, "red fish", 1, 3),
        (1, "blue", 1, 1), (1, "blue fish", 1, 1), (1, "fish", 2, 3), (1, "fish blue", 1, 1), (1, "red", 1, 3),
        (1, "red fish", 1, 3), (2, "fish", 1, 3), (2, "red", 1, 3), (2, "red fish", 1, 3),
    ]
    plan = counts._jdf.queryExecution().sparkPlan().toString()
    executed = counts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert executed.count("Exchange hashpartitioning") == 1 and "MapInArrow" in plan
