"""Benchmark items of a few words are matched unchanged."""

import random

import numpy as np
import pytest
from lexistat.llm import decontaminate

ITEMS = {1: "alpha", 2: "alpha beta", 3: "beta gamma alpha", 4: "alpha beta alpha beta", 5: "gamma gamma",
         6: "Delta  gamma\nbeta alpha", 7: "  "}


def held(item: str, text: str) -> bool:
    own, words = item.lower().split(), text.lower().split()
    return bool(own) and any(words[i:i + len(own)] == own for i in range(len(words) - len(own) + 1))


def test_short_items_leak_where_they_stand_unchanged(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "x", "y"], k=rng.randrange(0, 12))) for _ in range(300)]
    texts += ["", "alpha", "DELTA gamma beta ALPHA", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([*ITEMS.items(), (8, None)], "item_id bigint, text string")
    rows = decontaminate.leak_rows(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == sorted(
        (d, i) for d, t in enumerate(texts) for i, item in ITEMS.items() if t and held(item, t))
    for r in rows:
        words = texts[r.doc_id].lower().split()
        assert r.distance == 0 and words[r.first_word:r.first_word + r.n_words] == ITEMS[r.item_id].lower().split()


@pytest.mark.parametrize("size", [4, 5, 9, 10])
def test_items_at_the_border_of_an_edit(size):
    words = [f"w{i}" for i in range(size)]
    items = decontaminate.Items([1], [" ".join(words)], 20)
    import pyarrow as pa

    changed = [" ".join(["a", *words[:i], "z", *words[i + 1:], "b"]) for i in range(size)]
    found = items.leaks(pa.array([" ".join(words), *changed]))
    assert found[0][0]["distance"] == 0
    assert np.mean([bool(f) for f in found[1:]]) == 0 if size < 5 else np.mean([bool(f) for f in found[1:]]) >= 0.8


def test_chance_items_remove_no_document(spark):
    docs = spark.createDataFrame([(1, "alpha beta x y z"), (2, "one two three four five six")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "alpha beta"), (2, "two three four five six")], "item_id bigint, text string")
    assert [r.doc_id for r in decontaminate.remove_leaking(docs, items).collect()] == [1]
    assert decontaminate.remove_leaking(docs, items, least_words=1).count() == 0
