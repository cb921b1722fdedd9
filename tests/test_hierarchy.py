"""The topic hierarchy against a plain Ward merge, one closest pair after the other."""

from __future__ import annotations

import numpy as np
import pytest
from lexistat.operators import topicplots


def plain(similarity):
    n = len(similarity)
    d = {(a, b): max(1 - similarity[a, b], 0.0) ** 2 for a in range(n) for b in range(n) if a != b}
    size, out = {a: 1 for a in range(n)}, []
    while len(size) > 1:
        d2, a, b = min((d[a, b], a, b) for a in size for b in size if a < b)
        for c in size:
            if c not in (a, b):
                new = ((size[a] + size[c]) * d[a, c] + (size[b] + size[c]) * d[b, c] - size[c] * d2) / (size[a] + size[b] + size[c])
                d[a, c] = d[c, a] = new
        size[a] += size.pop(b)
        out.append((a, b, d2**0.5, size[a]))
    return out


@pytest.mark.parametrize("n", [1, 5, 16])
def test_merges_equal_closest_pairs_one_by_one(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    rows = [(a, b, float(s[a, b])) for a in range(n) for b in range(n)]
    df = spark.createDataFrame(rows, "topic_a int, topic_b int, similarity double")
    got = sorted(topicplots.hierarchy_data(df).collect())
    assert [r["step"] for r in got] == list(range(1, n))
    for r, (a, b, gap, members) in zip(got, plain(s)):
        assert (r["topic_a"], r["topic_b"], r["members"]) == (a, b, members) and np.isclose(r["distance"], gap)
