"""The SQL of the quality rules on texts where the count of holders decides, and links of large families."""

from __future__ import annotations

import duckdb
import numpy as np
from compare import plain
from lexistat.llm import jaccard, quality
from lexistat.llm.checks import CHECKS


def stock_pages():
    """Pages made of a pool of stock lines: counting distinct pages and counting distinct other lines differ."""
    rng = np.random.default_rng(7)
    pool = [f"stock line number {k} of this host with more words" for k in range(8)]
    rows = [(i, "\n".join(pool[k] for k in rng.permutation(8)[: 3 + i % 3]), "h") for i in range(60)]
    rows += [(100 + i, f"footer of the whole site {i % 2} with its own words\nown words of page {i}", "h") for i in range(60)]
    rows += [(200 + i, "\n".join(f"own words {i} {k} a b c d e f" for k in range(4)), "h") for i in range(60)]
    return rows + [(300 + i, "a page that one host holds forty times over\nwith this second line", "h") for i in range(40)]


def test_sql_counts_distinct_pages_as_the_rules_do(spark):
    rows = stock_pages()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    judged, name = quality.quality_rules(docs)
    mine = judged.select("doc_id", f"{name}.*")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    found = con.execute(CHECKS["op10_quality_rules"])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(mine.columns)
    theirs = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert sorted(tuple(r) for r in mine.select(*names).collect()) == theirs
    assert sum(r["n_shared_words"] > 0 for r in mine.collect()) == 120


def test_a_family_sends_fewer_links_than_texts(spark):
    """Near copies that nothing has linked yet, every one under its own label."""
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(150):
        own = list(words)
        own[(i * 7) % 400] = f"own{i}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bits = jaccard.bucket_bits(docs)
    nodes = jaccard.sketches(docs, "doc_id", "text", bits).selectExpr(
        "doc_id AS doc", "doc_id AS label", "n", "frequent", "prefix")
    links = jaccard.family_links(nodes, docs, "doc_id", "text").collect()
    near = {r.doc_id: i for i, r in enumerate(docs.collect())}
    roots = list(range(len(rows)))

    def root(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a, b in links:
        roots[root(near[a])] = root(near[b])
    assert len({root(x) for x in range(len(rows))}) == 1 and len(links) < len(rows)
