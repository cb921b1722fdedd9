"""Counts of n-grams inside record batches, so that a frequent term is one row of a batch before it is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BATCH_WORDS = 1_000_000


def word_runs(sizes: np.ndarray, most: int = BATCH_WORDS) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of rows with about `most` words; a longer row is a run of its own."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        after = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield first, after - first
        first = after


def count_grams(group: pa.Array, words: pa.Array, low: int, high: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(groups, terms, counts) of the n-grams of each length; they do not cross from one row into the next."""
    groups, flat = group.dictionary_encode("encode"), words.flatten().dictionary_encode()
    number, names = flat.indices.to_numpy().astype(np.int64), flat.dictionary
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    owner = np.repeat(groups.indices.to_numpy().astype(np.int64), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(number))  # words from here to the end of the row
    gram, at = number, np.arange(len(number))
    for n in range(1, high + 1):
        if n > 1:
            whole = left[at] >= n
            at = at[whole]
            gram = gram[whole] * len(names) + number[at + n - 1]
            if n < high:
                gram = np.unique(gram, return_inverse=True)[1]  # small numbers for the next length
        if n >= low and len(at):
            _, first, counts = np.unique(gram * len(groups.dictionary) + owner[at], return_index=True, return_counts=True)
            start = at[first]
            parts = [names.take(pa.array(number[start + i])) for i in range(n)]
            terms = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
            yield groups.dictionary.take(pa.array(owner[start])), terms, counts


def batch_gram_counts(rows: DataFrame, group: str, low: int, high: int) -> DataFrame:
    """(group, term, n) from (group, words): one row for each group and n-gram of a batch of about a million words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, words = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
            for first, many in word_runs(sizes):
                for owner, terms, counts in count_grams(groups.slice(first, many), words.slice(first, many), low, high):
                    yield pa.RecordBatch.from_arrays([owner, terms, pa.array(counts, pa.int64())], [group, "term", "n"])

    kind = rows.schema[group].dataType.simpleString()
    return rows.select(group, "words").mapInArrow(count, f"{group} {kind}, term string, n bigint")
