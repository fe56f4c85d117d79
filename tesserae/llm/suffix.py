"""Exact byte-substring dedup by longest previous factors over suffix arrays (operator 9).

In each group of runs (see repeats.py) suffixes are sorted, with their longest common prefixes. The longest previous
factor of a suffix is its longest match with a suffix at an earlier place: among all of them that is one of two, the nearest in
suffix order before it and after it whose place is smaller. Where it has `width` bytes or more, the suffix is a later copy.
`keep="first"` removes the bytes of these factors and so keeps each passage's first place. `keep="none"` (what the query asks
for) removes every copy: then the longest next factor, by the nearest greater places, counts as well. Texts are UTF-8
bytes; cuts may split a character, so kept texts are binary.

See repeats.py for nulls, empty and long texts, ties and repeated rows (rows of equal key and text are one place: neither
is the other's later copy).
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common, repeats
from tesserae.llm.suffix_array import Suffixes, deep_nodes, minima, nearest_smaller, range_min, window_starts

WIDTH = 400
GRAM = 32


def previous_factors(lcp: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix in order, length) of the longest previous factors of `width` or more; place: by suffix order, all different."""
    begin, end, _ = deep_nodes(lcp, width)  # a match of that length stays within such a range
    sizes = end - begin
    row = common.ragged(begin, sizes)
    first = np.cumsum(sizes) - sizes
    low, high = np.repeat(first, sizes), np.repeat(first + sizes, sizes)
    before, after = nearest_smaller(place[row].astype(np.int32), low, high)
    tables = minima(lcp[row].astype(np.int32), int(sizes.max(initial=1)))
    here, length = np.arange(len(row)), np.zeros(len(row), np.int64)
    some = np.flatnonzero(before >= 0)
    length[some] = range_min(tables, before[some] + 1, here[some] + 1)
    some = np.flatnonzero(after >= 0)
    length[some] = np.maximum(length[some], range_min(tables, here[some] + 1, after[some] + 1))
    found = length >= width
    return row[found], length[found]


def copies(group: repeats.Group, width: int, keep: str) -> tuple[np.ndarray, ...]:
    """(run, start, end, key, place): what goes of the occurrences of each run beyond a place."""
    run, at = window_starts(group.first, width)
    s = Suffixes(group.codes, group.first, at)
    offset = at - group.first[run]
    place = np.empty(len(at), np.int64)
    place[np.lexsort((group.place[run] + offset, group.key[run]))] = np.arange(len(at))
    place = place[s.order]
    longest = np.zeros(len(at), np.int64)
    for sign in (1, -1) if keep == "none" else (1,):
        suffix, length = previous_factors(s.lcp, sign * place, width)
        longest[s.order[suffix]] = np.maximum(longest[s.order[suffix]], length)
    bounds = np.searchsorted(run, np.arange(len(group.first)))
    r, first, last = repeats.stretches(longest > 0, bounds)
    ends = np.append(offset + longest, 0)
    stop = np.maximum.reduceat(ends, np.stack((bounds[r] + first, bounds[r] + last + 1), 1).ravel())[::2] if len(r) else last
    many = np.flatnonzero(group.times > 1)
    cat = lambda a, b: np.concatenate((a, b))
    whole = (np.full(len(many), repeats.ALWAYS), np.full(len(many), repeats.NOWHERE)) if keep == "none" else (group.key[many], group.place[many])
    return cat(r, many), cat(first, 0 * many), cat(stop, np.diff(group.first)[many]), cat(np.full(len(r), repeats.ALWAYS), whole[0]), cat(np.full(len(r), repeats.NOWHERE), whole[1])


def spec(width: int = WIDTH, keep: str = "none") -> repeats.Spec:
    return repeats.Spec("bytes", width, min(GRAM, width), partial(copies, keep=keep), keep)


def dedup(docs: DataFrame, width: int = WIDTH, keep: str = "first", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_units (bytes), n_removed, n_spans, kept (binary)."""
    return repeats.removed(docs, spec(width, keep), key, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(common.read(spark, sf_dir, "documents"), keep="none")
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
