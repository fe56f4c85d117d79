"""Substring dedup over word windows by prefix-partitioned suffix trees (operator 8).

Suffixes are dealt out by prefixes of varying length, lengthened until a group fits in memory (see repeats.py). Each
group's suffix tree is held as its suffix array with longest common prefixes, where an internal node is a range of the
order. The nodes right below depth `width` are the deep ones: all suffixes below one share a passage of that node's own depth, which
is repeated there and can't be made longer on the right. The smallest key below a node keeps its copy, and every suffix below
it of a larger key loses the whole passage. Windows are judged on the input. maximal_repeats() lists the deep nodes of
a whole tree that differ on the left too.

See repeats.py for nulls, empty and long texts, ties and repeated rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common, repeats
from tesserae.llm.suffix_array import Suffixes, deep_nodes, internal_nodes, window_starts

WIDTH = 50
GRAM = 8


def passages(group: repeats.Group, width: int) -> tuple[np.ndarray, ...]:
    """(run, start, end, key, place): the units that a smaller key has too, in all occurrences of a larger key."""
    run, at = window_starts(group.first, width)
    s = Suffixes(group.codes, group.first, at)
    begin, end, depth = deep_nodes(s.lcp, width)
    leaves = common.ragged(begin, end - begin)
    node = np.repeat(np.arange(len(begin)), end - begin)
    suffix = s.order[leaves]
    owner = group.key[run[suffix]]
    least = np.minimum.reduceat(owner, np.cumsum(end - begin) - (end - begin)) if len(begin) else owner
    lose = least[node] < owner
    suffix, head, size = suffix[lose], least[node[lose]], depth[node[lose]]
    order = np.argsort(suffix)
    suffix, head, size = suffix[order], head[order], size[order]
    r, p = run[suffix], at[suffix] - group.first[run[suffix]]
    # neighbouring suffixes that lose to one key are one stretch
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1) | (head[1:] != head[:-1])
    first = np.flatnonzero(new)
    stop = np.maximum.reduceat(p + size, first) if len(first) else p
    many = np.flatnonzero(group.times > 1)  # all but the smallest key lose a run that is there several times
    cat = lambda a, b: np.concatenate((a, b))
    return cat(r[first], many), cat(p[first], 0 * many), cat(stop, np.diff(group.first)[many]), cat(head[first], group.key[many]), np.full(len(first) + len(many), repeats.NO_PLACE)


def maximal_repeats(codes: np.ndarray, first: np.ndarray, width: int) -> list[tuple[int, int, list[int]]]:
    """(length, times, places) of each repeat of `width` units or more that can't be made longer on either side."""
    _, at = window_starts(first, width)
    s = Suffixes(codes, first, at)
    out = []
    for a, b, depth in zip(*(x.tolist() for x in internal_nodes(s.lcp, width)), strict=True):
        places = np.sort(at[s.order[a:b]])
        before = np.where(np.isin(places, first), -1 - np.arange(len(places)), codes[places - 1].astype(np.int64))
        if len(np.unique(before)) > 1:
            out.append((depth, b - a, places.tolist()))
    return out


def spec(width: int = WIDTH) -> repeats.Spec:
    return repeats.Spec("words", width, min(GRAM, width), passages, "smaller")


def dedup(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_units (words), n_removed, n_spans, kept (words joined by one space, binary)."""
    return repeats.removed(docs, spec(width), key, text)


def rewritten(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the removed words taken out: texts that lose none stay as they are, the others' kept words are joined
    by one space, and rows that lose all their words go."""
    others = [c for c in docs.columns if c != key]
    out = repeats.removed(docs, spec(width), key, text, tuple(others))
    named = {c: F.col(f"carry_{k}").alias(c) for k, c in enumerate(others)} | {key: F.col(key)}
    named[text] = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col(f"carry_{others.index(text)}")).alias(text)
    return out.where("n_removed = 0 or n_removed < n_units").select(*(named[c] for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(common.read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
