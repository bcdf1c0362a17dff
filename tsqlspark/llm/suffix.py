"""Operator 10, suffix-array dedup with sparse suffix arrays.

Only suffixes that start at content-selected minimiser positions are kept (see
``spans``: the anchors).  All suffixes of a shard, whatever their anchors, are sorted and
neighbours compared, which gives their common prefixes to the right; runs of neighbours
that share enough are then extended word by word to the left.  A passage of ``LENGTH`` words or more that also stands in a
document with a smaller doc_id is removed.

Defined results: as for operator 2 (``substring``), with windows of ``LENGTH`` words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import spans
from ._common import table
from .substring import oracle as _window_oracle

LENGTH, GRAM = 50, 10


def _common(a: list, b: list) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def by_suffix_array(regions: list[list[bytes]], splits: list[int], owners: list[int], length: int) -> list[list[int]]:
    """Of the window that starts ``left`` words before its anchor, the words from the anchor on
    are a common prefix of neighbours in the sparse suffix array; those before it are compared
    by prolonging each match leftwards, one word for each step of ``left``."""
    rights = [r[a:] for r, a in zip(regions, splits, strict=True)]
    order = sorted(range(len(regions)), key=lambda i: rights[i])
    lcp = [0, *[_common(rights[order[k - 1]], rights[order[k]]) for k in range(1, len(order))]]
    out = [[owners[i]] * (len(r) - length + 1) for i, r in enumerate(regions)]
    # matches further left need fewer words on the right: runs of neighbours grow as ``left`` does
    same = [0] * len(regions)  # number of the class of equal words to the left, for each region
    for left in range(max(splits, default=-1) + 1):
        need, k = length - left, 0  # words from the anchor on
        if left:
            classes: dict[tuple, int] = {}
            for i, r in enumerate(regions):
                if same[i] >= 0:
                    a = splits[i]
                    same[i] = classes.setdefault((same[i], r[a - left]), len(classes)) if left <= a else -1
        while k < len(order):
            e = k + 1
            while e < len(order) and lcp[e] >= need:
                e += 1
            if e - k > 1:
                least: dict[int, int] = {}
                members = [i for i in order[k:e] if same[i] >= 0 and len(rights[i]) >= need]
                for i in members:
                    least[same[i]] = min(owners[i], least.get(same[i], owners[i]))
                for i in members:
                    out[i][splits[i] - left] = least[same[i]]
            k = e
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH, frequent: int = spans.FREQUENT) -> DataFrame:
    return spans.strip(docs, by_suffix_array, length, GRAM, frequent)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def oracle() -> str:
    return _window_oracle(LENGTH)
