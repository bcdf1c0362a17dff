"""Repeated word windows across documents, shared by operators 2 and 10.

A window is ``length`` consecutive words of one document; it is repeated if its word
sequence also starts in a document with a smaller doc_id.  Every window selects the
smallest-hashed run of ``gram`` words in it (a minimiser), so equal windows select equal
anchors at equal places.  Windows next to each other that select the same anchor form a
region, whose words are all that is needed to compare them.

1. Anchors are found once and counted; those that stand in one text only end here.
2. Texts with shared anchors give their regions.  An anchor of very many regions would
   gather them all in one place; its regions are cut into windows, each with a key of its
   own, so that no key gathers many different regions.
3. Equal regions collapse to the smallest doc_id before and during a shuffle; what is left
   is dealt by key and read as reference shards of about ``SHARD_WORDS`` words.  An engine
   (suffix automaton, sparse suffix array) is built of every shard, and its regions are
   streamed past it to find the smallest doc_id of each window.
4. Results go back to the documents by region, and words of repeated windows go.

A row's text is known by a hash of doc_id and text, so rows of one doc_id may differ.
Shared folders hold the regions; nothing is collected to the driver or broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Words, drop_stored, freed, mix64, small_batches, stored, tidy

#: Regions from which an anchor counts as frequent.
FREQUENT = 500
#: Words of a reference shard, about.
SHARD_WORDS = 1 << 14
_CHUNK = 1 << 21


def _texts(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _pieces(texts: list[bytes]):
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= _CHUNK:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def regions_of(w: Words, length: int, gram: int):
    """Regions of all texts: (text, first window's word index, number of windows, anchor's word index and hash)."""
    g, _ = w.grams(gram)
    span = length - gram + 1
    n = len(w.hash) - length + 1
    empty = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    if n <= 0:
        return empty
    pick = np.arange(n) + np.lib.stride_tricks.sliding_window_view(g, span)[:n].argmin(1)
    ok = np.flatnonzero(w.doc[:n] == w.doc[length - 1 :])
    if not len(ok):
        return empty
    pick = pick[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (w.doc[ok[1:]] != w.doc[ok[:-1]])
    starts = np.flatnonzero(new)
    count = np.diff(np.append(starts, len(ok)))
    return w.doc[ok[starts]], ok[starts], count, pick[starts], g[pick[starts]]


def _anchors(length: int, gram: int):
    def run(batches):
        for b in batches:
            rows, texts = b.column(0).to_numpy(zero_copy_only=False), _texts(b.column(1))
            for lo, hi in _pieces(texts):
                doc, _, _, _, h = regions_of(Words(texts[lo:hi]), length, gram)
                if len(doc):
                    both, n = np.unique(np.stack([doc.astype(np.uint64), h]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(both[1].view(np.int64)), pa.array(rows[lo:hi][both[0].astype(np.int64)]), pa.array(n.astype(np.int32))], names=["h", "row", "m"]
                    )
        tidy()

    return run


def _regions(length: int, gram: int):
    def run(batches):
        for b in batches:
            ids, rows, texts = b.column(0), b.column(1), _texts(b.column(2))
            shared, often = b.column(3), b.column(4)
            for lo, hi in _pieces(texts):
                w = Words(texts[lo:hi])
                doc, at, n, anchor, h = regions_of(w, length, gram)
                # keep regions whose anchor the text shares
                pick, cut = [], []
                bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
                for k in range(hi - lo):
                    own = h[bounds[k] : bounds[k + 1]].view(np.int64)
                    known = shared[lo + k].values.to_numpy()
                    order = np.argsort(known)
                    spot = np.minimum(np.searchsorted(known, own, sorter=order), len(known) - 1)
                    hit = known[order[spot]] == own
                    pick.append(bounds[k] + np.flatnonzero(hit))
                    cut.append(often[lo + k].values.to_numpy(zero_copy_only=False)[order[spot]][hit])
                if not pick:
                    continue
                pick, cut = np.concatenate(pick), np.concatenate(cut).astype(bool)
                whole, parted = pick[~cut], pick[cut]
                reps = n[parted]
                first = np.concatenate([at[whole], np.repeat(at[parted], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)])
                count = np.concatenate([n[whole], np.ones(int(reps.sum()), np.int64)])
                owner, split, key = (np.concatenate([x[whole], np.repeat(x[parted], reps)]) for x in (doc, anchor, h))
                split = (split - first).astype(np.int32)
                if len(parted):
                    win, _ = w.grams(length)
                    key[len(whole) :] = mix64(win[first[len(whole) :]] ^ key[len(whole) :])
                data, start, end = w.data, w.start, w.end
                for s in range(0, len(first), 20_000):
                    f, c = first[s : s + 20_000], count[s : s + 20_000]
                    body = [data[x:y] for x, y in zip(start[f].tolist(), end[f + c + length - 2].tolist(), strict=True)]
                    o = owner[s : s + 20_000]
                    here = pa.array(lo + o)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(here), rows.take(here), pa.array((f - w.bounds[o]).astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(split[s : s + 20_000]),
                         pa.array(key[s : s + 20_000].view(np.int64)), pa.array([b" ".join(x.split()) for x in body], pa.binary())],
                        names=["doc_id", "row", "at", "n", "split", "key", "body"],
                    )
        tidy()

    return run


#: An engine gets the distinct regions of a shard as lists of words in ascending order of the
#: smallest doc_id of each, where the anchor is in each, and these doc_ids; it gives for each
#: region the smallest doc_id of each of its windows.
Engine = Callable[[list[list[bytes]], list[int], list[int], int], list[list[int]]]


def _solve(engine: Engine, length: int):
    """Rows sorted by key; a shard ends with a key."""

    def run(batches):
        held: list[tuple] = []
        key, words = None, 0

        def shard():
            held.sort(key=lambda r: r[2])
            regions = [r[1].split(b" ") for r in held]
            got = engine(regions, [r[3] for r in held], [r[2] for r in held], length)
            out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.binary()), pa.array(got, pa.list_(pa.int64()))], names=["key", "body", "least"])
            held.clear()
            return out

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if words >= SHARD_WORDS and row[0] != key:
                    yield shard()
                    words = 0
                key = row[0]
                held.append(row)
                words += row[1].count(b" ") + 1
        if held:
            yield shard()
        tidy()

    return run


def _strip(length: int):
    def run(batches):
        for b in batches:
            n_words, n_removed, sha = [], [], []
            for text, starts, counts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                w = (text or "").encode("utf-8", "surrogatepass").split()
                kept = w
                if starts:
                    edge = np.zeros(len(w) + 1, np.int32)
                    s = np.array(starts)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + np.array(counts) + length - 1, -1)
                    kept = [w[i] for i in np.flatnonzero(edge.cumsum()[:-1] == 0)]
                n_words.append(len(w))
                n_removed.append(len(w) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def repeated(docs: DataFrame, engine: Engine, length: int, gram: int, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, row, starts, counts): for each text with repeated windows, runs of ``counts``
    consecutive windows from word ``starts`` on.  Rows without doc_id are not compared."""
    small_batches(docs.sparkSession)
    narrow = _rows(docs).filter("doc_id IS NOT NULL")
    # kept on executors' disks, and computed again where an executor is lost
    anchors = narrow.select("row", "text").mapInArrow(_anchors(length, gram), "h long, row long, m int").persist(StorageLevel.DISK_ONLY)
    shared = anchors.groupBy("h").agg(F.count("*").alias("c"), F.sum("m").alias("m")).filter("c > 1").select("h", (F.col("m") > frequent).alias("often"))
    lists = anchors.join(shared, "h").groupBy("row").agg(F.collect_list("h").alias("hs"), F.collect_list("often").alias("often"))
    regions = narrow.join(lists, "row").select("doc_id", "row", "text", "hs", "often")
    regions = stored(regions.mapInArrow(_regions(length, gram), "doc_id long, row long, at int, n int, split int, key long, body binary"))
    anchors.unpersist()
    freed(docs.sparkSession)  # the next shuffles are as large as those before
    reps = regions.groupBy("key", "body").agg(F.min("doc_id").alias("owner"), F.min("split").alias("split")).repartition("key").sortWithinPartitions("key")
    solved = reps.mapInArrow(_solve(engine, length), "key long, body binary, least array<long>")
    solved = stored(solved.select("key", F.xxhash64("body").alias("rid"), F.array_max("least").alias("most"), "least"))
    back = regions.select("doc_id", "row", "at", "n", "key", F.xxhash64("body").alias("rid")).join(solved, ["key", "rid"])
    runs = F.when(F.col("most") < F.col("doc_id"), F.array(F.struct(F.col("at").alias("s"), F.col("n").alias("c")))).otherwise(
        F.expr("transform(filter(sequence(0, n - 1), i -> least[i] < doc_id), i -> struct(at + i AS s, 1 AS c))")
    )
    runs = back.select("doc_id", "row", F.explode(runs).alias("r"))
    runs = stored(runs.groupBy("doc_id", "row").agg(F.collect_list("r.s").alias("starts"), F.collect_list("r.c").alias("counts")))
    drop_stored(regions)
    drop_stored(solved)
    return runs


def _rows(docs: DataFrame) -> DataFrame:
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return named.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def strip(docs: DataFrame, engine: Engine, length: int, gram: int, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each document."""
    runs = repeated(docs, engine, length, gram, frequent).withColumnsRenamed({"doc_id": "r_id", "row": "r_row"})
    joined = _rows(docs).join(runs, (F.col("row") == F.col("r_row")) & (F.col("doc_id") == F.col("r_id")), "left")
    return joined.select("doc_id", "text", "starts", "counts").mapInArrow(_strip(length), "doc_id long, n_words long, n_removed long, kept_sha256 string")
