"""Operator 6, exact dedup by Patricia-trie owners.

Texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is
deleted.  Each input partition inserts the full normalised byte strings into a compressed
radix trie whose terminal nodes hold the owner so far (most code points, then smallest
doc_id) and a count; so a group of copies leaves a partition as one row however large it
is.  When a trie outgrows its memory it spills its largest subtree as partial owners.
The partial owners meet in partitions of length and content hash, sorted by both, where
a trie for each key merges them byte for byte.  Documents find their owner by the
SHA-256 that the owner's full string gave.

Defined results: a null text counts as empty and all empty texts are one group; a null
doc_id owns a group only if all its longest rows have none; repeated rows get equal
result rows and each counts in group_size; an empty table gives no rows.  Only doc_id and
text are read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StringType

from ._common import SPACE, fresh, small_batches, table, tidy

#: Bytes that one trie may hold before it spills a subtree, and those of a node besides its edge.
TRIE_BYTES, NODE_BYTES = 64 << 20, 400
#: Bytes of texts in one output batch.
BATCH_BYTES = 4 << 20

_PARTIAL = "len long, h long, body binary, cp long, id long, n long"
_NO_ID = (1 << 63) - 1


class Node:
    __slots__ = ("edge", "children", "owner")

    def __init__(self, edge: bytes, children: dict | None = None, owner: tuple | None = None):
        self.edge, self.children, self.owner = edge, children, owner


def _shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by doubling and halving slices."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, step = 0, 64
    while a[lo : lo + step] == b[lo : lo + step]:
        lo += step
        step *= 2
    hi = min(lo + step, n)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class PatriciaTrie:
    """Maps byte strings to (code points, smallest id, count); ``size`` is about the bytes it takes."""

    def __init__(self):
        self.root, self.size = Node(b"", {}), 0

    @staticmethod
    def merge(a: tuple | None, b: tuple) -> tuple:
        if a is None:
            return b
        (cp, i), n = min((-a[0], a[1]), (-b[0], b[1])), a[2] + b[2]
        return (-cp, i, n)

    def insert(self, key: bytes, owner: tuple) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at]) if node.children else None
            if child is None:
                if node.children is None:
                    node.children = {}
                node.children[key[at]] = Node(key[at:], None, owner)
                self.size += len(key) - at + NODE_BYTES
                return
            edge = child.edge
            if key[at : at + len(edge)] == edge:
                node, at = child, at + len(edge)
                continue
            k = _shared_prefix(edge, key[at : at + len(edge)])
            child.edge = edge[k:]
            middle = Node(edge[:k], {edge[k]: child})
            node.children[key[at]] = middle
            self.size += NODE_BYTES
            node, at = middle, at + k
        node.owner = self.merge(node.owner, owner)

    @staticmethod
    def _walk(node: Node, prefix: bytes):
        todo = [(node, prefix)]
        while todo:
            x, p = todo.pop()
            p += x.edge
            if x.owner is not None:
                yield p, x.owner
            if x.children:
                todo.extend((c, p) for c in x.children.values())

    def items(self):
        return self._walk(self.root, b"")

    def spill(self):
        """Takes out the largest subtree below the root and yields its strings with their owners."""

        def weight(top: Node) -> int:
            total, todo = 0, [top]
            while todo:
                x = todo.pop()
                total += len(x.edge) + NODE_BYTES
                if x.children:
                    todo.extend(x.children.values())
            return total

        sizes = {k: weight(c) for k, c in self.root.children.items()}
        k = max(sizes, key=sizes.get)
        self.size -= sizes[k]
        yield from self._walk(self.root.children.pop(k), b"")


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, SPACE)


def _hash(body: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(body)
    return h - (1 << 64) if h >> 63 else h


def _emit(rows, of):
    """Arrow batches of bounded bytes from an iterator of tuples."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2]) if isinstance(row[2], bytes) else 64
        if size >= BATCH_BYTES or len(held) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), of, strict=True)], names=[str(i) for i in range(len(of))])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), of, strict=True)], names=[str(i) for i in range(len(of))])


_PARTIAL_ARROW = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def _named(batches, names):
    for b in batches:
        yield b.rename_columns(names)


def partial_owners(limit: int):
    def run(batches):
        def rows():
            trie = PatriciaTrie()
            for batch in batches:
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    t = t.as_py()
                    trie.insert(normalised(t), (len(t or ""), _NO_ID if i is None else i, 1))
                    while trie.size > limit and trie.root.children:
                        for body, own in trie.spill():
                            yield (len(body), _hash(body), body, *own)
            for body, own in trie.items():
                yield (len(body), _hash(body), body, *own)

        yield from _named(_emit(rows(), _PARTIAL_ARROW), ["len", "h", "body", "cp", "id", "n"])
        tidy()

    return run


def _final_owners(batches):
    """Rows sorted by length and hash: one trie for each such key."""

    def rows():
        trie, key = PatriciaTrie(), None
        for batch in batches:
            cols = [batch.column(j) for j in range(6)]
            for j in range(batch.num_rows):
                now = (cols[0][j].as_py(), cols[1][j].as_py())
                if now != key:
                    for body, (_, i, n) in trie.items():
                        yield hashlib.sha256(body).hexdigest(), i, n
                    trie, key = PatriciaTrie(), now
                trie.insert(cols[2][j].as_py(), (cols[3][j].as_py(), cols[4][j].as_py(), cols[5][j].as_py()))
        for body, (_, i, n) in trie.items():
            yield hashlib.sha256(body).hexdigest(), i, n

    yield from _named(_emit(rows(), [pa.string(), pa.int64(), pa.int64()]), ["owner_sha", "owner_id", "owner_n"])
    tidy()


def _fingerprints(batches):
    for batch in batches:
        sha = [hashlib.sha256(normalised(t.as_py())).hexdigest() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.string())], names=["doc_id", "text_sha256"])


def owners(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(owner_sha, owner_id, owner_n): one row for each distinct normalised text."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    partial = narrow.mapInArrow(partial_owners(trie_bytes), _PARTIAL)
    return partial.repartition("len", "h").sortWithinPartitions("len", "h").mapInArrow(_final_owners, "owner_sha string, owner_id long, owner_n long")


def exact_dedup(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    small_batches(docs.sparkSession)
    prints = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, text_sha256 string")
    joined = prints.join(owners(docs, trie_bytes), F.col("text_sha256") == F.col("owner_sha"))
    keep = F.when(F.col("owner_id") != _NO_ID, F.col("owner_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.col("owner_n").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )


@F.arrow_udf(StringType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(normalised(t.as_py())).hexdigest() for t in texts], pa.string())


def keep_one(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged: of its
    owner's rows the longest, then the first by text."""
    own, owned, sha, nth = (fresh(docs, n) for n in ("_keep_id", "_keep_sha", "_sha", "_nth"))
    kept = exact_dedup(docs, trie_bytes).filter("kept").select(F.col("text_sha256").alias(owned), F.col("doc_id").alias(own)).distinct()
    joined = docs.withColumn(sha, _fingerprint("text")).join(kept, (F.col(sha) == F.col(owned)) & F.col("doc_id").eqNullSafe(F.col(own))).drop(own, owned)
    first = Window.partitionBy(sha).orderBy(F.length("text").desc_nulls_last(), "text")
    return joined.withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1).drop(nth, sha)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def oracle() -> str:
    return """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
 o AS (SELECT norm, count(*) AS n, max(length(t)) AS cp FROM d GROUP BY norm),
 k AS (SELECT o.norm, o.n, min(d.doc_id) AS keep_id FROM o JOIN d ON o.norm = d.norm AND length(d.t) = o.cp GROUP BY o.norm, o.n)
SELECT d.doc_id, k.keep_id, CAST(k.n AS BIGINT) AS group_size, d.doc_id = k.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN k ON d.norm = k.norm"""
