"""Operator 9, n-gram Jaccard join by universe partition and pigeonhole.

A document's set are the 64-bit hashes of its distinct word shingles.  Sets of x and y
elements that link differ in at most ``H = 15 (x + y) // 185`` elements (for 0.85).  By
size band the universe of hashes is cut into m segments:

* Large sets: m > H, so at least m - H segments of two linked sets are equal.  The
  segments' contents are the keys.  Each set leaves m - H - 1 of them unused (the
  allocation): empty ones, then those whose content the most sets have.  As all sets
  follow one order of the keys, the cheapest key that two linked sets share stays.
* Small sets, whose segments would be nearly empty: m = H // 2 + 1, so that one segment
  differs in one element at most.  The segments and their one-deletion neighbourhoods are
  indexed, which costs more keys but fewer candidates there.

``_allocate`` takes the cheaper of the two for a band.  Two sets whose sizes allow a link
share the band of the larger one.

Sets that are equal form a class, and only its smallest document goes on.  A key's
members are first compared with its smallest member only, then links are joined to
components; then, where a key still holds several components, members are compared with
one of its largest component, and at last those that are still in different components
with each other.  Before a pair is verified, two bounds are taken from what a key's members
carry: the shingles that only one of them has, and the parity sketches of both sets.  A
sketch has a bit for each of ``SKETCH_BITS`` hash cells, set if an odd number of the set's
shingles falls there; what two sets share cancels out, so the bits in which their sketches
differ are no more than the shingles in which the sets do.  Texts that share a template but
do not link are thereby told apart where they meet, and what is verified grows with the
links.  Every other candidate pair is either verified on the texts' shingles themselves or
already joined, and no group is written out as all its pairs.

Links lie within components, so all of them are counted there at last: the members of each
component are compared with each other, a large component in blocks of which any two meet
in one task, by products of matrices of texts and shingles (the shingles themselves).

Defined results: a null, empty or wordless text has an empty set and links with nothing;
a null doc_id links with nothing and has no component; repeated rows each get a row; an
empty table gives no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Words, bounded, drop_stored, freed, fresh, mix64, small_batches, stored, table, tidy

PERCENT, SHINGLE = 85, 4
#: Rounds that compare a key's members with one other each before the rest are compared.
LINEAR_ROUNDS = 2
#: Keys of a text that are looked at to tell whether a pair has been met before; others
#: only cost a repeated pair.
FIRST_KEYS = 32
#: Texts, and shingles of all of them, in a block of a component when its links are counted.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 19
SKETCH_BITS = 1024
_COLUMNS = 4096
_CHUNK = 1 << 21
_C1, _C2, _C3 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def most_different(x: int, y: int, percent: int) -> int:
    """Largest symmetric difference of linked sets of x and y elements."""
    return (100 - percent) * (x + y) // (100 + percent)


def bands(percent: int, ratio: float = 1.5, top: int = 1 << 31) -> list[tuple[int, int]]:
    """Size bands [low, high); below the first a link needs equal sets."""
    low = 1
    while not most_different(low, 100 * low // percent, percent):
        low += 1
    out = []
    while low < top:
        high = max(low + 1, int(low * ratio))
        out.append((low, high))
        low = high
    return out


def _allocate(low: int, high: int, percent: int) -> tuple[str, int]:
    """('equal' or 'deletion', number of segments) for a band, by estimated cost.

    Equal segments cost a key each; the empty ones that cannot be left out cannot tell sets
    apart, which is charged as candidates.  Deletion neighbourhoods cost one key for each
    element more."""
    h = most_different(high - 1, high - 1, percent)
    equal, deletion = -(-5 * (h + 1) // 4), h // 2 + 1
    forced = 0.0
    for size in (low, high - 1):
        empty = equal * np.exp(-size / equal)
        spare = equal - most_different(size, min(100 * size // percent, high - 1), percent) - 1
        forced = max(forced, empty + 3 * np.sqrt(empty) - spare)
    return ("equal", equal) if equal + 100 * forced < deletion + high else ("deletion", deletion)


class Sets:
    """Distinct shingle hashes of several texts: ``hash`` sorted within ``doc``."""

    def __init__(self, texts: list[bytes], k: int):
        w = Words(texts, lower=True)
        g, ok = w.grams(k)
        doc, h = w.doc[: len(g)][ok], g[ok]
        count = np.diff(w.bounds)
        for i in np.flatnonzero((count > 0) & (count < k)):  # the whole sequence as one
            total = mix64(w.hash[w.bounds[i] : w.bounds[i + 1]])
            x = np.array([count[i]], np.uint64)
            for y in total:
                x = mix64((x * _C1) ^ y)
            doc, h = np.append(doc, i), np.append(h, x)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.doc, self.hash, self.texts = doc[new], h[new], len(texts)
        self.size = np.bincount(self.doc, minlength=self.texts)

    def sums(self, of: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
        """Sums of uint64 modulo 2^64 by index."""
        low = np.bincount(where, (of & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
        high = np.bincount(where, (of >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
        return low + (high << np.uint64(32))

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums that identify each text's set."""
        return tuple(self.sums(mix64(self.hash ^ c), self.doc, self.texts) for c in (_C1, _C2))


def keys_of(sets: Sets, percent: int, table_: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, key, spare): the index's keys, and for each place how many of its keys may go
    unused.  A place is twice a text's number, and one more for the keys under which the text
    is the smaller set of the next band."""
    at_out, keys_out, spare_out = [], [], np.zeros(2 * sets.texts, np.int64)
    lows = np.array([b[0] for b in table_])
    band = np.searchsorted(lows, sets.size, side="right") - 1
    for up in (0, 1):
        at = band + up
        use = (at >= 0) & (at < len(lows)) & (sets.size > 0)
        if up:
            use &= 100 * sets.size // percent >= lows[np.clip(at, 0, len(lows) - 1)]
        for b in np.unique(at[use]):
            low, high = table_[b]
            kind, m = _allocate(low, high, percent)
            mine = use & (at == b)
            pick = mine[sets.doc]
            doc, h = sets.doc[pick], sets.hash[pick]
            seg = (((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
            value, salt = mix64(h ^ _C3), mix64(np.arange(m, dtype=np.uint64) + np.uint64(int(b) << 24))
            ids = np.flatnonzero(mine)
            place = np.searchsorted(ids, doc)
            cell = place * m + seg
            content = sets.sums(value, cell, len(ids) * m)
            full = mix64(content ^ np.tile(salt, len(ids)))
            if kind == "deletion":
                at_out += [np.repeat(2 * ids + up, m), 2 * ids[place] + up]
                keys_out += [full, mix64((content[cell] - value) ^ salt[seg])]
                continue
            empty = np.bincount(cell, minlength=len(ids) * m).reshape(len(ids), m) == 0
            size = sets.size[ids]
            spare = m - (100 - percent) * (size + np.minimum(100 * size // percent, high - 1)) // (100 + percent) - 1
            empties = empty.sum(1)
            # empty segments are the first to go, the last of them before the others
            kept = (~empty | (np.cumsum(empty, axis=1) <= (empties - spare)[:, None])).ravel()
            spare_out[2 * ids + up] = np.maximum(0, spare - empties)
            at_out.append(np.repeat(2 * ids + up, m)[kept])
            keys_out.append(full[kept])
    if not at_out:
        return np.empty(0, np.int64), np.empty(0, np.uint64), spare_out
    return np.concatenate(at_out), np.concatenate(keys_out), spare_out


def _pieces(batch):
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
    ids, first, size = batch.column(0), 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= _CHUNK or i == len(texts) - 1:
            yield ids.slice(first, i + 1 - first), texts[first : i + 1]
            first, size = i + 1, 0


_INDEX = "doc_id long, up int, n long, p1 long, p2 long, spare long, keys array<long>"


def _index(k: int, percent: int):
    """A row for each text, and one more (``up``) for those that may be the smaller set of a
    pair in the next band."""

    def run(batches):
        own = bands(percent)
        for b in batches:
            for ids, texts in _pieces(b):
                s = Sets(texts, k)
                at, key, spare = keys_of(s, percent, own)
                count = np.bincount(at, minlength=2 * s.texts)
                rows = np.flatnonzero((count > 0) | (np.arange(2 * s.texts) % 2 == 0))
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count[rows])]).astype(np.int32), key[np.argsort(at, kind="stable")].view(np.int64))
                text = rows // 2
                p1, p2 = s.prints()
                long = [s.size.astype(np.int64)[text], p1.view(np.int64)[text], p2.view(np.int64)[text], spare[rows]]
                columns = [ids.take(pa.array(text)), pa.array((rows % 2).astype(np.int32)), *map(pa.array, long), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "up", "n", "p1", "p2", "spare", "keys"])
        tidy()

    return run


def _elements(k: int):
    def run(batches):
        for b in batches:
            for ids, texts in _pieces(b):
                s = Sets(texts, k)
                columns = [ids.take(pa.array(s.doc)), pa.array(s.size.astype(np.int64)[s.doc]), pa.array(s.hash.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "h"])
        tidy()

    return run


def _sketches(k: int):
    """The parity sketch of each text's set, as 64-bit words."""

    def run(batches):
        for b in batches:
            for ids, texts in _pieces(b):
                s = Sets(texts, k)
                cell = (mix64(s.hash ^ _C2) >> np.uint64(32)).astype(np.int64) % SKETCH_BITS
                bits = np.bincount(s.doc * SKETCH_BITS + cell, minlength=s.texts * SKETCH_BITS) & 1
                words = np.packbits(bits.astype(np.uint8).reshape(-1, 8), axis=1).reshape(-1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(s.texts + 1, dtype=np.int32) * (SKETCH_BITS // 64)), pa.array(words))
                yield pa.RecordBatch.from_arrays([ids, pa.array(s.size.astype(np.int64)), lists], names=["doc_id", "n", "sketch"])
        tidy()

    return run


def shingles(text: str | None, k: int) -> set[bytes]:
    """The set itself, as byte strings."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) < k:
        return {b" ".join(w)} if w else set()
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}


def _verify(k: int, percent: int):
    def run(batches):
        last, left = None, set()
        for b in bounded(batches):
            a_ids, b_ids, a_text, b_text = (b.column(i).to_pylist() for i in range(4))
            keep = []
            for i, (x, t, u) in enumerate(zip(a_ids, a_text, b_text, strict=True)):
                if x != last:
                    last, left = x, shingles(t, k)
                right = shingles(u, k)
                both = len(left & right)
                if both and 100 * both >= percent * (len(left) + len(right) - both):
                    keep.append(i)
            at = np.array(keep, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a_ids, np.int64)[at]), pa.array(np.array(b_ids, np.int64)[at])], names=["a", "b"])
        tidy()

    return run


def _degrees(left: list[tuple[int, set]], right: list[tuple[int, set]] | None, percent: int) -> list[tuple[int, int]]:
    """(document, links) for documents and their sets, sorted by document: links of ``left``
    with ``right`` for both, or those among ``left``.  Repeated documents count once."""
    every = left + (right or [])
    if len(every) == 2:  # most components
        (x, a), (y, b) = every
        both = len(a & b)
        return [(x, 1), (y, 1)] if x != y and 100 * both >= percent * (len(a) + len(b) - both) else []
    number: dict[bytes, int] = {}
    own = [np.array([number.setdefault(h, len(number)) for h in s], np.int64) for _, s in every]
    # shingles of one text only are in no intersection
    often = np.bincount(np.concatenate(own), minlength=len(number)) > 1
    column = np.cumsum(often) - 1
    size = np.array([len(s) for _, s in every], np.int64)
    where = np.repeat(np.arange(len(every)), size)
    at = np.concatenate(own)
    where, at = where[often[at]], column[at[often[at]]]
    order = np.argsort(at, kind="stable")
    where, at, n = where[order], at[order], len(left)
    both = np.zeros((n, len(every) - n if right else n), np.float32)
    for low in range(0, int(often.sum()), _COLUMNS):
        i, j = np.searchsorted(at, [low, low + _COLUMNS])
        dense = np.zeros((len(every), _COLUMNS if len(every) > 64 else int(at[j - 1]) + 1 - low), np.float32)
        dense[where[i:j], at[i:j] - low] = 1
        both += dense[:n] @ dense[n if right else 0 :].T
    both = both.astype(np.int64)
    link = 100 * both >= percent * (size[:n, None] + size[None, n if right else 0 :] - both)
    ids = np.array([x for x, _ in every], np.int64)
    (a, at_a), (b, at_b) = (np.unique(x, return_index=True) for x in (ids[:n], ids[n if right else 0 :]))
    link = np.logical_or.reduceat(np.logical_or.reduceat(link, at_a, axis=0), at_b, axis=1)
    if not right:
        np.fill_diagonal(link, False)
        return list(zip(a.tolist(), link.sum(1).tolist(), strict=True))
    return [*zip(a.tolist(), link.sum(1).tolist(), strict=True), *zip(b.tolist(), link.sum(0).tolist(), strict=True)]


def _counted(k: int, percent: int):
    """Links of each document of a unit; rows are sorted by unit, side and document."""

    def run(batches):
        def rows():
            unit, sides, last = None, ([], []), None
            for b in batches:
                for comp, i, j, side, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (comp, i, j) != unit:
                        if unit:
                            yield from _degrees(sides[0], sides[1] if unit[1] != unit[2] else None, percent) if sides[0] and (sides[1] or unit[1] == unit[2]) else []
                        unit, sides, last = (comp, i, j), ([], []), None
                    if (doc, text) != last:
                        sides[side].append((doc, shingles(text, k)))
                        last = (doc, text)
            if unit:
                yield from _degrees(sides[0], sides[1] if unit[1] != unit[2] else None, percent) if sides[0] and (sides[1] or unit[1] == unit[2]) else []

        held = []
        for row in rows():
            held.append(row)
            if len(held) >= 8192:
                yield _pairs(held)
                held = []
        if held:
            yield _pairs(held)

    return run


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["d_id", "n_links"])


def degrees(labels: DataFrame, sized: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """(d_id, n_links): all links of each document of ``labels``.  Links lie within components;
    a component is cut into blocks by a hash of the document, and each two of its blocks (or
    one block with itself) are compared in one place, where only counts leave."""
    own = stored(labels.join(sized.groupBy(F.col("doc_id").alias("id")).agg(F.max("n").alias("n")), "id"))
    sizes = own.groupBy("label").agg(F.count("*").alias("c"), F.sum("n").alias("s")).filter("c > 1")
    sizes = sizes.select("label", F.ceil(F.greatest(F.col("c") / BLOCK_TEXTS, F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    at = own.join(sizes, "label").withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    units = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("at", x).alias("i"), F.greatest("at", x).alias("j"), (x < F.col("at")).cast("int").alias("side")))
    dealt = texts.join(at.select(F.col("id").alias("doc_id"), "label", units.alias("units")), "doc_id").select("label", F.explode("units").alias("unit"), "doc_id", "text")
    unit = ["label", "i", "j"]
    rows = dealt.select("label", "unit.i", "unit.j", "unit.side", "doc_id", "text").repartition(*unit).sortWithinPartitions(*unit, "side", "doc_id", "text")
    return rows.mapInArrow(_counted(k, percent), "d_id long, n_links long").groupBy("d_id").agg(F.sum("n_links").alias("n_links"))


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable from each id of ``links`` (a, b), by label
    propagation with pointer jumping; each round is written and read again."""
    edges = stored(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "id"))
    while True:
        near = edges.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(near, F.col("id") == F.col("a")).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hop = labels.select(F.col("id").alias("h"), F.col("label").alias("hop"))
        new = stored(nearer.join(hop, F.col("label") == F.col("h"), "left").select("id", "old", F.least("label", "hop").alias("label")))
        labels = new.select("id", "label")
        if new.filter("old <> label").isEmpty():
            return labels


def linked(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE, count: bool = True) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest document with an equal set), component_id, and with
    ``count`` n_links: how many other classes the document's class links with."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wide = stored(narrow.mapInArrow(_index(k, percent), _INDEX).withColumn("row", F.monotonically_increasing_id()))
    sets = stored(wide.filter("up = 0").select("doc_id", "n", "p1", "p2"))
    classes = stored(sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "p1", "p2").agg(F.min("doc_id").alias("rep")))
    reps = stored(wide.select("row", "doc_id", "n", "p1", "p2", "spare").join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "n", "p1", "p2"]).drop("p1", "p2"))
    keyed = wide.filter("doc_id IS NOT NULL").select("row", F.explode("keys").alias("key"))  # no more columns, as each key is a row to shuffle
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"))
    freed(docs.sparkSession)  # the next shuffle is as large
    # what a text may leave unused are its most frequent keys: of all keys that two linked
    # texts share, the least frequent one is among those that both keep
    met = stored(keyed.join(shared, "key"))
    drop_stored(wide)
    freed(docs.sparkSession)
    ranked = met.join(reps, "row").withColumn("place", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("c"), "key")))
    members = stored(ranked.filter("place > spare").select("key", "doc_id", "n", F.lit(0).cast("long").alias("u")))
    fits = F.col("n") * 100 >= F.col("n_a") * percent
    fits = fits & (F.col("n_a") * 100 >= F.col("n") * percent)

    def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")
        two = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")
        return stored(two.select("a", "b", "a_text", "b_text").mapInArrow(_verify(k, percent), "a long, b long").distinct())

    def open_keys(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members of keys that hold several components, and of those the ones outside the key's largest."""
        own = members.join(labels.withColumnRenamed("id", "l_id"), F.col("doc_id") == F.col("l_id"), "left")
        own = stored(own.select("key", "doc_id", "n", "u", F.coalesce("label", "doc_id").alias("comp")))
        by_comp = own.groupBy("key", "comp").agg(F.count("*").alias("c"))
        main = by_comp.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("comps")).filter("comps > 1")
        some = stored(own.join(main.select("key", F.col("m.comp").alias("main")), "key"))
        minor = some.filter("comp <> main").select("key", F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("u").alias("u_a"), F.col("comp").alias("comp_a"))
        return some, minor

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).distinct()

    # 1. each member with the smallest of its key
    first = members.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("m"), F.count("*").alias("c")).filter("c > 1")
    first = first.select("key", F.col("m.doc_id").alias("a"), F.col("m.n").alias("n_a"))
    together = stored(members.join(first, "key").select("doc_id", "n", "a", "n_a").distinct())
    tried = together.filter((F.col("a") != F.col("doc_id")) & fits).select("a", F.col("doc_id").alias("b")).distinct()
    # whole texts are shuffled once; only those of documents that share a key go on
    texts = shared_texts = stored(narrow.join(together.select("doc_id").distinct(), "doc_id"))
    links = verified(tried, texts)
    labels = components(links)
    # shingles that no other member of an open key has are in no intersection
    some, minor = open_keys(labels)
    texts = stored(texts.join(some.select("doc_id").distinct(), "doc_id"))
    own = texts.mapInArrow(_elements(k), "doc_id long, n long, h long").groupBy("h").agg(F.min(F.struct("doc_id", "n")).alias("d"), F.max("doc_id").alias("last"))
    own = own.filter("d.doc_id = last").groupBy("d.doc_id", "d.n").agg(F.count("*").alias("u"))
    members = stored(some.select("key", "doc_id", "n").join(own, ["doc_id", "n"], "left").fillna(0, ["u"]))
    sketches = stored(texts.mapInArrow(_sketches(k), "doc_id long, n long, sketch array<long>"))
    sketched = lambda rows, d, n, to: rows.join(sketches.select(F.col("doc_id").alias(d), F.col("n").alias(n), F.col("sketch").alias(to)), [d, n])
    differ = F.aggregate(F.zip_with("sketch", "sketch_a", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    near = differ * (100 + percent) <= (F.col("n") + F.col("n_a")) * (100 - percent)
    fits = fits & (F.least(F.col("n") - F.col("u"), F.col("n_a") - F.col("u_a")) * (100 + percent) >= (F.col("n") + F.col("n_a")) * percent)
    # 2. where a key still holds several components, those outside its largest with one member of that, another for each key
    some, minor = open_keys(labels)
    for turn in range(LINEAR_ROUNDS):
        other = some.filter("comp = main").groupBy("key").agg(F.min(F.struct("u", F.xxhash64("key", "doc_id", F.lit(turn)), "doc_id", "n")).alias("m"))
        other = other.select("key", "m.doc_id", "m.n", "m.u")
        pairs = minor.join(other, "key").filter(fits).select("a", "n_a", "doc_id", "n").distinct()
        pairs = sketched(sketched(pairs, "a", "n_a", "sketch_a"), "doc_id", "n", "sketch").filter(near)
        pairs = stored(ordered(pairs).join(tried, ["a", "b"], "left_anti"))
        new = verified(pairs, texts)
        tried = tried.union(pairs)
        if new.isEmpty():
            break
        links = links.union(new)
        labels = components(links)
        some, minor = open_keys(labels)
    # 3. all pairs of members of a key that are in different components now, each at its
    # first key as far as FIRST_KEYS of a text's keys tell
    first = some.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_set("key")), 1, FIRST_KEYS).alias("first"))
    some = stored(sketched(some.join(first, "doc_id"), "doc_id", "n", "sketch").withColumn("first", F.filter("first", lambda x: x < F.col("key"))))
    minor = some.filter("comp <> main").select("key", F.col("first").alias("first_a"), *(F.col(c).alias(f"{c}_a") for c in ("n", "u", "comp", "sketch")), F.col("doc_id").alias("a"))
    apart = (F.col("comp") != F.col("comp_a")) & fits & near & ~F.arrays_overlap("first", "first_a")
    cross = ordered(minor.join(some, "key").filter(apart)).join(tried, ["a", "b"], "left_anti")
    more = verified(stored(cross), texts)
    if not more.isEmpty():
        labels = components(links.union(more))
    named = classes.join(labels.withColumnRenamed("id", "l_id"), F.col("rep") == F.col("l_id"), "left")
    named = named.select("n", "p1", "p2", "rep", F.coalesce("label", "rep").alias("component_id"))
    if count:
        # 4. all links, now that the components are known
        degree = degrees(labels, reps.select("doc_id", "n"), shared_texts, percent, k)
        named = named.join(degree, F.col("rep") == F.col("d_id"), "left").drop("d_id")
    out = sets.join(named, ["n", "p1", "p2"], "left")
    alone = F.col("doc_id").isNull() | F.col("rep").isNull()
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("rep")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        *([F.when(alone, 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links")] if count else []),
    )


def keep_first(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """``docs`` with the smallest document of each component, and those without doc_id."""
    own = fresh(docs, "_keep")
    kept = linked(docs, percent, k, count=False).filter("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, F.col("doc_id") == F.col(own), "left").filter(F.col("doc_id").isNull() | F.col(own).isNotNull()).drop(own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))
