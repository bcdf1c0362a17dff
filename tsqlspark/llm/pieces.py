"""Operator 7, SentencePiece encoding and decoding with N-best segmentation.

A text's pieces form a lattice whose edges are the vocabulary's pieces with their scores;
a character without a piece is an edge of its UTF-8 bytes.  Forward Viterbi gives the best
score up to each position.  These are exact heuristics for the rest of a path that is
built from the end backwards, so A* search with them pops complete segmentations in order
of their scores.

Where no piece of the vocabulary holds two neighbouring characters in that order, every
segmentation has a boundary; the lattice falls apart there into segments.  Segments repeat
(words): those of some megabytes of texts are numbered by Arrow's dictionary encoding,
each distinct one is searched once, for its best and the loss of its second best, and the
texts' ids are gathered from the words' by index arithmetic.  The N best of a text differ
from its best in at most N - 1 words, those of the least losses; these are searched for
their N best, and the text's are merged from them.

Spaces become U+2581 and one more is put in front; nothing else is normalised, so decoding
gives the text back.

Defined results: a null or empty text has no tokens, one segmentation of score 0 and
decodes to the empty text; repeated rows each get a row; an empty table gives no rows; a
literal U+2581 is encoded by bytes.  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import small_batches, table, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: Words whose solution a worker remembers; when there are more, those that came once are forgotten.
CACHE = 400_000
#: Bytes of texts whose words are solved at a time.
GROUP_BYTES = 2 << 20
_LATTICES: dict = {}
SPACE = "▁"


class Lattice:
    """Pieces and scores of a SentencePiece model, and search over them."""

    def __init__(self, model: bytes, n_best: int = N_BEST):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.n_best, self.pieces, self.bytes_of, byte_ids = n_best, {}, [], {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.pieces[piece] = (i, sp.get_score(i))
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        self.byte_ids = [byte_ids[b] for b in range(256)]
        self.least = min(s for _, s in self.pieces.values()) - 10.0 if self.pieces else -10.0
        #: Each prefix of a piece: its (id, score) where it is a piece itself.
        self.table = {p[:k]: None for p in self.pieces for k in range(1, len(p) + 1)} | self.pieces
        self.joined = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        # of two bytes, whether a piece may hold them side by side; unknown unless both are ASCII
        self.beside = np.ones((256, 256), bool)
        for a in range(128):
            for b in range(128):
                self.beside[a, b] = (chr(a) + chr(b)).replace(" ", SPACE) in self.joined
        self.words = Words()
        self.worse: dict[bytes, list] = {}
        self.vocabulary = None

    def segments(self, text: str) -> list[str]:
        """Parts between positions that every segmentation has as a boundary."""
        joined, out, at = self.joined, [], 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in joined:
                out.append(text[at:i])
                at = i
        out.append(text[at:])
        return out

    def forward(self, seg: str) -> tuple[list[float], list[list]]:
        """Best score up to each position, and the edges (start, id, score) that end at it."""
        size, low = len(seg), float("-inf")
        best = [low] * (size + 1)
        best[0] = 0.0
        ending: list[list] = [[] for _ in range(size + 1)]
        get = self.table.get
        for i in range(size):
            here, whole = best[i], False
            for j in range(i + 1, size + 1):
                p = get(seg[i:j], 0)
                if p == 0:
                    break
                if p is not None:
                    k, s = p
                    whole = whole or j == i + 1
                    ending[j].append((i, k, s))
                    if here + s > best[j]:
                        best[j] = here + s
            if not whole:
                ending[i + 1].append((i, -1 - i, self.least))
                if here + self.least > best[i + 1]:
                    best[i + 1] = here + self.least
        return best, ending

    def search(self, seg: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations, best first: (score, ids)."""
        best, ending = self.forward(seg)
        heap, found, nth = [(-best[-1], 0, len(seg), 0.0, None)], [], 0
        while heap and len(found) < n:
            f, _, at, g, path = heapq.heappop(heap)
            if not at:
                ids = []
                while path is not None:
                    k, path = path
                    ids.append(k)
                found.append((-f, self._ids(seg, ids)))
                continue
            for i, k, s in ending[at]:
                nth += 1
                heapq.heappush(heap, (-(best[i] + g + s), nth, i, g + s, (k, path)))
        return found

    def _ids(self, seg: str, edges: list[int]) -> tuple[int, ...]:
        if min(edges) >= 0:
            return tuple(edges)
        return tuple(chain.from_iterable((k,) if k >= 0 else [self.byte_ids[b] for b in seg[-1 - k].encode()] for k in edges))

    def two(self, seg: str) -> tuple[list[int], float, float]:
        """(ids of the best segmentation, its score, how much worse the second is): the two that
        the search pops first.  As the heuristics are exact, the nodes of one best path can be
        popped without a queue, and of the others that were pushed the largest is the second."""
        best, ending = self.forward(seg)
        at, done, second, edges = len(seg), 0.0, -_NEVER, []
        while at:
            top = -_NEVER
            for i, k, s in ending[at]:
                f = best[i] + s
                if f > top:
                    if top + done > second:
                        second = top + done
                    top, take = f, (i, k, s)
                elif f + done > second:
                    second = f + done
            at = take[0]
            done += take[2]
            edges.append(take[1])
        edges.reverse()
        return self._ids(seg, edges), best[-1], best[-1] - second

    def number(self, word: bytes) -> int:
        """The place of a word's solution in ``words``; solved now where it is not remembered."""
        at = self.words.number.get(word)
        if at is None:
            if word == _LITERAL:  # in the text itself
                return self.words.add(word, [self.byte_ids[b] for b in word], self.least, _NEVER)
            parts = self.segments(word.decode().replace(" ", SPACE))
            if len(parts) == 1:
                return self.words.add(word, *self.two(parts[0]))
            own, w = [self.number(p.replace(SPACE, " ").encode()) for p in parts], self.words
            ids = np.concatenate([w.flat[w.start[i] : w.start[i] + w.count[i]] for i in own])
            return w.add(word, ids, float(sum(w.score[i] for i in own)), float(min(w.loss[i] for i in own)))
        return at

    def others(self, word: bytes) -> list[tuple[float, np.ndarray]]:
        """(loss against its best, ids) of the next segmentations of a word, by A* search."""
        out = self.worse.get(word)
        if out is None:
            parts = []
            for s in self.segments(word.decode().replace(" ", SPACE)):
                found, best, score, _ = self.search(s, self.n_best), *self.two(s)
                parts.append([(score, tuple(best)), *(p for p in found if p[1] != tuple(best))][: len(found)])  # of equals the one that is taken first
            ids = [p[0][1] for p in parts]
            out = []
            for loss, picks in merged([[p[0][0] - x for x, _ in p] for p in parts], self.n_best)[1:]:
                way = list(ids)
                for k, i in picks:
                    way[k] = parts[k][i][1]
                out.append((loss, np.array(list(chain.from_iterable(way)), np.int32)))
            if len(word) < 64:  # longer ones seldom repeat
                if len(self.worse) >= CACHE // 8:
                    self.worse.clear()
                self.worse[word] = out
        return out

    def solve(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[np.ndarray]], list[list[float]]]:
        """(ids of all texts' best segmentations, their bounds by text, ids of the next ones and
        scores of all n best for each text).

        At most n - 1 words of a text, those of the least losses (the first of equals), differ
        from the best in its n best."""
        bounds = np.zeros(len(texts) + 1, np.int64)
        others: list[list[np.ndarray]] = [[] for _ in texts]
        scores: list[list[float]] = [[0.0] for _ in texts]
        some = [i for i, t in enumerate(texts) if t]
        if not some:
            return np.empty(0, np.int32), bounds, others, scores
        if len(self.words.number) >= CACHE:
            self.words = self.words.frequent(CACHE // 2)
        data = b"".join([b" " + texts[i] for i in some])
        first = np.cumsum([0] + [len(texts[i]) + 1 for i in some])
        start = word_starts(np.frombuffer(data, np.uint8), first[:-1], self.beside)
        array = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(start, len(data)).astype(np.int32)), pa.py_buffer(data)])
        coded = array.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        number = np.fromiter(map(self.number, distinct), np.int64, len(distinct))
        which, w = coded.indices.to_numpy(), self.words
        entry = number[which]
        w.seen[number] += 1
        count, loss = w.count[entry], w.loss[entry]
        at = np.concatenate([[0], np.cumsum(count)])
        ids = w.flat[np.arange(at[-1]) + np.repeat(w.start[entry] - at[:-1], count)]
        of = np.searchsorted(start, first)
        total = np.add.reduceat(w.score[entry], of[:-1])
        for k, i in enumerate(some):
            a, b = int(of[k]), int(of[k + 1])
            bounds[i + 1] = at[b] - at[a]
            own, n = loss[a:b], min(self.n_best - 1, b - a)
            worse = []
            if n:
                near = np.flatnonzero(own <= (np.partition(own, n - 1)[n - 1] if b - a > n else _NEVER))
                worse = [a + int(j) for j in near[np.argsort(own[near], kind="stable")[:n]] if own[j] < _NEVER]
            other = [self.others(distinct[which[j]]) for j in worse]
            scores[i] = [float(total[k])]
            for lost, picks in merged([[0.0, *(x for x, _ in o)] for o in other], self.n_best)[1:]:
                way, done = [], int(at[a])
                for j, new in sorted((worse[q], other[q][r - 1][1]) for q, r in picks):
                    way += [ids[done : at[j]], new]
                    done = int(at[j + 1])
                others[i].append(np.concatenate([*way, ids[done : at[b]]]))
                scores[i].append(float(total[k]) - lost)
        return ids, np.cumsum(bounds), others, scores

    def best(self, text: str | None) -> tuple[list[np.ndarray], list[float]]:
        """(ids, scores) of the n best segmentations, best first."""
        ids, _, others, scores = self.solve([(text or "").encode()])
        return [ids, *others[0]], scores[0]

    def encode(self, text: str | None) -> tuple[np.ndarray, list[float]]:
        """Ids of the best segmentation; scores of the n best, best first."""
        ways, scores = self.best(text)
        return ways[0], scores

    def decode_all(self, ids: pa.ListArray) -> list[bytes]:
        """UTF-8 of the text of each row, by one take over all rows' ids."""
        if self.vocabulary is None:
            self.vocabulary = pa.array(self.bytes_of, pa.large_binary())
        offsets = ids.offsets.to_numpy()
        taken = self.vocabulary.take(ids.values.slice(offsets[0], offsets[-1] - offsets[0]))
        at = np.frombuffer(taken.buffers()[1], np.int64)[offsets - offsets[0] + taken.offset].tolist()
        data = memoryview(taken.buffers()[2] or b"")
        return [bytes(data[i + 1 : j]) if j > i else b"" for i, j in zip(at[:-1], at[1:], strict=True)]

    def decode(self, ids) -> str:
        got = self.decode_all(pa.array([ids], pa.list_(pa.int32())))
        return got[0].decode("utf-8", "replace")


class Words:
    """Solved words: ids, score of the best segmentation and loss of the second best, in growing arrays."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.score, self.loss = np.empty(1 << 14), np.empty(1 << 14)
        self.seen = np.zeros(1 << 14, np.int64)

    def add(self, word: bytes, ids, score: float, loss: float) -> int:
        i, n = len(self.number), len(ids)
        if self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(n, len(self.flat)), np.int32)])
        if i == len(self.start):
            self.start, self.count, self.score, self.loss, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.score, self.loss, self.seen))
        self.flat[self.used : self.used + n] = ids
        self.start[i], self.count[i], self.score[i], self.loss[i] = self.used, n, score, loss
        self.used += n
        self.number[word] = i
        return i

    def frequent(self, most: int) -> Words:
        """The words that were in two groups of texts or more; none if these are more than ``most``."""
        kept, out = [(x, i) for x, i in self.number.items() if self.seen[i] > 1], Words()
        for x, i in kept if len(kept) <= most else []:
            out.add(x, self.flat[self.start[i] : self.start[i] + self.count[i]], self.score[i], self.loss[i])
        return out


_NEVER = float("inf")
_LITERAL = SPACE.encode()


def word_starts(raw: np.ndarray, first: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Where the words of the lattice start: a run of spaces with what follows, a run of
    newlines, what stands without a space, a literal U+2581, and what no piece joins to the
    byte before; ``first`` are texts' starts."""
    space, line = raw == 32, raw == 10
    start = np.zeros(len(raw) + 3, bool)
    start[first] = True
    start[1 : len(raw)] |= (space[1:] & ~space[:-1]) | (line[1:] != line[:-1]) | ~beside[raw[:-1], raw[1:]]
    literal = np.flatnonzero((raw[:-2] == _LITERAL[0]) & (raw[1:-1] == _LITERAL[1]) & (raw[2:] == _LITERAL[2]))
    start[literal] = True
    start[literal + 3] = True
    return np.flatnonzero(start[: len(raw)])


def lattice_of(model: bytes, n_best: int) -> Lattice:
    """One lattice for each Python worker, whose solved words serve its later tasks too."""
    key = (hashlib.sha256(model).digest(), n_best)
    if key not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[key] = Lattice(model, n_best)
    return _LATTICES[key]


def merged(lists: list[list[float]], n: int) -> list[tuple[float, tuple]]:
    """The n smallest sums of one loss from each list, each list starting with 0 and sorted:
    (sum, the (list, place) that are not first places)."""
    sums = [(0.0, ())]
    for _, k in heapq.nsmallest(n - 1, ((x[1], k) for k, x in enumerate(lists) if len(x) > 1)):
        sums = heapq.nsmallest(n, [(a + b, (*p, (k, i)) if i else p) for a, p in sums for i, b in enumerate(lists[k])])
    return sums


def _lists(values: np.ndarray, counts) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _groups(texts: list[bytes]):
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_BYTES or i == len(texts) - 1:
            yield at, i + 1
            at, size = i + 1, 0


def encode(docs: DataFrame, model_path: str = MODEL, n_best: int = N_BEST) -> DataFrame:
    """doc_id, ids of the best segmentation, scores of the n best, whether decoding gives the
    text back, and the ids of the second to nth best."""
    small_batches(docs.sparkSession, 1000)
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches):
        lattice = lattice_of(model, n_best)
        for b in batches:
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            for i, j in _groups(texts):
                ids, bounds, other, scores = lattice.solve(texts[i:j])
                ids = _lists(pa.array(ids, pa.int32()), np.diff(bounds))
                same = [x == t for x, t in zip(lattice.decode_all(ids), texts[i:j], strict=True)]
                flat = [x for o in other for x in o]
                ways = _lists(pa.array(np.concatenate([*flat, np.empty(0, np.int32)]), pa.int32()), [len(x) for x in flat])
                columns = [b.column(0).slice(i, j - i), ids, pa.array(scores, pa.list_(pa.float64())), pa.array(same, pa.bool_()), _lists(ways, [len(o) for o in other])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "scores", "round_trip", "others"])
        tidy()

    schema = "doc_id long, ids array<int>, scores array<double>, round_trip boolean, others array<array<int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id and text of rows that ``encode`` made."""
    small_batches(encoded.sparkSession, 500)
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches):
        lattice = lattice_of(model, N_BEST)
        for b in batches:
            ids = b.column(1)
            ids = pa.array([x or [] for x in ids.to_pylist()], pa.list_(pa.int32())) if ids.null_count else ids
            texts = [x.decode("utf-8", "replace") for x in lattice.decode_all(ids)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of ``encode``: number of tokens, SHA-256 of the ids (32-bit little-endian), scores, round trip,
    and the SHA-256 of the ids of each of the second to nth best."""

    def shas(lists: pa.ListArray) -> list[str]:
        values, offsets = lists.values.to_numpy().astype("<i4", copy=False), lists.offsets.to_numpy()
        return [hashlib.sha256(values[i:j].tobytes()).hexdigest() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]

    def digest(batches):
        for b in batches:
            ids, others = b.column(1), b.column(4)
            offsets = others.offsets.to_numpy()
            each = pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(shas(others.values.slice(offsets[0], offsets[-1] - offsets[0])), pa.string()))
            columns = [b.column(0), pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64)), pa.array(shas(ids), pa.string()), b.column(2), b.column(3), each]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "scores", "round_trip", "others_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, scores array<double>, round_trip boolean, others_sha256 array<string>"
    return encode(table(spark, sf_dir, "documents")).mapInArrow(digest, schema)
