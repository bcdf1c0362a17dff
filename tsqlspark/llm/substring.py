"""Operator 2, substring dedup by suffix automata of reference shards.

The references are all documents.  Their words are dealt to shards by anchors (see
``spans``), each shard of a bounded number of words; its automaton is built where the
documents' regions for that shard are streamed, instead of broadcasting automata that
together are as large as the corpus past documents of which few share anything with them.
Streaming a region gives its matching statistics; where the matched length reaches
``LENGTH`` the automaton's state tells the smallest document that has the window.

Defined results: a null text has no words; a null doc_id takes no part and keeps its
words; rows of one doc_id, equal or not, are one document for comparison and each get a row;
an empty table gives no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import spans
from ._common import table

LENGTH, GRAM = 13, 5


class Automaton:
    """Generalised suffix automaton over words; each state knows the smallest owner of its substrings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.owner = [-1], [0], [1 << 63]

    def _state(self, length: int, nxt: dict, link: int, owner: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.len.append(length)
        self.owner.append(owner)
        return len(self.len) - 1

    def _extend(self, last: int, c) -> int:
        nxt, link, size = self.next, self.link, self.len
        q = nxt[last].get(c)
        if q is not None:
            if size[q] == size[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = self._state(size[last] + 1, {}, 0, 1 << 63)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c, q: int) -> int:
        made = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q], self.owner[q])
        self.link[q] = made
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = made
            p = self.link[p]
        return made

    def add(self, words: list, owner: int) -> None:
        """Owners must come in ascending order, so a state that has one keeps it."""
        last = 0
        for c in words:
            last = self._extend(last, c)
            v = last
            while v > 0 and self.owner[v] > owner:
                self.owner[v] = owner
                v = self.link[v]

    def least(self, words: list, length: int) -> list[int]:
        """Streams words; the smallest owner of each window of ``length`` words."""
        v = matched = 0
        out = []
        for e, c in enumerate(words):
            while v and c not in self.next[v]:
                v = self.link[v]
                matched = self.len[v]
            v = self.next[v].get(c, 0)
            matched = matched + 1 if v else 0
            if e >= length - 1:
                if matched < length:
                    out.append(1 << 62)
                    continue
                while self.len[self.link[v]] >= length:
                    v = self.link[v]
                    matched = self.len[v]
                out.append(self.owner[v])
        return out


def by_automaton(regions: list[list[bytes]], _: list[int], owners: list[int], length: int) -> list[list[int]]:
    """One automaton of the whole shard, past which its regions are streamed."""
    shard = Automaton()
    for words, owner in zip(regions, owners, strict=True):
        shard.add(words, owner)
    return [shard.least(words, length) for words in regions]


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, frequent: int = spans.FREQUENT) -> DataFrame:
    return spans.strip(docs, by_automaton, length, gram, frequent)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def oracle(length: int = LENGTH) -> str:
    gram = " || ' ' || ".join(["word", *[f"lead(word, {i}) OVER p" for i in range(1, length)]])
    return f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM documents),
 g AS (SELECT doc_id, i, word, {gram} AS gram FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
 r AS (SELECT doc_id, i, word, gram IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY gram) AS again FROM g),
 c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) AS gone FROM r),
 s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN s USING (doc_id)"""
