"""Operator 3, personal data by rules and a skip-chain conditional random field.

Rules find emails, IP addresses, cards and phone numbers.  A skip-chain CRF over the
tokens that hold a digit or an at sign adds what the rules miss: neighbouring tokens share
a chain potential; repeated tokens (equal letters and digits) anywhere in the document
share a skip potential, consecutive occurrences being linked, so that a document's graph
is linear in its length.  Loopy belief propagation makes labels agree over a document,
rule matches being evidence.  Unary weights are a multinomial logistic model over token
shapes, pair potentials smoothed log ratios (piecewise training), both fitted to rule
matches in at most ``max_train`` documents, those of the smallest hashes among texts with
a digit or at sign.

Defined results: a null text is empty and has no spans; repeated rows each get a row; an
empty table gives no rows; without training documents nothing is added.  Only doc_id and
text are read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORD, small_batches, table

KINDS = ("email", "ip", "card", "phone")
MAX_TRAIN, MAX_CHARS = 1500, 20_000
#: Rounds of message passing at most, and the largest change of a message that counts as none.
ROUNDS, STILL = 200, 1e-4
#: Characters at one end that make two tokens similar, and letters and digits that both must have.
SAME_END, LEAST_SIMILAR = 6, 8
SEED = 3

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# what does not match from the start of a run of digits matches from no later digit of it
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")
_WORD = re.compile(WORD)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    """Leftmost non-overlapping matches; only runs before an at sign can start one."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m.start(), m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted by start and kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = _only_digits(m.group())
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_only_digits(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_NUMBERS = re.compile(r"[^0-9]+")
_PARTS = re.compile(r"[A-Za-z0-9-][.,_][A-Za-z0-9-]")


def features(token: str) -> np.ndarray:
    """Shape of a token, and whether its digits pass the tests that numbers of a kind pass."""
    only = _only_digits(token)
    digits, letters = len(only), sum(c.isalpha() for c in token)
    dots, at = token.count("."), token.count("@")
    tail = token.rpartition("@")[2] if at else ""
    parts = [p for p in _NUMBERS.split(token) if p]
    card, four = 14 <= digits <= 19 and not letters, len(parts) == 4 and not letters
    return np.array([
        1, at == 1, at > 1, at == 1 and letters > 3, bool(at) and bool(_PARTS.search(tail)), digits == 0, 1 <= digits <= 3, 4 <= digits <= 8, 9 <= digits <= 13, digits > 19,
        letters == 0, letters > digits, dots == 0, card and luhn(only), card and not luhn(only), four and all(len(p) <= 3 and int(p) <= 255 for p in parts), four and digits <= 12 and any(int(p) > 255 for p in parts),
        token[0] == "+", "(" in token or ")" in token, "-" in token or "/" in token, '"' in token, "," in token, "%" in token or "$" in token,
        10 <= digits <= 15 and letters == 0 and len(parts) >= 3,
    ], dtype=np.float64)


N_FEATURES = len(features("x"))


class Graph:
    """Tokens of several texts, chain edges, and hidden nodes for equal and for similar tokens."""

    def __init__(self):
        self.text: list[int] = []
        self.span: list[tuple[int, int]] = []
        self.x: list[np.ndarray] = []
        self.label: list[int] = []  # 0 outside, else kind + 1; of the rules
        self.chain: list[tuple[int, int]] = []
        self.ties: list[list[list[int]]] = [[], []]  # groups of equal, and of similar tokens

    def add(self, k: int, text: str, base: list[tuple[int, int, int]], shapes: dict) -> None:
        groups: tuple[dict, dict] = ({}, {})
        at, was_near, nth = 0, -2, 0
        for m in _WORD.finditer(text):
            nth += 1
            t = m.group()
            if not ("@" in t or _DIGIT.search(t)):
                continue
            i, (a, b) = len(self.text), m.span()
            while at < len(base) and base[at][2] <= a and (at + 1 < len(base)):
                at += 1
            kind = next((kd + 1 for s, kd, e in base[max(0, at - 2) : at + 4] if s < b and e > a), 0)
            if len(t) < 64:  # one letter stands for all, which is all that features() tells of them
                shape = _LETTER.sub("a", t) if t.isascii() else "".join("a" if c.isalpha() else c for c in t)
                x = shapes.get(shape)
                if x is None:
                    x = features(t)
                    if len(shapes) < 20_000:
                        shapes[shape] = x
            else:
                x = features(t)
            self.text.append(k)
            self.span.append((a, b))
            self.x.append(x)
            self.label.append(kind)
            if was_near == nth - 1:
                self.chain.append((i - 1, i))
            was_near = nth
            key = "".join(c for c in t if c.isalnum()).lower()
            if len(key) > 3:
                groups[0].setdefault(key, []).append(i)
            if len(key) >= LEAST_SIMILAR:
                for end in (("<", key[:SAME_END]), (">", key[-SAME_END:])):
                    groups[1].setdefault(end, []).append(i)
        for ties, found in zip(self.ties, groups, strict=True):
            ties.extend(g for g in found.values() if len(g) > 1)


@dataclass
class Crf:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels, log potentials
    equal: np.ndarray
    similar: np.ndarray

    def beliefs(self, g: Graph) -> np.ndarray:
        """Marginals by loopy sum-product; labels of rule matches are clamped.  Texts share
        nothing: each text's messages stop when they are still, whatever the others do."""
        n, m = len(g.text), len(KINDS) + 1
        if not n:
            return np.zeros((0, m))
        hidden = [[(n + h, i) for h, group in enumerate(g.ties[0] + g.ties[1]) for i in group]]
        equal = sum(map(len, g.ties[0]))
        pairs = np.array([*g.chain, *hidden[0]], dtype=np.int64).reshape(-1, 2)
        nodes = n + len(g.ties[0]) + len(g.ties[1])
        score = np.zeros((nodes, m))
        score[:n] = np.array(g.x) @ self.unary
        fixed = np.array(g.label)
        at = np.flatnonzero(fixed)
        score[at] -= 50
        score[at, fixed[at]] += 100
        if len(pairs):
            sizes = (len(g.chain), equal, len(hidden[0]) - equal)
            pot = np.concatenate([np.repeat(p[None], k, 0) for p, k in zip((self.chain, self.equal, self.similar), sizes, strict=True)])
            pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
            src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
            half = len(pairs)
            back = np.concatenate([np.arange(half) + half, np.arange(half)])
            text = np.array(g.text)[np.concatenate([pairs[:, 1], pairs[:, 1]])]
            msg, total, on = np.zeros((2 * half, m)), score.copy(), np.arange(2 * half)
            for _ in range(ROUNDS):
                out = (total[src[on]] - msg[back[on]])[:, :, None] + pot[on]
                top = out.max(1, keepdims=True)
                new = (top + np.log(np.exp(out - top).sum(1, keepdims=True)))[:, 0]
                new = 0.5 * msg[on] + 0.5 * (new - new.max(1, keepdims=True))
                moved = np.bincount(text[on], np.abs(new - msg[on]).max(1) > STILL, int(text.max()) + 1) > 0
                msg[on] = new
                total[dst[on]] = score[dst[on]]
                np.add.at(total, dst[on], msg[on])
                on = on[moved[text[on]]]
                if not len(on):
                    break
            score = total
        score = score[:n] - score[:n].max(1, keepdims=True)
        p = np.exp(score)
        return p / p.sum(1, keepdims=True)


def disguised(text: str, base: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """A copy whose personal data no rule finds, with its spans: other separators."""
    out, spans, done, size = [], [], 0, 0
    for n, (a, k, b) in enumerate(base):
        if a < done:
            continue
        own = text[a:b]
        if k == 0:
            own = own.replace(".", ",") if n % 2 else own.replace(".", "_")
        elif k == 1:
            own = own.replace(".", "," if n % 2 else "-")
        elif k == 2:
            d = _only_digits(own)
            own = ("." if n % 2 else "/").join(d[i : i + 4] for i in range(0, len(d), 4))
        else:
            own = ("/" if n % 2 else "-").join(x for x in _NUMBERS.split(own) if x)
        out += [text[done:a], own]
        size += a - done
        spans.append((size, k, size + len(own)))
        size += len(own)
        done = b
    return "".join([*out, text[done:]]), spans


def fit(texts: list[str]) -> Crf | None:
    g, shapes = Graph(), {}
    for k, t in enumerate(texts):
        base = base_spans(t)
        g.add(2 * k, t, base, shapes)
        if base:
            g.add(2 * k + 1, *disguised(t, base), shapes)
    m = len(KINDS) + 1
    if not g.text:
        return None
    x, y = np.array(g.x), np.eye(m)[np.array(g.label)]
    w = np.zeros((N_FEATURES, m))
    w[0, 0] = 1.0
    for _ in range(600):  # multinomial logistic regression with a ridge
        z = x @ w
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        w += 2.0 * (x.T @ (y - p) / len(x) - 1e-4 * w)

    def potential(pairs):
        joint = np.full((m, m), 0.5)
        for a, b in pairs:
            joint[g.label[a], g.label[b]] += 1
            joint[g.label[b], g.label[a]] += 1
        joint /= joint.sum()
        return np.clip(np.log(joint) - np.log(joint.sum(1)[:, None] * joint.sum(0)[None]), -4, 4)

    tied = lambda groups: potential([p for x in groups for p in zip(x, x[1:])])
    return Crf(w, potential(g.chain), tied(g.ties[0]), tied(g.ties[1]))


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")"):
        b -= 1
    return a, b


def find(texts: list[str], crf: Crf | None) -> list[tuple[list, list]]:
    """(rule spans, all spans) for each text."""
    base = [base_spans(t) for t in texts]
    out = [list(b) for b in base]
    if crf is not None:
        g, shapes = Graph(), {}
        for k, (t, b) in enumerate(zip(texts, base, strict=True)):
            if "@" in t or _DIGIT.search(t):
                g.add(k, t, b, shapes)
        if g.text:
            p = crf.beliefs(g)
            best = p.argmax(1)
            near, runs = {b for _, b in g.chain}, []
            for i in np.flatnonzero((best > 0) & (np.array(g.label) == 0) & (p.max(1) > 0.5)):
                kind = int(best[i]) - 1
                if runs and runs[-1][3] == i - 1 and i in near and runs[-1][1] == kind:
                    runs[-1][2:] = [g.span[i][1], i]
                else:
                    runs.append([g.span[i][0], kind, g.span[i][1], i])
            for a, kind, b, i in runs:
                k = g.text[i]
                a, b = _trimmed(texts[k], a, b)
                if a < b:
                    out[k].append((a, kind, b))
    return [(b, sorted(set(o))) for b, o in zip(base, out, strict=True)]


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> Crf | None:
    """Fits to a bounded sample of different rows, of each at most ``MAX_CHARS`` code points around
    its first digit or at sign (of the training sample only)."""
    hashed = docs.select(F.xxhash64("doc_id", F.lit(SEED)).alias("o"), F.xxhash64("text").alias("t"), "text").filter(F.col("text").rlike("[0-9@]"))
    keys = hashed.select("o", "t").orderBy("o", "t").limit(max_train).distinct()
    start = F.greatest(F.lit(1), F.regexp_instr("text", F.lit("[0-9@]")) - MAX_CHARS // 2)
    near = F.substr("text", start, F.lit(MAX_CHARS)).alias("text")
    rows = hashed.join(F.broadcast(keys), ["o", "t"]).select("o", "t", near).groupBy("o", "t").agg(F.min("text").alias("text")).collect()
    return fit([r["text"] for r in sorted(rows)])


def personal_data(docs: DataFrame, crf: Crf | None) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = find(texts, crf)
            counts = [[sum(s[1] == k for s in base) for base, _ in found] for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string()),
                 pa.array([written(every) for _, every in found], pa.string())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal_data(docs, train(docs))
