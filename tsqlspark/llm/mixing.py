"""Operator 8, mixing sources to target weights by Sainte-Laguë apportionment.

Sizes are words.  Sources in code-point order (null last) weigh 1, 2, 3, repeating, and
share all words by weight; a target stops at three times its source's size and the excess
goes to the others by weight until none is above.  The mix consists of equal blocks of
``block`` words, shorter ones where all sources together are small.  Blocks go to sources
one by one to the highest quotient target / (2 k + 1), which gives integer quotas; a
source's blocks go to its shards by the same rule on the shards' sizes.

A shard lays its documents out in a seeded order and cuts the line into blocks.  Of a quota
of q blocks from n there are q div n of each block, and the other q mod n are selected by a
seeded permutation of the blocks: those whose place in it is below q mod n.  A document is
taken as often as the blocks that it lies in, so at most three times its size.

Driver memory holds one counter for each source (a dimension, not rows).  Shards are dealt
by words and by rows, so a source with a third of all rows, or one of a great many short
texts, is dealt over many tasks; documents without words take no part in this.

Defined results: a null text has size 0 and is never taken; null sources are one source,
last in order; of repeated rows each takes its own part, and rows of one doc_id with
different texts are dealt to shards apart; an empty table gives no rows.  Only doc_id, text and source are read,
and further columns carried on by ``mixed``.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._common import fresh, stored, table

BLOCK = 16
#: Blocks of the mix at least, by shortening them.
LEAST_BLOCKS = 64
#: Words and rows of a shard, about, as long as a source has fewer than MAX_SHARDS.
SHARD_WORDS, SHARD_ROWS, MAX_SHARDS = 1 << 19, 1 << 10, 1 << 16
#: Primes that are multiplied with a block's number to permute a shard's blocks.
PRIMES = (1_000_003, 1_299_709, 15_485_863, 32_452_843)
SEED = 20
REPEAT = 3


def targets(sizes: list[tuple[str | None, int]]) -> dict[str | None, float]:
    """Words wanted of each source."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: 1 + i % 3 for i, (s, _) in enumerate(order)}
    size, total = dict(sizes), sum(n for _, n in sizes)
    out, left = {}, dict(weight)
    while left:
        share = (total - sum(out.values())) / sum(left.values())
        above = [s for s in left if share * left[s] > REPEAT * size[s]]
        if not above:
            out |= {s: float(share * w) for s, w in left.items()}
            break
        for s in above:
            out[s] = float(REPEAT * size[s])
            del left[s]
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats for each vote by highest quotients, none above ``most``; ties go to the first.

    All quotients above a threshold win at once, the rest are dealt one by one.
    """
    n, total = len(votes), sum(votes)
    seats = min(seats, sum(most))
    if not n or total <= 0:
        return [0] * n
    threshold = total / (2 * max(1, seats)) * (1 + n / max(1, seats))
    got = [min(m, int((v / threshold + 1) / 2)) for v, m in zip(votes, most, strict=True)]
    while sum(got) > seats:
        threshold *= 1.01
        got = [min(m, int((v / threshold + 1) / 2)) for v, m in zip(votes, most, strict=True)]
    heap = [(-v / (2 * g + 1), i) for i, (v, g, m) in enumerate(zip(votes, got, most, strict=True)) if g < m and v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def _shard_quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    """Shards of one source: a source's blocks by the shards' sizes, in blocks."""
    pdf = pdf.sort_values("q_shard", ignore_index=True)
    block, blocks = int(pdf["block"].iloc[0]), int(pdf["blocks"].iloc[0])
    sizes = [int(x) for x in pdf["shard_size"]]
    pdf["quota"] = sainte_lague([float(x) for x in sizes], blocks, [REPEAT * -(-x // block) for x in sizes])
    return pdf[["q_source", "q_shard", "shard_size", "quota"]]


def mix(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken; source is kept too.
    With ``carry``, columns of other names, these are kept and documents without words left out."""
    spark = docs.sparkSession
    words = F.size(F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")
    rows_of = lambda *more: docs.select("doc_id", "source", words.alias("size"), F.xxhash64("text").alias("content"), *more)
    sized = stored(rows_of())
    totals = [(r["source"], r["n"], r["rows"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n"), F.sum((F.col("size") > 0).cast("long")).alias("rows")).collect()]
    totals.sort(key=lambda x: (x[0] is None, x[0] or ""))
    goal, total = targets([(s, n) for s, n, _ in totals]), sum(n for _, n, _ in totals)
    block = max(1, min(block, total // LEAST_BLOCKS))
    blocks = sainte_lague([goal[s] for s, _, _ in totals], round(total / block), [REPEAT * -(-n // block) for _, n, _ in totals])
    plan = [(s, n, goal[s], b, min(MAX_SHARDS, max(1, -(-n // shard_words), -(-rows // shard_rows)))) for (s, n, rows), b in zip(totals, blocks, strict=True)]
    plan = spark.createDataFrame(plan, "p_source string, source_size long, target double, blocks long, shards long").coalesce(1)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))

    def dealt_of(rows: DataFrame) -> DataFrame:
        return rows.join(plan, same("source", "p_source"), "left").withColumn("shard", F.pmod(F.xxhash64("doc_id", "content", F.lit(seed)), F.col("shards")))

    dealt = dealt_of(sized)
    by_shard = dealt.filter("size > 0").groupBy(F.col("p_source").alias("q_source"), F.col("shard").alias("q_shard"))
    by_shard = by_shard.agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks")).withColumn("block", F.lit(block))
    quotas = by_shard.groupBy("q_source").applyInPandas(_shard_quotas, "q_source string, q_shard long, shard_size long, quota long")
    some = (dealt_of(rows_of(*carry)) if carry else dealt).filter("size > 0").join(quotas, same("source", "q_source") & (F.col("shard") == F.col("q_shard")), "left")
    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", "content", F.lit(seed + 1)), "doc_id", "content", "size").rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("before", F.coalesce(F.sum("size").over(line), F.lit(0)))
    some = some.withColumn("n", F.expr(f"(shard_size + {block - 1}) div {block}"))
    # a prime that n is no multiple of gives a permutation; one of two primes always does
    some = some.withColumn("prime", F.element_at(F.array(*[F.lit(x) for x in PRIMES]), (F.pmod(F.xxhash64("source", "shard", F.lit(seed)), F.lit(3)) + 1).cast("int")))
    some = some.withColumn("prime", F.when(F.col("n") % F.col("prime") == 0, F.lit(PRIMES[3])).otherwise(F.col("prime")))
    some = some.withColumn("shift", F.pmod(F.xxhash64("shard", "source", F.lit(seed + 2)), F.col("n")))
    chosen = F.expr(
        f"aggregate(sequence(before div {block}, (before + size - 1) div {block}), 0L, (a, j) -> a + IF(pmod(j * prime + shift, n) < quota % n, "
        f"least(before + size, (j + 1) * {block}) - greatest(before, j * {block}), 0))"
    )
    some = some.withColumn("taken", F.expr("quota div n") * F.col("size") + chosen)
    names = ["doc_id", "source", "size", "source_size", "target", "taken", *carry]
    if carry:
        return some.select(*names)
    return some.select(*names).union(dealt.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*names))


def mixed(docs: DataFrame, seed: int = SEED, **parameters) -> DataFrame:
    """The mix itself, with the columns of ``docs``: documents as a whole, as often as they
    are taken as a whole, and once more with the chance of the part that is left, by a seeded
    hash; so a source's words are its quota but for the rounding of single documents."""
    carry = {c: fresh(docs, f"_c{i}") for i, c in enumerate(docs.columns)}
    plain = docs.select("*", *[F.col(c).alias(n) for c, n in carry.items()])
    plain = plain.select("doc_id", "text", "source", *carry.values())
    got = mix(plain, seed=seed, carry=tuple(carry.values()), **parameters).filter("taken > 0")
    chance = F.pmod(F.xxhash64("doc_id", carry["text"], F.lit(seed + 3)), F.lit(1 << 20)) / (1 << 20)
    copies = F.floor(F.col("taken") / F.col("size") + chance).cast("int")
    copies = got.withColumn("copies", copies).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copies.select(*[F.col(n).alias(c) for c, n in carry.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")
