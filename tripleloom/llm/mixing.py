"""Mixing sources to target weights: the cube method, balancing words and documents of each source at once.

Each document of a source is to be taken equally often, target / size of the source. The whole part is taken of every document;
the fraction is drawn. A flight moves the fractions of three documents at a time along the direction that changes neither
their number of documents nor their words, until one of them is 0 or 1. It needs three documents in memory, so a source is dealt
over blocks, each leaves two fractions at most, and these fly again until one block a source is left. There the last dozen
documents land: of all ways to take or leave them, the one whose words are nearest to the target, as many as are due.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, session_of

WEIGHTS = (5, 2, 1)
#: A source gives each document so often at most.
MOST = 3
#: Documents of a source in one block, about.
BLOCK = 4_000
#: Sources up to which their targets are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Documents that a source's last block holds back, to land together with the two of the flight.
HELD = 12
#: A fraction this near to 0 or 1 is settled.
NEAR = 1e-9


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """The rows with `rank`, from 0 in the order of `source` by code point, null last. Ranges of sources are numbered in
    their tasks; what the driver sees is one count for each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(range(at, at + b.num_rows), pa.int64())], names=[*b.schema.names, "rank"])
            at += b.num_rows

    order = F.col("source").asc_nulls_last()
    dealt = sources.repartitionByRange(order).sortWithinPartitions(order)
    kinds = ", ".join(f"`{c}` {t}" for c, t in sources.dtypes)
    rows = saved(dealt.mapInArrow(run, f"{kinds}, rank long").withColumn("part", F.spark_partition_id()))
    before, starts = 0, []
    for r in sorted(rows.groupBy("part").count().collect()):
        starts += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    if not starts:
        return rows.drop("part")
    return rows.withColumn("rank", F.col("rank") + F.create_map(*starts)[F.col("part")]).drop("part")


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, docs, target) from (source, size): shares of all words by weight, none above `most` times what the
    source has; what is above goes to the others by weight. Each round caps all sources above the level that the others get,
    and the driver sees two sums a round."""
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("docs"))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    rows = saved(ranked(sources).withColumn("w", weight))
    big = lambda x: x.cast("decimal(38,0)")
    cap = F.col("source_size") * most
    total = int(rows.agg(F.sum(big(F.col("source_size")))).first()[0] or 0)
    level, last = Fraction(0), None
    above = F.lit(False)
    while level != last:
        r = rows.agg(F.sum(F.when(above, big(cap))).alias("capped"), F.sum(F.when(~above, big(F.col("w")))).alias("w")).first()
        last, level = level, Fraction(total - int(r["capped"] or 0), int(r["w"])) if r["w"] else level
        # level * w > cap, in whole numbers
        above = big(F.lit(level.numerator)) * F.col("w") > big(cap) * F.lit(level.denominator)
    target = F.when(above, cap.cast("double")).otherwise(F.lit(float(level)) * F.col("w"))
    return rows.select("source", "source_size", "docs", F.least(target, cap.cast("double")).alias("target"))


class Flight:
    """Fractions of one block: [place, size, fraction] of at most two documents between calls, and of `hold` that wait to land."""

    def __init__(self, seed: str, hold: int):
        self.draw, self.active, self.held, self.hold = Random(seed).random, [], [], hold

    def add(self, place: int, size: int, p: float) -> list[tuple[int, float]]:
        """Takes a document in; gives places that are settled, with 0 or 1."""
        self.held.append([place, size, p])
        if len(self.held) > self.hold:
            self.active.append(self.held.pop(0))
        return self.move() if len(self.active) == 3 else []

    def move(self) -> list[tuple[int, float]]:
        (_, a, _), (_, b, _), (_, c, _) = self.active
        # The null space of the rows (1, 1, 1) and (a, b, c); of equal sizes, any exchange of two.
        along = (c - b, a - c, b - a) if not a == b == c else (1, -1, 0)
        up = min((1 - p if u > 0 else p) / abs(u) for (_, _, p), u in zip(self.active, along) if u)
        down = min((p if u > 0 else 1 - p) / abs(u) for (_, _, p), u in zip(self.active, along) if u)
        step = up if self.draw() * (up + down) < down else -down
        for x, u in zip(self.active, along):
            x[2] += step * u
        done = [(place, float(round(p))) for place, _, p in self.active if not NEAR < p < 1 - NEAR]
        self.active = [x for x in self.active if NEAR < x[2] < 1 - NEAR]
        return done

    def left(self) -> list[tuple[int, float]]:
        return [(place, p) for place, _, p in self.active + self.held]

    def land(self) -> list[tuple[int, float]]:
        """Takes or leaves the last documents: as many as are due, rounded either way, with words nearest to what is due."""
        last = self.active + self.held
        sizes, p = np.array([x[1] for x in last], float), np.array([x[2] for x in last])
        ways = (np.arange(1 << len(last))[:, None] >> np.arange(len(last))) & 1
        uneven, off = np.abs(ways.sum(axis=1) - p.sum()), np.abs(ways @ sizes - p @ sizes)
        best = ways[np.lexsort((uneven, off, uneven >= 1))[0]]
        return [(x[0], float(taken)) for x, taken in zip(last, best)]


def fly(units: DataFrame, turn: int) -> DataFrame:
    """(source, doc_id, size, h, block, blocks, p) with p moved; two a block keep a fraction, none where a source has one block."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in units.dtypes)
    key = ["source", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, flight, kept, last = None, None, {}, None

        def made(done: list[tuple[int, float]]) -> list[tuple]:
            return [(*kept.pop(place)[:-1], p) for place, p in done]

        def ended() -> list[tuple]:
            return [] if flight is None else made(flight.land() if last else flight.left())

        place = 0
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                source, _, size, _, block, blocks, p = row
                if (source, block) != now:
                    out += ended()
                    now, last = (source, block), blocks == 1
                    flight = Flight(f"{source!r} {block} {turn}", HELD if last else 0)
                place += 1
                kept[place] = row
                out += made(flight.add(place, size, p))
            if out:
                yield batch(out, b.schema)
            schema = b.schema
        if out := ended():
            yield batch(out, schema)

    def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return units.repartition(*key).sortWithinPartitions(*key, "h", "doc_id", "size").mapInArrow(run, kinds)


def with_sources(rows: DataFrame, sources: DataFrame, number: int) -> DataFrame:
    """Joined by source, null meeting null; what is broadcast is bounded by the number of sources."""
    right = sources.withColumnRenamed("source", "_source")
    right = F.broadcast(right) if number <= BROADCAST_SOURCES else right
    return rows.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of (doc_id, text, source): how many words a mix takes of each document.

    Sources by code point, null last, weigh as `weights`, repeating. Null texts have no words and are taken with 0, and so is a
    document without words. Draws depend on ids and texts, not on how rows are dealt, so reruns agree; rows equal in all of
    doc_id, source and text are alike and share a block. Extra columns are left out."""
    session_of(docs)
    narrow = docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    narrow = saved(narrow)
    sources = saved(targets(narrow, weights, most))
    number = sources.count()
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(times)
    rows = with_sources(narrow, sources.withColumn("whole", whole).withColumn("p", times - whole), number)
    drawn = (F.col("size") > 0) & (F.col("p") > NEAR)
    blocks = F.ceil(F.col("docs") / block)
    units = rows.filter(drawn).select("source", "doc_id", "size", "h", F.pmod(F.xxhash64("h"), blocks).alias("block"), blocks.alias("blocks"), "p")
    decided, turn = rows.filter(~drawn).select("source", "doc_id", "size", F.lit(0.0).alias("p")), 0
    while True:
        flown = saved(fly(units, turn))
        settled = (F.col("p") <= NEAR) | (F.col("p") >= 1 - NEAR)
        decided = decided.union(flown.filter(settled).select("source", "doc_id", "size", "p"))
        left = flown.filter(~settled)
        if not left.limit(1).count():
            break
        fewer = F.ceil(F.col("blocks") * 2 / block)
        units = left.select("source", "doc_id", "size", "h", F.pmod("block", fewer).alias("block"), fewer.alias("blocks"), "p")
        turn += 1
    taken = (F.col("size") * (F.col("whole") + F.col("p"))).cast("long")
    return with_sources(decided, sources.withColumn("whole", whole), number).select("doc_id", "size", "source_size", "target", taken.alias("taken"))
