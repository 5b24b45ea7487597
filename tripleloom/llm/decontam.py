"""Benchmark decontamination: exact hits of item pieces, verified by bit-parallel edit distance.

An item with an error budget of k edits is cut into k + 1 pieces; a passage within k edits leaves at least one piece
intact. All pieces are found in one pass by an Aho-Corasick automaton; around each hit Myers' bit-parallel algorithm gives the exact
distance of the best matching passage. Items are taken in blocks of bounded size, one block at a time: only one is held by the
driver and by the workers, and each block is a pass over the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, rewrite_rows, session_of

#: One edit is allowed for so many characters of an item.
PER_EDIT = 16
#: Characters of items that are broadcast at once (an item longer than that is a block of its own).
BLOCK_CHARS = 4_000_000
STRETCH = re.compile(r"\S+")


def normalise(text: str) -> str:
    """Lower case, single blanks."""
    return " ".join(text.lower().split())


def source_places(text: str) -> list[int]:
    """For each character of the normalised text the place of the source character that it comes from."""
    lowered = text.lower()
    origin = range(len(text)) if len(lowered) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()]
    out: list[int] = []
    for m in STRETCH.finditer(lowered):
        if out:
            out.append(origin[m.start() - 1])  # the blank before
        out += origin[m.start() : m.end()]
    return out


def best_match(pattern: str, text: str, budget: int, anchored: bool = False) -> tuple[int, int] | None:
    """(distance, end) of the passage of `text` nearest to `pattern`, by edit distance; the first of equally near. None
    beyond the budget. An anchored passage begins where the text does. One big integer holds the whole column of vertical
    differences."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = None
    get = where.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(xh | plus) & full
        down = plus & xh
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up = (up << 1 | anchored) & full
        down = down << 1 & full
        plus = down | ~(xv | up) & full
        minus = up & xv
        if score <= budget:
            if best is None or score < best[0]:
                best = (score, j + 1)
            if not score:
                break
    return best


class Items:
    """The automaton over the pieces of a block of items, normalised and not empty."""

    def __init__(self, items: list[tuple[int, str]], per_edit: int):
        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            budget = len(text) // per_edit
            k = len(self.items)
            self.items.append((item_id, text, budget))
            bounds = [len(text) * i // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the nearest passage for each item within its budget, in the normalised text."""
        if not self.items:
            return
        starts: dict[int, set[int]] = {}
        for end, (n, places) in self.automaton.iter(text):
            for k, offset in places:
                starts.setdefault(k, set()).add(end + 1 - n - offset)
        for k, found in starts.items():
            item_id, pattern, budget = self.items[k]
            if not budget:  # the only piece is the item itself
                if whole := [s for s in found if stands_alone(text, s, s + len(pattern))]:
                    yield item_id, 0, min(whole), min(whole) + len(pattern)
                continue
            best = None
            low = high = None
            # passages that begin near one another share a window, unless that would be long
            windows = []
            for s in sorted(found):
                if low is not None and s <= high + 2 * budget + 1 and s - low <= 4 * len(pattern):
                    high = s
                else:
                    if low is not None:
                        windows.append((low, high))
                    low = high = s
            windows.append((low, high))
            for low, high in windows:
                a = max(0, low - budget)
                hit = best_match(pattern, text[a : high + len(pattern) + budget], budget)
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], a + hit[1])
            if best:
                distance, end = best
                yield item_id, distance, self.start(pattern, text, end, distance), end

    @staticmethod
    def start(pattern: str, text: str, end: int, distance: int) -> int:
        """Where the passage that ends at `end` begins: the same search, backwards from there; the shortest passage."""
        if not distance:
            return end - len(pattern)
        back = text[max(0, end - len(pattern) - distance) : end][::-1]
        return end - best_match(pattern[::-1], back, distance, anchored=True)[1]


def stands_alone(text: str, a: int, b: int) -> bool:
    """Whether a stretch neither begins nor ends within a word."""
    return not (a and text[a - 1].isalnum() and text[a].isalnum() or b < len(text) and text[b].isalnum() and text[b - 1].isalnum())


def blocks(benchmark: DataFrame, least: int = 1, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items, in order, in blocks of bounded size, one after another. Items without id or text and those whose normalised
    text has fewer than `least` characters are left out."""
    items = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).filter("item_id is not null and text is not null")
    block: list[tuple[int, str]] = []
    size = 0
    for item_id, text in items.orderBy("item_id", "text").toLocalIterator():
        text = normalise(text)
        if len(text) < max(1, least):
            continue
        if size and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    if block:
        yield block


def block_by_block(benchmark: DataFrame, least: int, limit: int, step) -> list:
    """step(broadcast of a block, whether it is the last one) for each block. A block but the last must be used up by its step,
    as its broadcast goes."""
    context = benchmark.sparkSession.sparkContext
    found, out = blocks(benchmark, least, limit), []
    block = next(found, [])
    while True:
        after = next(found, None)
        held = context.broadcast(block)
        out.append(step(held, after is None))
        if after is None:
            return out
        held.destroy()
        block = after


def matcher(held, per_edit: int):
    """items() for use in tasks: the automaton of a broadcast block, made once in each worker."""
    cache: dict = {}

    def items() -> Items:
        if not cache:
            cache["items"] = Items(held.value, per_edit)
        return cache["items"]

    return items


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: list[str] = ["doc_id"], per_edit: int = PER_EDIT, limit: int = BLOCK_CHARS) -> DataFrame:
    """(keep…, item_id, distance, start, end): a row for each document and benchmark item that its whole text holds within the
    item's budget of one edit for `per_edit` characters, with the nearest passage's place (the first of equally near ones) in
    code points of the document's own text, end exclusive.

    Texts are compared in lower case with single blanks. An item too short for a budget must stand there unchanged and not within
    a word. Null and empty texts hold nothing; items that are null or blank, or without id, are in nothing; repeated rows
    and repeated items each give rows of their own; other columns are not read."""
    spark = session_of(docs)
    kinds = dict(docs.dtypes)
    names = [*keep, "item_id", "distance", "start", "end"]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "item_id bigint, distance bigint, start bigint, end bigint"])
    source = docs.filter("text is not null").select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("text"))

    def search(held, last):
        items = matcher(held, per_edit)

        def run(batches):
            for b in batches:
                at, rows = [], []
                for i, text in enumerate(b.column(len(keep)).to_pylist()):
                    place = None
                    for item_id, distance, start, end in items().matches(normalise(text)):
                        place = place or source_places(text)
                        at.append(i)
                        rows.append((item_id, distance, place[start], place[end - 1] + 1))
                if rows:
                    kept = [b.column(k).take(pa.array(at)) for k in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=names)

        found = source.mapInArrow(run, schema)
        if last:
            return found
        place = new_folder(spark, "benchmark-hits")
        found.write.parquet(place)
        return spark.read.parquet(place)

    return reduce(DataFrame.union, block_by_block(benchmark, 1, limit, search))


def without_items(docs: DataFrame, benchmark: DataFrame, per_edit: int = PER_EDIT, limit: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs`, with all columns, whose texts hold no benchmark item within its budget, as `contaminated` finds
    them. Items of fewer than `per_edit` characters, which stand in clean texts too, don't count here. Null and empty texts
    and null ids stay; of repeated rows all stay or go."""
    spark = docs.sparkSession
    left = [docs]

    def clean(held, last):
        items = matcher(held, per_edit)

        def each(batch, texts, _):
            return batch.filter(pa.array([next(items().matches(normalise(t)), None) is None for t in texts], pa.bool_()))

        left[0] = rewrite_rows(left[0], each)
        if not last:
            place = new_folder(spark, "without-items")
            left[0].write.parquet(place)
            left[0] = spark.read.schema(docs.schema).parquet(place)

    block_by_block(benchmark, per_edit, limit, clean)
    return left[0]
