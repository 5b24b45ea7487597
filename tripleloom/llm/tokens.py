"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies."""

from __future__ import annotations

import json
import os
import re
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo
from .common import map_texts, new_folder, session_of

#: Fixed value: how byte-level vocabularies of this kind part a text into pre-tokens.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Rows of the sample that tells which pre-tokens are common, and how many of those are looked up ahead of the join.
#: They bound the broadcast; every count is over all rows, and the result doesn't depend on them.
SAMPLE_ROWS, COMMON = 16_384, 200_000
BLANKS = re.compile(r"\s\s")


class Library:
    """The public tokenizer behind a file, asked for piece counts only."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.spec = {k: v for k, v in json.load(f).items() if k != "model"}
        added = [t["content"] for t in self.spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")

    def pieces(self, tokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(tokens, add_special_tokens=False)]


_LIBRARIES: dict[str, Library] = {}


def library(path: str) -> Library:
    if path not in _LIBRARIES:
        _LIBRARIES[path] = Library(path)
    return _LIBRARIES[path]


def stretches(text: str) -> Counter:
    """Parts of a text, with their frequencies, that can be cut into pre-tokens one by one. A single blank
    parts two pre-tokens and goes with the second; a single line end is one. Where blanks stand
    together, the cut depends on what follows, and the text is cut as a whole."""
    if BLANKS.search(text):
        return Counter(PRE_TOKEN.findall(text))
    first, *rest = text.replace("\n", " \n").split(" ")
    found = Counter(c if c[:1] == "\n" else " " + c for c in rest)
    if first:
        found[first] += 1
    return found


def cut(stretch: str) -> list[str]:
    if stretch[:1] == "\n" and stretch[1:2].strip():
        return ["\n", *PRE_TOKEN.findall(stretch, 1)]
    return PRE_TOKEN.findall(stretch)


def frequencies(text: str, special: re.Pattern) -> tuple[Counter, int]:
    """Stretches of a text with their frequencies, and the number of special tokens in it."""
    parts = special.split(text)
    found = stretches(parts[0])
    for p in parts[1:]:
        found += stretches(p)
    return found, len(parts) - 1


def common_pieces(docs: DataFrame, path: str) -> dict[str, int]:
    """Piece counts of the pre-tokens that are frequent in a bounded sample."""
    rows = docs.count()
    sample = docs.sample(min(1.0, SAMPLE_ROWS / max(1, rows)), 7)

    def each(texts, _):
        total: Counter = Counter()
        for t in texts:
            for s, n in frequencies(t, library(path).special)[0].items():
                for token in cut(s):
                    total[token] += n
        first = [list(total.items())] + [[]] * (len(texts) - 1)
        return [pa.array(first, pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())])))]

    counted = (
        map_texts(sample, [], "found array<struct<token:string,n:bigint>>", each)
        .select(F.inline("found")).groupBy("token").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "token").limit(COMMON)
    )
    tokens = [r[0] for r in counted.select("token").collect()]
    return dict(zip(tokens, library(path).pieces(tokens), strict=True))


def token_counts(docs: DataFrame, path: str, keep: list[str] = ["doc_id"]) -> DataFrame:
    """(keep…, n_bytes, n_tokens) for every row. Null text counts as empty; repeated rows and null ids stay
    rows of their own; columns not in `keep` are not read.

    One pass parts each text into pre-tokens. Frequent ones (a bounded table, broadcast) are summed at once; the
    others leave as (row, token, frequency), are counted once per distinct token, joined and summed by row.
    """
    spark = session_of(docs)
    known = spark.sparkContext.broadcast(common_pieces(docs, path))

    def each(texts, _):
        special, table = library(path).special, known.value

        def look(stretch):
            tokens = cut(stretch)
            return sum(table.get(t, 0) for t in tokens), [t for t in tokens if t not in table]

        memo = caches.setdefault("m", Memo(look))
        sums, sizes, rare = [], [], []
        for t in texts:
            found, total = frequencies(t, special)
            others: Counter = Counter()
            for s, n in found.items():
                ready, rest = memo[s]
                total += n * ready
                for token in rest:
                    others[token] += n
            sums.append(total)
            sizes.append(len(t.encode()))
            rare.append(list(others.items()))
        kind = pa.list_(pa.struct([("token", pa.string()), ("freq", pa.int64())]))
        return [pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(rare, kind)]

    caches: dict = {}
    parts = map_texts(docs, keep, "n_bytes bigint, known bigint, rare array<struct<token:string,freq:bigint>>", each)
    place = new_folder(spark, "token-frequencies")
    parts.withColumn("row_id", F.monotonically_increasing_id()).write.parquet(place)
    rows = spark.read.parquet(place)
    rare = rows.select("row_id", F.inline("rare"))

    def count(batches):
        for b in batches:
            tokens = b.column(0)
            yield pa.RecordBatch.from_arrays([tokens, pa.array(library(path).pieces(tokens.to_pylist()), pa.int64())], names=["token", "pieces"])

    pieces = rare.select("token").distinct().mapInArrow(count, "token string, pieces bigint")
    sums = rare.join(pieces, "token").groupBy("row_id").agg(F.sum(F.col("freq") * F.col("pieces")).alias("more"))
    return rows.join(sums, "row_id", "left").select(*keep, "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
