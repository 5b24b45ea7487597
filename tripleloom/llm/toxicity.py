"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Terms that tell the labels apart are chosen on labelled rows; document frequencies of the chosen terms are counted over all
documents. Labelled examples are vectors over those terms in an inverted index whose longer posting lists are cut into blocks of
examples with the largest weight of each. A query adds up short lists, takes the blocks with the best upper bounds and then
those that can still reach the neighbours found so far, so its neighbours are exact. Votes weighted by distance give a raw
score, calibrated on the examples' own leave-one-out votes.

A text without a chosen term is compared in all terms, in the same way, with the examples that have none either. The terms of
that second index are all those of its examples, and every one counts in vectors and norms.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled, map_texts, rewrite_rows, saved, session_of

#: Labelled documents used as examples at most (by a hash of doc_id): the bound of what is collected and broadcast.
EXAMPLES = 20_000
#: A term is chosen if its log-likelihood ratio for the labels is at least this (one in about 130,000 terms reaches it by
#: chance) and it is in so many examples, if so large a share of these has label 1, and so many times the share of all.
LEAST_RATIO, LEAST_ROWS, LEAST_SHARE, LEAST_LIFT = 20.0, 4, 0.3, 2.0
#: Examples without a chosen term that texts without one are compared with in all terms, at most (by a hash of doc_id).
BARE_EXAMPLES = 1024
#: Examples whose leave-one-out votes calibrate the scores, at most.
CALIBRATION = 4000
NEIGHBOURS, BLOCK = 25, 64
#: A term in one of so many examples, or more, has a row of weights instead of a list.
LONG = 8
#: Texts searched together, at most, and list entries that these may add up.
GROUP, ENTRIES = 64, 1 << 20
#: Bytes of texts cut into words together (a longer text is cut alone).
PORTION = 1 << 22
#: Weight of the share of label 1 among all examples in each vote.
PRIOR_WEIGHT = 0.5

#: ASCII marks and digits become blanks.
MARKS = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))
#: Letters of a longer word that also count as a term, for inflected and compound forms.
STEM = 6


def stem(word: bytes) -> bytes:
    return (word[:STEM] if word.isascii() else word.decode()[:STEM].encode()) + b"*"


def letters(text: str) -> bytes:
    return text.lower().encode().translate(MARKS)


def terms_of(text: str) -> list[bytes]:
    """Words, and the stems of longer ones (with a star)."""
    words = letters(text).split()
    return words + [stem(w) for w in words if len(w) > STEM]


def portions(texts: list[str]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in map(letters, texts):
        if part and size + len(t) > PORTION:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    yield part


def counts_of(texts: list[str], terms: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the places in `terms` of those that it holds, in order, with their frequencies. Distinct words of a portion
    of the texts are looked up once."""
    out, many = [], len(terms) + 1
    for part in portions(texts):
        split = pc.split_pattern(pa.array(part, pa.binary()), b" ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        stems = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words.cast(pa.string()), 0, STEM), "*", "").cast(pa.binary())
        place = pc.fill_null(pc.index_in(pa.concat_arrays([words, stems]), value_set=terms), len(terms)).to_numpy().astype(np.int64)
        own, other = place[: len(words)], np.where(pc.binary_length(words).to_numpy() > STEM, place[len(words) :], len(terms))
        code = coded.indices.to_numpy()
        row = np.repeat(np.arange(len(part)) * many, split.value_lengths().to_numpy())
        found = np.concatenate([own[code][(mine := own[code] < len(terms))] + row[mine], other[code][(mine := other[code] < len(terms))] + row[mine]])
        found.sort()
        first = np.flatnonzero(np.diff(found, prepend=-1))
        found, times = found[first], np.diff(first, append=len(found))
        ends = np.searchsorted(found, np.arange(len(part) + 1) * many).tolist()
        found %= many
        out += [(found[a:b], times[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    return out[: len(texts)]


def ratio(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Log-likelihood ratio of presence against label: in a of n1 rows with label 1, in b of n0 with label 0."""
    share = (a + b) / max(1, n1 + n0)
    parts = [(p, share * n) for p, n in ((a, n1), (b, n0))] + [(n - p, (1 - share) * n) for p, n in ((a, n1), (b, n0))]
    return 2 * reduce(Column.__add__, [F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0) for seen, expected in parts])


@dataclass
class Index:
    """Block-max inverted index over the examples."""

    terms: dict[bytes, int]
    idf: np.ndarray
    labels: np.ndarray
    ids: list
    prior: float
    none: float  # score of texts without a term
    scale: tuple[float, float] = (0.0, 1.0)
    first: int = 8  # the share of the blocks taken before any is left out is 1 / first

    def vector(self, counts: tuple | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t, n = np.asarray(counts, np.int64).reshape(-1, 2).T
        w = (1 + np.log(n.astype(np.float64))) * self.idf[t]
        return t, w / np.sqrt((w * w).sum())

    def fill(self, rows: list) -> None:
        """Lists of at least one in LONG of the examples become rows of weights cut into blocks, with the largest weight of each;
        the shorter ones stay lists. Rows take LONG times the room of their lists at most."""
        self.blocks = max(1, (len(rows) + BLOCK - 1) // BLOCK)
        found = [self.vector(counts) for counts in rows]
        t = np.concatenate([np.zeros(0, np.int64), *[t for t, _ in found]])
        at = np.repeat(np.arange(len(rows)), [len(t) for t, _ in found])
        w = np.concatenate([np.zeros(0), *[w for _, w in found]])
        size = np.bincount(t, minlength=len(self.terms))
        long = size * LONG >= self.blocks * BLOCK
        self.row = np.where(long, long.cumsum() - 1, -1)
        mine = long[t]
        self.rows = np.zeros((self.blocks, long.sum(), BLOCK))
        self.rows[at[mine] // BLOCK, self.row[t[mine]], at[mine] % BLOCK] = w[mine]
        self.best = self.rows.max(axis=2)  # blocks x rows
        # a short list of term t is from edges[t] to edges[t + 1]
        self.edges = np.append(0, np.where(long, 0, size).cumsum())
        t, at, w = t[~mine], at[~mine], w[~mine]
        order = np.argsort(t, kind="stable")
        self.at, self.w = at[order], w[order]

    def nearest(self, counts: tuple | np.ndarray, without: int = -1) -> list[tuple[float, int]]:
        """(similarity, example) of the nearest examples with some similarity; equally near ones by number."""
        return self.search([self.vector(counts)], np.array([without]))[0]

    def nearest_all(self, rows: list, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """The same for many, in groups."""
        out: list = []
        group: list = []
        load, left_out = 0, np.array(without if without is not None else [-1] * len(rows), np.int64)
        for counts in rows:
            terms, weights = self.vector(counts)
            entries = int((self.edges[terms + 1] - self.edges[terms]).sum())
            if group and (len(group) == GROUP or load + entries > ENTRIES):
                out += self.search(group, left_out[len(out) : len(out) + len(group)])
                group, load = [], 0
            group.append((terms, weights))
            load += entries
        return out + self.search(group, left_out[len(out) :]) if group else out

    def search(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: np.ndarray) -> list[list[tuple[float, int]]]:
        """Short lists are added up whole; rows then block by block: for each vector first those of the blocks with the best
        bounds, then those of the blocks that can still reach its neighbours."""
        n, width = len(vectors), self.blocks * BLOCK
        terms, weights = (np.concatenate(c) for c in zip(*vectors, strict=True))
        which = np.repeat(np.arange(n), [len(t) for t, _ in vectors])
        row = self.row[terms]
        short = row < 0
        start = self.edges[terms[short]]
        size = self.edges[terms[short] + 1] - start
        spots = np.repeat(start - size.cumsum() + size, size) + np.arange(size.sum())
        at = np.repeat(which[short] * width, size) + self.at[spots]
        sums = np.bincount(at, np.repeat(weights[short], size) * self.w[spots], n * width).astype(float, copy=False).reshape(n, self.blocks, BLOCK)
        own = np.zeros((n, self.best.shape[1]))
        own[which[~short], row[~short]] = weights[~short]
        more = own @ self.best.T
        bound = sums.max(axis=2) + more
        order = np.argsort(-bound, axis=1, kind="stable")
        begun = np.zeros(bound.shape, bool)
        np.put_along_axis(begun, order[:, : -(-self.blocks // self.first)], True, 1)
        flat = sums.reshape(n, width)
        self.add_rows(sums, own, begun & (more > 0))
        least = self.reached(flat, without)
        self.add_rows(sums, own, ~begun & (more > 0) & (bound + 1e-9 >= least[:, None]))
        flat = np.round(flat, 9)
        least = self.reached(flat, without)
        out = []
        for s, reached in zip(flat, least.tolist(), strict=True):
            hit = np.flatnonzero(s >= reached if reached > 0 else s > 0)
            hit = hit[np.argsort(-s[hit], kind="stable")][:NEIGHBOURS]
            out.append(list(zip(s[hit].tolist(), hit.tolist(), strict=True)))
        return out

    def add_rows(self, sums: np.ndarray, own: np.ndarray, wanted: np.ndarray) -> None:
        for b in np.flatnonzero(wanted.any(axis=0)).tolist():
            mine = np.flatnonzero(wanted[:, b])
            sums[mine, b] += own[mine] @ self.rows[b]

    @staticmethod
    def reached(sums: np.ndarray, without: np.ndarray) -> np.ndarray:
        """The similarity of the last neighbour found so far; the example `without` (unless -1) is none and loses its own."""
        mine = np.flatnonzero(without >= 0)
        sums[mine, without[mine]] = 0
        return np.partition(sums, -NEIGHBOURS, axis=1)[:, -NEIGHBOURS]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of label 1 among the neighbours, each weighing 1 / (distance + 0.05) of its cosine distance."""
        up, down = PRIOR_WEIGHT * self.prior, PRIOR_WEIGHT
        for s, i in near:
            w = s / (1.05 - s)
            up, down = up + w * self.labels[i], down + w
        return up / down

    def score(self, rows: list) -> list[tuple[float, list]]:
        """Calibrated scores and the ids of the three nearest examples."""
        known = [i for i, counts in enumerate(rows) if len(counts) and len(self.labels)]
        out: list = [(self.none, [])] * len(rows)
        a, b = self.scale
        for i, near in zip(known, self.nearest_all([rows[i] for i in known]), strict=True):
            x = min(max(self.vote(near), 1e-4), 1 - 1e-4)
            out[i] = 1 / (1 + math.exp(-(a + b * math.log(x / (1 - x))))), [self.ids[i] for _, i in near[:3]]
        return out

    def calibrate(self, rows: list) -> None:
        """Logistic scaling of leave-one-out votes, by Newton steps with a mild pull to the votes themselves."""
        if not rows:
            return
        some = list(range(0, len(rows), -(-len(rows) // CALIBRATION)))
        votes = np.array([self.vote(near) for near in self.nearest_all([rows[i] for i in some], some)])
        labels = self.labels[some]
        x = np.clip(votes, 1e-4, 1 - 1e-4)
        x = np.log(x / (1 - x))
        design = np.stack([np.ones_like(x), x], 1)
        w, pull = np.array([0.0, 1.0]), 1.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            gradient = design.T @ (p - labels) + pull * (w - [0.0, 1.0])
            w = w - np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + pull * np.eye(2), gradient)
        if w[1] > 0:
            self.scale = (float(w[0]), float(w[1]))


@dataclass
class WideIndex(Index):
    """The same over all terms. A text holds many of them, so that bounds leave out few blocks: half are taken at first."""

    first: int = 2


def lists(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    """Numbers and frequencies of each text as a list of (t, n)."""
    ends = np.cumsum([0, *[len(t) for t, _ in found]])
    t, n = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(t, pa.int32()), pa.array(n, pa.int64())], ["t", "n"]))


@dataclass
class Scorer:
    """The index of chosen terms, and that of all terms for texts without a chosen one; equal ones of either are scored once
    while they are remembered."""

    chosen: Index
    wide: WideIndex

    def __post_init__(self) -> None:
        self.known: dict = {}
        self.terms = pa.array([*self.chosen.terms, *self.wide.terms], pa.binary())

    def score(self, texts: list[str]) -> list[tuple[float, list]]:
        if len(self.known) >= 50_000:
            self.known.clear()
        keys, few = [], len(self.chosen.terms)
        new: tuple[dict, dict] = {}, {}
        for terms, times in counts_of(texts, self.terms):
            chosen = int(np.searchsorted(terms, few))
            counts = np.stack([terms[:chosen], times[:chosen]] if chosen else [terms - few, times], 1)
            keys.append((chosen > 0, hashlib.blake2b(counts.tobytes(), digest_size=16).digest()))
            if keys[-1] not in self.known:
                new[chosen > 0][keys[-1]] = counts
        for index, rows in zip((self.wide, self.chosen), new, strict=True):
            self.known.update(zip(rows, index.score(list(rows.values())), strict=True))
        return [self.known[k] for k in keys]

    def __reduce__(self):
        return Scorer, (self.chosen, self.wide)


def fit(docs: DataFrame, labels: DataFrame, rows: int = EXAMPLES) -> Scorer:
    """Both indexes from at most `rows` labelled documents outside the held-out fifth (crc32 of doc_id as text, mod 5, is 0).
    Labels without a document, null labels and null ids aren't used; several labels of a document count as the largest; of
    several texts of a document the least counts; equal texts with equal labels are one example. Without any usable
    label all scores are 0."""
    label = labels.filter("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    label = label.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    one = labelled(docs, label, "toxic", rows).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    train = saved(one.groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id")))

    def present(texts, batch):
        counts: Counter = Counter()
        for t, y in zip(texts, batch.column(0).to_pylist(), strict=True):
            counts.update((w, y) for w in set(terms_of(t)))
        first = [[{"term": w, "y": y, "n": n} for (w, y), n in counts.items()]] + [[]] * (len(texts) - 1)
        return [pa.array(first, pa.list_(pa.struct([("term", pa.binary()), ("y", pa.int32()), ("n", pa.int64())])))]

    sizes = {r[0]: r[1] for r in train.groupBy("toxic").agg(F.count("*")).collect()}
    n1, n0 = sum(n for y, n in sizes.items() if y > 0), sum(n for y, n in sizes.items() if y <= 0)
    share = n1 / max(1, n1 + n0)
    least = max(LEAST_SHARE, LEAST_LIFT * min(0.4, share))
    found = (
        map_texts(train.withColumn("toxic", (F.col("toxic") > 0).cast("int")), ["toxic"], "found array<struct<term:binary,y:int,n:bigint>>", present)
        .select(F.inline("found")).groupBy("term").agg(F.sum(F.col("n") * F.col("y")).alias("a"), F.sum(F.col("n") * (1 - F.col("y"))).alias("b"))
        .filter((F.col("a") + F.col("b") >= LEAST_ROWS) & (F.col("a") >= least * (F.col("a") + F.col("b"))))
    )
    best = found.withColumn("ratio", ratio(F.col("a"), F.col("b"), n1, n0)).filter(F.col("ratio") >= LEAST_RATIO).select("term").collect()
    terms = {t: i for i, t in enumerate(sorted(bytes(r["term"]) for r in best))}
    chosen = pa.array(list(terms), pa.binary())

    def vectors(texts, _):
        return [lists(counts_of(texts, chosen))]

    rows_ = map_texts(train, ["doc_id", "toxic"], "counts array<struct<t:int,n:bigint>>", vectors).collect()
    examples = sorted((tuple((c["t"], c["n"]) for c in r["counts"]), r["doc_id"], int(r["toxic"] > 0)) for r in rows_)
    bare = [(d, y) for c, d, y in examples if not c]
    examples = [e for e in examples if e[0]]  # in the order of their terms, so that blocks hold similar examples
    none = (sum(y for _, y in bare) + PRIOR_WEIGHT * share) / (len(bare) + PRIOR_WEIGHT)
    some = sorted(bare, key=lambda e: hashlib.md5(str(e[0]).encode()).digest())[:BARE_EXAMPLES]

    def words(texts, _):
        found = [[{"w": w, "n": n} for w, n in Counter(terms_of(t)).items()] for t in texts]
        return [pa.array(found, pa.list_(pa.struct([("w", pa.binary()), ("n", pa.int64())])))]

    own = train.filter(F.col("doc_id").isin([d for d, _ in some])) if some else train.limit(0)
    # as Arrow columns: a row object for each word of each example would take some hundred bytes of the driver
    texts_ = map_texts(own, ["doc_id"], "words array<struct<w:binary,n:bigint>>", words).toArrow().combine_chunks()
    found_ = texts_.column("words").combine_chunks()
    flat, ends = found_.flatten(), found_.value_lengths().to_numpy().cumsum()
    coded = flat.field("w").dictionary_encode()
    own_words = coded.dictionary.to_pylist()
    wide_terms = {w: i for i, w in enumerate(sorted(own_words))}
    pairs_ = np.stack([np.array([wide_terms[w] for w in own_words], np.int64)[coded.indices.to_numpy()], flat.field("n").to_numpy()], 1)
    words_of = {d: c[np.argsort(c[:, 0])] for d, c in zip(texts_.column("doc_id").to_pylist(), np.split(pairs_, ends[:-1]), strict=True)} if len(ends) else {}
    counted = {w: i for i, w in enumerate(sorted(terms.keys() | wide_terms.keys()))}

    numbered = pa.array(list(counted), pa.binary())

    def frequency(texts, _):
        df = np.bincount(np.concatenate([t for t, _ in counts_of(texts, numbered)]), minlength=len(counted))
        held = np.flatnonzero(df)
        return [lists([(held, df[held])] + [(held[:0], held[:0])] * (len(texts) - 1))]

    df = np.zeros(len(counted))
    if counted:
        sums = map_texts(docs, [], "df array<struct<t:int,n:bigint>>", frequency).select(F.inline("df")).groupBy("t").agg(F.sum("n").alias("n")).toArrow()
        df[sums.column("t").to_numpy()] = sums.column("n").to_numpy()
    weight = np.log((1 + docs.count()) / (1 + df)) + 1
    idf = lambda of: weight[np.array([counted[w] for w in of], np.int64)]

    def filled(index: Index, rows: list) -> Index:
        index.fill(rows)
        index.calibrate(rows)
        return index

    index = Index(terms=terms, idf=idf(terms), labels=np.array([y for _, _, y in examples], float), ids=[d for _, d, _ in examples], prior=share, none=none)
    # by the most frequent terms, which tell languages and topics apart, so that blocks hold similar examples
    of_bare = [(words_of[d], d, y) for d, y in some if len(words_of[d])]
    of_bare.sort(key=lambda e: ([(-int(n), int(t)) for t, n in e[0][np.lexsort((e[0][:, 0], -e[0][:, 1]))[:4]]], e[1]))
    wide = WideIndex(terms=wide_terms, idf=idf(wide_terms), labels=np.array([y for _, _, y in of_bare], float), ids=[d for _, d, _ in of_bare], prior=none, none=none)
    return Scorer(filled(index, [c for c, _, _ in examples]), filled(wide, [c for c, _, _ in of_bare]))


def scores(docs: DataFrame, labels: DataFrame, keep: list[str] = ["doc_id"]) -> DataFrame:
    """(keep…, score, evidence) for every row's whole text; evidence is the doc_ids of the nearest examples. Null text counts
    as empty; texts without any term of an example get the share of label 1 among examples without a chosen term, and no
    evidence. Repeated rows stay."""
    spark = session_of(docs)
    scorer = spark.sparkContext.broadcast(fit(docs, labels))

    def each(texts, _):
        found = scorer.value.score(texts)
        return [pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))]

    return map_texts(docs, keep, "score double, evidence array<bigint>", each)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all columns, whose score is below the threshold. Null texts count as empty and stay with
    their nulls; of repeated rows all stay or go."""
    scorer = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def each(batch, texts, _):
        return batch.filter(pa.array([s < threshold for s, _ in scorer.value.score(texts)], pa.bool_()))

    return rewrite_rows(docs, each)
