"""Quality rules and a gradient-boosted model over document statistics.

Statistics are worked out per document in one pass; the model is trained here on a bounded sample of labelled rows with
monotonic constraints, flattened into numpy node arrays and applied to whole batches at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled, map_texts, session_of

WINDOW = 8
#: Labelled rows for training at most (by a hash of doc_id).
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF, PENALTY = 60, 4, 0.2, 64, 8, 1.0
KEEP_AT = 0.5

BLANKS, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
UPPER, DIGITS, PUNCTUATION = bytes(range(65, 91)), bytes(range(48, 58)), b".,;:!?"
ODD = np.uint64(0x9E3779B97F4A7C15)

#: Features of the model. +1: the score never falls as the feature grows; -1: it never rises.
FEATURES = {
    "n_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0,
    "upper_share": -1, "digit_share": 0, "stop_share": 0, "marks_per_word": 0, "words_per_line": 0, "non_ascii_share": 0,
}


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of eight words that stand twice or more in the text. Windows are compared by a hash first; where
    hashes meet, by the words themselves."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolled = rolled * ODD + h[k : k + n]
    order = np.sort(rolled)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    places = np.flatnonzero(np.isin(rolled, twice)).tolist()
    seen: dict[tuple, list[int]] = {}
    for p in places:
        seen.setdefault(tuple(words[p : p + WINDOW]), []).append(p)
    cover = np.zeros(len(words) + 1, np.int64)
    for found in seen.values():
        if len(found) > 1:
            cover[found] += 1
            cover[np.array(found) + WINDOW] -= 1
    return int((np.cumsum(cover) > 0).sum())


def statistics(text: str) -> tuple[tuple[int, ...], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the model's features."""
    data = text.encode()
    words = data.split()
    n = len(words)
    inside = data.translate(None, BLANKS)
    chars = len(text) - (len(data) - len(inside))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(BLANKS)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    some, letters = max(1, n), max(1, chars)
    size = max(1, len(inside))
    short = sum(1 for w in words if len(w) <= 3)
    features = [
        float(n), chars / some, symbols / letters, dup / max(1, len(lines)), repeat / some, len(set(words)) / some,
        (size - len(inside.translate(None, UPPER))) / size, (size - len(inside.translate(None, DIGITS))) / size, short / some,
        (size - len(inside.translate(None, PUNCTUATION))) / some, n / max(1, len(lines)), (len(data) - len(text)) / letters,
    ]
    return (n, chars, symbols, dup, repeat), features


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Scores of all rows of x at once: every row walks down every tree in step."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                down = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(down, self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, constraints: list[int]) -> Trees:
    """Boosted trees for the logistic loss over binned features. A split on a constrained feature is taken only if its leaves
    stand in the right order, and its middle bounds all leaves below, so that the whole model is monotonic."""
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    share = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1) if len(x) else np.zeros(x.shape, int)
    score = np.full(len(x), start)

    def grow(at, depth, low, high, g, h):
        k = len(nodes)
        value = float(np.clip(-g[at].sum() / (h[at].sum() + PENALTY), low, high))
        nodes.append([0, np.inf, k, k, RATE * value])
        if depth == DEPTH or len(at) < 2 * LEAST_LEAF:
            score[at] += RATE * value
            return k
        best = (1e-6, None)
        total_g, total_h = g[at].sum(), h[at].sum()
        for j, e in enumerate(edges):
            if not len(e):
                continue
            size = len(e) + 1
            gs = np.cumsum(np.bincount(bins[at, j], g[at], size))[:-1]
            hs = np.cumsum(np.bincount(bins[at, j], h[at], size))[:-1]
            n = np.cumsum(np.bincount(bins[at, j], minlength=size))[:-1]
            vl, vr = np.clip(-gs / (hs + PENALTY), low, high), np.clip(-(total_g - gs) / (total_h - hs + PENALTY), low, high)
            gain = -(gs * vl + 0.5 * (hs + PENALTY) * vl**2) - ((total_g - gs) * vr + 0.5 * (total_h - hs + PENALTY) * vr**2)
            gain += total_g * value + 0.5 * (total_h + PENALTY) * value**2
            ok = (n >= LEAST_LEAF) & (len(at) - n >= LEAST_LEAF) & (constraints[j] * (vr - vl) >= 0)
            gain = np.where(ok, gain, -1)
            c = int(gain.argmax())
            if gain[c] > best[0]:
                best = (gain[c], (j, c, vl[c], vr[c]))
        if best[1] is None:
            score[at] += RATE * value
            return k
        j, c, vl, vr = best[1]
        mid = (vl + vr) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[constraints[j]]
        down = bins[at, j] <= c
        nodes[k][0], nodes[k][1] = j, edges[j][c]
        nodes[k][2] = grow(at[down], depth + 1, *bounds[0], g, h)
        nodes[k][3] = grow(at[~down], depth + 1, *bounds[1], g, h)
        return k

    for _ in range(TREES if len(set(y.tolist())) > 1 else 0):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(len(x)), 0, -np.inf, np.inf, p - y, np.maximum(p * (1 - p), 1e-6)))
    flat = np.array(nodes, float).reshape(-1, 5)
    return Trees(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots, int), start)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """The model from labelled rows. Labels that are null or lack an id or a document aren't used; several labels of a document
    count as the smallest. Without two different labels the model keeps everything."""
    label = labels.filter("doc_id is not null and quality is not null")
    label = label.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min((F.col("quality") > 0).cast("int")).alias("quality"))

    def each(texts, _):
        return [pa.array([statistics(t)[1] for t in texts], pa.list_(pa.float64()))]

    chosen = map_texts(labelled(docs, label, "quality", rows), ["doc_id", "quality"], "features array<double>", each)
    # of a document's repeated rows one counts, so that what is collected stays within the bound
    found = chosen.groupBy("doc_id").agg(F.min(F.struct("features", "quality")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").collect()
    x = np.array([r["features"] for r in found], float).reshape(-1, len(FEATURES))
    y = np.array([r["quality"] for r in found], float)
    return train(x, y, list(FEATURES.values()))


def quality(docs: DataFrame, labels: DataFrame, keep: list[str] = ["doc_id"]) -> DataFrame:
    """(keep…, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) for every row's whole text.
    Null text counts as empty and fails; repeated rows and null ids stay; other columns are not read."""
    spark = session_of(docs)
    model = spark.sparkContext.broadcast(fit(docs, labels))

    def each(texts, _):
        rows = [statistics(t) for t in texts]
        base = np.array([r[0] for r in rows], np.int64)
        p = model.value.probability(np.array([r[1] for r in rows], float))
        failed = (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])
        return [*(pa.array(c, pa.int64()) for c in base.T), pa.array(failed), pa.array(p), pa.array(~failed & (p >= KEEP_AT))]

    schema = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, score double, kept boolean"
    return map_texts(docs, keep, schema, each)
