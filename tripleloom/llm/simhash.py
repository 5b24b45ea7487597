"""SimHash near-duplicates, found with BK-trees over shards of fingerprints, and near-duplicates by Jaccard similarity.

A fingerprint has 64 bits. Two that differ in at most `radius` bits agree on at least `blocks - radius` of `blocks`
equal blocks of bits, so every such pair meets in a shard keyed by that many agreeing blocks (for radius 2 and three blocks, by one
block). A BK-tree is built over each shard and searched with its own members. Shards grow with the collection, so they
are dealt by a shuffle on their key; nothing that grows is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, saved, shared_dir, text_or_empty
from .components import components

SEED = 42
#: Fingerprints in one tree at most; a larger shard goes by the exact search of `ball_links`.
TREE = 4096
#: Rows sampled for the order of shingles, and shingles ordered by it at most; the others go by their hashes.
SAMPLE, ORDERED = 8192, 100_000
#: Bits of a shingle's hash in the search for pairs.
BITS = 48
#: Bits of a set's parities.
PARITIES = 512
#: Bits of the bitmap that marks the rows whose sets are needed.
SPOTS = 1 << 23


def majority(counts: np.ndarray, n: int) -> int:
    """The bits set in over half of n hashes, as a signed number."""
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def bit_counts(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(words: list[bytes], size: int) -> int:
    """SimHash over word shingles of `size`, repeats included, as a signed number; no words: zero."""
    if not words:
        return 0
    text = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    n = max(1, len(words) - size + 1)
    starts = (ends - lengths + 1)[:n].tolist()
    stops = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 65_536):  # a very long text in slices
        counts += bit_counts(np.array([digest(text[a:b], SEED) for a, b in zip(starts[k : k + 65_536], stops[k : k + 65_536], strict=True)], "<u8"))
    return majority(counts, n)


def fingerprints(docs: DataFrame, keep: list[str], words: int = 3) -> DataFrame:
    """(keep…, fp) for every row's whole text with A-Z lower-cased; null text counts as empty."""

    def each(texts, _):
        return [pa.array([fingerprint(t.encode().lower().split(), words) for t in texts], pa.int64())]

    return map_texts(docs, keep, "fp bigint", each)


class BKTree:
    """Children hang on the edge of their distance to the parent; a search follows only edges within the radius."""

    def __init__(self, radius: int):
        self.radius, self.root = radius, None

    def search(self, x: int) -> list[tuple[int, int]]:
        """(distance, member) of all members within the radius."""
        found, radius = [], self.radius
        todo = [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                found.append((d, value))
            for edge, child in children.items():
                if -radius <= edge - d <= radius:
                    todo.append(child)
        return found

    def add(self, x: int) -> None:
        if not self.root:
            self.root = (x, {})
            return
        node = self.root
        while d := (node[0] ^ x).bit_count():
            if d not in node[1]:
                node[1][d] = (x, {})
                return
            node = node[1][d]


def masks(blocks: int, choose: int) -> list[int]:
    """The bits that a shard's members agree on, for each choice of blocks, as signed numbers."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << bounds[i + 1]) - 1) ^ ((1 << bounds[i]) - 1) for i in range(blocks)]
    return [m - (m >> 63 << 64) for m in (sum(block[i] for i in c) for c in combinations(range(blocks), choose))]


def shard_links(fps: DataFrame, radius: int, blocks: int, choose: int, tree: int = TREE) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp), found shard by shard. They connect all members that are within the
    radius, by one link to each connected group before a member, so that components over them are those over all pairs.
    Shards of more than `tree` members go by `ball_links` or `piece_links`, which give the same components."""
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("bigint")) for m in masks(blocks, choose)]))
    members = fps.select("fp", keys.alias("mask", "key"))
    sizes = members.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
    small, large = sizes.filter(F.col("n") <= tree), sizes.filter(F.col("n") > tree)
    shards = members.join(small.drop("n"), ["mask", "key"], "left_semi").groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))

    def search(batches):
        for b in batches:
            left, right = [], []
            for shard in b.column(0).to_pylist():
                links(sorted(shard), left, right)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    def links(shard, left, right):
        bk, group = BKTree(radius), {}

        def top(x):
            while group[x] != x:
                group[x] = x = group[group[x]]
            return x

        for x in shard:
            u = x & 0xFFFFFFFFFFFFFFFF
            found = bk.search(u)
            group[x] = x
            for _, v in found:
                other, own = top(v - (v >> 63 << 64)), top(x)
                if other != own:
                    left.append(x)
                    right.append(v - (v >> 63 << 64))
                    group[max(other, own)] = min(other, own)
            bk.add(u)

    found = shards.select("fps").mapInArrow(search, "a bigint, b bigint")
    hot = members.join(large, ["mask", "key"])
    more = ball_links(hot.select("fp").distinct()) if radius <= 2 else piece_links(hot, radius, tree)
    return found.union(more).distinct()


def piece_links(hot: DataFrame, radius: int, tree: int) -> DataFrame:
    """Links within oversized shards (mask, key, fp, n): each is cut into pieces with a tree of their own, and every member
    searches all the trees of its shard, so memory stays bounded. A member gives all its finds."""
    pieces = F.ceil(F.col("n") / tree).cast("int")
    own = hot.select("mask", "key", F.pmod(F.xxhash64("fp"), pieces).cast("int").alias("piece"), F.lit(0).alias("asks"), "fp")
    asks = hot.select("mask", "key", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), F.lit(1).alias("asks"), "fp")
    place = ["mask", "key", "piece"]

    def search(batches):
        now, bk = None, BKTree(radius)
        for b in batches:
            left, right = [], []
            for mask, key, piece, ask, fp in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (mask, key, piece) != now:
                    now, bk = (mask, key, piece), BKTree(radius)
                u = fp & 0xFFFFFFFFFFFFFFFF
                if not ask:
                    bk.add(u)
                else:
                    for v in (v - (v >> 63 << 64) for _, v in bk.search(u) if v != u):
                        left.append(max(fp, v))
                        right.append(min(fp, v))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    rows = own.union(asks).repartition(*place).sortWithinPartitions(*place, "asks")
    return rows.mapInArrow(search, "a bigint, b bigint")


def ball_links(fps: DataFrame) -> DataFrame:
    """Links that connect all fingerprints within two bits, for shards too large for one tree: two are that near exactly
    if some value is within one bit of both. No value is near more than 65, so no group is large."""
    near = fps.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(m - (m >> 63 << 64)).cast("bigint")) for m in (1 << i for i in range(64))])).alias("v"))
    groups = near.groupBy("v").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    return groups.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).filter("a <> b").select("a", "b").distinct()


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, blocks: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest doc_id reachable over links of at most `radius` bits.

    Rows without words have fingerprint zero and are linked like others. Rows without doc_id get a component too; it is
    null only where no member has an id. Repeated rows stay. Fingerprints are kept in the shared folder, 16
    bytes a row, and everything after works on distinct ones."""
    rows = saved(fingerprints(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id"], words))
    least = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(shard_links(least.select("fp"), radius, blocks, blocks - radius))
    joined = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = joined.join(ids, "root").select("fp", "component_id")
    return rows.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles of a text; fewer words: the whole sequence."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    found = {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}
    return np.sort(np.array([xxhash.xxh64_intdigest(s, SEED) for s in found], "<u8"))


def key_of(shingles: bytes, bits: int) -> int:
    """A number that equal shingle sets share."""
    return (xxhash.xxh64_intdigest(shingles, SEED) >> 64 - bits) - (1 << bits - 1)


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes (`BITS` bits) and counts of shingles that repeat in a sample of the rows: no exchange by shingle has to
    count these. They only set the order in which shingles are looked at: any order finds the same pairs."""
    share = min(1.0, SAMPLE / max(1, docs.count()))

    def each(texts, _):
        return [pa.array([short(shingle_set(t, words)) for t in texts], pa.list_(pa.int64()))]

    found = map_texts(docs.sample(share, SEED), [], "found array<bigint>", each).select(F.explode("found").alias("h"))
    rows = found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "h").limit(ORDERED).collect()
    hashes, counts = np.array([r["h"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def short(found: np.ndarray) -> np.ndarray:
    """The first `BITS` bits of hashes: shorter on disk, and an equal pair too many is checked later."""
    return (found >> np.uint64(64 - BITS)).view("<i8")


def parities(found: np.ndarray) -> np.ndarray:
    """For each slot of `PARITIES`, whether an odd number of shingles falls into it. Each shingle that only one of two sets holds
    turns one bit, so the sets differ in as many shingles at least as these bits differ."""
    return np.packbits(np.bincount((found % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES).astype(np.uint8) & 1).view("<i8")


def prefix_length(size: int, similarity: float) -> int:
    """Two sets at the similarity or above share one at least of so many first shingles, in any one order of all shingles."""
    return size - math.ceil(similarity * size - 1e-9) + 1 if size else 0


def split(found: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set that are not common, and the common ones that still fall into its prefix: these come last in the
    order, the least common first."""
    hashes, counts = common
    h = short(found)
    if not len(hashes):
        return h, h[:0]
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    hot = hashes[at] == h
    rest, h, n = h[~hot], h[hot], counts[at[hot]]
    return rest, h[np.lexsort((h, n))[: max(0, prefix_length(len(found), similarity) - len(rest))]]


def rare_prefixes(posts: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """(key, size, shingle): the shingles of each set's prefix that other sets hold too, of those that are not common.

    posts: (key, shingle) for every shingle that is not common (equal rows may repeat); sizes: key, size, common (how many of its
    shingles are). The order is by the number of sets that hold a shingle, counted over all sets. So what only one set holds comes
    first, and a set of which a fifth is its own has no row here: a passage that it shares with many others can't make it a pair."""
    lists = Window.partitionBy("shingle")
    counted = posts.select("*", F.count("*").over(lists).alias("n"), F.min("key").over(lists).alias("low"), F.max("key").over(lists).alias("high"))
    # the number of sets above the bits of the shingle, so that one long sorts both
    ranked = F.shiftleft(F.least("n", F.lit((1 << 63 - BITS) - 1)).cast("bigint"), BITS).bitwiseOR(F.col("shingle"))
    shared = counted.filter("low <> high").select("key", ranked.alias("ranked")).join(sizes, "key")
    own = Window.partitionBy("key")
    place = shared.select("*", F.row_number().over(own.orderBy("ranked")).alias("place"), F.count("*").over(own).alias("shared"))
    first = F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1
    alone = F.col("size") - F.col("common") - F.col("shared")
    return place.filter(F.col("place") <= first - alone).select("key", "size", F.col("ranked").bitwiseAND(F.lit((1 << BITS) - 1)).alias("shingle"))


def close_keys(rows: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Pairs (a, b) of keys with equal or close fingerprints (rows: key, fp), as links that connect them: BK-trees over
    shards of the distinct fingerprints, and each key with the least key of its fingerprint."""
    least = saved(rows.groupBy("fp").agg(F.min("key").alias("least")))
    found = shard_links(least.select("fp"), radius, blocks, blocks - radius)
    for side in ("a", "b"):
        found = found.join(least.select(F.col("fp").alias(side), F.col("least").alias(f"key_{side}")), side)
    same = rows.select("key", "fp").join(least, "fp").filter("key <> least")
    return found.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).union(same.select("key", "least"))


def similar_links(rows: DataFrame, posts: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float, radius: int, blocks: int) -> DataFrame:
    """Links (a, b) whose components are those over all pairs of keys with a Jaccard similarity of at least `similarity`.

    rows: key (each once), fp, parity; posts: key, size, shingle for the shingles of each prefix, those that no other set holds left
    out; sets(keys) gives (key, shingles). Keys that share a shingle of their prefixes are a list. First pairs with close fingerprints are compared and every key of a list is held against the list's least
    and greatest key and its hub, so that a large group is joined by few links. Then all pairs of a list that are not joined yet are looked at,
    but for those whose parities differ in more bits than sets so similar may differ in shingles, and counted:
    what two sets share is at most what their prefixes share and the longer one of their rests, so a pair with less than
    it needs is no pair."""
    lists = Window.partitionBy("shingle")
    # the hub of a list is the text with the fewest shingles of its own, which lies in the middle of a group of near copies
    first = F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1
    ranked = posts.select("*", (first - F.count("*").over(Window.partitionBy("key"))).alias("own"))
    hub = F.min(F.struct("own", "key")).over(lists)["key"]
    marked = ranked.select("key", "size", "shingle", F.min("key").over(lists).alias("first"), F.max("key").over(lists).alias("last"), hub.alias("hub"))
    shared = saved(marked.filter("first <> last"))

    def enough(a, b, part=1.0):
        rest = F.ceil(similarity * F.greatest(a, b) - 1e-9) - 1
        return F.col("n") >= part * (similarity / (1 + similarity) * (a + b) - rest) - 1e-9

    def verify(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                both = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                keep.append(both >= similarity * ((len(x) + len(y)) // 8 - both))
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verified(pairs):
        pairs = saved(pairs)
        shingles = saved(sets(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()))
        place = pairs.join(shingles.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
        place = place.join(shingles.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")
        return place.mapInArrow(verify, "a bigint, b bigint")

    ends = shared.select(F.col("key").alias("a"), "size", F.explode(F.array_distinct(F.array("first", "last", "hub"))).alias("b")).filter("a <> b")
    ends = ends.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("size").alias("size")).filter(enough(F.col("size"), F.col("size"), 0.5))
    ends = ends.select("a", "b").union(close_keys(rows, radius, blocks))
    joined = saved(components(verified(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())))
    labelled = shared.drop("first", "last", "hub").join(joined, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")).drop("node")
    labelled = labelled.select("*", F.min("root").over(lists).alias("low"), F.max("root").over(lists).alias("high"))
    left = saved(labelled.filter("low <> high").drop("low", "high").join(rows.select("key", "parity"), "key"))
    x = left.select("shingle", *[F.col(c).alias(f"{c}_a") for c in ("key", "root", "size", "parity")])
    y = left.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("key", "root", "size", "parity")])
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    differ = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITIES // 64)), F.lit(0))
    near = (small >= similarity * large - 1e-9) & (differ <= (1 - similarity) / (1 + similarity) * (small + large) + 1e-9)
    pairs = x.join(y, (x["shingle"] == y["shingle"]) & (F.col("key_a") < F.col("key_b")) & (F.col("root_a") != F.col("root_b")) & near)
    pairs = pairs.groupBy(F.col("key_a").alias("a"), F.col("key_b").alias("b"), "size_a", "size_b").agg(F.count("*").alias("n"))
    pairs = pairs.filter(enough(F.col("size_a"), F.col("size_b"))).select("a", "b")
    return joined.select(F.col("node").alias("a"), F.col("root").alias("b")).union(verified(pairs))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 2, blocks: int = 3, bits: int = 64) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each group one row stays, that with the smallest doc_id.

    Texts with equal shingle sets (case apart) are one text. Two texts are linked if the Jaccard similarity of their shingle
    sets is at least `similarity`: pairs whose fingerprints over these sets are within `radius` bits are compared first,
    then `similar_links` finds the rest exactly. Groups are the connected components. Rows with null ids rank last; of
    fully equal rows one stays. Empty and null texts are one group. All columns stay, whatever their names.

    A text goes by a key of `bits` bits in the search; different texts with one key are left out of it and stay, each as its
    own group, so that no text is lost to that."""
    spark = docs.sparkSession
    shared_dir(spark)
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("copy", F.xxhash64("text"))
    common = spark.sparkContext.broadcast(common_shingles(known, words))

    def marks(texts, _):
        sets = [shingle_set(t, words) for t in texts]
        data = [s.tobytes() for s in sets]
        keys = [key_of(d, bits) for d in data]
        checks = [xxhash.xxh64_intdigest(d, SEED + 1) - (1 << 63) for d in data]
        parts = [split(s, common.value, similarity) for s in sets]
        counts = [len(s) - len(rest) for s, (rest, _) in zip(sets, parts, strict=True)]
        fps = [majority(bit_counts(s), len(s)) if len(s) else 0 for s in sets]
        numbers = [pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(counts, pa.int32()), pa.array(fps, pa.int64())]
        return [*numbers, *(pa.array(a, pa.list_(pa.int64())) for a in (list(map(parities, sets)), [first for _, first in parts]))]

    spot = F.pmod(F.xxhash64("copy", "doc_id"), F.lit(SPOTS))
    marked = map_texts(known, ["doc_id", "copy"], "key bigint, check bigint, size int, common int, fp bigint, parity array<bigint>, prefix array<bigint>", marks)
    rows = saved(marked.select("key", "check", "size", "common", "fp", "parity", "prefix", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy").alias("row"), spot.alias("spot")))
    # copies meet here, after a part of them in each task; from here on a text is one row
    one = rows.groupBy("key").agg(
        F.min("row").alias("row"), F.min("spot").alias("spot"), F.min("check").alias("check"), F.max("check").alias("other"),
        F.first("size").alias("size"), F.first("common").alias("common"), F.first("fp").alias("fp"), F.first("parity").alias("parity"), F.first("prefix").alias("prefix"),
    )
    one = saved(one)
    alone = one.filter("check <> other").select("key")
    one = one.filter("check = other")

    def sets_of(wanted, each, schema):
        # one row of each wanted key, marked in a bitmap of fixed size, so that no text is shuffled; more rows may be marked by chance
        bitmap = wanted.groupBy(F.expr("bitmap_bucket_number(spot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(spot))").alias("bits"))
        held = spark.sparkContext.broadcast({r["bucket"]: bytes(r["bits"]) for r in bitmap.collect()})

        def run(batches):
            for b in batches:
                texts = (t for p, bit, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if p in held.value and held.value[p][bit >> 3] >> (bit & 7) & 1)
                yield from each([shingle_set(t, words) for t in texts])

        places = known.select(spot.alias("spot"), text_or_empty().alias("text")).selectExpr("bitmap_bucket_number(spot) AS place", "bitmap_bit_position(spot) AS bit", "text")
        return places.mapInArrow(run, schema)

    def whole(sets):
        data = [s.tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array([key_of(d, bits) for d in data], pa.int64()), pa.array(data, pa.binary())], names=["key", "shingles"])

    def shingles(wanted):
        chosen = one.select("key", "spot").join(wanted, "key", "left_semi")
        return sets_of(chosen, whole, "key bigint, shingles binary").join(wanted, "key", "left_semi").dropDuplicates(["key"])

    def flat(sets):
        parts = [split(s, common.value, similarity)[0] for s in sets]
        if any(map(len, parts)):
            keys = np.repeat(np.array([key_of(s.tobytes(), bits) for s in sets], np.int64), list(map(len, parts)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate(parts))], names=["key", "shingle"])

    rare = rare_prefixes(sets_of(one, flat, "key bigint, shingle bigint"), one.select("key", "size", "common"), similarity)
    posts = saved(rare.union(one.select("key", "size", F.explode("prefix").alias("shingle"))))
    roots = components(similar_links(one.select("key", "fp", "parity"), posts, shingles, similarity, radius, blocks))
    best = one.join(roots, F.col("key") == F.col("node"), "left").groupBy(F.coalesce("root", "key")).agg(F.min("row").alias("row")).select("row")
    best = best.union(rows.join(alone, "key").groupBy("key", "check").agg(F.min("row").alias("row")).select("row"))

    def mark(doc_id, copy):
        return F.concat_ws(":", F.coalesce(doc_id.cast("bigint").cast("string"), F.lit("-")), copy)

    # one exchange of the documents serves the join and the removal of repeated rows
    kept = docs.select(mark(F.col("doc_id"), F.xxhash64("text")).alias("mark"), F.struct("*").alias("row"))
    best = best.select(mark(F.col("row.doc_id"), F.col("row.copy")).alias("mark"))
    return kept.join(best, "mark", "left_semi").dropDuplicates(["mark"]).select("row.*")
