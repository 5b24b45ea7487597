"""Conversation repair, whitening and mixing against brute force, library results and edge cases."""

import hashlib
import random
import re
import zlib
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleloom.llm import mixing, queries, repair, whitening

DATA = "/root/testdata/sf0.001"


def damaged(rows):
    """conv_id -> [(turn, role, text)] after damage, in order."""
    found = {}
    for c, turn, role, text in rows:
        found.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        found[c] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for rs in found.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    return found


def cheapest(roles, faults):
    """(cost, edits) of the best of all edits: whole edit texts compared, up to two turns put in at each place."""
    keep, other = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}, (2, 2, 3, 2)
    behind = [(0, ""), (9**9, ""), (9**9, ""), (0, "")]
    for i in range(len(roles), -1, -1):
        ways = [[behind[s]] if i == len(roles) else [(4 + behind[s][0], "D" + behind[s][1])] for s in range(4)]
        for s in range(4 if i < len(roles) and faults[i] not in ("blank", "duplicate") else 0):
            late = 3 * (faults[i] == "truncated")
            cost, edits = behind[other[s]]
            ways[s].append((cost + 3 + late, "R" + edits))
            if (to := keep[s].get(roles[i][:1])) is not None:
                ways[s].append((behind[to][0] + late, "K" + behind[to][1]))
        once = [ways[s] + [(c + 3, "I" + e) for c, e in ways[other[s]]] for s in range(4)]
        behind = [min(once[s] + [(c + 3, "I" + e) for c, e in once[other[s]]]) for s in range(4)]
    return behind[0]


def brute_repair(rows):
    found = {}
    for c, rs in damaged(rows).items():
        seen, faults = set(), []
        for _, role, text in rs:
            marks = re.findall("[^\x20\x09-\x0d]", text)
            faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "" if marks[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in rs if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        cost, edits = cheapest([r for _, r, _ in rs], faults)
        said, state, left = [], 0, list(rs)
        for e in edits:
            made = ("user", "user", "assistant", "user")[state]
            _, role, text = (None, made, "") if e == "I" else left.pop(0)
            if e != "D":
                role = role if e == "K" else made
                said.append(f"{role}:{text}")
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
        found[c] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, edits, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return found


def mended(df, **how):
    rows = repair.repair(df, **how).collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_repair_against_brute_force(spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    texts = ["a.", "b.", "c!", "no end", "  ", "", None, "x?", "y. \x0b", "z", "é。"]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for c in [*range(40), None] for _ in range(rng.randint(0, 9))]
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumn("c", F.lit(1)).withColumn("letters", F.lit("x"))
    want = brute_repair(rows)
    for longest in (1 << 16, 1):  # pieces of one row try the cost matrices
        assert mended(df, longest=longest) == want


def test_repair_of_one_long_conversation(spark):
    rng = random.Random(6)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["same.", f"t{t}.", "cut", ""])) for t in range(700)]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    want = brute_repair(rows)
    assert mended(df, longest=50) == want == mended(df)
    assert repair.pieces(repair.faults(repair.damaged(df)), 50).count() > 10


def test_repair_table_and_edges(spark):
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, DATA).collect()}
    assert got == brute_repair(rows)
    assert repair.repair(df.limit(0)).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    alone = repair.repair(spark.createDataFrame([(1, gone, "user", "x.")], CONVERSATIONS)).collect()
    assert [tuple(r) for r in alone] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    twice = spark.createDataFrame([(2, 3, "user", "long " * 50_000)] * 5, CONVERSATIONS)
    assert mended(twice) == brute_repair([(2, 3, "user", "long " * 50_000)] * 5)


def test_repair_walks_each_suffix_once():
    repair.step.cache_clear()
    assert repair.shared("abcd", "abxd") == 2 and repair.shared("", "a") == 0 and repair.shared("ab", "ab") == 2
    least, costs, best = repair.step("u", repair.END)
    assert (least + costs[0], best[0]) == (3, "K")  # a user's turn alone: keep it, then put an answer in behind


def polynomial_by_fractions(a):
    """Faddeev and LeVerrier's coefficients, from the constant on."""
    n = len(a)
    m, c = [[Fraction(0)] * n for _ in range(n)], [Fraction(1)]
    for k in range(1, n + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(n)) + (c[-1] if i == j else 0) for j in range(n)] for i in range(n)]
        c.append(-sum(a[i][t] * m[t][i] for i in range(n) for t in range(n)) / k)
    return [int(x) for x in c[::-1]]


def test_characteristic_polynomial(spark):
    rng = np.random.default_rng(1)
    for d, rank in ((1, 1), (2, 1), (5, 5), (6, 3)):
        x = rng.integers(-(10**6), 10**6, (rank, d)).astype(object)
        a = (x.T @ x).tolist()
        poly = whitening.characteristic_polynomial(spark, a)
        assert poly == polynomial_by_fractions(a)
        assert next(i for i, c in enumerate(poly) if c) == d - rank
    assert whitening.characteristic_polynomial(spark, [[0, 0], [0, 0]]) == [0, 0, 1]


def test_roots_and_null_space(spark):
    a = [[4, 0, 0], [0, 4, 0], [0, 0, 9]]  # a double root
    poly = whitening.characteristic_polynomial(spark, a)
    assert [whitening.roots_above(poly, x) for x in (0, 3, 4, 8, 9)] == [3, 3, 1, 1, 0]
    lo, bits, first, count = whitening.isolate(poly, 3, 4.1, 9.0)
    assert (first, count) == (2, 2) and lo < 4 << bits <= lo + 1
    with localcontext() as c:
        c.prec = 90
        v = whitening.null_space(a, Decimal(2 * lo + 1) / Decimal(2 << bits), 2)
    assert np.allclose(v.astype(float) @ v.astype(float).T, np.eye(2), atol=1e-15) and np.abs(v[:, 2].astype(float)).max() < 1e-20
    (r1, v1), (r2, v2), (r3, v3) = whitening.components(spark, a, poly, 3)
    assert (r1, r2, r3) == (9.0, 4.0, 4.0) and abs(np.dot(v2, v3)) < 1e-15


def compare_whitening(rows, want_rows):
    v = np.array([r for _, r in want_rows], float)
    x = np.floor(1024 * v)
    apart = x - x.mean(axis=0)
    e, u = np.linalg.eigh(apart.T @ apart / len(x))
    e, u = e[::-1], u[:, ::-1]
    k = min(8, int((e > e[0] * 1e-12).sum()))
    assert len(rows) == k * len(want_rows) and {r["component"] for r in rows} == set(range(1, k + 1))
    ints = [[int(c) + 100_000 for c in r] for r in x]
    sums = [sum(c) for c in zip(*ints)]
    far = sorted((i, sum((len(ints) * c - s) ** 2 for c, s in zip(r, sums))) for (i, _), r in zip(want_rows, ints))
    white = apart @ u[:, :k] / np.sqrt(e[:k])
    for c in range(1, k + 1):
        mine = sorted((r for r in rows if r["component"] == c), key=lambda r: (r["vec_id"], r["deviation"], abs(r["whitened"])))
        assert [(r["vec_id"], int(r["deviation_exact"])) for r in mine] == far and all(r["deviation"] == int(r["deviation_exact"]) for r in mine)
        assert all(r["n"] == len(ints) and r["identity_error"] < 1e-9 and abs(r["explained"] / (e[c - 1] / e.sum()) - 1) < 1e-9 for r in mine)
        other = [x for _, _, x in sorted((i, d, abs(w)) for (i, _), d, w in zip(want_rows, (sum((len(ints) * q - s) ** 2 for q, s in zip(r, sums)) for r in ints), white[:, c - 1]))]
        assert np.allclose([abs(r["whitened"]) for r in mine], other, atol=1e-8)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i % 20, rng.normal(size=4).astype(np.float32).tolist()) for i in range(60)]
    good += good[:7]  # repeated rows count each time
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [float("nan"), 0.0, 0.0, 0.0]), (103, [float("inf")] * 4), (104, []), (105, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in good + bad], "vec_id long, embedding array<float>, component int, v string").repartition(5)
    compare_whitening(whitening.whitened(df).collect(), good)


def test_whitening_tables_and_edges(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    compare_whitening(queries.op12_embedding_whitening(spark, DATA).collect(), [(r["vec_id"], r["embedding"]) for r in df.collect()])
    kind = "vec_id long, embedding array<float>"
    assert whitening.whitened(df.limit(0)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).count() == 0  # nothing varies
    flat = whitening.whitened(spark.createDataFrame([(None, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [6.0, 7.0])], kind)).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 3  # one direction only
    large = [(i, [1e13 * i, float(i % 3), -1e13]) for i in range(9)]
    rows = whitening.whitened(spark.createDataFrame(large, "vec_id long, embedding array<double>")).collect()
    ints = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in large]
    sums = [sum(c) for c in zip(*ints)]
    assert {r["vec_id"]: int(r["deviation_exact"]) for r in rows} == {i: sum((9 * c - s) ** 2 for c, s in zip(v, sums)) for (i, _), v in zip(large, ints)}
    assert max(r["identity_error"] for r in rows) < 1e-9


def shares(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing what is above, in fractions."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, free, rest = {}, set(names), Fraction(sum(sizes.values()))
    while free:
        level = rest / sum(w[s] for s in free)
        above = {s for s in free if level * w[s] > most * sizes[s]}
        if not above:
            return {**capped, **{s: level * w[s] for s in free}}
        for s in above:
            capped[s] = Fraction(most * sizes[s])
            rest -= capped[s]
        free -= above
    return capped


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def check_mix(rows, docs, near):
    size = {}
    for _, text, source in docs:
        size[source] = size.get(source, 0) + words(text)
    want, of = shares(size), {d: s for d, _, s in docs}
    assert sorted((r["doc_id"], r["size"]) for r in rows) == sorted((d, words(t)) for d, t, _ in docs)
    taken, times = dict.fromkeys(size, 0), dict.fromkeys(size, 0)
    for r in rows:
        s = of[r["doc_id"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(float(want[s])) and 0 <= r["taken"] <= 3 * r["size"]
        q = want[s] / size[s] if size[s] else 0
        assert r["taken"] in (r["size"] * int(q), r["size"] * (int(q) + (q > int(q))))
        taken[s] += r["taken"]
        times[s] += r["taken"] // r["size"] if r["size"] else 0
    for s in size:
        n = sum(1 for _, t, x in docs if x == s and words(t))
        largest = max(words(t) for _, t, x in docs if x == s)
        assert abs(taken[s] - want[s]) <= max(near * want[s], largest), s
        assert size[s] == 0 or abs(times[s] - n * want[s] / size[s]) < 3, s
    return taken, want


def test_mixing(spark):
    rng = random.Random(2)
    docs = [(i, "w " * max(int(rng.lognormvariate(4, 1)), 1), rng.choice(["a", "b", "B", "é", "\U0001f600", None, "￮"])) for i in range(1200)]
    docs += [(i, "hot " * rng.randint(1, 300), "hot") for i in range(2000, 2900)] + [(3000, None, "b"), (3001, " \n", "empty"), (3002, "word " * 30_000, "z"), (3003, "one", "tiny")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("target", F.lit(None).cast("int"))
    first = mixing.mix(df, block=40).collect()
    taken, want = check_mix(first, docs, 0.01)
    assert sum(abs(taken[s] - want[s]) for s in ("hot", "a", "b", "B", None)) < 0.002 * sum(want.values())
    again = mixing.mix(df.repartition(7), block=40).collect()  # however the rows are dealt
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    assert mixing.mix(df.limit(0)).count() == 0
    nothing = mixing.mix(spark.createDataFrame([(1, "", "a"), (None, None, None)], "doc_id long, text string, source string")).collect()
    assert sorted(map(tuple, nothing), key=repr) == [(1, 0, 0, 0.0, 0), (None, 0, 0, 0.0, 0)]


def test_mixing_table_and_repeated_rows(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
    check_mix(queries.op13_source_mixing(spark, DATA).collect(), docs, 0.02)
    same = [(5, "x y z", "a")] * 301 + [(6, "u v", "b")] * 100
    rows = mixing.mix(spark.createDataFrame(same, "doc_id long, text string, source string"), block=20).collect()
    assert len(rows) == 401
    for s, target in shares({"a": 903, "b": 200}).items():
        assert abs(sum(r["taken"] for r in rows if r["doc_id"] == (5 if s == "a" else 6)) - target) <= 3


def test_flight_keeps_words_and_documents():
    flight, rng, sizes, p, done = mixing.Flight("x", 0), random.Random(4), {}, 0.37, {}
    for i in range(3000):
        sizes[i] = rng.randint(1, 900)
        done |= dict(flight.add(i, sizes[i], p))
    done |= dict(flight.left())
    assert len(done) == 3000 and sum(0 < x < 1 for x in done.values()) <= 2
    assert sum(done.values()) == pytest.approx(3000 * p) and sum(sizes[i] * x for i, x in done.items()) == pytest.approx(p * sum(sizes.values()))
