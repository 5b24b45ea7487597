"""Repair of damaged conversations by the cheapest edits, worked out once for each suffix that conversations share.

A conversation is read as a signature, one letter for each row's role and fault. Signatures, sorted from their ends, are walked
as an automaton with shared suffixes: a node is a distinct suffix, and its cost-to-go and best next edit for each state of the
grammar are worked out once, however many conversations end that way. Only the path to the current signature is in memory.
Long conversations are cut into pieces by range, so none is gathered for this: pieces become small cost matrices, which give each
piece the costs behind it. Texts are exchanged once, and streamed in order into the digests; a digest is one chain over
all of a conversation's text, which therefore passes through one task, though never held there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, session_of

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: Grammar states: nothing yet, behind system, behind user, behind assistant. It may end in the first and the last.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
#: Where a user's or assistant's turn leads that is put in or made from another, and what it is then.
NEXT, SAID = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
KEPT = {"s": {BEGIN: SYSTEM}, "u": {BEGIN: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
NEVER = 1 << 60
#: Costs behind the last row, and the edits that they stand for.
END, TAILS = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
#: Rows of a conversation in one piece at most.
PIECE = 1 << 16
#: Letters of rows: roles s u a and others, each without fault, blank, duplicate and truncated; and what the grammar sees of them:
#: the role, in capitals if truncated, or D if the row must go.
LETTERS, SEEN = "ABCDEFGHIJKLMNOP", "sDDSuDDUaDDAoDDO"
BLANKS = " \t\n\x0b\x0c\r"


def damaged(conversations: DataFrame) -> DataFrame:
    """(c, turn, role, text, digest, blank, cut_off, copies): the rows left by damage that their conversation and turn
    decide; c is a text that stands for conv_id, also where that is null. Null roles and texts are one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = conversations.select(key().alias("c"), "conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.filter("kind <> 0").withColumn("text", text).withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    bare = F.rtrim("text", F.lit(BLANKS))
    return rows.select(
        "c", "turn", "role", "text", F.sha2("text", 256).alias("digest"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?") & (bare != "")).alias("cut_off"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def faults(rows: DataFrame) -> DataFrame:
    """(c, turn, role, digest, n, fault): equal rows of a turn as one, with how many there are; fault 1 blank, 2 duplicate of an
    earlier turn's, 3 truncated, 0 none. Role and digest stand for role and text. Texts take no part, and counts come before
    any exchange."""
    alike = saved(rows.groupBy("c", "turn", "role", "digest", "blank", "cut_off").agg(F.sum("copies").alias("n")))
    first = F.min(F.struct("turn")).alias("first")
    repeated = alike.groupBy("c", "role", "digest").agg(first, F.count("*").alias("turns")).filter("turns > 1").drop("turns")
    both = alike.join(repeated, ["c", "role", "digest"], "left")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return both.select("c", "turn", "role", "digest", "n", F.when(F.col("blank"), 1).when(later, 2).when(F.col("cut_off"), 3).otherwise(0).alias("fault"))


def pieces(rows: DataFrame, longest: int = PIECE) -> DataFrame:
    """(c, part, at, letters): signatures by conversation, in order of part and at. Rows are dealt by ranges of conversation and
    turn, so a long conversation spreads over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, now, held, done = TaskContext.get().partitionId(), 0, None, [], []

        def flush() -> None:
            nonlocal at, held
            if held:
                done.append((now, part, at, "".join(held)))
                at, held = at + 1, []

        for b in batches:
            for c, role, n, fault in zip(*(b.column(x).to_pylist() for x in ("c", "role", "n", "fault"))):
                if c != now:
                    flush()
                    now = c
                group = 4 * "sua".index(role[0]) if role[:1] in ("s", "u", "a") else 12
                held.append(LETTERS[group + fault])
                again = LETTERS[group + (fault if fault == 1 else 2)]
                for _ in range(n - 1):
                    if len(held) >= longest:
                        flush()
                    held.append(again)
                if len(held) >= longest:
                    flush()
            if len(done) >= 4096:
                yield batch(done)
                done.clear()
        flush()
        if done:
            yield batch(done)

    def batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], names=["c", "part", "at", "letters"])

    order = ["c", "turn", "role", "digest"]
    return saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("c", "role", "n", "fault").mapInArrow(run, "c string, part int, at long, letters string"))


@lru_cache(maxsize=1 << 16)
def step(seen: str, behind: tuple[int, ...]) -> tuple[int, tuple[int, ...], str]:
    """What a row adds to the costs behind it: the least cost, costs above it for each state, and the best edit for each: the
    cheapest, of equals the first by letter. An inserted turn leaves the row itself for the next state."""
    stays, role, fine = seen != "D", seen.lower(), KEEP if seen.islower() else CUT_OFF
    base = []
    for state in range(4):
        ways = [(DELETE + behind[state], "D")]
        if stays:
            ways.append((fine + REROLE + behind[NEXT[state]], "R"))
            if state in KEPT[role]:
                ways.append((fine + behind[KEPT[role][state]], "K"))
        base.append(min(ways))
    best = list(base)
    best[USER] = min(base[USER], (INSERT + base[ASSISTANT][0], "I"))
    best[ASSISTANT] = min(base[ASSISTANT], (INSERT + base[USER][0], "I"))
    for state in (BEGIN, SYSTEM):
        best[state] = min(base[state], (INSERT + best[USER][0], "I"))
    least = min(cost for cost, _ in best)
    return least, tuple(cost - least if cost < NEVER else NEVER for cost, _ in best), "".join(edit for _, edit in best)


def shared(a: str, b: str) -> int:
    """How many letters two texts share from their beginning."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def audit(signature: str, nodes: list[tuple], start: int) -> tuple[str, int]:
    """The best edits of a signature from a state on, and the state behind them; nodes[i] is the suffix of i letters."""
    edits, state = [], start
    for left, seen in zip(range(len(signature), 0, -1), signature):
        best = nodes[left][2]
        while best[state] == "I":
            edits.append("I")
            state = NEXT[state]
        edits.append(best[state])
        if best[state] != "D":
            state = NEXT[state] if best[state] == "R" else KEPT[seen.lower()][state]
    return "".join(edits), state


def walked(signatures: DataFrame) -> DataFrame:
    """(signature, behind, costs, audits, states) from distinct (signature, behind, starts): for each state to start in, the cost
    with what is behind, and for the first `starts` of them the best edits and the state behind them. Signatures come sorted
    from their ends, so each suffix of a task is worked out once and only one path is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, path, nodes = None, "", []
        for b in batches:
            out = []
            for signature, behind, starts in zip(*(b.column(x).to_pylist() for x in ("signature", "behind", "starts"))):
                back = signature[::-1]
                if behind != last:
                    last, path, nodes = behind, "", [(0, tuple(behind), "")]
                del nodes[shared(path, back) + 1 :]
                for letter in back[len(nodes) - 1 :]:
                    least, costs, best = step(letter, nodes[-1][1])
                    nodes.append((nodes[-1][0] + least, costs, best))
                path = back
                costs = [nodes[-1][0] + c if c < NEVER else NEVER for c in nodes[-1][1]]
                edits = [audit(signature, nodes, s) for s in range(starts)]
                out.append((signature, behind, costs, [e for e, _ in edits], [s for _, s in edits]))
            if out:
                longs = pa.list_(pa.int64())
                kinds = (pa.string(), longs, longs, pa.list_(pa.string()), longs)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["signature", "behind", "costs", "audits", "states"])

    order = ["behind", F.reverse("signature")]
    sorted_ = signatures.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_.mapInArrow(run, "signature string, behind array<long>, costs array<long>, audits array<string>, states array<long>")


def along(rows: DataFrame, value: str, name: str, kind: str, each) -> DataFrame:
    """(c, part, at, `name`): each conversation's pieces in order through each(values); one row for thousands of rows of text."""
    grouped = rows.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("part", "at", F.col(value).alias("v")))).alias("xs"))
    schema = f"c string, part int, at long, `{name}` {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, xs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                new = each([x["v"] for x in xs])
                yield pa.RecordBatch.from_pylist([{"c": c, "part": x["part"], "at": x["at"], name: v} for x, v in zip(xs, new)], schema=typed)

    typed = pa.schema([("c", pa.string()), ("part", pa.int32()), ("at", pa.int64()), (name, pa.list_(pa.int64()) if "array" in kind else pa.int64())])
    return grouped.mapInArrow(run, schema)


def costs_behind(matrices: list[list[list[int]]]) -> list[list[int]]:
    """For each piece the costs behind it, less their least, from matrices of costs by state before and behind."""
    now, found = list(END), []
    for m in reversed(matrices):
        found.append(now)
        now = [min(a + b for a, b in zip(row, now)) for row in m]
        now = [x - min(now) for x in now]
    return found[::-1]


def starts(states: list[list[int]]) -> list[int]:
    """The state in which each piece starts, from the state behind it for each state before."""
    found, now = [], BEGIN
    for s in states:
        found.append(now)
        now = s[now]
    return found


def audits(parts: DataFrame) -> DataFrame:
    """(c, part, at, audit) of pieces (c, part, at, letters); the last piece's has the turns that are put in behind it."""
    rows = parts.select("c", "part", "at", F.translate("letters", LETTERS, SEEN).alias("signature"))
    several = rows.groupBy("c").agg(F.count("*").alias("k"), F.max(F.struct("part", "at")).alias("last")).filter("k > 1").drop("k")
    end = F.array(*[F.lit(x).cast("long") for x in END])
    rows = saved(rows.join(several, "c", "left"))
    cut = rows.filter("last is not null")
    units = F.array(*[F.array(*[F.lit(0 if s == t else NEVER).cast("long") for s in range(4)]) for t in range(4)])
    alone = walked(cut.select("signature").distinct().select("signature", F.explode(units).alias("behind"), F.lit(0).alias("starts")))
    columns = alone.groupBy("signature").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.array_position("behind", F.lit(0)).alias("t"), "costs"))), lambda x: x["costs"]).alias("by_end"))
    matrix = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.transform("by_end", lambda c: F.get(c, s)))
    behind = along(cut.join(columns.select("signature", matrix.alias("matrix")), "signature"), "matrix", "behind", "array<long>", costs_behind)
    rows = saved(rows.join(behind, ["c", "part", "at"], "left").withColumn("behind", F.coalesce("behind", end)))
    some = F.when(F.col("last").isNull(), 1).otherwise(4)
    best = walked(rows.groupBy("signature", "behind").agg(F.max(some).alias("starts")))
    rows = saved(rows.join(best, ["signature", "behind"]))
    start = along(rows.filter("last is not null"), "states", "start", "long", starts)
    rows = rows.join(start, ["c", "part", "at"], "left").withColumn("start", F.coalesce("start", F.lit(BEGIN)).cast("int"))
    is_last = F.col("last").isNull() | (F.struct("part", "at") == F.col("last"))
    tail = F.get(F.array(*[F.lit(t) for t in TAILS]), F.get("states", "start").cast("int"))
    return rows.select("c", "part", "at", F.concat(F.get("audits", "start"), F.when(is_last, tail).otherwise("")).alias("audit"))


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(c, illegal, cost, audit, repaired_sha256): conversations by turn, streamed through their edits; one exchange of texts."""
    texts = rows.select("c", F.lit(1).alias("kind"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), "turn", "role", "digest", "cut_off", F.explode(F.array_repeat("text", F.col("copies"))).alias("text"))
    heads = edits.select("c", F.lit(0).alias("kind"), "part", "at", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit(False).alias("cut_off"), F.col("audit").alias("text"))
    order = ["c", "kind", "part", "at", "turn", "role", "digest"]
    sorted_ = heads.union(texts).repartition("c").sortWithinPartitions(*order).select("c", "kind", "role", "cut_off", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, story, done = None, None, []
        for b in batches:
            for c, kind, role, cut_off, text in zip(*(x.to_pylist() for x in b.columns)):
                if c != now:
                    if story:
                        done.append((now, *story.end()))
                    now, story = c, Story()
                if kind == 0:
                    story.edits += text
                else:
                    story.row(role, cut_off, text)
            if len(done) >= 1024:
                yield batch(done)
                done = []
        if story:
            done.append((now, *story.end()))
        if done:
            yield batch(done)

    def batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], names=["c", "illegal", "cost", "audit", "repaired_sha256"])

    return sorted_.mapInArrow(run, "c string, illegal long, cost long, audit string, repaired_sha256 string")


class Story:
    """One conversation in the making: its digest so far, not its texts."""

    def __init__(self):
        self.edits, self.at, self.state, self.cost, self.illegal, self.before = "", 0, BEGIN, 0, 0, None
        self.digest, self.empty = hashlib.sha256(), True

    def say(self, role: str, text: str) -> None:
        self.digest.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def insert(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.say(SAID[self.state], "")
            self.state, self.cost, self.at = NEXT[self.state], self.cost + INSERT, self.at + 1

    def row(self, role: str, cut_off: bool, text: str) -> None:
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        self.insert()
        edit, self.at = self.edits[self.at], self.at + 1
        if edit == "D":
            self.cost += DELETE
            return
        self.cost += CUT_OFF * cut_off
        if edit == "K":
            self.say(role, text)
            self.state = KEPT[role[0]][self.state]
        else:
            self.say(SAID[self.state], text)
            self.state, self.cost = NEXT[self.state], self.cost + REROLE

    def end(self) -> tuple[int, int, str, str]:
        self.insert()
        return self.illegal, self.cost, self.edits, self.digest.hexdigest()


def repair(conversations: DataFrame, longest: int = PIECE) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conv_id, null included.

    Rows (conv_id, turn, role, text) are damaged first; rows of one turn stand in the order of role and of the text's SHA-256,
    equal ones next to each other; null turns come first and count for no gap. Roles go by their first letter. A conversation
    without rows after damage has zeros, no edits and the digest of nothing. Extra columns are left out."""
    session_of(conversations)
    rows = damaged(conversations)
    marked = saved(faults(rows))
    parts = pieces(marked, longest)
    text = repaired(rows, audits(parts))
    of = lambda letters: F.sum(F.length("letters") - F.length(F.translate("letters", letters, ""))).cast("long")
    counts = parts.groupBy("c").agg(of(LETTERS[1::4]).alias("blank"), of(LETTERS[2::4]).alias("duplicate"), of(LETTERS[3::4]).alias("truncated"))
    turns = marked.groupBy("c", "turn").agg(F.lit(1).alias("x")).groupBy("c").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    all_ = conversations.select(key().alias("c"), "conv_id").groupBy("c").agg(F.first("conv_id", ignorenulls=True).alias("conv_id"))
    whole = all_.join(turns, "c", "left").join(counts, "c", "left").join(text, "c", "left")
    numbers = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return whole.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
