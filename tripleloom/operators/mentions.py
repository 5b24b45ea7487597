"""Sentences, tokens, mentions, grounding and relation candidates."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = r"(?U)\w+|[^\w\s]"
PIECES = "array<struct<start:int,end:int,token:string,gap:string>>"
#: Tokens whose places are summed together.
BLOCK = 256


def sentence_split(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n, sentence): lines, cut behind `.`, `!` or `?` and blanks before a capital, digit or quote; numbered from 1."""
    lines = F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, r'(?U)(?<=[.!?])\s+(?=[A-Z0-9"“])')))
    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    return docs.select(key, F.posexplode(kept).alias("at", "sentence")).select(key, (F.col("at") + 1).alias("n"), "sentence")


def with_marks(text: Column) -> Column:
    """The text with a mark before and behind each token."""
    return F.regexp_replace(text, f"({TOKEN})", "\u0001$1\u0002")


def tokens(text: Column) -> Column:
    """array<struct<start, end, token, gap>> of words and single symbols, with what stands behind each. The text is cut once;
    places are summed block by block, so that long texts take time in proportion to their length."""
    parts = F.split(with_marks(text), "\u0001")
    return F.element_at(F.transform(F.array(parts), places), 1)


def places(parts: Column) -> Column:
    """The same from a text's parts, each of which but the first begins with a token that ends at a mark."""
    body = F.slice(parts, F.lit(2), F.size(parts))
    last = F.ceil(F.size(body) / BLOCK).cast("int") - 1
    blocks = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(body, b * BLOCK + 1, F.lit(BLOCK))))
    sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x) - 1))
    first = F.struct(F.length(F.element_at(parts, 1)).alias("at"), F.array().cast("array<int>").alias("found"))
    starts = F.aggregate(sizes, first, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["found"], F.array(s["at"])).alias("found")), lambda s: s["found"])

    def step(state: Column, part: Column) -> Column:
        size = F.instr(part, "\u0002") - 1
        span = F.struct(state["at"].alias("start"), (state["at"] + size).cast("int").alias("end"), F.substring_index(part, "\u0002", 1).alias("token"), F.substring_index(part, "\u0002", -1).alias("gap"))
        return F.struct((state["at"] + F.length(part) - 1).alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    def spans(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(PIECES).alias("found")), step, lambda s: s["found"])

    return F.when(F.size(parts) <= BLOCK, spans(body, F.length(F.element_at(parts, 1)))).otherwise(F.flatten(F.zip_with(blocks, starts, spans)))


def token_rows(sentences: DataFrame, key: list[str], text: str = "sentence") -> DataFrame:
    """(key…, pos, token, start, end): what `tokens` gives, cut from texts with marks by whole Arrow columns, a portion at a time."""
    small_batches(sentences.sparkSession)
    source = sentences.select(*key, with_marks(F.col(text)).alias("_marked"))
    kinds, names = dict(source.dtypes), [*key, "pos", "token", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in portions(batch, len(key)):
                of, *columns = token_columns(b.column(len(key)))
                yield pa.RecordBatch.from_arrays([*(b.column(n).take(of) for n in range(len(key))), *columns], names=names)

    return source.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "pos int, token string, start int, end int"]))


#: Bytes of text that are cut at once.
PORTION = 1 << 22


def portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of so many bytes of a text column, or one text of more."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = sizes[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(sizes, before + PORTION, "right")))
        yield batch.slice(first, end - first)
        first = end


def token_columns(marked: pa.Array) -> list[pa.Array]:
    """The text's number, place, token, start and end of each token of texts `with_marks`, as `places` gives them."""
    parts = pc.split_pattern(marked, "\x01")
    counts = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    of, firsts = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
    at = np.arange(len(flat)) - firsts[of]  # 0 for what stands before the first token
    steps = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) - (at > 0)
    starts = np.cumsum(steps) - steps
    starts = starts - starts[firsts[of]]
    cut = pc.split_pattern(flat, "\x02", max_splits=1)
    token = pc.list_element(cut, 0)
    size = np.where(pc.list_value_length(cut).to_numpy(zero_copy_only=False) == 2, pc.utf8_length(token).to_numpy(zero_copy_only=False), -1)
    kept = at > 0
    number = lambda x: pa.array(x[kept].astype(np.int32))
    return [number(of), number(at - 1), token.filter(pa.array(kept)), number(starts), number(starts + size)]


def keep_longest(spans: Column) -> Column:
    """array<struct<start, end, surface, entries>> of spans (start, far, surface, entries), where far is the end below zero: from left
    to right, of those that begin together the longest, none overlapping another. Their own order is already the right one."""
    ordered = F.array_sort(spans)
    none = F.struct(F.lit(0).alias("free"), F.slice(ordered, 1, 0).alias("kept"))

    def step(state: Column, m: Column) -> Column:
        taken = F.struct((-m["far"]).alias("free"), F.concat(state["kept"], F.array(m)).alias("kept"))
        return F.when(m["start"] >= state["free"], taken).otherwise(state)

    kept = F.aggregate(ordered, none, step, lambda s: s["kept"])
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), (-m["far"]).alias("end"), m["surface"].alias("surface"), m["entries"].alias("entries")))


#: Surfaces of schema terms up to which they are broadcast.
BROADCAST_SURFACES = 20_000
#: Bits of the filter that n-grams pass before any exchange, 63 a row; it grows no further, whatever the dictionary.
FILTER_BITS = 1 << 23


def digits_alike(text: Column) -> Column:
    """The text with all digits alike: names that differ in numbers alone have one form, however many they are."""
    return F.translate(text, "123456789", "000000000")


def form_hash(text: Column) -> Column:
    return F.pmod(F.crc32(digits_alike(text)), F.lit(FILTER_BITS))


def mask_of(h: Column) -> Column:
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (h % 63).cast("int"))).alias("_mask")


def masks(texts: DataFrame, text: str) -> DataFrame:
    """(_word, _mask): the bits that the hashes of a column's forms set, digits alike; at most FILTER_BITS / 63 rows."""
    bits = texts.select(form_hash(F.col(text)).alias("h"))
    return bits.groupBy(F.floor(F.col("h") / 63).alias("_word")).agg(mask_of(F.col("h")))


def may_hold(rows: DataFrame, text: str, filter_: DataFrame) -> DataFrame:
    """The rows whose text is null or passes a filter of `masks`, which is broadcast."""
    h = form_hash(F.col(text))
    set_ = F.getbit(F.col("_mask"), (h % 63).cast("int")) == 1
    return rows.join(F.broadcast(filter_), F.floor(h / 63) == F.col("_word"), "left").filter(F.col(text).isNull() | set_).drop("_word", "_mask")


#: Digits as `digits_alike` has them; letters whose small forms may differ between Spark and Python; marks of tokens.
ALIKE = str.maketrans("123456789", "000000000")
UNSURE = re.compile("[^\x00-\u012f\u0131-\u024f]")
MARK = re.compile("[\x01\x02]")


class Passes(dict):
    """Whether a form passes a filter, remembered for so many forms at most."""

    MOST = 100_000

    def __init__(self, bits: array):
        self.bits = bits

    def __missing__(self, form: str) -> bool:
        if len(self) >= self.MOST:
            self.clear()
        h = zlib.crc32(form.encode()) % FILTER_BITS
        self[form] = found = bool(self.bits[h // 63] >> h % 63 & 1)
        return found


def grams(text: str, marked: str, heads: Passes, surfaces: Passes, longest: int) -> list[tuple[int, int, str]]:
    """(start, end, n-gram) of a text, also given `with_marks`: those whose first token passes one filter and that pass the other. In
    a text with letters that are not sure, all n-grams with such a one pass."""
    first, *parts = marked.split("\x01")
    at, spans, found = len(first), [], []
    for p in parts:
        size = p.find("\x02")
        spans.append((at, at + size))
        at += len(p) - 1
    if (text.isascii() or not UNSURE.search(text)) and not MARK.search(text):
        low = text.lower().translate(ALIKE)
        for i, (start, end) in enumerate(spans):
            if heads[low[start:end]]:
                found += [(start, end, text[start:end]) for _, end in spans[i : i + longest] if surfaces[low[start:end]]]
        return found
    may = lambda x, filter_: bool(UNSURE.search(x)) or filter_[x.lower().translate(ALIKE)]
    pieces = [(p.split("\x02", 1)[0], p.rsplit("\x02", 1)[-1]) for p in parts]
    for i, (start, _) in enumerate(spans):
        if may(pieces[i][0], heads):
            words = "".join([token + gap for token, gap in pieces[i : i + longest]])
            each = [(start, end, words[: max(0, end - start)]) for _, end in spans[i : i + longest]]
            found += [x for x in each if may(x[2], surfaces)]
    return found


def dictionary_filters(dictionary: DataFrame) -> tuple[array, array]:
    """The filters of the surfaces' first tokens and of the surfaces, by one scan; 1 MB each, whatever the dictionary."""
    both = F.array(F.lower(F.regexp_extract("surface", f"({TOKEN})", 1)), F.col("surface"))
    bits = dictionary.select(F.posexplode(both).alias("which", "text")).select("which", form_hash(F.col("text")).alias("h")).filter("h is not null")
    filters = tuple(array("q", bytes(8 * (FILTER_BITS // 63 + 1))) for _ in range(2))
    rows = bits.groupBy("which", F.floor(F.col("h") / 63).alias("_word")).agg(mask_of(F.col("h"))).toArrow()
    for which, word, mask in zip(*[rows.column(c).to_pylist() for c in ("which", "_word", "_mask")], strict=True):
        filters[which][word] = mask
    return filters


#: Sentences of an Arrow batch, few enough for long texts.
ARROW_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def gram_rows(sentences: DataFrame, dictionary: DataFrame, key: list[str], longest: int, text: str) -> DataFrame:
    """(key…, start, end, words, text): a row with each sentence's text, from -1 to -1, and one without for each n-gram that may be a
    surface."""
    spark = sentences.sparkSession
    small_batches(spark)
    filters = spark.sparkContext.broadcast(dictionary_filters(dictionary))
    source = sentences.select(*key, F.col(text).cast("string").alias("text"), with_marks(F.col(text)).alias("_marked"))
    kinds = dict(source.dtypes)
    names = [*key, "start", "end", "words", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, surfaces = map(Passes, filters.value)
        for batch in batches:
            of, wholes, found = [], [], []
            for i, (whole, marked) in enumerate(zip(batch.column(len(key)).to_pylist(), batch.column(len(key) + 1).to_pylist(), strict=True)):
                own = grams(whole, marked, heads, surfaces, longest) if whole else []
                found.append((-1, -1, None))
                found += own
                of += [i] * (len(own) + 1)
                wholes.append(i)
                wholes += [None] * len(own)
            starts, ends, words = zip(*found, strict=True) if found else ((), (), ())
            keys = [batch.column(n).take(pa.array(of, pa.int32())) for n in range(len(key))]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(words, pa.string()), batch.column(len(key)).take(pa.array(wholes, pa.int32()))], names=names)

    return source.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "start int, end int, words string, text string"]))


def detect_mentions(sentences: DataFrame, dictionary: DataFrame, key: list[str], longest: int, text: str = "sentence") -> DataFrame:
    """(key…, text, mentions array<struct<start, end, surface, entries>>): whole-word dictionary matches, case apart, chosen greedily.

    Token n-grams meet surfaces by an equi-join, so the cost grows with the text, not with text times dictionary; they are cut by a small
    function over Arrow batches, with the tokens that Spark's pattern marks. Surfaces of classes
    and properties, which many sentences hold, are few: they are broadcast while their number allows it, and an n-gram that one of
    them matches goes past the join under a key of its own, as does the row that carries the sentence's text. All others meet the
    dictionary by one exchange, if they pass a filter of bounded size, and a second brings a sentence together again; nothing is joined back to the sentences. Sentences
    without mentions stay, with null. Rows of one key must be one sentence."""
    schema_kind = F.exists("entries", lambda e: e["kind"].isin("class", "object_property", "datatype_property"))
    common = dictionary.filter(schema_kind)
    few = common.select("surface").limit(BROADCAST_SURFACES + 1).count() <= BROADCAST_SURFACES

    rows = gram_rows(sentences, dictionary, key, longest, text)
    rows = rows.select(*key, "start", "end", F.lower("words").alias("surface"), "text")
    light = dictionary
    if few:
        rows = rows.join(F.broadcast(common.select("surface", F.col("entries").alias("known"))), "surface", "left")
        light = dictionary.filter(~schema_kind)
    else:
        rows = rows.withColumn("known", F.lit(None).cast(dictionary.schema["entries"].dataType))
    past = (F.col("start") < 0) | F.col("known").isNotNull()
    # met by the surface's hash and itself, as numbers are sorted faster; a null surface meets none. Hashes hardly compress, so they are
    # no columns of an exchange: both of its sides make them again
    h, at = F.when(past, F.xxhash64(*key, "start", "end")).otherwise(F.xxhash64("surface")), F.when(~past, F.col("surface"))
    light = light.select(F.col("surface").alias("_at"), F.col("entries").alias("_entries"))
    rows = rows.join(light, (h == F.xxhash64("_at")) & (at == F.col("_at")), "left").withColumn("entries", F.coalesce("known", "_entries")).drop("_at", "_entries")
    rows = rows.filter((F.col("start") < 0) | F.col("entries").isNotNull())
    span = F.when(F.col("start") >= 0, F.struct("start", (-F.col("end")).alias("far"), "surface", "entries"))
    # a sentence's rows are far apart, so nothing is brought together before the exchange; numbers are sorted faster than names
    own = rows.repartition(*key).withColumn("_k", F.xxhash64(*key)).groupBy("_k", *key)
    found = own.agg(F.max("text").alias("text"), F.collect_list(span).alias("spans"))
    return found.select(*key, "text", F.when(F.size("spans") > 0, keep_longest(F.col("spans"))).alias("mentions"))


def weak_stats(mentioned: DataFrame, signature: DataFrame, key: list[str], split: Column, gated: bool = True) -> DataFrame:
    """(metric, key, value) of sentences with mentions (key…, text, mentions) and their candidates: numbers of sentences in all, by split
    and by whether they have a candidate, of mentions by kind, of candidates by property, and of sentences by their set of
    properties. One scan: a sentence's triggers come together again, and each sentence gives its counters to one grouping."""
    rows = candidate_rows(mentioned.withColumn("_split", split), signature, [*key, "_split"], gated, whole=True)
    found = F.col("sm").isNotNull() & F.col("om").isNotNull()
    each = rows.groupBy(*key).agg(F.max("_split").alias("split"), F.max("kinds").alias("kinds"), F.collect_list(F.when(found, F.col("p"))).alias("ps"))
    counter = lambda metric, name: F.struct(F.lit(metric).alias("metric"), name.alias("key"))
    own = F.array(counter("sentences", F.lit("")), counter("split", F.col("split")), counter("signal", F.when(F.size("ps") > 0, "relation").otherwise("none")))
    sets = F.when(F.size("ps") > 0, F.array(counter("label_set", F.array_join(F.array_sort(F.array_distinct("ps")), ",")))).otherwise(F.array().cast("array<struct<metric:string,key:string>>"))
    kinds = F.transform(F.coalesce("kinds", F.array().cast("array<string>")), lambda k: counter("mentions", k))
    all_ = F.concat(own, sets, kinds, F.transform("ps", lambda p: counter("candidates", p)))
    return each.select(F.inline(all_)).groupBy("metric", "key").agg(F.count("*").alias("value"))


def context_mentions(sentences: DataFrame, pattern: str, allowed: DataFrame, key: list[str], text: str = "sentence") -> DataFrame:
    """(key…, surface): words that a context pattern captures and that the allowed surfaces hold."""
    found = sentences.select(*key, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("x")).select(*key, F.lower("x").alias("surface"))
    return found.join(allowed.select("surface").distinct(), "surface", "left_semi").select(*key, "surface").distinct()


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def merge_mentions(first: Column, second: Column) -> Column:
    """The first spans and those of the second that touch none of them, in order."""
    free = F.filter(second, lambda m: ~F.exists(first, lambda k: overlaps(k, m)))
    return F.array_sort(F.concat(first, free), lambda a, b: a["start"] - b["start"])


def ground(entries: DataFrame, closed: DataFrame, key: list[str], role: str) -> DataFrame:
    """(key…, short): for rows (key…, pos, short, kind, role class): the first individual that has the class, else the first individual."""
    typed = closed.select(F.col("ind").alias("short"), F.col("cls").alias(role), F.lit(True).alias("fits"))
    rows = entries.join(typed, ["short", role], "left").filter("kind = 'individual'")
    return rows.groupBy(*key).agg(F.min_by("short", F.struct(F.col("fits").isNull().cast("int").alias("x"), F.col("pos"), F.col("short"))).alias("short"))


def with_types(names: DataFrame, closed: DataFrame) -> DataFrame:
    """Names (short, …) with each one's types, before surfaces are made of them, so that later steps need no join."""
    types = closed.groupBy(F.col("ind").alias("short")).agg(F.array_sort(F.collect_set("cls")).alias("types"))
    return names.join(types, "short", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))


def role_fits(mention: Column, cls: Column) -> Column:
    """Whether any entry behind a mention has the class."""
    return F.exists(mention["entries"], lambda e: F.array_contains(e["types"], cls))


def grounded(mention: Column, cls: Column) -> Column:
    """The first individual behind a mention that has the class, else the first individual, else null."""
    people = F.filter(mention["entries"], lambda e: e["kind"] == "individual")
    fits = F.filter(people, lambda e: F.array_contains(e["types"], cls))
    return F.coalesce(F.get(fits, F.lit(0))["short"], F.get(people, F.lit(0))["short"])


def candidate_rows(mentioned: DataFrame, signature: DataFrame, key: list[str], gated: bool, whole: bool = False) -> DataFrame:
    """(key…, text, kinds, p, domain, range, tr, sm, om): for each property mentioned the nearest entity before and behind it, null
    where there is none. whole: a sentence without such a property stays, with nulls, and each carries its mentions' kinds."""
    is_property = lambda m: F.exists(m["entries"], lambda e: e["kind"] == "object_property")
    is_entity = lambda m: F.exists(m["entries"], lambda e: e["kind"].isin("individual", "class"))
    of_trigger = F.filter(F.col("tr.entries"), lambda e: e["kind"] == "object_property")
    kinds = F.transform("mentions", lambda m: F.element_at(m["entries"], -1)["kind"]) if whole else F.lit(None)
    rows = mentioned if whole else mentioned.filter(F.size("mentions") > 2)
    rows = rows.select(*key, "text", "mentions", kinds.alias("kinds"), (F.explode_outer if whole else F.explode)(F.filter("mentions", is_property)).alias("tr"))
    rows = rows.select(*key, "text", "kinds", F.filter("mentions", is_entity).alias("ents"), "tr", F.get(of_trigger, F.lit(0))["short"].alias("p"))
    rows = rows.join(signature.filter("domain is not null and range is not null"), "p", "left" if whole else "inner")
    left = F.filter("ents", lambda m: (m["end"] <= F.col("tr.start")) & (role_fits(m, F.col("domain")) if gated else F.col("domain").isNotNull()))
    right = F.filter("ents", lambda m: (m["start"] >= F.col("tr.end")) & (role_fits(m, F.col("range")) if gated else F.col("range").isNotNull()))
    by_end = F.array_max(F.transform(left, lambda m: F.struct(m["end"].alias("k"), m.alias("m"))))["m"]
    by_start = F.array_min(F.transform(right, lambda m: F.struct(m["start"].alias("k"), m.alias("m"))))["m"]
    return rows.withColumn("sm", by_end).withColumn("om", by_start).drop("ents")


def relation_candidates(mentioned: DataFrame, signature: DataFrame, key: list[str], gated: bool = True, window: int | None = None) -> DataFrame:
    """(key…, text, p, trigger_start, s, o, s_start, s_end, o_start, o_end): for each property mentioned, the nearest entity before
    and behind it. gated: entities must have the types of its signature, and both are grounded to them. window: both must begin
    within so many tokens of the trigger, whatever their types."""
    rows = candidate_rows(mentioned, signature, key, gated).filter("sm is not null and om is not null")
    if window is not None:
        between = lambda a, b: F.regexp_count(F.substr("text", a + 1, b - a), F.lit(TOKEN))
        rows = rows.filter((between(F.col("sm.start"), F.col("tr.start")) <= window) & (between(F.col("tr.start"), F.col("om.start")) <= window))
    first = lambda m, cls: grounded(m, cls) if gated else F.coalesce(F.get(F.filter(m["entries"], lambda e: e["kind"] == "individual"), F.lit(0))["short"], m["entries"][0]["short"])
    return rows.select(
        *key, "text", "p", F.col("tr.start").alias("trigger_start"), first(F.col("sm"), F.col("domain")).alias("s"), first(F.col("om"), F.col("range")).alias("o"),
        F.col("sm.start").alias("s_start"), F.col("sm.end").alias("s_end"), F.col("om.start").alias("o_start"), F.col("om.end").alias("o_end"),
    )


def document_mentions(docs: DataFrame, dictionary: DataFrame, key: str, longest: int, text: str = "text") -> DataFrame:
    """(key, n, text, mentions): documents cut into sentences, numbered from 1, with their mentions; offsets are those in a sentence."""
    return detect_mentions(sentence_split(docs, key, text), dictionary, [key, "n"], longest)


def distinct_triples(candidates: DataFrame, order: list[str]) -> DataFrame:
    """(s, p, o, text, order…): each triple once, with the sentence where it stands first."""
    place = F.struct(*order, F.col("text"))
    return candidates.groupBy("s", "p", "o").agg(F.min(place).alias("first")).select("s", "p", "o", *[F.col(f"first.{c}").alias(c) for c in [*order, "text"]])


def bio_tags(token_table: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """(key…, pos, token, tag) from tokens and spans (key…, start, end, type): B- for a span's first token, I- for its others, else O."""
    both = token_table.alias("t").join(
        spans.alias("m"), reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"m.{k}") for k in key]) & (F.col("t.start") < F.col("m.end")) & (F.col("m.start") < F.col("t.end")), "left"
    )
    tag = F.when(F.col("m.type").isNull(), "O").when(F.col("t.start") <= F.col("m.start"), F.concat(F.lit("B-"), F.col("m.type"))).otherwise(F.concat(F.lit("I-"), F.col("m.type")))
    return both.select(*[F.col(f"t.{k}") for k in key], "pos", "token", tag.alias("tag"))


def sentence_tags(mentioned: DataFrame, key: list[str], type_of: Callable[[Column], Column]) -> DataFrame:
    """(key…, text, tags array<struct<pos, token, tag>>): the same of sentences with mentions (key…, text, mentions), a row a sentence,
    without a join or an exchange. type_of: a mention's type, null where it is none of a name."""
    spans = F.filter(F.transform(F.coalesce("mentions", F.slice("mentions", 1, 0)), lambda m: F.struct(m["start"], m["end"], type_of(m).alias("type"))), lambda m: m["type"].isNotNull())

    def tag(t: Column, own: Column) -> Column:
        over = F.filter(own, lambda m: overlaps(t, m))
        return F.coalesce(F.get(F.transform(over, lambda m: F.concat(F.when(t["start"] <= m["start"], "B-").otherwise("I-"), m["type"])), F.lit(0)), F.lit("O"))

    def tagged(own: Column) -> Column:
        return F.transform(tokens(F.col("text")), lambda t, i: F.struct(i.alias("pos"), t["token"].alias("token"), tag(t, own).alias("tag")))

    # bound by a lambda: as a column, the spans would be made anew for each token
    return mentioned.select(*key, "text", F.element_at(F.transform(F.array(spans), tagged), 1).alias("tags"))


def decoded(tags: Column, strict: bool = False) -> Column:
    """array<struct<entity, label>> of a sentence's array<struct<pos, token, tag>> in order: I- goes on with whatever is open; an I-
    with nothing open counts for nothing. strict: it must have the open label, and the text keeps its case."""
    none = F.struct(F.lit(None).cast("string").alias("label"), F.lit("").alias("words"), F.array().cast("array<struct<entity:string,label:string>>").alias("found"))

    def closed(s: Column) -> Column:
        return F.when(s["label"].isNull(), s["found"]).otherwise(F.concat(s["found"], F.array(F.struct((s["words"] if strict else F.lower(s["words"])).alias("entity"), s["label"].alias("label")))))

    def step(s: Column, x: Column) -> Column:
        label = F.substring(x["tag"], 3, 100)
        ended = F.struct(F.lit(None).cast("string").alias("label"), F.lit("").alias("words"), closed(s).alias("found"))
        begun = F.struct(label.alias("label"), x["token"].alias("words"), closed(s).alias("found"))
        more = F.struct(s["label"].alias("label"), F.concat(s["words"], F.lit(" "), x["token"]).alias("words"), s["found"].alias("found"))
        goes_on = s["label"].isNotNull() & ((s["label"] == label) if strict else F.lit(True))
        return F.when(x["tag"].isNull(), s).when(x["tag"] == "O", ended).when(x["tag"].startswith("B-"), begun).when(goes_on, more).otherwise(ended)

    return F.aggregate(tags, none, step, closed)


def bio_decode(tags: DataFrame, key: list[str], strict: bool = False) -> DataFrame:
    """(key…, entity, label) from (key…, pos, token, tag), as `decoded` gives them. One exchange; rows of one key are one sentence."""
    whole = tags.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "token", "tag"))).alias("xs"))
    return whole.select(*key, F.inline(decoded(F.col("xs"), strict)))
