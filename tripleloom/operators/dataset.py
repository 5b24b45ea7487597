"""Labelled datasets: sentences for facts, negatives, tiers of difficulty, splits and their audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.strings import bare_texts, hash_split, md5_mod, pick, sentence_id, strip_markers, verifier_text
from ..sources.files import saved
from .metrics import numbered

#: Fixed values of this package: clauses for the harder tiers.
DISTRACTORS = [", as many records show,", ", after a long review,", ", unlike some others,"]
SUBORDINATES = ["Although the files are old, ", "While nobody asked, ", "Because the audit said so, "]
OBJECT_TEMPLATES = ["A {s} {phrase} a {o}.", "Every {s} {phrase} some {o}.", "Some {s} {phrase} a {o}.", "It is a {o} that a {s} {phrase}.", "As for the {s}, it {phrase} the {o}."]
DATA_TEMPLATES = ["A {s} has a {phrase}.", "The {phrase} of a {s} is a value."]
FACT_TEMPLATES = ["{s} {phrase} {o}.", "As is known, {s} {phrase} {o}."]
#: What may stand between the relation and the sentence of a verifier's text.
LEADS = ["", "It is said that ", "Records show that "]
SUBCLASS_TEMPLATES = ["Every {s} is a {o}.", "A {s} is a kind of {o}."]


def fill(template: Column, s: Column, phrase: Column, o: Column) -> Column:
    return F.replace(F.replace(F.replace(template, F.lit("{s}"), s), F.lit("{phrase}"), phrase), F.lit("{o}"), o)


def verbalize_schema(triples: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """(s, p, o, variant, text) from (s, p, o, phrase): each schema triple by each of its templates. templates: (s, p, o, template,
    pos), the forms of single triples, which take the place of the general ones for them."""
    array = lambda ts: F.array(*[F.lit(t) for t in ts])
    chosen = F.when(F.col("p") == "rdfs:subClassOf", array(SUBCLASS_TEMPLATES)).when(F.col("o") == "LiteralValue", array(DATA_TEMPLATES)).otherwise(array(OBJECT_TEMPLATES))
    rows = triples.withColumn("own", F.lit(None).cast("array<string>"))
    if templates is not None:
        own = templates.groupBy("s", "p", "o").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "template"))), lambda x: x["template"]).alias("own"))
        rows = triples.join(own, ["s", "p", "o"], "left")
    rows = rows.select("s", "p", "o", "phrase", F.posexplode(F.coalesce("own", chosen)).alias("variant", "template"))
    return rows.select("s", "p", "o", "variant", fill(F.col("template"), F.lower("s"), F.col("phrase"), F.lower("o")).alias("text"))


#: Documents take so many items at least, and so many more at most.
LEAST, MORE = 9, 3
#: Hashes below this make the steps of permutations.
STEPS = 499_979


def prime_from(n: int) -> int:
    """The least prime that is n or more, above 1."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def permutation(key: Column, n: int) -> list[Column]:
    """_step and _start of a key's own permutation of 0 … prime - 1, the prime being the least from n on, by hashes of the key. It leads
    a number to (_step * number + _start) % prime; places from n on are no items."""
    prime = prime_from(n)
    part = lambda name: md5_mod(F.concat_ws("|", F.lit(name), key), STEPS).cast("long")
    step = (part("step") * STEPS + part("step2")) % max(prime - 1, 1) + 1
    start = (part("start") * STEPS + part("start2")) % prime
    return [step.alias("_step"), start.alias("_start")]


def spread(docs: DataFrame) -> DataFrame:
    """The documents dealt to as many tasks as shuffles have: small rows that make much work, which Spark would leave to one task."""
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc")


def ordinals(items: DataFrame, seed: str, key: Column) -> DataFrame:
    """The items with `ordinal` from 0, in the order of a hash of seed and item (equal ones by the item itself); numbered by ranges."""
    order = F.struct(F.md5(F.concat_ws("|", F.lit(seed), key)).alias("h"), key.alias("k"))
    return numbered(items.withColumn("_by", order), "_by", "ordinal").drop("_by").withColumn("ordinal", F.col("ordinal") - 1)


def drawn(docs: DataFrame, n: int, most: int, seed: str, name: str = "") -> DataFrame:
    """(doc, turn, ordinal): for each document the first `most` of its own permutation of n items, from turn 0; never an array of all
    items. As many turns are looked at as the prime lies above n, and `most` more."""
    turns = F.explode(F.sequence(F.lit(0), F.lit(min(most + prime_from(n) - n, prime_from(n)) - 1)))
    # hashed once a document, before its turns
    own = docs.select("doc", *permutation(F.concat_ws("|", F.lit(seed), F.lit(name), F.col("doc").cast("string")), n)).select("*", turns.alias("turn"))
    at = (F.col("_step") * F.col("turn").cast("long") + F.col("_start")) % prime_from(n)
    return own.select("doc", "turn", at.alias("ordinal")).filter(F.col("ordinal") < n)


def sizes(seed: str) -> Column:
    return LEAST + md5_mod(F.concat_ws("|", F.lit(seed), F.col("doc").cast("string")), MORE + 1)


def picked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(doc, position, columns…) from (doc, turn, size, columns…): the first `size` turns of each document, of which there are few."""
    best = F.array_sort(F.collect_list(F.struct("turn", F.struct(*columns).alias("item")))).alias("xs")
    own = rows.groupBy("doc", "size").agg(best)
    chosen = F.slice("xs", F.lit(1), F.col("size"))
    return own.select("doc", F.posexplode(chosen).alias("at", "x")).select("doc", (F.col("at") + 1).alias("position"), "x.item.*")


def sample_documents(docs: DataFrame, items: DataFrame, seed: str, key: Column) -> DataFrame:
    """(doc, position, item columns…): each document (doc) takes 9 to 12 items without repeats, or all where there are fewer, in the
    order of a permutation of its own. Items are numbered once and met by an equi-join on their numbers, so they may be as many
    as facts."""
    numbers = ordinals(items, seed, key)
    n = numbers.count()
    if not n:
        return docs.select("doc", F.lit(0).alias("position")).join(items.limit(0), F.lit(True)).filter("false")
    rows = drawn(spread(docs), n, LEAST + MORE, seed).join(numbers, "ordinal").withColumn("size", sizes(seed))
    return picked(rows, items.columns)


def stratified_documents(docs: DataFrame, items: DataFrame, quotas: dict[str, int], seed: str, key: Column, stratum: str) -> DataFrame:
    """(doc, position, item columns…): first a fixed quota from each stratum, by permutations of the strata, then, up to 9 to 12, the
    rest by a permutation of all items that leaves out what was taken."""
    docs, items = spread(docs), saved(items)  # numbered and counted once for each stratum and for all
    parts = []
    for name, quota in quotas.items():
        numbers = ordinals(items.filter(F.col(stratum) == name), seed, key)
        if n := numbers.count():
            parts.append(drawn(docs, n, quota, seed, name).join(numbers, "ordinal").withColumn("quota", F.lit(quota)).withColumn("stage", F.lit(len(parts))))
    numbers = ordinals(items, seed, key)
    n, most = numbers.count(), LEAST + MORE + sum(quotas.values())
    if not n:
        return docs.select("doc", F.lit(0).alias("position")).join(items.limit(0), F.lit(True)).filter("false")
    parts.append(drawn(docs, n, most, seed).join(numbers, "ordinal").withColumn("quota", F.lit(most)).withColumn("stage", F.lit(len(parts))))
    rows = reduce(DataFrame.unionByName, parts)
    # few rows a document: the quotas' first, then those of all that none of them has
    one = F.struct("stage", "turn", "quota", F.struct(*items.columns).alias("item"))
    own = rows.groupBy("doc").agg(F.array_sort(F.collect_list(one)).alias("xs")).withColumn("size", sizes(seed))
    of_stage = lambda i: F.filter("xs", lambda x: x["stage"] == i)
    # a stratum without items has no rows and no quota
    quotas_of = [F.slice(of_stage(i), F.lit(1), F.coalesce(F.get(of_stage(i), F.lit(0))["quota"], F.lit(0))) for i in range(len(parts) - 1)]
    firsts = F.transform(F.concat(*quotas_of) if quotas_of else F.slice("xs", 1, 0), lambda x: x["item"])

    def with_rest(taken: Column) -> Column:
        rest = F.filter("xs", lambda x: (x["stage"] == len(parts) - 1) & ~F.array_contains(taken, x["item"]))
        return F.slice(F.concat(taken, F.transform(rest, lambda x: x["item"])), F.lit(1), F.col("size"))

    # bound by a lambda: as a column, the firsts would be made anew for each item that they are compared with
    chosen = F.element_at(F.transform(F.array(firsts), with_rest), 1)
    return own.select("doc", F.posexplode(chosen).alias("at", "item")).select("doc", (F.col("at") + 1).alias("position"), "item.*")


def verbalize_facts(facts: DataFrame, labels: DataFrame, phrases: DataFrame, symmetric: DataFrame, templates: list[str] = FACT_TEMPLATES[:1]) -> DataFrame:
    """(p, s, o, variant, text): a sentence for each fact and template; of a symmetric property's two directions the first by name."""
    marked = facts.join(symmetric.withColumn("sym", F.lit(True)), "p", "left")
    unordered = F.when(F.col("sym"), F.struct(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b"))).otherwise(F.struct(F.col("s").alias("a"), F.col("o").alias("b")))
    once = marked.groupBy("p", unordered.alias("k")).agg(F.min(F.struct("s", "o")).alias("f")).select("p", "f.s", "f.o")
    names = labels.select("ind", "label")
    rows = once.join(names.select(F.col("ind").alias("s"), F.col("label").alias("sl")), "s").join(names.select(F.col("ind").alias("o"), F.col("label").alias("ol")), "o")
    rows = rows.join(phrases, "p").select("p", "s", "o", "sl", "phrase", "ol", F.posexplode(F.array(*map(F.lit, templates))).alias("variant", "t"))
    return rows.select("p", "s", "o", "variant", fill(F.col("t"), F.col("sl"), F.col("phrase"), F.col("ol")).alias("text"))


#: Sentences of a document, and documents whose lengths are summed together.
FEWEST, MOST_SENTENCES, SUMMED = 8, 12, 4096


def document_cuts(spark: SparkSession, n: int, seed: str) -> DataFrame:
    """(doc, size, first): documents of 8 to 12 sentences, by a hash of seed and number, until n sentences are used up; `first` is the
    place of the first, from 0. Lengths are summed in parts of so many documents, then over parts."""
    docs = spark.range(-(-n // FEWEST)).select(F.col("id").alias("doc"), F.floor(F.col("id") / SUMMED).alias("part"))
    docs = docs.withColumn("size", FEWEST + md5_mod(F.concat_ws("|", F.lit(seed), F.col("doc").cast("string")), MOST_SENTENCES - FEWEST + 1))
    within = F.sum("size").over(Window.partitionBy("part").orderBy("doc")) - F.col("size")
    parts = docs.groupBy("part").agg(F.sum("size").alias("whole"))  # one row for thousands of documents
    before = parts.select("part", (F.sum("whole").over(Window.orderBy("part")) - F.col("whole")).alias("before"))
    return docs.withColumn("within", within).join(before, "part").select("doc", "size", (F.col("before") + F.col("within")).alias("first")).filter(F.col("first") < n)


def chunk_documents(sentences: DataFrame, seed: str = "7", text: str = "text") -> DataFrame:
    """(doc, position, columns…): sentences in the order of a hash of their text (equal ones by all columns), cut into documents of 8 to
    12, the last of what is left. Sentences are numbered by ranges and meet their document by an equi-join on the number."""
    order = F.struct(F.md5(text).alias("h"), *sentences.columns)
    rows = numbered(sentences.withColumn("_by", order), "_by", "_n").drop("_by")
    cuts = document_cuts(sentences.sparkSession, rows.count(), seed)
    places = cuts.select("doc", "first", F.posexplode(F.sequence(F.lit(1), F.col("size"))).alias("at", "x")).select("doc", (F.col("first") + F.col("at") + 1).alias("_n"), (F.col("at") + 1).alias("position"))
    return rows.join(places, "_n").drop("_n")


def document_records(chunks: DataFrame, prefix: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(document_id, split, text, n_sentences) of whole documents, a line for each sentence, and the gold records (document_id,
    sentence_id, split, text, s, p, o) of their sentences, from (doc, position, s, p, o, text). Splits are by document."""
    name = F.concat(F.lit(f"{prefix}_"), F.lpad((F.col("doc") + 1).cast("string"), 7, "0"))
    rows = chunks.withColumn("document_id", name).withColumn("split", hash_split(F.col("document_id")))
    lines = F.array_sort(F.collect_list(F.struct("position", "text")))
    docs = rows.groupBy("document_id", "split").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("n_sentences"))
    gold = rows.select("document_id", sentence_id(F.col("document_id"), F.col("position")).alias("sentence_id"), "split", "text", "s", "p", "o")
    return docs, gold


def other_properties(signature: DataFrame) -> DataFrame:
    """(p, neg_type, options): the other properties of each class of likeness, in order; where there is none of any class, all others.
    Signatures are a schema, so the pairs of properties stay few."""
    a, b = signature.alias("a"), signature.alias("b")
    d, r = F.col("a.domain").eqNullSafe(F.col("b.domain")), F.col("a.range").eqNullSafe(F.col("b.range"))
    whole = F.col("a.domain").isNotNull() & F.col("a.range").isNotNull()
    kind = F.when(d & r & whole, "type_identical").when((d | r) & ~(d & r), "partial_overlap").when(~d & ~r, "type_incompatible")
    pairs = a.join(b, F.col("a.p") != F.col("b.p")).select(F.col("a.p").alias("p"), F.col("b.p").alias("q"), kind.alias("neg_type"))
    any_ = pairs.groupBy("p").agg(F.count("neg_type").alias("n"))
    pairs = pairs.join(any_, "p").withColumn("neg_type", F.when(F.col("n") == 0, "type_incompatible").otherwise(F.col("neg_type"))).filter("neg_type is not null").drop("n")
    return pairs.groupBy("p", "neg_type").agg(F.array_sort(F.collect_list("q")).alias("options"))


def picked_property() -> Column:
    """One of the options by a hash of key and class."""
    return F.element_at("options", (md5_mod(F.concat_ws("|", F.col("key"), F.col("neg_type")), 1000) % F.size("options") + 1).cast("int"))


def hard_negatives(signature: DataFrame, keys: DataFrame) -> DataFrame:
    """(columns of keys…, neg_type, q): for rows with p and key, one other property of each class of likeness, picked by a hash."""
    return keys.join(other_properties(signature), "p").select(*keys.columns, "neg_type", picked_property().alias("q"))


def verifier_examples(facts: DataFrame, phrases: DataFrame, signature: DataFrame, carry: tuple[str, ...] = (), leads: list[str] = LEADS[:1], classes: bool = False) -> DataFrame:
    """(key, text, label, candidate_relation, sentence_relation, subject, object, neg_type, carry…) from (key, p, subject, object):
    a VALID row for each fact and lead, and an INVALID one for each of its hard negatives, with a lead by a hash. classes: subjects
    and objects are classes, which take an article."""
    # a fact's own property is one more choice, so facts are read once for both labels
    own = phrases.select("p").distinct().select("p", F.lit(None).cast("string").alias("neg_type"), F.array("p").alias("options"))
    rows = facts.join(phrases, "p").join(own.unionByName(other_properties(signature)), "p")
    valid = F.col("neg_type").isNull()
    rows = rows.withColumn("candidate_relation", F.when(valid, F.col("p")).otherwise(picked_property()))
    text = verifier_text(F.col("candidate_relation"), F.col("subject"), F.col("phrase"), F.col("object"), classes)
    label = F.when(valid, "VALID").otherwise("INVALID")
    rows = rows.select("key", "subject", "object", *carry, "candidate_relation", F.col("p").alias("sentence_relation"), text.alias("text"), label.alias("label"), "neg_type")
    if leads != [""]:
        some = F.when(valid, F.array(*map(F.lit, leads))).otherwise(F.array(pick(leads, F.concat_ws("|", "key", "neg_type"))))
        led = F.regexp_replace("text", r"^(\[REL\] .*? \[/REL\] )", F.concat(F.lit("$1"), F.col("_lead")))
        rows = rows.withColumn("_lead", F.explode(some)).withColumn("text", led).drop("_lead")
    return rows


def with_clauses(examples: DataFrame) -> DataFrame:
    """The rows with `_clause` and `_head`, the clauses of their text's hash, once for all tiers."""
    return examples.withColumns({"_clause": pick(DISTRACTORS, F.col("text")), "_head": pick(SUBORDINATES, F.col("text"))})


def with_places(rows: DataFrame) -> DataFrame:
    """The rows with `_one`, the length of the text up to its first argument's end, and `_two`, the place of its second argument, 0 where
    its marks are not all there in order."""
    behind = lambda mark, at, size: F.position(F.lit(mark), F.col("text"), F.col(at) + size)
    rows = rows.withColumn("_a", F.locate("[E1]", "text")).withColumn("_b", behind("[/E1]", "_a", 4))
    rows = rows.withColumn("_c", behind("[E2]", "_b", 5)).withColumn("_d", behind("[/E2]", "_c", 4))
    whole = (F.col("_a") > 0) & (F.col("_b") > 0) & (F.col("_c") > 0) & (F.col("_d") > 0)
    return rows.withColumns({"_one": F.col("_b") + 4, "_two": F.when(whole, F.col("_c")).otherwise(0)}).drop("_a", "_b", "_c", "_d")


def implicit(text: Column, synonym: Column) -> Column:
    """The words between the arguments of a text `with_places` in other words; a text without marks stays."""
    return F.when(F.col("_two") > 0, F.concat(F.substr(text, F.lit(1), F.col("_one")), F.lit(" "), synonym, F.lit(" "), F.substr(text, F.col("_two")))).otherwise(text)


def distant(text: Column) -> Column:
    """A clause behind the first argument of a text `with_places`; a text without marks stays."""
    return F.when(F.col("_two") > 0, F.concat(F.substr(text, F.lit(1), F.col("_one")), F.col("_clause"), F.substr(text, F.col("_one") + 1))).otherwise(text)


def tier_implicit(examples: DataFrame, synonyms: DataFrame, by: str = "sentence_relation") -> DataFrame:
    """The relation in other words; rows whose relation has none are dropped. by: the relation the sentence states, or, as a
    known quirk, the candidate."""
    rows = with_places(examples).join(synonyms.withColumnRenamed("p", by), by)
    return rows.withColumn("text", implicit(F.col("text"), F.col("synonym"))).drop("synonym").withColumn("complexity_tier", F.lit("implicit")).select(*examples.columns, "complexity_tier")


def tier_long_distance(examples: DataFrame) -> DataFrame:
    """A clause behind the first argument."""
    rows = with_places(with_clauses(examples)).withColumn("text", distant(F.col("text"))).withColumn("complexity_tier", F.lit("long_distance"))
    return rows.select(*examples.columns, "complexity_tier")


def tier_nested(examples: DataFrame) -> DataFrame:
    """A subordinate clause before the sentence, behind the relation in front."""
    return examples.withColumn("text", nested(F.col("text"))).withColumn("complexity_tier", F.lit("nested"))


def nested(text: Column, clause: Column | None = None) -> Column:
    """A clause, without one that of the text's hash, before the sentence."""
    behind = F.locate("[/REL]", text, 6) + 6
    head = F.when(text.startswith("[REL]") & (behind > 6), behind - 1 + (F.substr(text, behind, F.lit(1)) == " ").cast("int")).otherwise(F.lit(0))
    return F.concat(F.substr(text, F.lit(1), head), pick(SUBORDINATES, text) if clause is None else clause, F.substr(text, head + 1))


def augment_tiers(examples: DataFrame, synonyms: DataFrame) -> DataFrame:
    """The explicit rows and their three harder forms, all from one pass. Rows that carry another tier are left out first, so that a second run
    over its own result changes nothing."""
    if "complexity_tier" in examples.columns:
        examples = examples.filter(F.coalesce("complexity_tier", F.lit("explicit")).isin("explicit", "tier_1")).drop("complexity_tier")
    return in_tiers(with_places(with_clauses(examples)), synonyms).select(*examples.columns, "complexity_tier")


def in_tiers(rows: DataFrame, synonyms: DataFrame) -> DataFrame:
    """The rows, `with_clauses` and `with_places`, in each tier."""
    names = lambda *ts: F.array(*map(F.lit, ts))
    tiers = F.when(F.col("synonym").isNotNull(), names("explicit", "implicit", "long_distance", "nested")).otherwise(names("explicit", "long_distance", "nested"))
    rows = rows.join(synonyms.withColumnRenamed("p", "sentence_relation"), "sentence_relation", "left").withColumn("complexity_tier", F.explode(tiers))
    tier, text = F.col("complexity_tier"), F.col("text")
    form = F.when(tier == "implicit", implicit(text, F.col("synonym"))).when(tier == "long_distance", distant(text)).when(tier == "nested", nested(text, F.col("_head"))).otherwise(text)
    return rows.withColumn("text", form)


def augmented_forms(examples: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(text, label, split, complexity_tier, n) of examples with a split: the same for a trainer that takes all numbers as one word.
    Examples that are alike but for numbers are counted before tiers are made of them; their marks keep their numbers."""
    rows = with_clauses(examples).withColumn("text", F.regexp_replace("text", r"[0-9]++(?!\])", "0"))
    rows = rows.groupBy("text", "label", "split", "sentence_relation", "_clause", "_head").agg(F.count("*").alias("n"))
    return in_tiers(with_places(rows), synonyms).select("text", "label", "split", "complexity_tier", "n")


def with_split(examples: DataFrame, on: str = "fact", buckets: int = 100, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """A split column. on: `fact` keeps all forms of a fact together, `sentence` those of one bare sentence, `marked_text` none."""
    key = {"fact": F.col("key"), "sentence": strip_markers(F.col("text"), whole_head=True), "marked_text": F.col("text")}[on]
    return examples.withColumn("split", hash_split(key, train, val, buckets))


def index_split(ordinal: Column, total: Column) -> Column:
    """First 80 % train, next 10 % val, the rest test, by ordinal from 0."""
    return F.when(ordinal < F.floor(total * 0.8), "train").when(ordinal < F.floor(total * 0.9), "val").otherwise("test")


def leakage(rows: DataFrame, text: str = "text") -> DataFrame:
    """(split, leaked): how many rows of val and test have a text that is in train."""
    train = rows.filter("split = 'train'").select(text).distinct().withColumn("in_train", F.lit(True))
    held = rows.filter("split <> 'train'").join(train, text, "left")
    return held.groupBy("split").agg(F.count("in_train").alias("leaked"))


def split_table(rows: DataFrame) -> DataFrame:
    """(split, total, n_pos, n_neg, identical, partial, incompatible)"""
    neg = lambda k: F.count(F.when(F.col("neg_type") == k, 1))
    return rows.groupBy("split").agg(
        F.count("*").alias("total"), F.count(F.when(F.col("label") == "VALID", 1)).alias("n_pos"), F.count(F.when(F.col("label") == "INVALID", 1)).alias("n_neg"),
        neg("type_identical").alias("n_identical"), neg("partial_overlap").alias("n_partial"), neg("type_incompatible").alias("n_incompatible"),
    )


def positives_by_relation(rows: DataFrame) -> DataFrame:
    """(split, relation, n_pos): how many VALID rows each relation has in each split."""
    return rows.filter("label = 'VALID'").groupBy("split", F.col("candidate_relation").alias("relation")).agg(F.count("*").alias("n_pos"))


def split_percent(rows: DataFrame) -> DataFrame:
    """(split, n, percent)"""
    counts = rows.groupBy("split").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def tier_by_split(rows: DataFrame) -> DataFrame:
    """(complexity_tier, train, val, test)"""
    return rows.groupBy("complexity_tier").pivot("split", ["train", "val", "test"]).count().na.fill(0)


def dataset_stats(rows: DataFrame) -> DataFrame:
    """(metric, key, value): labels, negative types, splits, and distinct texts and sentences (texts without marks) by split. One scan:
    each row gives its kind, and its texts as digests, to one grouping; counters are made of what comes out of it."""
    none, digest = F.lit(None).cast("string"), lambda text: F.unhex(F.md5(text))
    one = lambda metric, label, neg_type, item: F.struct(F.lit(metric).alias("metric"), label.alias("label"), neg_type.alias("neg_type"), F.col("split").alias("split"), item.alias("item"))
    counters = F.array(one("rows", F.col("label"), F.col("neg_type"), none.cast("binary")), one("distinct_texts", none, none, digest(F.col("text"))), one("sentences", none, none, digest(F.col("_bare"))))
    # equal digests and mere counts come together before the exchange
    once = bare_texts(rows, "text", "_bare").select(F.inline(counters)).groupBy("metric", "label", "neg_type", "split", "item").agg(F.count("*").alias("n"))
    kinds = once.groupBy("metric", "label", "neg_type", "split").agg(F.count("item").alias("items"), F.sum("n").alias("n"))
    counter = lambda metric, key, n: F.struct(metric.alias("metric"), F.col(key).alias("key"), F.col(n).alias("n"))
    own = F.when(F.col("metric") == "rows", F.array(*[counter(F.lit(k), k, "n") for k in ("label", "neg_type", "split")])).otherwise(F.array(counter(F.col("metric"), "split", "items")))
    return kinds.select(F.inline(own)).filter("key is not null").groupBy("metric", "key").agg(F.sum("n").alias("value"))


def length_budget(texts: DataFrame, text: str, exact: bool = True) -> DataFrame:
    """(budget): the 99th percentile of token counts, held between 64 and 192. exact=False for large inputs."""
    n = F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]"))
    p = F.percentile(n, 0.99) if exact else F.percentile_approx(n, 0.99)
    return texts.agg(F.greatest(F.lit(64.0), F.least(F.lit(192.0), p.cast("double"))).alias("budget"))
