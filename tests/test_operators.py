"""Small literal cases of the operators."""

from pyspark.sql import functions as F

from tripleloom.functions import strings as fs
from tripleloom.operators import dataset, graph, mentions, metrics, ontology
from tripleloom.sources import files


def test_names(spark):
    row = spark.range(1).select(
        fs.camel_to_words(F.lit("ex:isBasedIn_place")).alias("a"), fs.camel_to_words(F.lit("LiteralValue")).alias("b"), fs.display_name(F.lit('"Rusty (pilot)"'), F.lit("x")).alias("c"),
        fs.short_iri(F.lit("http://a/b#c/d")).alias("d"), fs.md5_mod(F.lit("abc"), 100).alias("e"),
    ).first()
    import hashlib

    assert row[:] == ("is based in place", "literal value", "Rusty", "d", int(hashlib.md5(b"abc").hexdigest(), 16) % 100)


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")
    got = {tuple(r) for r in ontology.closure(edges).collect()}
    assert got == {(x, y) for x in "abc" for y in "abc"} | {("d", y) for y in "abc"}


def test_longest_match_from_the_left(spark):
    texts = spark.createDataFrame([(1, "New York City is in New York."), (2, ""), (3, None)], "k int, sentence string")
    words = spark.createDataFrame([("new york",), ("york city",), ("new york city",)], "surface string")
    d = words.select("surface", F.array(F.struct(F.lit(0).alias("pos"), F.col("surface").alias("short"), F.lit("individual").alias("kind"))).alias("entries"))
    rows = {r["k"]: r["mentions"] for r in mentions.detect_mentions(texts, d, ["k"], 3).collect()}
    assert [(m["start"], m["end"]) for m in rows[1]] == [(0, 13), (20, 28)]
    assert not rows[2] and not rows[3]


def test_dictionary_with_types(spark):
    """A surface that an individual and a property share, repeated names, an individual without types."""
    names = spark.createDataFrame([("acme_1", "Acme", "individual"), ("acme_1", "Acme", "individual"), ("Acme", None, "class"), ("makes", '"Makes (up)"', "individual"), ("x", None, "individual")], "short string, label string, kind string")
    closed = spark.createDataFrame([("acme_1", "Party"), ("acme_1", "Entity"), ("Acme", "Acme")], "ind string, cls string")
    trigger = spark.createDataFrame([("makes", (1, "makes", "object_property", []))], "surface string, entry struct<pos:int,short:string,kind:string,types:array<string>>")
    rows = ontology.entity_dictionary(ontology.surface_entries(mentions.with_types(names, closed)).union(trigger)).collect()
    acme = (3, "acme_1", "individual", ["Entity", "Party"])
    assert {r["surface"]: [tuple(e) for e in r["entries"]] for r in rows} == {
        "acme": [(0, "Acme", "class", ["Acme"]), acme], "acme_1": [acme], "acme 1": [acme], '"makes (up)"': [(3, "makes", "individual", [])],
        "makes": [(1, "makes", "object_property", []), (3, "makes", "individual", [])],
    }


def test_strict_and_lax_decoding(spark):
    tags = spark.createDataFrame([(1, 0, "A", "I-X"), (1, 1, "B", "B-X"), (1, 2, "C", "I-Y"), (1, 3, "d", "O")], "k int, pos int, token string, tag string")
    assert [tuple(r) for r in mentions.bio_decode(tags, ["k"]).collect()] == [(1, "b c", "X")]
    assert [tuple(r) for r in mentions.bio_decode(tags, ["k"], strict=True).collect()] == [(1, "B", "X")]


def test_patterns_and_metrics(spark):
    kg = spark.createDataFrame([("a", "p", "b", "iri", None), ("a", "p", "a", "iri", None), ("b", "q", "c", "iri", None)], "s string, p string, o string, o_kind string, o_dtype string")
    assert graph.pattern(kg, "?x", "p", "?x").count() == 1
    assert graph.match_pattern(kg, [("?x", "p", "?y"), ("?y", "q", "?z")]).collect()[0][:] == ("b", "a", "c")
    none = metrics.triple_prf(kg.limit(0), kg.limit(0)).first()
    assert none["tp"] == 0 and none["f1"] == 0.0


def test_tokens_of_long_and_odd_texts(spark):
    import re

    texts = ["", None, "  a b, c", "x", "Éa-b  ς" * 700, " ".join(f"w{i}." for i in range(3000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", mentions.tokens(F.col("t")).alias("x")).collect()
    for k, found in rows:
        want = None if texts[k] is None else [(m.start(), m.end(), m[0]) for m in re.finditer(r"\w+|[^\w\s]", texts[k])]
        assert (None if found is None else [(x["start"], x["end"], x["token"]) for x in found]) == want


def test_relations_in_running_text(spark):
    """A nearer entity of the wrong type, a surface that two individuals share, two relations in a sentence, a side that is missing."""
    entry = lambda pos, short, kind, *types: (pos, short, kind, list(types))
    words = [
        ("acme", [entry(3, "acme", "individual", "Party")]), ("bolt", [entry(3, "bolt", "individual", "Part")]), ("france", [entry(3, "france", "individual", "Nation")]), ("europe", [entry(3, "europe", "individual", "Region")]),
        ("mercury", [entry(3, "mercury_part", "individual", "Part"), entry(3, "mercury_party", "individual", "Party")]), ("is based in", [entry(1, "basedIn", "object_property")]), ("lies in", [entry(1, "inRegion", "object_property")]),
    ]
    d = spark.createDataFrame(words, "surface string, entries array<struct<pos:int,short:string,kind:string,types:array<string>>>")
    sig = spark.createDataFrame([("basedIn", "Party", "Nation"), ("inRegion", "Nation", "Region")], "p string, domain string, range string")
    texts = ["Acme, which makes the bolt, is based in lovely France.", "Mercury is based in Europe near France.", "ACME is based in France which lies in Europe.", "Somebody is based in France.", "nothing at all"]
    found = mentions.detect_mentions(spark.createDataFrame(list(enumerate(texts)), "k int, sentence string"), d, ["k"], 3)
    gated = {(r["k"], r["s"], r["p"], r["o"]) for r in mentions.relation_candidates(found, sig, ["k"]).collect()}
    assert gated == {(0, "acme", "basedIn", "france"), (1, "mercury_party", "basedIn", "france"), (2, "acme", "basedIn", "france"), (2, "france", "inRegion", "europe")}
    near = {(r["k"], r["s"], r["p"], r["o"]) for r in mentions.relation_candidates(found, sig, ["k"], gated=False, window=10).collect()}
    assert near == {(0, "bolt", "basedIn", "france"), (1, "mercury_part", "basedIn", "europe"), (2, "acme", "basedIn", "france"), (2, "france", "inRegion", "europe")}


PRETTY = """<?xml version="1.0"?>
<!DOCTYPE Ontology [
    <!ENTITY xsd "http://www.w3.org/2001/XMLSchema#" >
]>
<Ontology>
    <Declaration>
        <Class IRI="#Tool"/>
    </Declaration>
    <DataPropertyDomain>
        <DataProperty IRI="#size"/>
        <Class IRI="#Tool"/>
    </DataPropertyDomain>
    <DataPropertyAssertion>
        <DataProperty IRI="#size"/>
        <NamedIndividual IRI="#saw"/>
        <Literal datatypeIRI="&xsd;integer">7</Literal>
    </DataPropertyAssertion>
    <AnnotationAssertion>
        <AnnotationProperty abbreviatedIRI="rdfs:comment"/>
        <IRI>#saw</IRI>
        <Literal xml:lang="en">cuts &amp; &quot;saws&quot;</Literal>
    </AnnotationAssertion>
</Ontology>"""


def test_ontology_in_both_layouts(spark, tmp_path):
    import re

    for name, text in (("pretty", PRETTY), ("lines", re.sub(r">\s+<", ">\n<", PRETTY))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "o.owx").write_text(text)
        t = files.load_ontology(spark, str(tmp_path / name))
        got = {k: [tuple(r) for r in t[k].collect()] for k in ("class", "domain", "data", "comment", "label", "obj")}
        assert got == {"class": [("Tool",)], "domain": [("size", "Tool", "data")], "data": [("size", "saw", "7", "xsd:integer")], "comment": [("saw", 'cuts & "saws"')], "label": [], "obj": []}


def test_tiers_again_change_nothing(spark):
    rows = spark.createDataFrame([("k", "[REL] p [/REL] [E1]A$1[/E1] likes [E2]B[/E2].", "p"), ("l", "[REL] q [/REL] [E1]C[/E1] has [E2]D[/E2].", "q")], "key string, text string, sentence_relation string")
    synonyms = spark.createDataFrame([("p", "is $fond\\ of")], "p string, synonym string")
    once = dataset.augment_tiers(rows, synonyms)
    twice = dataset.augment_tiers(once, synonyms)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) and once.count() == 7
    assert once.filter("complexity_tier = 'implicit'").first()["text"] == "[REL] p [/REL] [E1]A$1[/E1] is $fond\\ of [E2]B[/E2]."


def test_numbers_and_classes(spark):
    rows = spark.range(1000).select(F.concat(F.lit("t"), F.lpad("id", 5, "0")).alias("text")).repartition(7)
    got = {r["text"]: r["n"] for r in metrics.numbered(rows, "text", "n").collect()}
    assert got == {f"t{i:05d}": i + 1 for i in range(1000)} and metrics.numbered(rows.limit(0), "text", "n").count() == 0
    facts = spark.createDataFrame([("k", "p", "tool", "shed")], "key string, p string, subject string, object string")
    sig = spark.createDataFrame([("p", "Tool", "Place"), ("q", "Tool", "Place")], "p string, domain string, range string")
    made = dataset.verifier_examples(facts, spark.createDataFrame([("p", "stands in")], "p string, phrase string"), sig, classes=True).collect()
    assert {(r["label"], r["text"]) for r in made} == {("VALID", "[REL] p [/REL] A [E1]tool[/E1] stands in a [E2]shed[/E2]."), ("INVALID", "[REL] q [/REL] A [E1]tool[/E1] stands in a [E2]shed[/E2].")}


def test_ngrams_of_odd_texts(spark):
    """Marks of tokens within a text, letters whose small forms are long or unsure, digits; sentences are grouped without a step before
    the exchange, and n-grams are cut outside of Spark's array functions, which made the largest stage."""
    words = ["big cat", "ünsicher 12", "i̇stanbul", "ΣΑΣ".lower(), "a b", "x7"]
    d = spark.createDataFrame([(w,) for w in words], "surface string").select("surface", F.array(F.struct(F.lit(0).alias("pos"), F.col("surface").alias("short"), F.lit("individual").alias("kind"))).alias("entries"))
    texts = ["The Big  cat, BIG CAT", "ÜNSICHER 12 and ünsicher 34", "in İstanbul, ΣΑΣ", "a\u0001 A B \u0002 a b", "X7 x8 x́ 7", ""]
    found = mentions.detect_mentions(spark.createDataFrame(list(enumerate(texts)), "k int, sentence string"), d, ["k"], 3)
    got = {r["k"]: [m["surface"] for m in r["mentions"] or []] for r in found.collect()}
    assert got == {0: ["big cat"], 1: ["ünsicher 12"], 2: ["i̇stanbul", "σας"], 3: ["a b", "a b"], 4: ["x7"], 5: []}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "RepartitionByExpression" in plan and "lambdafunction(named_struct(start" not in plan


def test_draws_are_spread_over_tasks(spark):
    """Many documents' draws are no one task's work, and a document's hashes are made before its turns."""
    docs, items = spark.range(500).select(F.col("id").alias("doc")), spark.range(40).select(F.col("id").cast("string").alias("s"), F.lit("x").alias("kind"))
    rows = dataset.stratified_documents(docs, items, {"x": 3}, "7", F.col("s"), "kind")
    assert "repartition" in rows._jdf.queryExecution().optimizedPlan().toString().lower()
    taken = rows.groupBy("doc").agg(F.count("*").alias("n"), F.count_distinct("s").alias("d")).filter("n = d and n between 9 and 12").count()
    assert taken == 500
    plan = dataset.drawn(docs, 40, 12, "7")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("md5") > plan.index("Generate explode") and "md5" not in plan[: plan.index("Generate explode")]


def test_forms_of_marked_texts(spark):
    """Clauses behind the relation in front, as the pattern has it, also in odd texts; statistics by one row a text and one a kind."""
    import re

    texts = ["[REL] p [/REL] [E1]a[/E1] x [E2]b[/E2].", "[REL] p [/REL]a", "[REL] p\n[/REL]  a", "[REL]p a", "a [REL] p [/REL] b", "[REL][/REL] é", "", None, "[/REL] [REL] x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r["k"]: r["x"] for r in rows.select("k", dataset.nested(F.col("text")).alias("x")).collect()}
    for k, t in enumerate(texts):
        if t is None:
            assert got[k] is None
            continue
        head, rest = (x or "" for x in re.match(r"(?s)^(\[REL\].*?\[/REL\] ?)?(.*)$", t).groups())
        assert got[k] in {head + clause + rest for clause in dataset.SUBORDINATES}
    rows = spark.createDataFrame([("[REL] p [/REL] a", "VALID", None, "train"), ("[REL] q [/REL] a", "INVALID", "partial", "train"), (None, "VALID", None, None)], "text string, label string, neg_type string, split string")
    stats = dataset.dataset_stats(rows)
    assert {tuple(r) for r in stats.collect()} == {("label", "VALID", 2), ("label", "INVALID", 1), ("neg_type", "partial", 1), ("split", "train", 2), ("distinct_texts", "train", 2), ("sentences", "train", 1)}
    plan = dataset.augment_tiers(rows.withColumn("sentence_relation", F.lit("p")), spark.createDataFrame([("p", "says")], "p string, synonym string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan


def test_bare_texts_as_by_patterns(spark):
    """Texts cut at their usual marks are those that patterns leave, and only unusual ones go by patterns."""
    usual = ["[REL] a [/REL] [E1]X[/E1] is [E2]Y[/E2].", "[REL] a [/REL]  So [E1]é𝔘[/E1], [E2] Z [/E2]", "[REL]a[/REL][E1][/E1][E2][/E2]"]
    odd = ["[REL] a\nb [/REL] [E1]X[/E1] is [E2]Y[/E2].", "[REL] a [/REL] [E1]X[1][/E1] is [E2]Y[/E2]", "[E1]X[/E1] is [E2]Y[/E2].", "[REL] a [/REL] [E2]X[/E2] is [E1]Y[/E1]", "x [REL] a [/REL] [E1]X[/E1] is [E2]Y[/E2]", "[E[E1]1]", "", "plain", None,
           "[REL] a [/REL] [REL]b[/REL] c", "[REL] a [/REL] [E1]X[/E1] is [E2]Y[/E2]]["]
    rows = spark.createDataFrame([(t,) for t in usual + odd], "text string")
    got = fs.bare_texts(rows, "text", "bare").withColumn("wanted", fs.strip_markers(F.col("text"), whole_head=True)).collect()
    assert [r["bare"] for r in got] == [r["wanted"] for r in got] and got[0]["bare"] == "X is Y."
    assert fs.bare_texts(rows, "text", "bare").columns == ["text", "bare"]


def test_token_columns_as_by_column_functions(spark, monkeypatch):
    """Tokens cut from Arrow columns are those of `tokens`, whatever stands in a text and however small the portions are."""
    texts = ["A b, c.", "", None, "  x", "é𝔘 ß!", "a\x01b \x02 c\x01\x02", "\x01", "\x02\x02", "\u00a0w\u2028v", "word " * 700, "\n", "x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, sentence string").coalesce(1)
    wanted = rows.select("k", F.posexplode(mentions.tokens(F.col("sentence"))).alias("pos", "x")).select("k", "pos", "x.token", "x.start", "x.end")
    for size in (mentions.PORTION, 8):
        monkeypatch.setattr(mentions, "PORTION", size)
        got = mentions.token_rows(rows, ["k"])
        assert got.dtypes == wanted.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    assert "MapInArrow" in got._jdf.queryExecution().toString()  # whole columns at once, no fold over each text's tokens
    batch = mentions.pa.RecordBatch.from_arrays([mentions.pa.array(texts)], names=["t"])
    slices = [b.column(0).to_pylist() for b in mentions.portions(batch, 0)]
    assert sum(slices, []) == texts and all(len(x) == 1 or sum(len((t or "").encode()) for t in x) <= 8 for x in slices) and len(slices) > 4


def test_no_hash_goes_through_an_exchange(spark):
    """Rows of n-grams and sentences are dealt out by hashes that are no columns of theirs; mentions of shared surfaces stay whole."""
    import re

    texts = [f"Item {i} is near Item {i % 3}, é." for i in range(30)] + ["", None]
    words = spark.createDataFrame([(f"item {i}", f"i{i}", "individual") for i in range(0, 30, 2)] + [("is near", "near", "object_property")], "surface string, short string, kind string")
    d = files.saved(words.select("surface", F.array(F.struct(F.lit(0).alias("pos"), "short", "kind")).alias("entries")))
    found = mentions.detect_mentions(spark.createDataFrame(list(enumerate(texts)), "k int, sentence string"), d, ["k"], 3)
    below = found._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression", 1)[1]
    assert not re.search(r"xxhash64\([^\n]*\) AS ", below)
    got = {r["k"]: [m["surface"] for m in r["mentions"] or []] for r in found.collect()}
    assert got == {i: ([f"item {i}"] if i % 2 == 0 else []) + ["is near"] + ([f"item {i % 3}"] if i % 3 % 2 == 0 else []) for i in range(30)} | {30: [], 31: []}


def test_spans_of_a_sentence_are_made_once(spark):
    """A sentence's typed spans are bound before its tokens are looked at, not made again for each token."""
    span = "struct<start:int,end:int,surface:string,entries:array<struct<kind:string>>>"
    rows = spark.createDataFrame([(1, "New York is big.", [(0, 8, "new york", [("city",)]), (12, 15, "big", [("x",)])]), (2, "So.", None), (3, None, None)], f"k int, text string, mentions array<{span}>")
    tags = mentions.sentence_tags(rows, ["k"], lambda m: F.when(F.exists(m["entries"], lambda e: e["kind"] == "city"), F.lit("CITY")))
    plan = tags._jdf.queryExecution().optimizedPlan().toString()
    assert "array(filter(transform(" in plan and "filter(filter(" not in plan
    got = {r["k"]: [(t["pos"], t["token"], t["tag"]) for t in r["tags"] or []] for r in tags.collect()}
    assert got == {1: [(0, "New", "B-CITY"), (1, "York", "I-CITY"), (2, "is", "O"), (3, "big", "O"), (4, ".", "O")], 2: [(0, "So", "O"), (1, ".", "O")], 3: []}
