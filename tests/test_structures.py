"""Closures, type bitmaps, star patterns, samples, documents, decoding and stored models against plain Python."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tripleloom.operators import dataset, graph, mentions, ontology, verify
from tripleloom.sources import files


def reached(edges):
    """(from, to): the shortest way above 0."""
    after, found = {}, {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    for a in {x for e in edges for x in e}:
        level, far = after.get(a, set()), 1
        while level:
            for b in level:
                found[a, b] = far
            level, far = {c for b in level for c in after.get(b, ()) if (a, c) not in found}, far + 1
    return found


def test_distances_of_graphs(spark):
    rng = random.Random(1)
    for n, m in ((12, 14), (30, 45), (40, 400)):
        edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]  # cycles, loops and repeated edges among them
        rows = ontology.distances(spark.createDataFrame([*edges, (None, "x"), ("y", None)], "child string, parent string")).collect()
        assert {(r["cls"], r["anc"]): r["far"] for r in rows} == reached(edges) and len(rows) == len(reached(edges))
    assert ontology.closure(spark.createDataFrame([], "child string, parent string")).count() == 0


def test_closure_of_a_chain_of_two_thousand(spark):
    chain = spark.range(2000).select(F.col("id").cast("string").alias("child"), (F.col("id") + 1).cast("string").alias("parent"))
    row = ontology.distances(chain).agg(F.count("*").alias("n"), F.max("far").alias("far"), F.count(F.when(F.col("anc").cast("long") - F.col("cls").cast("long") == F.col("far"), 1)).alias("right")).first()
    assert row[:] == (2000 * 2001 // 2, 2000, 2000 * 2001 // 2)


def test_type_bits_of_many_classes(spark):
    rng = random.Random(2)
    classes = [f"c{i}" for i in range(150)]
    edges = [(c, rng.choice(classes)) for c in classes for _ in range(2)]
    types = [(f"i{k}", rng.choice(classes)) for k in range(80)] + [("i0", "c1"), ("i0", "c2")]
    ancestors = ontology.closure(spark.createDataFrame(edges, "child string, parent string"))
    bits = files.saved(ontology.class_bits(ancestors, spark.createDataFrame([(c,) for c in classes], "name string")))
    number = {r["cls"]: r["bit"] for r in bits.collect()}
    assert sorted(number.values()) == list(range(150)) and ontology.words_of(bits) == 3
    maps = {r["ind"]: r["types"] for r in ontology.type_bits(spark.createDataFrame(types, "ind string, cls string"), ancestors, bits, 3).collect()}
    up = reached(edges)
    for ind in {t[0] for t in types} | set(classes):
        own = {c for i, c in types if i == ind} | ({ind} & set(classes))
        want = own | {b for a in own for b in classes if (a, b) in up}
        assert {c for c, b in number.items() if maps[ind][b // ontology.WORD] >> b % ontology.WORD & 1} == want
    tests = spark.createDataFrame([([5], 0), ([5], 1), ([5], 62), ([5], 63), ([0, 2], 64), (None, 0), ([5], -1), ([5], None)], "types array<long>, bit int")
    assert [r[0] for r in tests.select(ontology.has_type(F.col("types"), F.col("bit"))).collect()] == [True, False, False, False, True, False, False, False]


def test_gates_by_bits(spark):
    sig = spark.createDataFrame([("p", "A", "B"), ("q", "A", None), ("r", None, "Gone")], "p string, domain string, range string")
    classes = spark.createDataFrame([("A",), ("B",), ("Sub",)], "name string")
    ancestors = ontology.closure(spark.createDataFrame([("Sub", "A")], "child string, parent string"))
    bits = ontology.class_bits(ancestors, classes)
    signature = ontology.signature_bits(sig, bits)
    types = ontology.type_bits(spark.createDataFrame([("x", "Sub"), ("y", "B")], "ind string, cls string"), ancestors, bits, 1)
    triples = spark.createDataFrame([("p", "x", "y"), ("p", "y", "x"), ("q", "x", "none"), ("q", "y", "none"), ("r", "x", "y"), ("t", "x", "y")], "p string, s string, o string")
    assert {tuple(r) for r in graph.gate(triples, signature, types).collect()} == {("x", "p", "y", True), ("y", "p", "x", False), ("x", "q", "none", True), ("y", "q", "none", False), ("x", "r", "y", False), ("x", "t", "y", True)}
    assert [tuple(r) for r in verify.gate_by_rule(triples, signature, types).collect()] == [("p", "x", "y")]
    rows = verify.with_types(triples, types).join(signature, "p").filter("domain_bit is not null and range_bit is not null")
    assert [r["s"] for r in verify.batch_validate(rows, verify.types_fit).collect()] == ["x"]


def test_star_patterns(spark):
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(9)}", rng.choice("pqr"), f"o{rng.randrange(4)}", "iri", None) for _ in range(70)]
    rows += [(f"o{rng.randrange(4)}", "back", f"s{rng.randrange(9)}", "iri", None) for _ in range(20)] + [("s1", "p", None, "literal", None)]
    kg = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_dtype string")
    required, optional = [("?x", "p", "?a"), ("?x", "q", "o1")], [("?x", "r", "?b"), ("?c", "back", "?x")]
    want = graph.match_pattern(kg, required)
    for p in optional:
        want = graph.optional_pattern(want, kg, p)
    want = sorted((tuple(r[c] for c in "xabc") for r in want.collect()), key=repr)
    assert want
    for grouped in (10_000, 3, 0):  # all grouped, some nodes by joins, all by joins
        assert sorted((tuple(r[c] for c in "xabc") for r in graph.star_pattern(kg, "?x", required, optional, grouped).collect()), key=repr) == want
    with pytest.raises(ValueError, match="shared variable"):
        graph.star_pattern(kg, "?x", [("?y", "p", "?z")], [])


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]))


def test_star_patterns_take_one_exchange(spark):
    kg = spark.range(100).select(F.col("id").cast("string").alias("s"), F.lit("p").alias("p"), F.lit("o").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dtype"))
    assert exchanges(graph.star_pattern(kg, "?x", [("?x", "p", "?a")], [("?x", "q", "?b"), ("?x", "r", "?c")])) == 1


def test_best_path_against_all_sequences(spark):
    rng = random.Random(4)
    tags = ["O", "I-Y", "I-X", "B-X", "B-Y", "I-Z"]  # no B-Z: an I-Z can't stand
    rows = [[[math.log(rng.random()) for _ in tags] for _ in range(n)] for n in (1, 1, 2, 3, 3, 4, 4, 4)] + [[]]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, scores array<array<double>>")
    got = {r["k"]: r["path"] for r in df.select("k", verify.best_path(F.col("scores"), tags).alias("path")).collect()}
    fine = lambda seq: all(not t.startswith("I-") or (i and seq[i - 1][0] in "BI" and seq[i - 1][2:] == t[2:]) for i, t in enumerate(seq))
    for k, scores in enumerate(rows):
        if not scores:
            assert got[k] is None
            continue
        ways = [w for w in itertools.product(range(len(tags)), repeat=len(scores)) if fine([tags[i] for i in w])]
        assert tuple(got[k]) == max(ways, key=lambda w: sum(s[i] for s, i in zip(scores, w)))


def tag_table(spark):
    words = [("Ann", "B-P"), ("Lee", "I-P"), ("sees", "O"), ("Rome", "B-Q"), ("and", "O"), ("Bob", "B-P"), ("Ray", "I-P"), (".", "O")]
    rows = [(k, i, w, t, ("train", "val", "test")[k % 3]) for k in range(60) for i, (w, t) in enumerate(words[k % 4 :])]
    return spark.createDataFrame(rows, "k int, pos int, token string, tag string, split string")


def test_stored_taggers_and_runs(spark):
    rows = tag_table(spark)
    model, accuracy = verify.train_tagger(rows, ["k"])
    assert accuracy > 0.9
    path = verify.save_model(model, files.shared_folder(spark, "tagger"))
    test = rows.filter("split = 'test'").drop("tag")
    fitted, stored = (sorted(map(tuple, verify.predict_tags(m, test, ["k"]).collect())) for m in (model, path))
    assert fitted == stored and len(fitted) == test.count()
    before = {(k, p): t for k, p, _, t in fitted}
    for (k, p), t in before.items():
        assert not t.startswith("I-") or before.get((k, p - 1), "O")[1:] == t[1:]
    free = verify.predict_tags(path, test, ["k"], constrained=False)
    assert free.count() == test.count() and verify.tag_sentences(path, test, ["k"]).count() > 0


def test_stored_verifier_gates_as_the_fitted_one(spark):
    made = [(f"[REL] {rel} [/REL] [E1]a{i}[/E1] {phrase} [E2]b{i}[/E2].", "VALID" if rel == said else "INVALID", ("train", "val")[i % 2])
            for i in range(40) for rel in "pq" for said, phrase in (("p", "lies in"), ("q", "eats"))]
    model, accuracy = verify.train_verifier(spark.createDataFrame(made, "text string, label string, split string"))
    assert accuracy > 0.9
    path = verify.save_model(model, files.shared_folder(spark, "verifier"))
    candidates = spark.createDataFrame([(1, "p", "Oz lies in Ix.", 0, 2, 11, 13), (2, "q", "Oz lies in Ix.", 0, 2, 11, 13), (3, "q", "Oz eats Ix.", 0, 2, 8, 10), (4, "p", "Ix eats Oz.", 8, 10, 0, 2)],
                                       "k int, p string, text string, s_start int, s_end int, o_start int, o_end int")
    assert verify.claims_of(candidates).filter("k = 4").first()["claim"] == "[REL] p [/REL] [E2]Ix[/E2] eats [E1]Oz[/E1]."
    kept = [sorted(map(tuple, verify.gate_by_model(candidates, m).collect())) for m in (model, path)]
    assert kept[0] == kept[1] and [r[0] for r in kept[0]] == [1, 3]
    assert verify.gate_by_model(candidates.limit(0), path).count() == 0


def test_samples_without_repeats(spark):
    items = spark.range(101).select(F.col("id").cast("string").alias("s"), F.lit("p").alias("p"))
    docs = spark.range(300).select(F.col("id").alias("doc"))
    rows = dataset.sample_documents(docs, items, "7", F.col("s")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc"], []).append((r["position"], r["s"]))
    assert len(by) == 300 and {len(v) for v in by.values()} == {9, 10, 11, 12}
    assert all(len({s for _, s in v}) == len(v) and sorted(p for p, _ in v) == list(range(1, len(v) + 1)) for v in by.values())
    times = [sum(r["s"] == str(i) for r in rows) for i in range(101)]
    assert min(times) > 5 and max(times) < 80  # about 31 each
    few = dataset.sample_documents(docs, items.limit(4), "7", F.col("s"))
    assert {r["count"] for r in few.groupBy("doc").count().collect()} == {4}
    assert dataset.sample_documents(docs, items.limit(0), "7", F.col("s")).count() == 0
    kinds = items.withColumn("kind", F.when(F.col("s").cast("int") < 3, "rare").otherwise("other"))
    mixed = dataset.stratified_documents(docs, kinds, {"rare": 2, "gone": 3}, "7", F.col("s"), "kind")
    got = {r["doc"]: (r["n"], r["rare"], r["all"]) for r in mixed.groupBy("doc").agg(F.count_distinct("s").alias("n"), F.count(F.when((F.col("kind") == "rare") & (F.col("position") <= 2), 1)).alias("rare"), F.count("*").alias("all")).collect()}
    assert len(got) == 300 and all(n == all_ and 9 <= n <= 12 and rare == 2 for n, rare, all_ in got.values())


def test_documents_of_eight_to_twelve(spark):
    rows = spark.range(5000).select(F.lit("p").alias("p"), F.col("id").cast("string").alias("s"), F.lit("o").alias("o"), F.concat(F.lit("Text "), "id", F.lit(".")).alias("text"))
    chunks = dataset.chunk_documents(rows.repartition(5))
    sizes = [r["n"] for r in chunks.groupBy("doc").agg(F.count("*").alias("n"), F.max("position").alias("m")).orderBy("doc").collect()]
    assert sum(sizes) == 5000 and set(sizes[:-1]) == {8, 9, 10, 11, 12} and sizes[-1] <= 12
    again = dataset.chunk_documents(rows.repartition(3))
    assert sorted(map(tuple, chunks.collect())) == sorted(map(tuple, again.collect()))
    docs, gold = dataset.document_records(chunks)
    texts = {r["document_id"]: r["text"].split("\n") for r in docs.collect()}
    assert all(texts[r["document_id"]][int(r["sentence_id"][-3:]) - 1] == r["text"] for r in gold.collect()) and gold.count() == 5000
    assert gold.groupBy("document_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert dataset.chunk_documents(rows.limit(0)).count() == 0


def test_mentions_take_two_exchanges(spark):
    texts = spark.createDataFrame([(1, "the big cat sat"), (2, None), (3, ""), (4, "Big Cat eats cat. " * 400)], "k int, sentence string")
    entry = lambda short, kind: [(0, short, kind)]
    words = [("big cat", entry("bc", "individual")), ("cat", entry("c", "class")), ("eats", entry("eats", "object_property"))]
    d = spark.createDataFrame(words, "surface string, entries array<struct<pos:int,short:string,kind:string>>")
    found = mentions.detect_mentions(texts, files.saved(d), ["k"], 3)
    got = {r["k"]: None if r["mentions"] is None else [(m["start"], m["end"], m["entries"][0]["short"]) for m in r["mentions"]] for r in found.collect()}
    assert got[1] == [(4, 11, "bc")] and got[2] is None and got[3] is None
    assert len(got[4]) == 1200 and got[4][:3] == [(0, 7, "bc"), (8, 12, "eats"), (13, 16, "c")]
    assert {r["k"]: r["text"] for r in found.collect()}[4] == "Big Cat eats cat. " * 400


def test_relations_with_places_in_documents(spark):
    docs = spark.createDataFrame([("d1", "Acme is based in France.\nNothing here. Acme is based in France."), ("d2", "")], "id string, text string")
    entry = lambda pos, short, kind, *types: (pos, short, kind, list(types))
    words = [("acme", [entry(3, "acme", "individual", "Party")]), ("france", [entry(3, "france", "individual", "Nation")]), ("is based in", [entry(1, "basedIn", "object_property")])]
    d = spark.createDataFrame(words, "surface string, entries array<struct<pos:int,short:string,kind:string,types:array<string>>>")
    sig = spark.createDataFrame([("basedIn", "Party", "Nation")], "p string, domain string, range string")
    found = mentions.document_mentions(docs, d, "id", 3)
    rows = mentions.relation_candidates(found, sig, ["id", "n"]).collect()
    assert sorted((r["id"], r["n"], r["s"], r["o"], r["s_start"], r["o_end"]) for r in rows) == [("d1", 1, "acme", "france", 0, 23), ("d1", 3, "acme", "france", 0, 23)]


def test_ontology_files_read_in_parts(spark, tmp_path):
    names = [f"thing{i}" for i in range(300)]
    pretty = "<Ontology>\n" + "".join(f'    <ClassAssertion>\n        <Class IRI="#Tool"/>\n        <NamedIndividual IRI="#{n}"/>\n    </ClassAssertion>\n    <AnnotationAssertion><AnnotationProperty abbreviatedIRI="rdfs:label"/>\n<IRI>#{n}</IRI><Literal>first\nsecond {n}</Literal></AnnotationAssertion>' for n in names) + "</Ontology>\n"
    (tmp_path / "a.owx").write_text(pretty)
    (tmp_path / "b.owx").write_text('<Ontology><Declaration><Class IRI="#Tool"/></Declaration><Declaration><Class IRI="#Shed"/></Declaration></Ontology>')
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("1000b", "130b"):  # some axioms in a part; parts shorter than an axiom
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            t = files.load_ontology(spark, str(tmp_path))
            ordered = [(r["cls"], r["ind"]) for r in t["type"].orderBy("pos").collect()]
            assert ordered == [("Tool", n) for n in names]
            assert {tuple(r) for r in t["label"].collect()} == {(n, f"first\nsecond {n}") for n in names}
            assert {r["name"] for r in t["class"].collect()} == {"Tool", "Shed"} and t["obj"].count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_each_ontology_table_reads_its_own_files(spark, tmp_path):
    tables = {"individual": spark.range(500).select(F.concat(F.lit("x"), "id").alias("name")), "label": spark.range(500).select(F.concat(F.lit("x"), "id").alias("name"), F.lit("a < b & c").alias("label"))}
    for kind in ("none", "gzip"):
        files.write_ontology({k: df.union(df) for k, df in tables.items()}, str(tmp_path / kind), 200, kind)
        t = files.load_ontology(spark, str(tmp_path / kind))
        assert re.search(r"PartitionFilters: \[[^\]]*label", t["label"]._jdf.queryExecution().executedPlan().toString())
        assert t["individual"].count() == 500 and {tuple(r) for r in t["label"].collect()} == {(f"x{i}", "a < b & c") for i in range(500)}


def test_forms_of_numbered_names_stay_few(spark):
    """A filter over surfaces with numbers doesn't fill up, and lets all of them through."""
    names = spark.range(100_000).select(F.concat(F.lit("order#"), "id").alias("surface"))
    bits = mentions.masks(names, "surface")
    assert bits.agg(F.sum(F.bit_count("_mask"))).first()[0] <= 5
    assert mentions.may_hold(names, "surface", bits).count() == 100_000


def test_models_fit_forms_with_weights(spark):
    """Rows that differ in numbers alone are fitted as one, with their number as weight."""
    rows = [(f"[REL] {rel} [/REL] [E1]a#{i}[/E1] {phrase} [E2]b#{i}[/E2].", "VALID" if rel == said else "INVALID", ("train", "val")[i % 2]) for i in range(50) for rel in "pq" for said, phrase in (("p", "lies in"), ("q", "eats"))]
    model, accuracy = verify.train_verifier(spark.createDataFrame(rows, "text string, label string, split string"))
    assert accuracy == 1.0 and model.stages[-1].summary.predictions.count() == 4
    words = [("Order", "B-O"), ("#", "I-O"), ("", "I-O"), ("ran", "O")]
    tags = spark.createDataFrame([(k, i, w or str(k), t, ("train", "val")[k % 2]) for k in range(60) for i, (w, t) in enumerate(words)], "k int, pos int, token string, tag string, split string")
    model, accuracy = verify.train_tagger(tags, ["k"])
    assert accuracy == 1.0 and model.stages[-1].summary.predictions.count() == 4


def test_claims_alike_are_scored_once(spark, monkeypatch):
    """However many claims differ in numbers alone, a model scores one of them; all claims get its score."""
    told = [("[REL] a [/REL] [E1]X#%d[/E1] is at [E2]Y[/E2].", "VALID"), ("[REL] b [/REL] [E1]X#%d[/E1] is at [E2]Y[/E2].", "INVALID")]
    rows = [(t % i, label, s) for t, label in told for s in ("train", "val") for i in range(20)]
    model, _ = verify.train_verifier(spark.createDataFrame(rows, "text string, label string, split string"))
    claims = spark.createDataFrame([(i, t % i) for t, _ in told for i in range(50)] + [(99, None)], "k int, text string")
    seen, whole = [], verify.scored
    wanted = {(r["k"], r["text"]): r["p_valid"] for r in whole(model, claims.filter("text is not null")).collect()}
    monkeypatch.setattr(verify, "scored", lambda m, r: seen.append(r.count()) or whole(m, r))
    got = verify.score_claims(model, claims).collect()
    assert seen == [2] and len(got) == 101 and sorted(got, key=repr) == sorted(verify.score_claims(model, claims, claims.filter("k < 3")).collect(), key=repr)
    assert {(r["k"], r["text"]): r["p_valid"] for r in got if r["text"] is not None} == wanted
    text = "X#%d is at Y."
    candidates = spark.createDataFrame([("ab"[i % 2], text % i, 0, len(text % i) - 9, len(text % i) - 2, len(text % i) - 1, i) for i in range(40)], "p string, text string, s_start int, s_end int, o_start int, o_end int, i int")
    kept = verify.gate_by_model(candidates, model, ["i", "p"])
    assert seen == [2, 2, 2] and kept.columns == ["i", "p"] and sorted(r["i"] for r in kept.collect()) == list(range(0, 40, 2))


def test_forms_are_counted_before_tiers(spark):
    """Trainers see the same texts and numbers of rows whether examples are counted before or after their tiers are made."""
    from tripleloom.operators import dataset

    texts = ["[REL] a [/REL] [E1]X#%d[/E1] is at [E2]Y %d[/E2].", "[REL] b [/REL] [E1]X#%d 12][/E1] was 5 [E2]Z%d[/E2], 07.", "no marks %d, %d", "[E2]X%d[/E2] before [E1]Y%d[/E1]"]
    rows = [(f"k{i}", t % (i, i * 7), "VALID" if i % 3 else "INVALID", "ab"[i % 2], "train" if i % 4 else "val") for t in texts for i in range(60)] + [("n", None, "VALID", "a", "train")]
    examples = spark.createDataFrame(rows, "key string, text string, label string, sentence_relation string, split string")
    synonyms = spark.createDataFrame([("a", "sits 3 in")], "p string, synonym string")
    form = verify.without_numbers(F.col("text")).alias("text")
    columns = [form, "label", "split", "complexity_tier"]
    one = dataset.augment_tiers(examples, synonyms).groupBy(*columns).agg(F.count("*").alias("n"))
    two = dataset.augmented_forms(examples, synonyms)
    assert two.count() < one.agg(F.sum("n")).first()[0] / 2
    two = two.groupBy(*columns).agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, two.collect()), key=repr)


def test_texts_of_tiers(spark):
    """Marks are found in order, as the pattern of a marked text finds them."""
    from tripleloom.functions.strings import MARKED
    from tripleloom.operators import dataset

    texts = ["[E1]a[/E1] b [E2]c[/E2] d", "x [E1]a[/E1][E2]c[/E2]\n", "[E2]a[/E2] b [E1]c[/E1]", "[E1]a[E1]b[/E1] [/E1] [E2]c[/E2][E2]", "[/E1][E1]a [E2]c[/E2]", "[E1][/E1] [E2][/E1]q", "", "é[E1]ü[/E1] 𝔘 [E2]ß[/E2]$1\\", "[E2][E1]a[/E1] [E2]x[/E2]"]
    rows = spark.createDataFrame([(t, "s") for t in texts], "text string, sentence_relation string")
    synonyms = spark.createDataFrame([("s", "$2 \\ is")], "p string, synonym string")
    got = {r["text"]: r["x"] for r in dataset.with_places(rows).select("text", dataset.implicit(F.col("text"), F.lit("$2 \\ is")).alias("x")).collect()}
    import re

    assert got == {t: re.sub(MARKED, lambda m: f"{m[1]}[E1]{m[2]}[/E1] $2 \\ is [E2]{m[4]}[/E2]{m[5]}", t, count=1) for t in texts}
    tiers = dataset.augment_tiers(rows, synonyms)
    assert tiers.count() == 4 * len(texts)
    clause = dataset.pick(dataset.DISTRACTORS, F.col("text")).alias("c")
    wanted = {r["text"]: re.sub(MARKED, lambda m: f"{m[1]}[E1]{m[2]}[/E1]{r['c']}{m[3]}[E2]{m[4]}[/E2]{m[5]}", r["text"], count=1) for r in rows.select("text", clause).collect()}
    assert sorted(r["text"] for r in tiers.filter("complexity_tier = 'long_distance'").collect()) == sorted(wanted.values())
