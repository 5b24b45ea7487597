"""Readers and writers: ontology files, corpora, JSON lines, splits, N-Triples, reports."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRIPLES = "array<struct<subject:string,predicate:string,object:string>>"
#: Explicit schemas of the JSON-lines records; nothing is inferred.
SCHEMAS = {
    "sentences": f"document_id string, sentence_id string, split string, text string, triples {TRIPLES}, is_object_relation boolean",
    "examples": "text string, label string, candidate_relation string, subject string, object string, tier string, neg_type string, sentence string, complexity_tier string, split string",
    "ner": "sentence_id string, split string, tokens array<string>, ner_tags array<string>",
    "triples": "subject string, subject_short string, predicate string, object string, object_short string, sentence_id string, sentence string",
}


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path that driver and executors share: below spark.checkpoint.dir, or a temporary folder where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="tripleloom-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder as Parquet, so that steps that use them twice don't make them twice, read
    only the columns that they need, and a lost executor loses none. checkpoint() would run the last stage twice."""
    place = shared_folder(df.sparkSession, "rows")
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


#: Rows of a table that is broadcast at most.
BROADCAST_ROWS = 50_000


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked to be broadcast if a count finds few rows in it; otherwise Spark joins it as it likes."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Spark DDL of the axiom tables.
AXIOMS = {
    "class": "name string", "objprop": "name string", "dataprop": "name string", "individual": "name string", "label": "name string, label string", "comment": "name string, comment string",
    "domain": "p string, cls string, kind string", "range": "p string, cls string", "subclass": "child string, parent string", "type": "cls string, ind string, pos bigint",
    "obj": "p string, s string, o string", "data": "p string, s string, lex string, dtype string", "inverse": "a string, b string", "symmetric": "p string",
}
#: Elements of the format that are axioms.
ELEMENTS = ["Declaration", "AnnotationAssertion", "ObjectPropertyDomain", "DataPropertyDomain", "ObjectPropertyRange", "SubClassOf", "ClassAssertion", "ObjectPropertyAssertion", "DataPropertyAssertion",
            "InverseObjectProperties", "SymmetricObjectProperty"]
#: Axioms of one part of a file at most, as a power of two, for their places.
PLACES = 23


def axiom_forms() -> dict[str, list[tuple[str, re.Pattern]]]:
    """element -> (table, what stands in it): the forms of axioms that are read; groups are columns a, b and c."""
    iri = lambda tag: rf'<{tag} (?:IRI|abbreviatedIRI)="(?:[^"#]*#)?([^"]*)"/>'
    text, literal = r"<IRI>(?:[^<#]*#)?([^<]*)</IRI>", r"<Literal[^>]*>([^<]*)</Literal>"
    noted = lambda what: rf'<AnnotationProperty (?:IRI|abbreviatedIRI)="[^"]*[#:]{what}"/>' + text + literal
    forms = [
        ("class", "Declaration", iri("Class")), ("objprop", "Declaration", iri("ObjectProperty")), ("dataprop", "Declaration", iri("DataProperty")), ("individual", "Declaration", iri("NamedIndividual")),
        ("label", "AnnotationAssertion", noted("label")), ("comment", "AnnotationAssertion", noted("comment")),
        ("domain object", "ObjectPropertyDomain", iri("ObjectProperty") + iri("Class")), ("domain data", "DataPropertyDomain", iri("DataProperty") + iri("Class")),
        ("range", "ObjectPropertyRange", iri("ObjectProperty") + iri("Class")), ("subclass", "SubClassOf", iri("Class") + iri("Class")), ("type", "ClassAssertion", iri("Class") + iri("NamedIndividual")),
        ("obj", "ObjectPropertyAssertion", iri("ObjectProperty") + iri("NamedIndividual") + iri("NamedIndividual")), ("data", "DataPropertyAssertion", iri("DataProperty") + iri("NamedIndividual") + literal),
        ("inverse", "InverseObjectProperties", iri("ObjectProperty") + iri("ObjectProperty")), ("symmetric", "SymmetricObjectProperty", iri("ObjectProperty")),
    ]
    found: dict[str, list[tuple[str, re.Pattern]]] = {}
    for name, element, body in forms:
        found.setdefault(element, []).append((name, re.compile(f"<{element}>{body}</{element}>")))
    return found


GAPS = re.compile(r">\s+<", re.ASCII)
DATATYPE = re.compile(r'<Literal[^>]*datatypeIRI="(?:[^"]*#|&xsd;|xsd:)([^"]*)"')
#: Columns of a read axiom; those of a piece at a part's border are its file, its text, and `head` where it begins the part.
READ = "axiom string, a string, b string, c string, dtype string, pos long"


def unescaped(s: str) -> str:
    if "&" in s:
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
            s = s.replace(a, b)
    return s


def parsed_axiom(x: str, pos: int, forms: dict[str, list[tuple[str, re.Pattern]]]) -> tuple | None:
    """One axiom as a row of `READ`, or None where it has no form that is read; only assertions of types keep their places."""
    x = GAPS.sub("><", x)
    for name, form in forms.get(x[1 : x.find(">")], ()):
        if m := form.match(x):
            cells = [*map(unescaped, m.groups()), None, None][:3]
            kind = DATATYPE.search(x) if name == "data" else None
            return name, *cells, f"xsd:{kind[1]}" if kind and kind[1] else None, pos if name == "type" else None
    return None


def axiom_batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        types = [pa.string()] * 5 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["axiom", "a", "b", "c", "dtype", "pos"])


def read_axioms(spark: SparkSession, path: str) -> DataFrame:
    """The axioms of all files under a path as rows of `READ`, in one scan, whatever their lines, kept in the shared folder with a
    folder for each kind, so that a table reads only its own; pos rises within a file. A file is read by as many tasks as it has
    parts: each task cuts its lines where an axiom begins and reads each axiom that ends within the part; what stands before its
    first axiom belongs to the last axiom of the part before. These pieces, two a part at most, are kept as axiom `edge`,
    joined, and read afterwards."""
    begin = re.compile("<(?:" + "|".join(ELEMENTS) + ")[ >]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, now, n, parts, done = axiom_forms(), None, 0, [], []

        def put(last: bool) -> None:
            if now:
                pos, x = (now[1] << PLACES) + n, "".join(parts)
                if n == 0 or last:
                    done.append(("edge", now[0], x, "head" if n == 0 else None, None, pos))
                elif row := parsed_axiom(x, pos, forms):
                    done.append(row)

        for b in batches:
            values, of_file, of_block = b.columns
            # the rows of one part stand together
            one = len(b) and (of_file[0], of_block[0]) == (of_file[-1], of_block[-1])
            places = itertools.repeat((of_file[0].as_py(), of_block[0].as_py())) if one else zip(of_file.to_pylist(), of_block.to_pylist())
            for value, place in zip(values.to_pylist(), places):
                if place != now:
                    put(True)
                    now, n, parts = place, 0, []
                at = [m.start() for m in begin.finditer(value)]
                parts.append(value[: at[0]] if at else value)
                for i, j in zip(at, [*at[1:], None]):
                    put(False)
                    n, parts = n + 1, [value[i:j]]
                parts.append("\n")
            if len(done) >= 4096:
                yield from axiom_batches(done)
                done.clear()
        put(True)
        yield from axiom_batches(done)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = axiom_forms()
        for b in batches:
            yield from axiom_batches([r for x, pos in zip(*(c.to_pylist() for c in b.columns)) if (r := parsed_axiom(x, pos, forms))])

    kept = shared_folder(spark, "axioms")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    spark.read.text(path).select("value", *place).mapInArrow(run, READ).write.partitionBy("axiom").parquet(kept)
    # the last axiom of a part and what the next parts begin with
    edges = spark.read.schema(READ).parquet(kept).filter("axiom = 'edge'").select(F.col("a").alias("file"), F.col("b").alias("x"), F.col("c").isNotNull().alias("head"), "pos")
    pieces = edges.withColumn("g", F.sum((~F.col("head")).cast("int")).over(Window.partitionBy("file").orderBy("pos")))
    whole = pieces.groupBy("file", "g").agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]), "").alias("x"))
    whole.filter("g > 0").select("x", "pos").mapInArrow(again, READ).write.mode("append").partitionBy("axiom").parquet(kept)
    return spark.read.schema(READ).parquet(kept)


def load_ontology(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of `AXIOMS` from all OWL/XML files under a path, which are scanned once. Names are cut behind `#`; the kind of a
    domain is `object` or `data`; dtype is `xsd:` and a name, also where a file writes it as an entity. Class expressions aren't
    read: a union as range is no range."""
    rows = read_axioms(spark, path)

    def table(name: str, *columns: str) -> DataFrame:
        # repeated axioms go in an exchange of their table
        return rows.filter(F.col("axiom") == name).select(*[F.col(c).alias(n) for c, n in zip("abc", columns)]).distinct()

    domain = lambda kind: table(f"domain {kind}", "p", "cls").withColumn("kind", F.lit(kind))
    found = {name: table(name, *columns) for name, columns in (
        ("class", ["name"]), ("objprop", ["name"]), ("dataprop", ["name"]), ("individual", ["name"]), ("label", ["name", "label"]), ("comment", ["name", "comment"]), ("range", ["p", "cls"]),
        ("subclass", ["child", "parent"]), ("obj", ["p", "s", "o"]), ("inverse", ["a", "b"]), ("symmetric", ["p"]),
    )}
    data = rows.filter("axiom = 'data'").select(F.col("a").alias("p"), F.col("b").alias("s"), F.col("c").alias("lex"), "dtype").distinct()
    types = rows.filter("axiom = 'type'").select(F.col("a").alias("cls"), F.col("b").alias("ind"), "pos").distinct()
    return found | {"domain": domain("object").unionByName(domain("data")), "data": data, "type": types}


def write_ontology(tables: dict[str, DataFrame], path: str, per_file: int = 50_000, compression: str = "none") -> None:
    """OWL/XML axioms of the given tables (names and columns as in `AXIOMS`), one a line, so many lines a file at most. Compressed
    files are read whole, each by one task."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    one = lambda tag, c: F.concat(F.lit(f'<{tag} IRI="#'), esc(F.col(c)), F.lit('"/>'))
    axiom = lambda tag, *cells: F.concat(F.lit(f"<{tag}>"), *cells, F.lit(f"</{tag}>"))
    note = lambda what: axiom("AnnotationAssertion", F.lit(f'<AnnotationProperty abbreviatedIRI="rdfs:{what}"/><IRI>#'), esc(F.col("name")), F.lit("</IRI><Literal>"), esc(F.col(what)), F.lit("</Literal>"))
    prop = lambda c: one("ObjectProperty", c)
    ind = lambda c: one("NamedIndividual", c)
    literal = F.concat(F.when(F.col("dtype").isNull(), F.lit("<Literal>")).otherwise(F.concat(F.lit('<Literal datatypeIRI="http://www.w3.org/2001/XMLSchema#'), F.substring_index("dtype", ":", -1), F.lit('">'))), esc(F.col("lex")), F.lit("</Literal>"))
    lines = {
        "class": axiom("Declaration", one("Class", "name")), "objprop": axiom("Declaration", prop("name")), "dataprop": axiom("Declaration", one("DataProperty", "name")), "individual": axiom("Declaration", ind("name")),
        "label": note("label"), "comment": note("comment"),
        "domain": F.when(F.col("kind") == "object", axiom("ObjectPropertyDomain", prop("p"), one("Class", "cls"))).otherwise(axiom("DataPropertyDomain", one("DataProperty", "p"), one("Class", "cls"))),
        "range": axiom("ObjectPropertyRange", prop("p"), one("Class", "cls")), "subclass": axiom("SubClassOf", one("Class", "child"), one("Class", "parent")),
        "type": axiom("ClassAssertion", one("Class", "cls"), ind("ind")), "obj": axiom("ObjectPropertyAssertion", prop("p"), ind("s"), ind("o")),
        "data": axiom("DataPropertyAssertion", one("DataProperty", "p"), ind("s"), literal),
        "inverse": axiom("InverseObjectProperties", prop("a"), prop("b")), "symmetric": axiom("SymmetricObjectProperty", prop("p")),
    }
    out = reduce(DataFrame.union, [df.select(lines[name].alias("value")) for name, df in tables.items()])
    out.write.option("maxRecordsPerFile", per_file).option("compression", compression).text(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, stem, text) of text files, whole."""
    name = F.col("_metadata.file_name")
    return spark.read.text(path, wholetext=True).select(name.alias("source_file"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("value").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by an explicit schema; blank lines are skipped, missing keys are null."""
    return spark.read.schema(SCHEMAS.get(schema, schema)).json(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    """Predicted triples as JSON lines, a folder for each system."""
    rows.write.partitionBy("system").json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(subject_short, predicate, object_short, sentence, system) of all systems' files below a path; a system is its folder's name."""
    named = spark.read.schema(SCHEMAS["triples"] + ", system string").json(path)
    return named.select("subject_short", "predicate", "object_short", "sentence", "system")


def write_splits(rows: DataFrame, path: str, kind: str = "json") -> None:
    """One folder for each split; reading the whole path gives all."""
    rows.write.partitionBy("split").format(kind).save(path)


def ntriples(kg: DataFrame, namespace: str) -> DataFrame:
    """(value): the graph as N-Triples lines."""
    def iri(c: str) -> Column:
        known = F.when(F.col(c).startswith("rdf:"), F.concat(F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#"), F.substr(c, F.lit(5))))
        known = known.when(F.col(c).startswith("rdfs:"), F.concat(F.lit("http://www.w3.org/2000/01/rdf-schema#"), F.substr(c, F.lit(6))))
        return F.concat(F.lit("<"), known.otherwise(F.concat(F.lit(namespace), c)), F.lit(">"))

    text = F.col("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    kind = F.when(F.col("o_dtype") == "xsd:string", "").otherwise(F.concat(F.lit("^^<http://www.w3.org/2001/XMLSchema#"), F.substr("o_dtype", F.lit(5)), F.lit(">")))
    obj = F.when(F.col("o_kind") == "iri", iri("o")).otherwise(F.concat(F.lit('"'), text, F.lit('"'), kind))
    return kg.select(F.concat_ws(" ", iri("s"), iri("p"), obj, F.lit(".")).alias("value"))


def write_ntriples(kg: DataFrame, path: str, namespace: str) -> None:
    ntriples(kg, namespace).write.text(path)


def write_csv_report(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)
