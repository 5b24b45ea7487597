"""The knowledge graph: building it, checking it, and matching patterns in it. A graph is a set of (s, p, o, o_kind, o_dtype)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import type_literal
from ..sources.files import if_small, saved
from .ontology import has_type

COLUMNS = ["s", "p", "o", "o_kind", "o_dtype"]


def iri_triples(df: DataFrame) -> DataFrame:
    return df.select("s", "p", "o", F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dtype"))


def gate(triples: DataFrame, signature: DataFrame, types: DataFrame) -> DataFrame:
    """(s, p, o, accepted): whether subject and object have the types of the property's signature; a missing side passes. types:
    (ind, types) bitmaps, one row each; signature with the bits of its sides."""
    sided = triples.join(if_small(signature), "p", "left")
    for end in ("s", "o"):
        sided = sided.join(types.select(F.col("ind").alias(end), F.col("types").alias(f"{end}_types")), end, "left")
    ok = lambda side, end: F.col(f"{side}_bit").isNull() | has_type(F.col(f"{end}_types"), F.col(f"{side}_bit"))
    return sided.select("s", "p", "o", (ok("domain", "s") & ok("range", "o")).alias("accepted"))


def used_individuals(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("s", "o")).alias("ind")).distinct()


def type_triples(used: DataFrame, closed: DataFrame) -> DataFrame:
    return iri_triples(closed.join(used, "ind", "left_semi").select(F.col("ind").alias("s"), F.lit("rdf:type").alias("p"), F.col("cls").alias("o")))


def label_triples(used: DataFrame, labels: DataFrame) -> DataFrame:
    rows = labels.filter("label is not null").join(used, "ind", "left_semi")
    return rows.select(F.col("ind").alias("s"), F.lit("rdfs:label").alias("p"), F.col("label").alias("o"), F.lit("literal").alias("o_kind"), F.lit("xsd:string").alias("o_dtype"))


def subclass_triples(type_rows: DataFrame, subclass: DataFrame) -> DataFrame:
    used = type_rows.select(F.col("o").alias("child")).distinct()
    return iri_triples(subclass.join(used, "child", "left_semi").select(F.col("child").alias("s"), F.lit("rdfs:subClassOf").alias("p"), F.col("parent").alias("o")))


def attribute_triples(used: DataFrame, attributes: DataFrame) -> DataFrame:
    rows = attributes.join(used.withColumnRenamed("ind", "s"), "s", "left_semi").withColumn("v", type_literal(F.col("lex"), F.col("dtype")))
    return rows.select("s", "p", F.col("v.o").alias("o"), F.lit("literal").alias("o_kind"), F.col("v.o_dtype").alias("o_dtype"))


def build_kg(triples: DataFrame, signature: DataFrame, bitmaps: DataFrame, closed: DataFrame, labels: DataFrame, subclass: DataFrame, attributes: DataFrame) -> DataFrame:
    """The graph of the accepted triples (see `gate`) with their individuals' types, labels and attributes, and the classes' axioms."""
    accepted = gate(triples, signature, bitmaps).filter("accepted").select("s", "p", "o")
    accepted = saved(accepted)
    used = saved(used_individuals(accepted))
    types = type_triples(used, closed)
    parts = [iri_triples(accepted), types, label_triples(used, labels), subclass_triples(types, subclass), attribute_triples(used, attributes)]
    return reduce(DataFrame.unionByName, parts).dropDuplicates()


def graph_summary(kg: DataFrame, gated: DataFrame) -> DataFrame:
    """(added, skipped, individuals, total)"""
    totals = gated.agg(F.count(F.when(F.col("accepted"), 1)).alias("added"), F.count(F.when(~F.col("accepted"), 1)).alias("skipped"))
    sizes = kg.agg(F.countDistinct(F.when(F.col("p") == "rdf:type", F.col("s"))).alias("individuals"), F.count("*").alias("total"))
    return totals.crossJoin(sizes)


def make_shapes(signature: DataFrame) -> DataFrame:
    """(target_class, path, required_class, message)"""
    message = F.format_string("%s must point at %s", F.col("p"), F.col("range"))
    return signature.filter("domain is not null and range is not null").select(F.col("domain").alias("target_class"), F.col("p").alias("path"), F.col("range").alias("required_class"), message.alias("message"))


def infer_types(kg: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(ind, cls): the types that follow from the graph's own type edges along subclass axioms."""
    own = kg.filter("p = 'rdf:type'").select(F.col("s").alias("ind"), F.col("o").alias("cls"))
    return own.union(own.join(ancestors, "cls").select("ind", "anc")).distinct()


def validate_shapes(kg: DataFrame, shapes: DataFrame, types: DataFrame) -> DataFrame:
    """(s, path, o, required_class, message): values of a path, at nodes of the target class, that lack the required class.
    Subjects of another class aren't looked at."""
    rows = kg.filter("o_kind = 'iri'").join(shapes, kg["p"] == shapes["path"]).select("s", "path", "o", "target_class", "required_class", "message")
    rows = rows.join(types.select(F.col("ind").alias("s"), F.col("cls").alias("target_class")), ["s", "target_class"], "left_semi")
    return rows.join(types.select(F.col("ind").alias("o"), F.col("cls").alias("required_class")), ["o", "required_class"], "left_anti").select("s", "path", "o", "required_class", "message")


def pattern(kg: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """Bindings of one pattern; terms that begin with ? are variables and become columns."""
    terms = {"s": s, "p": p, "o": o}
    rows = kg
    for c, t in terms.items():
        if not t.startswith("?"):
            rows = rows.filter(F.col(c) == t)
    variables: dict[str, str] = {}
    for c, t in terms.items():
        if t.startswith("?"):
            if t[1:] in variables:
                rows = rows.filter(F.col(c) == F.col(variables[t[1:]]))
            else:
                variables[t[1:]] = c
    return rows.select(*[F.col(c).alias(v) for v, c in variables.items()])


def match_pattern(kg: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Bag of bindings of all patterns together; patterns that share variables are joined on them. Put selective ones first; a pattern
    that shares none with those before it is refused, as it would pair all rows."""
    out = pattern(kg, *patterns[0])
    for p in patterns[1:]:
        out = joined(out, pattern(kg, *p), "inner")
    return out


def optional_pattern(bindings: DataFrame, kg: DataFrame, p: tuple[str, str, str]) -> DataFrame:
    """All bindings, with the pattern's variables where it matches: once for each match, null without."""
    return joined(bindings, pattern(kg, *p), "left")


#: Values of one subject and pattern up to which they are grouped; a subject with more goes by joins.
GROUPED = 10_000


def star_pattern(kg: DataFrame, center: str, required: list[tuple[str, str, str]], optional: list[tuple[str, str, str]], grouped: int = GROUPED) -> DataFrame:
    """Bag of bindings of patterns that share one variable: all required ones, and the optional ones where they match, as
    `match_pattern` and `optional_pattern` give them one by one, but from one scan and one exchange on the shared variable. Each
    pattern binds one more variable at most. Nodes with very many values, counted first, go by the joins instead, so that no
    group grows beyond bounds."""
    patterns = [*required, *optional]
    cells = []
    for i, (s, p, o) in enumerate(patterns):
        at, other, term = ("s", "o", o) if s == center else ("o", "s", s)
        if (s == center) == (o == center) or p.startswith("?"):
            raise ValueError("each pattern has the shared variable as subject or object, and a fixed property")
        fits = (F.col("p") == p) & (F.lit(True) if term.startswith("?") else F.col(other) == term)
        cells.append(F.when(fits, F.struct(F.col(at).alias("_k"), F.lit(i).alias("i"), F.col(other).alias("v"))))
    rows = kg.filter(F.col("p").isin(*{p for _, p, _ in patterns})).select(F.inline(F.array_compact(F.array(*cells)))).filter("_k is not null")
    heavy = rows.groupBy("_k", "i").agg(F.count("*").alias("n")).filter(F.col("n") > grouped).select("_k").distinct()
    heavy = saved(heavy)
    key, out = center[1:], None
    if not heavy.isEmpty():
        few = heavy.withColumnRenamed("_k", key)
        parts = [pattern(kg, *p).join(few, key, "left_semi") for p in patterns]
        out = parts[0]
        for i, p in enumerate(parts[1:], 1):
            out = joined(out, p, "inner" if i < len(required) else "left")
        rows = rows.join(heavy, "_k", "left_anti")
    sets = rows.groupBy("_k").agg(*[F.collect_list(F.when(F.col("i") == i, F.struct("v"))).alias(f"x{i}") for i in range(len(patterns))])
    sets = sets.filter(" and ".join(f"size(x{i}) > 0" for i in range(len(required)))).withColumnRenamed("_k", key)
    for i, (s, _, o) in enumerate(patterns):
        term = o if s == center else s
        sets = sets.withColumn(f"x{i}", (F.explode if i < len(required) else F.explode_outer)(f"x{i}"))
        sets = sets.withColumn(term[1:], F.col(f"x{i}.v")) if term.startswith("?") else sets
        sets = sets.drop(f"x{i}")
    return sets if out is None else sets.unionByName(out.select(*sets.columns))


def joined(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise ValueError("patterns without a shared variable")
    return a.join(b, shared, how)


def result_edges(rows: DataFrame, subject: str, columns: list[str]) -> DataFrame:
    """(s, p, o): one edge for each bound column of a query's rows."""
    cells = F.array(*[F.struct(F.lit(c).alias("p"), F.col(c).alias("o")) for c in columns])
    return rows.select(F.col(subject).alias("s"), F.inline(cells)).filter("o is not null").select("s", "p", "o")


def top_edges(edges: DataFrame, n: int = 60) -> DataFrame:
    """(node, degree) over the first n edges by name."""
    first = edges.distinct().orderBy("s", "p", "o").limit(n)
    return first.select(F.explode(F.array("s", "o")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def edge_diff(gold: DataFrame, predicted: DataFrame, n: int = 45) -> DataFrame:
    """(s, p, o, status): FP first, then FN, then TP, cut at n."""
    both = gold.distinct().withColumn("g", F.lit(1)).join(predicted.distinct().withColumn("x", F.lit(1)), ["s", "p", "o"], "full_outer")
    status = F.when(F.col("g").isNull(), "FP").when(F.col("x").isNull(), "FN").otherwise("TP")
    order = F.when(F.col("status") == "FP", 0).when(F.col("status") == "FN", 1).otherwise(2)
    return both.select("s", "p", "o", status.alias("status")).orderBy(order, "s", "p", "o").limit(n)
