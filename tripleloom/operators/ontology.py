"""Class hierarchies, signatures and consistency checks, as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import camel_to_words, display_name
from ..sources.files import if_small, saved
from .metrics import numbered


def distances(edges: DataFrame) -> DataFrame:
    """(cls, anc, far) for (child, parent): all ancestors with the length of the shortest way, which for a class on a cycle leads
    back to itself. Lengths double in each round: a way longer than 2^k begins with one of exactly 2^k, so only pairs that are
    that far apart are joined with what is known, and only new pairs are kept and written. Ends when no pair is that far apart."""
    new = saved(edges.filter("child is not null and parent is not null").select(F.col("child").alias("cls"), F.col("parent").alias("anc")).distinct().withColumn("far", F.lit(1).cast("long")))
    known, step = new, 1
    while True:
        ends = new.filter(F.col("far") == step)
        if ends.isEmpty():
            return known
        beyond = known.select(F.col("cls").alias("mid"), F.col("anc").alias("to"), (F.col("far") + step).alias("way"))
        further = ends.select("cls", F.col("anc").alias("mid")).join(beyond, "mid").groupBy("cls", F.col("to").alias("anc")).agg(F.min("way").alias("far"))
        have = known.select(F.col("cls").alias("_c"), F.col("anc").alias("_a"))
        new = saved(further.join(have, (F.col("cls") == F.col("_c")) & (F.col("anc") == F.col("_a")), "left_anti"))
        known, step = known.union(new), step * 2


def closure(edges: DataFrame) -> DataFrame:
    """(cls, anc) for (child, parent): all ancestors, also over cycles; edges without both ends are left out."""
    return distances(edges).select("cls", "anc")


#: Types in one word of a bitmap.
WORD = 63


def class_bits(ancestors: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, bit): classes numbered from 0, those with fewer ancestors first, then by name."""
    depth = ancestors.groupBy("cls").agg(F.count("*").alias("n"))
    every = classes.select(F.col("name").alias("cls")).union(ancestors.select("cls")).union(ancestors.select("anc")).distinct()
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "cls")
    return numbered(every.join(depth, "cls", "left").select("cls", order.alias("_by")), "_by", "bit").select("cls", (F.col("bit") - 1).cast("int").alias("bit"))


def type_bits(types: DataFrame, ancestors: DataFrame, bits: DataFrame, words: int, label: str | None = None) -> DataFrame:
    """(ind, types array<bigint>): the types of individuals (ind, cls), asserted and inherited, as a bitmap of so many words; one row
    each, so that a test of a type is a test of a bit. Classes count as individuals of their own name. label: a column that comes
    along, the greatest of an individual's."""
    mask = lambda w: F.bit_or(F.when(F.floor(F.col("bit") / WORD) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % WORD).cast("int"))).otherwise(F.lit(0).cast("long")))
    up = bits.select("cls", F.col("cls").alias("anc")).union(ancestors).distinct()
    of_class = up.join(bits.withColumnRenamed("cls", "anc"), "anc").groupBy("cls").agg(F.array(*[mask(w) for w in range(words)]).alias("types"))
    more = [F.col(label)] if label else []
    own = types.select("ind", "cls", *more).union(bits.select(F.col("cls").alias("ind"), "cls", *[F.lit(None).cast("string") for _ in more]))
    joined = own.join(if_small(of_class), "cls")
    return joined.groupBy("ind").agg(F.array(*[F.bit_or(F.get("types", F.lit(w))) for w in range(words)]).alias("types"), *[F.max(c).alias(label) for c in more])


def words_of(bits: DataFrame) -> int:
    """How many words bitmaps of these classes take; one count over a schema."""
    return max(1, -(-bits.count() // WORD))


def has_type(types: Column, bit: Column) -> Column:
    """Whether a bitmap (null: none) has a bit."""
    word = F.get(types, F.floor(bit / WORD).cast("int"))
    return (bit >= 0) & F.coalesce(F.getbit(word, (bit % WORD).cast("int")) == 1, F.lit(False))


def signature_bits(signature: DataFrame, bits: DataFrame) -> DataFrame:
    """(p, domain, range, domain_bit, range_bit): null where the property states no side; -1 for a class that is none."""
    rows = signature
    for side in ("domain", "range"):
        rows = rows.join(bits.select(F.col("cls").alias(side), F.col("bit").alias(f"{side}_bit")), side, "left")
        rows = rows.withColumn(f"{side}_bit", F.when(F.col(side).isNotNull(), F.coalesce(f"{side}_bit", F.lit(-1))))
    return rows.select("p", "domain", "range", "domain_bit", "range_bit")


def type_closure(types: DataFrame, ancestors: DataFrame, classes: DataFrame) -> DataFrame:
    """(ind, cls): all types of individuals, and of classes taken as nodes."""
    own = types.select("ind", "cls")
    more = own.join(ancestors, "cls").select("ind", F.col("anc").alias("cls"))
    nodes = classes.select(F.col("name").alias("ind"), F.col("name").alias("cls")).union(ancestors.select("cls", "anc"))
    return own.union(more).union(nodes).distinct()


def most_specific_class(types: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(ind, cls): the asserted class (ind, cls, pos) with most ancestors, the first of equals; `Entity` where none is asserted."""
    depth = ancestors.groupBy("cls").agg(F.count("*").alias("depth"))
    ranked = types.join(depth, "cls", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    best = F.max_by("cls", F.when(F.col("cls").isNotNull(), F.struct("depth", -F.col("pos"))))
    return ranked.groupBy("ind").agg(F.coalesce(best, F.lit("Entity")).alias("cls"))


def priority_type(closed: DataFrame, priority: DataFrame) -> DataFrame:
    """(ind, coarse): the coarse type of the first listed class among an individual's types, else `Entity`."""
    return closed.join(priority, "cls", "left").groupBy("ind").agg(F.coalesce(F.min_by("coarse", "rank"), F.lit("Entity")).alias("coarse"))


KIND_ORDER = {"class": 0, "object_property": 1, "datatype_property": 2, "individual": 3}


def surface_entries(names: DataFrame) -> DataFrame:
    """(surface, entry) from (short, label, kind) and, where given, types: each entity under its label, name, the name's words and
    its display name, in lower case, two characters at least. Entries hold the place of their kind, short, kind and types."""
    surfaces = F.array_distinct(F.transform(F.array(F.coalesce("label", "short"), F.col("short"), camel_to_words(F.col("short")), display_name(F.col("label"), F.col("short"))), lambda s: F.lower(F.trim(s))))
    order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in KIND_ORDER.items()])
    entry = F.struct(order.alias("pos"), "short", "kind", *[c for c in ("types",) if c in names.columns])
    return names.select(F.explode(surfaces).alias("surface"), entry.alias("entry")).filter(F.length("surface") >= 2)


def entity_dictionary(entries: DataFrame) -> DataFrame:
    """surface -> entries, from (surface, entry), in the order of kinds, then names. One exchange, on the surface."""
    return entries.groupBy("surface").agg(F.array_sort(F.collect_set("entry")).alias("entries"))


def relation_triggers(properties: DataFrame, phrases: DataFrame) -> DataFrame:
    """(surface, p): the phrase and the words of each property, without repeats."""
    both = properties.join(phrases, "p", "left")
    words = F.array_distinct(F.array_compact(F.array(F.lower("phrase"), camel_to_words(F.col("p")))))
    return both.select(F.explode(words).alias("surface"), "p").distinct()


def inverse_groups(inverse: DataFrame) -> DataFrame:
    """(a, inverses): each property with all its inverses, both ways round."""
    both = inverse.select("a", "b").union(inverse.select("b", "a"))
    return both.groupBy("a").agg(F.array_join(F.array_sort(F.collect_set("b")), ",").alias("inverses"))


def vocabulary(signature: DataFrame, data_signature: DataFrame, phrases: DataFrame, inverse: DataFrame) -> DataFrame:
    """(p, kind, label, phrase, inverses): all properties by name, with their words as label; '' where there is no phrase or inverse."""
    rows = signature.select("p", F.lit("object_property").alias("kind")).union(data_signature.select("p", F.lit("datatype_property")))
    rows = rows.join(phrases, "p", "left").join(inverse_groups(inverse).withColumnRenamed("a", "p"), "p", "left")
    return rows.select("p", "kind", camel_to_words(F.col("p")).alias("label"), F.coalesce("phrase", F.lit("")).alias("phrase"), F.coalesce("inverses", F.lit("")).alias("inverses")).orderBy("p")


def missing_signature(signature: DataFrame) -> DataFrame:
    """(p, side): the sides that a property doesn't state."""
    sides = F.array(F.when(F.col("domain").isNull(), "domain"), F.when(F.col("range").isNull(), "range"))
    return signature.select("p", F.explode(F.array_compact(sides)).alias("side"))


def inverse_consistency(inverse: DataFrame, signature: DataFrame) -> DataFrame:
    """(a, b, consistent): whether domain and range of inverse properties mirror each other; nulls equal nulls."""
    x = signature.select(F.col("p").alias("a"), F.col("domain").alias("da"), F.col("range").alias("ra"))
    y = signature.select(F.col("p").alias("b"), F.col("domain").alias("db"), F.col("range").alias("rb"))
    return inverse.join(x, "a").join(y, "b").select("a", "b", (F.col("da").eqNullSafe(F.col("rb")) & F.col("ra").eqNullSafe(F.col("db"))).alias("consistent"))


def assertion_violations(facts: DataFrame, signature: DataFrame, closed: DataFrame) -> DataFrame:
    """(p, s, o, side): one row for each side of a fact whose individual lacks the required class."""
    typed = facts.join(signature, "p")
    sides = []
    for side, end in (("domain", "s"), ("range", "o")):
        need = typed.filter(F.col(side).isNotNull()).withColumn("ind", F.col(end)).withColumn("cls", F.col(side))
        sides.append(need.join(closed, ["ind", "cls"], "left_anti").select("p", "s", "o", F.lit(side).alias("side")))
    return sides[0].unionByName(sides[1])


def description_coverage(named: DataFrame, comments: DataFrame) -> DataFrame:
    """(kind, n, described, missing) for (name, kind): how many have a comment, and which have none."""
    both = named.join(comments.select("name", F.lit(True).alias("has")), "name", "left")
    lacks = F.array_join(F.array_sort(F.collect_list(F.when(F.col("has").isNull(), F.col("name")))), ",")
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.count("has").alias("described"), lacks.alias("missing"))


def class_structure(classes: DataFrame, subclass: DataFrame) -> DataFrame:
    """(cls, subclasses, is_root): direct subclasses in order; roots have no parent."""
    below = subclass.groupBy(F.col("parent").alias("name")).agg(F.array_join(F.array_sort(F.collect_list("child")), ",").alias("subclasses"))
    above = subclass.select(F.col("child").alias("name"), F.lit(True).alias("has")).distinct()
    return classes.join(below, "name", "left").join(above, "name", "left").select(F.col("name").alias("cls"), F.coalesce("subclasses", F.lit("")).alias("subclasses"), F.col("has").isNull().alias("is_root"))


def schema_triples(signature: DataFrame, data_signature: DataFrame, subclass: DataFrame) -> DataFrame:
    """(s, p, o) of the schema: signatures with both sides, data properties with a literal, subclass axioms."""
    objects = signature.filter("domain is not null and range is not null").select(F.col("domain").alias("s"), "p", F.col("range").alias("o"))
    data = data_signature.filter("domain is not null").select(F.col("domain").alias("s"), "p", F.lit("LiteralValue").alias("o"))
    return objects.unionByName(data).unionByName(subclass.select(F.col("child").alias("s"), F.lit("rdfs:subClassOf").alias("p"), F.col("parent").alias("o")))
