"""Queries on classes, signatures and individuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ontology as onto
from ..sources.files import saved
from .binding import Star, sql, values
from .book import Book

book = Book()
#: Names of all kinds, as the dictionary takes them: labels only for individuals.
NAMES = """names AS (SELECT name AS short, NULL::VARCHAR AS label, 'class' AS kind, 0 AS pos FROM classes UNION ALL SELECT p, NULL, 'object_property', 1 FROM sig
  UNION ALL SELECT p, NULL, 'datatype_property', 2 FROM dsig UNION ALL SELECT ind, label, 'individual', 3 FROM inds)"""
WORDS = "lower(trim(regexp_replace(replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' '), '\\s+', ' ', 'g')))"


def ancestors(star: Star) -> DataFrame:
    return star.once("ancestors", lambda: onto.closure(star.subclass))


def closed(star: Star) -> DataFrame:
    return star.once("closed", lambda: onto.type_closure(star.individuals(), ancestors(star), star.classes))


def bits(star: Star) -> DataFrame:
    return star.once("bits", lambda: saved(onto.class_bits(ancestors(star), star.classes)))


def bitmaps(star: Star, *kinds: str) -> DataFrame:
    """(ind, types, label): the individuals' types as bits, one row each."""
    return onto.type_bits(star.individuals(*kinds), ancestors(star), bits(star), onto.words_of(bits(star)), "label")


def signature_bits(star: Star) -> DataFrame:
    return star.once("signature_bits", lambda: saved(onto.signature_bits(star.signature, bits(star))))


def names(star: Star) -> DataFrame:
    none = F.lit(None).cast("string").alias("label")
    rows = star.classes.select(F.col("name").alias("short"), none, F.lit("class").alias("kind"))
    rows = rows.unionByName(star.signature.select(F.col("p").alias("short"), none, F.lit("object_property").alias("kind")))
    rows = rows.unionByName(star.data_signature.select(F.col("p").alias("short"), none, F.lit("datatype_property").alias("kind")))
    return rows.unionByName(star.individuals().select(F.col("ind").alias("short"), "label", F.lit("individual").alias("kind")))


@book.add(sql("SELECT anc.cls, anc.anc, count(inds.ind) AS n_individuals FROM anc LEFT JOIN inds USING (cls) GROUP BY ALL", "anc", "inds"))
def subclass_closure(star):
    n = star.individuals().groupBy("cls").agg(F.count("*").alias("n"))
    return onto.closure(star.subclass).join(n, "cls", "left").select("cls", "anc", F.coalesce("n", F.lit(0)).alias("n_individuals"))


def order_chains(star: Star) -> DataFrame:
    """(child, parent): each order and the customer's next by key; the last leads back to the first where the customer's key is a
    multiple of 3, and to itself where it is of 5."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = star.table("orders").select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(w).alias("next"), F.first("o_orderkey").over(w).alias("first"))
    back = F.when(F.col("o_custkey") % 3 == 0, F.col("first")).when(F.col("o_custkey") % 5 == 0, F.col("o_orderkey"))
    name = lambda c: F.concat(F.lit("order_"), c)
    return rows.select(name("o_orderkey").alias("child"), name(F.coalesce("next", back)).alias("parent")).filter("parent is not null")


@book.add("""WITH RECURSIVE e AS (SELECT o_orderkey AS a, coalesce(lead(o_orderkey) OVER w, CASE WHEN o_custkey % 3 = 0 THEN first(o_orderkey) OVER w WHEN o_custkey % 5 = 0 THEN o_orderkey END) AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
r(a, b, far) AS (SELECT a, b, 1 FROM e WHERE b IS NOT NULL UNION SELECT r.a, e.b, far + 1 FROM r JOIN e ON e.a = r.b WHERE e.b IS NOT NULL AND far < 200)
SELECT 'order_' || a AS cls, 'order_' || b AS anc, min(far)::BIGINT AS far FROM r GROUP BY ALL""")
def chain_closure(star):
    """All that is reached along deep chains and cycles of the data, and how far it is."""
    return onto.distances(order_chains(star))


@book.add(sql("SELECT ind, cls FROM types", "types"))
def type_closure(star):
    return closed(star)


@book.add(sql("SELECT ind, CASE WHEN cls = 'Part' THEN 'Entity' ELSE cls END AS cls FROM inds", "inds"))
def most_specific_class(star):
    inds = star.individuals()
    types = inds.filter("cls <> 'Part'").select("ind", "cls", F.lit(1).alias("pos")).union(inds.filter("cls <> 'Part'").select("ind", F.lit("Entity"), F.lit(0)))
    types = types.union(inds.filter("cls = 'Part'").select("ind", F.lit(None).cast("string"), F.lit(0)))
    return onto.most_specific_class(types, ancestors(star))


@book.add(sql("SELECT ind, coalesce(arg_min(coarse, rank), 'Entity') AS coarse FROM types LEFT JOIN prio USING (cls) GROUP BY ind", "types", "prio"))
def priority_type(star):
    return onto.priority_type(closed(star), star.priority)


SURFACES = f"""surf AS (SELECT DISTINCT lower(trim(s)) AS surface, pos, short, kind FROM (SELECT unnest([coalesce(label, short), short, {WORDS.format('short')}, coalesce(label, {WORDS.format('short')})]) AS s, pos, short, kind FROM names) WHERE length(trim(s)) >= 2)"""


@book.add(sql(f"WITH {NAMES}, {SURFACES} SELECT surface, string_agg(kind || ':' || short, ',' ORDER BY pos, short) AS entries FROM surf GROUP BY surface", "classes", "sig", "dsig", "inds"))
def entity_dictionary(star):
    d = onto.entity_dictionary(onto.surface_entries(names(star)))
    return d.select("surface", F.array_join(F.transform("entries", lambda e: F.concat(e["kind"], F.lit(":"), e["short"])), ",").alias("entries"))


@book.add(sql(f"SELECT DISTINCT unnest([lower(phrase), {WORDS.format('p')}]) AS surface, p, n FROM sig JOIN (SELECT p, count(*) AS n FROM facts GROUP BY p) USING (p) LEFT JOIN phrases USING (p)", "sig", "phrases", "facts"))
def relation_triggers(star):
    used = star.facts().groupBy("p").agg(F.count("*").alias("n"))
    return onto.relation_triggers(star.signature, star.phrases).join(used, "p").select("surface", "p", "n")


@book.add(sql("""WITH both_ AS (SELECT a, b FROM inverse UNION SELECT b, a FROM inverse), g AS (SELECT a, string_agg(b, ',' ORDER BY b) AS inverses FROM both_ GROUP BY a)
SELECT k.p, kind, """ + WORDS.format("k.p") + """ AS label, coalesce(phrase, '') AS phrase, coalesce(inverses, '') AS inverses, coalesce(f.n, 0) AS n_facts FROM (SELECT p, 'object_property' AS kind FROM sig UNION ALL SELECT p, 'datatype_property' FROM dsig) k
LEFT JOIN phrases USING (p) LEFT JOIN g ON g.a = k.p LEFT JOIN (SELECT p, count(*) AS n FROM (SELECT p FROM facts UNION ALL SELECT p FROM attrs) GROUP BY p) f ON f.p = k.p""", "sig", "dsig", "phrases", "inverse", "facts", "attrs"))
def relation_vocabulary(star):
    used = star.facts().select("p").union(star.attributes().select("p")).groupBy("p").agg(F.count("*").alias("n_facts"))
    rows = onto.vocabulary(star.signature, star.data_signature, star.phrases, star.inverse).join(used, "p", "left")
    return rows.na.fill(0, ["n_facts"]).orderBy("p")


@book.add(sql("""SELECT (SELECT count(*) FROM classes) AS n_classes, (SELECT count(*) FROM sig) AS n_properties, (SELECT count(*) FROM dsig) AS n_data_properties, (SELECT count(*) FROM inds) AS n_individuals,
  (SELECT count(*) FROM facts) AS n_assertions, (SELECT count(*) FILTER (WHERE domain IS NOT NULL AND rng IS NOT NULL) || '/' || count(*) FROM sig) AS with_signature""", "classes", "sig", "dsig", "inds", "facts"))
def ontology_profile(star):
    n = lambda df, name: df.agg(F.count("*").alias(name))
    both = F.count(F.when(F.col("domain").isNotNull() & F.col("range").isNotNull(), 1))
    one = star.signature.agg(F.count("*").alias("n_properties"), F.concat_ws("/", both.cast("string"), F.count("*").cast("string")).alias("with_signature"))
    for df in (n(star.classes, "n_classes"), n(star.data_signature, "n_data_properties"), n(star.individuals(), "n_individuals"), n(star.facts(), "n_assertions")):
        one = one.crossJoin(df)
    return one


@book.add(sql("SELECT p, side, coalesce(n, 0) AS n_facts FROM (SELECT p, unnest(list_filter([CASE WHEN domain IS NULL THEN 'domain' END, CASE WHEN rng IS NULL THEN 'range' END], lambda x: x IS NOT NULL)) AS side FROM (SELECT * FROM sig UNION ALL SELECT p, domain, 'LiteralValue' FROM dsig)) LEFT JOIN (SELECT p, count(*) AS n FROM attrs GROUP BY p) USING (p)", "sig", "dsig", "attrs"))
def missing_signature(star):
    rows = star.signature.unionByName(star.data_signature.withColumn("range", F.lit("LiteralValue")))
    used = star.attributes().groupBy("p").agg(F.count("*").alias("n"))
    return onto.missing_signature(rows).join(used, "p", "left").select("p", "side", F.coalesce("n", F.lit(0)).alias("n_facts"))


@book.add(sql("SELECT i.a, i.b, (x.domain IS NOT DISTINCT FROM y.rng AND x.rng IS NOT DISTINCT FROM y.domain) AS consistent, n AS n_facts FROM inverse i JOIN sig x ON x.p = i.a JOIN sig y ON y.p = i.b JOIN (SELECT p, count(*) AS n FROM facts GROUP BY p) f ON f.p = i.a", "inverse", "sig", "facts"))
def inverse_consistency(star):
    used = star.facts().groupBy(F.col("p").alias("a")).agg(F.count("*").alias("n_facts"))
    return onto.inverse_consistency(star.inverse, star.signature).join(used, "a")


BROKEN = "bad AS (SELECT p, s, o FROM facts UNION ALL SELECT 'placedBy', o, s FROM facts WHERE p = 'basedIn' UNION ALL SELECT 'basedIn', s, s FROM facts WHERE p = 'inRegion')"


def broken(star: Star) -> DataFrame:
    """The facts and some that break their signatures."""
    f = star.facts()
    return f.union(star.facts("basedIn").select(F.lit("placedBy"), "o", "s")).union(star.facts("inRegion").select(F.lit("basedIn"), "s", "s"))


@book.add(sql(f"""WITH {BROKEN} SELECT p, s, o, 'domain' AS side FROM bad JOIN sig USING (p) WHERE domain IS NOT NULL AND NOT EXISTS (SELECT 1 FROM types WHERE ind = s AND cls = domain)
UNION ALL SELECT p, s, o, 'range' FROM bad JOIN sig USING (p) WHERE rng IS NOT NULL AND NOT EXISTS (SELECT 1 FROM types WHERE ind = o AND cls = rng)""", "facts", "sig", "types"))
def abox_violations(star):
    return onto.assertion_violations(broken(star), star.signature, closed(star))


@book.add(sql("""SELECT kind, count(*) AS n, count(c.name) AS described, coalesce(string_agg(CASE WHEN c.name IS NULL THEN k.name END, ',' ORDER BY k.name), '') AS missing
FROM (SELECT DISTINCT cls AS name, 'class' AS kind FROM inds UNION ALL SELECT DISTINCT p, 'object_property' FROM facts UNION ALL SELECT DISTINCT p, 'datatype_property' FROM attrs) k LEFT JOIN comments c USING (name) GROUP BY kind""", "inds", "facts", "attrs", "comments"))
def description_coverage(star):
    rows = star.individuals().select(F.col("cls").alias("name"), F.lit("class").alias("kind")).distinct()
    rows = rows.union(star.facts().select("p", F.lit("object_property")).distinct()).union(star.attributes().select("p", F.lit("datatype_property")).distinct())
    return onto.description_coverage(rows, star.comments)


@book.add(sql("""SELECT name AS cls, coalesce(b.subs, '') AS subclasses, NOT EXISTS (SELECT 1 FROM subclass WHERE child = name) AS is_root, coalesce(n, 0) AS n_individuals
FROM classes LEFT JOIN (SELECT parent, string_agg(child, ',' ORDER BY child) AS subs FROM subclass GROUP BY parent) b ON parent = name LEFT JOIN (SELECT cls, count(*) AS n FROM inds GROUP BY cls) i ON i.cls = name""", "classes", "subclass", "inds"))
def class_structure(star):
    n = star.individuals().groupBy("cls").agg(F.count("*").alias("n_individuals"))
    return onto.class_structure(star.classes, star.subclass).join(n, "cls", "left").na.fill(0, ["n_individuals"])


@book.add(sql("""SELECT t.s, t.p, t.o, coalesce(n, 0) AS n_facts FROM (SELECT domain AS s, p, rng AS o FROM sig WHERE domain IS NOT NULL AND rng IS NOT NULL UNION ALL SELECT domain, p, 'LiteralValue' FROM dsig WHERE domain IS NOT NULL
UNION ALL SELECT child, 'rdfs:subClassOf', parent FROM subclass) t LEFT JOIN (SELECT p, count(*) AS n FROM facts GROUP BY p) f USING (p)""", "sig", "dsig", "subclass", "facts"))
def schema_triples(star):
    used = star.facts().groupBy("p").agg(F.count("*").alias("n_facts"))
    return onto.schema_triples(star.signature, star.data_signature, star.subclass).join(used, "p", "left").na.fill(0, ["n_facts"])
