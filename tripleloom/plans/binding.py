"""The star-schema tables seen as a small world of classes, individuals and facts, and the texts as a corpus.

Each table is given twice: as a DataFrame and as a DuckDB common table expression, for the oracles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUBCLASSES = [
    ("Region", "Place"), ("Nation", "Place"), ("Place", "Entity"), ("Customer", "Party"), ("Supplier", "Party"), ("Party", "Entity"),
    ("Part", "Item"), ("Item", "Entity"), ("Order", "Record"), ("Record", "Entity"),
]
CLASSES = ["Entity", "Place", "Region", "Nation", "Party", "Customer", "Supplier", "Item", "Part", "Record", "Order"]
#: property, domain, range (null: none stated)
SIGNATURES = [
    ("inRegion", "Nation", "Region"), ("basedIn", "Party", "Nation"), ("placedBy", "Order", "Customer"), ("contains", "Order", "Part"),
    ("suppliedBy", "Part", "Supplier"), ("tradesWith", "Nation", "Nation"), ("billedTo", "Order", "Customer"), ("registeredIn", "Party", "Nation"),
    ("containedIn", "Part", "Order"), ("supplies", "Supplier", "Part"), ("hasNation", "Region", "Place"), ("relatedTo", "Entity", None),
]
DATA_PROPERTIES = [("acctbal", "Party"), ("segment", "Customer"), ("size", "Part"), ("flag", None)]
INVERSES = [("contains", "containedIn"), ("suppliedBy", "supplies"), ("inRegion", "hasNation")]
SYMMETRIC = ["tradesWith"]
PHRASES = [("inRegion", "lies in"), ("basedIn", "is based in"), ("placedBy", "was placed by"), ("contains", "contains"), ("suppliedBy", "is supplied by"), ("tradesWith", "trades with")]
SYNONYMS = [("inRegion", "belongs to"), ("basedIn", "operates from"), ("placedBy", "was ordered by"), ("contains", "includes")]
COMMENTS = ["Entity", "Nation", "Customer", "basedIn", "acctbal"]
PRIORITY = [("Customer", 0, "PARTY"), ("Supplier", 1, "PARTY"), ("Place", 2, "PLACE"), ("Part", 3, "ITEM")]
NAMESPACE = "http://example.org/star#"


def values(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A small fixed table of strings and numbers, as literals of the plan."""
    cells = F.array(*[F.struct(*[F.lit(v).cast("string" if v is None else "int" if isinstance(v, int) else "string").alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])
    return spark.range(1).select(F.inline(cells))


def sql_values(name: str, rows: list[tuple], *names: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"{name}({', '.join(names)}) AS (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)})"


class Star:
    """The tables of one folder as ontology tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._made = spark, sf_dir, {}
        self.subclass = values(spark, SUBCLASSES, "child", "parent")
        self.classes = values(spark, [(c,) for c in CLASSES], "name")
        self.signature = values(spark, SIGNATURES, "p", "domain", "range")
        self.data_signature = values(spark, DATA_PROPERTIES, "p", "domain")
        self.inverse = values(spark, INVERSES, "a", "b")
        self.phrases = values(spark, PHRASES, "p", "phrase")
        self.synonyms = values(spark, SYNONYMS, "p", "synonym")
        self.symmetric = values(spark, [(p,) for p in SYMMETRIC], "p")
        self.comments = values(spark, [(c,) for c in COMMENTS], "name")
        self.priority = values(spark, PRIORITY, "cls", "rank", "coarse")

    def once(self, name: str, make) -> DataFrame:
        """A table that several steps of one query use."""
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def individuals(self, *kinds: str) -> DataFrame:
        """(ind, cls, label)"""
        of = {
            "Region": ("region", "r_regionkey", F.col("r_name") if "Region" in kinds or not kinds else None),
            "Nation": ("nation", "n_nationkey", F.col("n_name")), "Customer": ("customer", "c_custkey", F.col("c_name")), "Supplier": ("supplier", "s_suppkey", F.col("s_name")),
            "Part": ("part", "p_partkey", F.concat(F.lit("Part#"), F.col("p_partkey"))), "Order": ("orders", "o_orderkey", F.concat(F.lit("Order#"), F.col("o_orderkey"))),
        }
        parts = [self.table(t).select(F.concat(F.lit(c.lower() + "_"), F.col(k)).alias("ind"), F.lit(c).alias("cls"), label.alias("label")) for c, (t, k, label) in of.items() if not kinds or c in kinds]
        return reduce(DataFrame.unionByName, parts)

    def facts(self, *names: str) -> DataFrame:
        """(p, s, o) of the named properties; all of them without names."""
        key = lambda prefix, c: F.concat(F.lit(prefix + "_"), F.col(c))
        made = {
            "inRegion": lambda: self.table("nation").select(key("nation", "n_nationkey").alias("s"), key("region", "n_regionkey").alias("o")),
            "basedIn": lambda: self.table("customer").select(key("customer", "c_custkey").alias("s"), key("nation", "c_nationkey").alias("o"))
            .union(self.table("supplier").select(key("supplier", "s_suppkey"), key("nation", "s_nationkey"))),
            "placedBy": lambda: self.table("orders").select(key("order", "o_orderkey").alias("s"), key("customer", "o_custkey").alias("o")),
            "contains": lambda: self.table("lineitem").select(key("order", "l_orderkey").alias("s"), key("part", "l_partkey").alias("o")).distinct(),
            "suppliedBy": lambda: self.table("lineitem").select(key("part", "l_partkey").alias("s"), key("supplier", "l_suppkey").alias("o")).distinct(),
            "tradesWith": self.trades,
        }
        return reduce(DataFrame.unionByName, [made[p]().select(F.lit(p).alias("p"), "s", "o") for p in (names or made)])

    def trades(self) -> DataFrame:
        """Nation pairs with more order lines than the mean pair, and the self loops of even nations."""
        lines = (
            self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).agg(F.count("*").alias("n"))
        )
        mean = lines.agg((F.sum("n") / F.count("*")).alias("mean"))
        wanted = (F.col("n") > F.col("mean")) | ((F.col("a") == F.col("b")) & (F.col("a") % 2 == 0))
        return lines.crossJoin(F.broadcast(mean)).filter(wanted).select(F.concat(F.lit("nation_"), "a").alias("s"), F.concat(F.lit("nation_"), "b").alias("o"))

    def attributes(self) -> DataFrame:
        """(p, s, lex, dtype): data property values; dtype is null where none is declared."""
        parts = []
        for t, key, prefix, columns in (
            ("customer", "c_custkey", "customer", {"acctbal": F.col("c_acctbal").cast("decimal(12,2)").cast("string"), "segment": F.col("c_mktsegment"), "flag": F.when(F.col("c_acctbal") < 0, "TRUE").otherwise("false")}),
            ("supplier", "s_suppkey", "supplier", {"acctbal": F.col("s_acctbal").cast("decimal(12,2)").cast("string")}),
            ("part", "p_partkey", "part", {"size": F.col("p_size").cast("string")}),
        ):
            for p, c in columns.items():
                parts.append(self.table(t).select(F.lit(p).alias("p"), F.concat(F.lit(prefix + "_"), F.col(key)).alias("s"), c.alias("lex"), F.lit("xsd:integer" if p == "size" else None).cast("string").alias("dtype")))
        return reduce(DataFrame.unionByName, parts)


#: The same tables in DuckDB SQL.
CTE = {
    "subclass": sql_values("subclass", SUBCLASSES, "child", "parent"),
    "classes": sql_values("classes", [(c,) for c in CLASSES], "name"),
    "sig": sql_values("sig", SIGNATURES, "p", "domain", "rng"),
    "dsig": sql_values("dsig", DATA_PROPERTIES, "p", "domain"),
    "inverse": sql_values("inverse", INVERSES, "a", "b"),
    "phrases": sql_values("phrases", PHRASES, "p", "phrase"),
    "synonyms": sql_values("synonyms", SYNONYMS, "p", "synonym"),
    "comments": sql_values("comments", [(c,) for c in COMMENTS], "name"),
    "prio": sql_values("prio", PRIORITY, "cls", "rank", "coarse"),
    "anc": """anc(cls, anc) AS (WITH RECURSIVE a(cls, anc) AS (SELECT child, parent FROM subclass UNION SELECT a.cls, s.parent FROM a JOIN subclass s ON s.child = a.anc) SELECT * FROM a)""",
    "inds": """inds AS (SELECT 'region_' || r_regionkey AS ind, 'Region' AS cls, r_name AS label FROM region UNION ALL SELECT 'nation_' || n_nationkey, 'Nation', n_name FROM nation
      UNION ALL SELECT 'customer_' || c_custkey, 'Customer', c_name FROM customer UNION ALL SELECT 'supplier_' || s_suppkey, 'Supplier', s_name FROM supplier
      UNION ALL SELECT 'part_' || p_partkey, 'Part', 'Part#' || p_partkey FROM part UNION ALL SELECT 'order_' || o_orderkey, 'Order', 'Order#' || o_orderkey FROM orders)""",
    "types": """types AS (SELECT ind, cls FROM inds UNION SELECT ind, anc.anc FROM inds JOIN anc USING (cls) UNION SELECT name, name FROM classes UNION SELECT cls, anc FROM anc)""",
    "facts": """facts AS (SELECT 'inRegion' AS p, 'nation_' || n_nationkey AS s, 'region_' || n_regionkey AS o FROM nation
      UNION ALL SELECT 'basedIn', 'customer_' || c_custkey, 'nation_' || c_nationkey FROM customer UNION ALL SELECT 'basedIn', 'supplier_' || s_suppkey, 'nation_' || s_nationkey FROM supplier
      UNION ALL SELECT 'placedBy', 'order_' || o_orderkey, 'customer_' || o_custkey FROM orders
      UNION ALL SELECT DISTINCT 'contains', 'order_' || l_orderkey, 'part_' || l_partkey FROM lineitem UNION ALL SELECT DISTINCT 'suppliedBy', 'part_' || l_partkey, 'supplier_' || l_suppkey FROM lineitem
      UNION ALL SELECT 'tradesWith', 'nation_' || a, 'nation_' || b FROM (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey) AS total,
        count(*) OVER () AS pairs FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) WHERE n > total / pairs OR (a = b AND a % 2 = 0))""",
    "attrs": """attrs AS (SELECT 'acctbal' AS p, 'customer_' || c_custkey AS s, c_acctbal::DECIMAL(12,2)::VARCHAR AS lex, NULL::VARCHAR AS dtype FROM customer UNION ALL SELECT 'segment', 'customer_' || c_custkey, c_mktsegment, NULL FROM customer
      UNION ALL SELECT 'flag', 'customer_' || c_custkey, CASE WHEN c_acctbal < 0 THEN 'TRUE' ELSE 'false' END, NULL FROM customer UNION ALL SELECT 'acctbal', 'supplier_' || s_suppkey, s_acctbal::DECIMAL(12,2)::VARCHAR, NULL FROM supplier
      UNION ALL SELECT 'size', 'part_' || p_partkey, p_size::VARCHAR, 'xsd:integer' FROM part)""",
}
NEEDS = {"anc": ["subclass"], "types": ["classes", "anc", "inds"]}


def sql(body: str, *needed: str) -> str:
    """A query with the common tables that it needs in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in needed:
        add(n)
    own = body.strip()
    if not order:
        return own
    head = ", ".join(CTE[n] for n in order)
    return f"WITH RECURSIVE {head}, {own[5:]}" if own.startswith("WITH ") else f"WITH {head} {own}"
