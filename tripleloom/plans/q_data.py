"""Queries on dataset generation, splits and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import strings as fs
from ..operators import dataset as ds
from ..operators import ontology as onto
from .binding import Star, sql, sql_values, values
from .book import Book, md5_mod, pick
from .q_ontology import WORDS, bitmaps
from .q_text import NEEDED, SENTS, told

book = Book()
SCHEMA = """st AS (SELECT domain AS s, p, rng AS o FROM sig WHERE domain IS NOT NULL AND rng IS NOT NULL UNION ALL SELECT domain, p, 'LiteralValue' FROM dsig WHERE domain IS NOT NULL UNION ALL SELECT child, 'rdfs:subClassOf', parent FROM subclass),
used AS (SELECT p, count(*) AS n FROM facts GROUP BY p), sp AS (SELECT s, st.p, o, coalesce(phrase, """ + WORDS.format("st.p") + """) AS phrase, coalesce(n, 0) AS n_facts FROM st LEFT JOIN phrases USING (p) LEFT JOIN used USING (p))"""
SCHEMA_NEEDS = ("sig", "dsig", "subclass", "phrases", "facts")


def schema_phrases(star: Star) -> DataFrame:
    """Schema triples with phrases and the number of facts of each property."""
    t = onto.schema_triples(star.signature, star.data_signature, star.subclass).join(star.phrases, "p", "left")
    used = star.facts().groupBy("p").agg(F.count("*").alias("n_facts"))
    return t.join(used, "p", "left").select("s", "p", "o", F.coalesce("phrase", fs.camel_to_words(F.col("p"))).alias("phrase"), F.coalesce("n_facts", F.lit(0)).alias("n_facts"))


def _list(ts: list[str]) -> str:
    return f"[{', '.join(repr(t) for t in ts)}]"


#: Templates of single schema triples.
OWN_TEMPLATES = [
    ("Order", "placedBy", "Customer", "An {s} {phrase} a {o}, who pays for it.", 0), ("Order", "placedBy", "Customer", "The {o} behind an {s} is known.", 1),
    ("Customer", "rdfs:subClassOf", "Party", "Whoever is a {s} is a {o} too.", 0),
]


@book.add(sql(f"""WITH {SCHEMA}, {sql_values("own0", OWN_TEMPLATES, "s", "p", "o", "template", "pos")}, own AS (SELECT s, p, o, list(template ORDER BY pos) AS own FROM own0 GROUP BY ALL),
t AS (SELECT sp.*, coalesce(own, CASE WHEN sp.p = 'rdfs:subClassOf' THEN {_list(ds.SUBCLASS_TEMPLATES)} WHEN sp.o = 'LiteralValue' THEN {_list(ds.DATA_TEMPLATES)} ELSE {_list(ds.OBJECT_TEMPLATES)} END) AS ts FROM sp LEFT JOIN own ON own.s = sp.s AND own.p = sp.p AND own.o = sp.o),
u AS (SELECT s, p, o, phrase, n_facts, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS variant FROM t) SELECT s, p, o, n_facts, variant::INTEGER AS variant, replace(replace(replace(t, '{{s}}', lower(s)), '{{phrase}}', phrase), '{{o}}', lower(o)) AS text FROM u""", *SCHEMA_NEEDS))
def verbalize_schema(star):
    rows = schema_phrases(star)
    own = values(star.spark, OWN_TEMPLATES, "s", "p", "o", "template", "pos")
    return ds.verbalize_schema(rows, own).join(rows.select("s", "p", "o", "n_facts"), ["s", "p", "o"])


def doc_ids(star: Star) -> DataFrame:
    return star.table("documents").select(F.col("doc_id").alias("doc")).distinct()


def sql_numbers(rows: str, columns: str, key: str) -> str:
    """DuckDB: the rows with an ordinal from 0 by hash, their number, and the least prime from it on."""
    return f"""(SELECT *, (SELECT min(x) FROM (SELECT unnest(range(greatest(n, 2), greatest(n, 2) + 300)) AS x) WHERE NOT EXISTS (SELECT 1 FROM range(2, 1100) d(d) WHERE d.d * d.d <= x AND x % d.d = 0)) AS prime
  FROM (SELECT {columns}, row_number() OVER (ORDER BY md5('7|' || {key}), {key}) - 1 AS ordinal, count(*) OVER () AS n FROM {rows}))"""


def sql_drawn(numbers: str, most: str, name: str, columns: str) -> str:
    """DuckDB: the first turns of each document's permutation, met with the items."""
    part = lambda what: md5_mod(f"'{what}|7|{name}|' || doc", ds.STEPS)
    step = f"(({part('step')}::BIGINT * {ds.STEPS} + {part('step2')}) % greatest(prime - 1, 1) + 1)"
    start = f"(({part('start')}::BIGINT * {ds.STEPS} + {part('start2')}) % prime)"
    return f"""(SELECT doc, turn, {columns} FROM (SELECT doc, turn, n, ({step} * turn + {start}) % prime AS at FROM docs, (SELECT DISTINCT n, prime FROM {numbers}) z, LATERAL (SELECT unnest(range(least({most} + prime - n, prime))) AS turn) y) d JOIN {numbers} i ON i.ordinal = d.at)"""


DOCS = "docs AS (SELECT DISTINCT doc_id AS doc FROM documents)"
SIZE = f"{ds.LEAST} + " + md5_mod("'7|' || doc", ds.MORE + 1)


@book.add(sql(f"""WITH {SENTS}, {DOCS}, nums AS MATERIALIZED {sql_numbers("sents", "p, s, o", "s || '|' || p || '|' || o")}, d AS {sql_drawn("nums", str(ds.LEAST + ds.MORE), "", "p, s, o")},
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY turn) AS position FROM d) SELECT doc, s, p, o, position::INTEGER AS position FROM r WHERE position <= {SIZE}""", *NEEDED))
def sample_documents(star):
    """9 to 12 of all told facts for each document."""
    return ds.sample_documents(doc_ids(star), told(star).select("s", "p", "o"), "7", F.concat_ws("|", "s", "p", "o"))


STRATA = {"used": 5, "subclass": 2, "other": 1}


@book.add(sql(f"""WITH {SCHEMA}, {DOCS}, k AS (SELECT s, p, o, CASE WHEN n_facts > 0 THEN 'used' WHEN p = 'rdfs:subClassOf' THEN 'subclass' ELSE 'other' END AS stratum FROM sp),
{", ".join(f"n_{x} AS MATERIALIZED " + sql_numbers(f"(SELECT * FROM k WHERE stratum = '{x}')", "s, p, o, stratum", "s || '|' || p || '|' || o") for x in STRATA)},
n_all AS MATERIALIZED {sql_numbers("k", "s, p, o, stratum", "s || '|' || p || '|' || o")},
own AS ({" UNION ALL ".join(f"SELECT * FROM (SELECT *, {i} AS stage, row_number() OVER (PARTITION BY doc ORDER BY turn) AS r FROM {sql_drawn(f'n_{x}', str(q), x, 's, p, o, stratum')}) WHERE r <= {q}" for i, (x, q) in enumerate(STRATA.items()))}),
rest AS (SELECT doc, turn, s, p, o, stratum, 3 AS stage, 0 AS r FROM {sql_drawn("n_all", str(ds.LEAST + ds.MORE + sum(STRATA.values())), "", "s, p, o, stratum")} a WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.doc = a.doc AND own.s = a.s AND own.p = a.p AND own.o = a.o)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY stage, turn) AS position FROM (SELECT * FROM own UNION ALL SELECT * FROM rest)) SELECT doc, s, p, o, stratum, position::INTEGER AS position FROM r WHERE position <= {SIZE}""", *SCHEMA_NEEDS))
def stratified_documents(star):
    stratum = F.when(F.col("n_facts") > 0, "used").when(F.col("p") == "rdfs:subClassOf", "subclass").otherwise("other")
    rows = schema_phrases(star).select("s", "p", "o", stratum.alias("stratum"))
    return ds.stratified_documents(doc_ids(star), rows, STRATA, "7", F.concat_ws("|", "s", "p", "o"), "stratum")


@book.add(sql("""WITH once AS (SELECT p, min([s, o]) AS k FROM facts WHERE p = 'tradesWith' GROUP BY p, least(s, o), greatest(s, o)), f AS (SELECT p, s, o FROM facts WHERE p <> 'tradesWith' UNION ALL SELECT p, k[1], k[2] FROM once),
t AS (SELECT p, s, o, x.label || ' ' || phrase || ' ' || y.label || '.' AS text FROM f JOIN inds x ON x.ind = s JOIN inds y ON y.ind = o JOIN phrases USING (p))
SELECT p, s, o, 0 AS variant, text FROM t UNION ALL SELECT p, s, o, 1, 'As is known, ' || text FROM t""", "facts", "inds", "phrases"))
def verbalize_facts(star):
    return ds.verbalize_facts(star.facts(), star.individuals(), star.phrases, star.symmetric, ds.FACT_TEMPLATES)


def sql_chunks(rows: str) -> str:
    """DuckDB: chunks of a relation (p, s, o, text) as `chunks` (doc, position, …)."""
    size = f"{ds.FEWEST} + " + md5_mod("'7|' || doc", ds.MOST_SENTENCES - ds.FEWEST + 1)
    return f"""numbered AS (SELECT *, row_number() OVER (ORDER BY md5(text), p, s, o) - 1 AS n FROM {rows}), cuts0 AS (SELECT doc, {size} AS size FROM range((SELECT ceil(count(*) / {ds.FEWEST})::BIGINT FROM {rows})) r(doc)),
cuts AS (SELECT doc, sum(size) OVER (ORDER BY doc) - size AS first, size FROM cuts0), chunks AS (SELECT p, s, o, text, doc, (n - first + 1)::INTEGER AS position FROM numbered ASOF JOIN cuts ON numbered.n >= cuts.first)"""


@book.add(sql(f"WITH {SENTS}, {sql_chunks('sents')} SELECT * FROM chunks", *NEEDED))
def chunk_documents(star):
    return ds.chunk_documents(told(star).select("p", "s", "o", "text"))


SPLIT_DOC = f"CASE WHEN {md5_mod('document_id', 100)} < 70 THEN 'train' WHEN {md5_mod('document_id', 100)} < 85 THEN 'val' ELSE 'test' END"


@book.add(sql(f"WITH {SENTS}, {sql_chunks('sents')}, d AS (SELECT *, 'doc_' || lpad((doc + 1)::VARCHAR, 7, '0') AS document_id FROM chunks) SELECT document_id, {SPLIT_DOC} AS split, string_agg(text, chr(10) ORDER BY position) AS text, count(*) AS n_sentences FROM d GROUP BY document_id", *NEEDED))
def document_texts(star):
    """Whole documents of 8 to 12 sentences."""
    return ds.document_records(chunk_documents(star))[0]


@book.add(sql(f"WITH {SENTS}, {sql_chunks('sents')}, d AS (SELECT *, 'doc_' || lpad((doc + 1)::VARCHAR, 7, '0') AS document_id FROM chunks) SELECT document_id, document_id || '_s' || lpad(position::VARCHAR, 3, '0') AS sentence_id, {SPLIT_DOC} AS split, text, s, p, o FROM d", *NEEDED))
def gold_records(star):
    """What each sentence of the documents states."""
    return ds.document_records(chunk_documents(star))[1]


# examples with negatives, tiers and splits

PAIRS = """pairs0 AS (SELECT a.p, b.p AS q, CASE WHEN a.domain IS NOT DISTINCT FROM b.domain AND a.rng IS NOT DISTINCT FROM b.rng THEN CASE WHEN a.domain IS NOT NULL AND a.rng IS NOT NULL THEN 'type_identical' END
  WHEN a.domain IS NOT DISTINCT FROM b.domain OR a.rng IS NOT DISTINCT FROM b.rng THEN 'partial_overlap' ELSE 'type_incompatible' END AS neg_type FROM sig a JOIN sig b ON a.p <> b.p),
opts AS (SELECT p, neg_type, list(q ORDER BY q) AS options FROM pairs0 WHERE neg_type IS NOT NULL GROUP BY p, neg_type)"""
NEGS = f"{SENTS}, {PAIRS}, base AS (SELECT s || '|' || p || '|' || o AS key, * FROM sents), negs AS (SELECT base.*, neg_type, options[{md5_mod("key || '|' || neg_type", 1000)} % len(options) + 1] AS q FROM base JOIN opts USING (p))"
TEXT = "'[REL] ' || {0} || ' [/REL] [E1]' || sl || '[/E1] ' || phrase || ' [E2]' || ol || '[/E2].'"
EX = f"""{NEGS}, ex AS (SELECT key, s, o, sl, ol, phrase, {TEXT.format('p')} AS text, 'VALID' AS label, p AS candidate_relation, p AS sentence_relation, NULL::VARCHAR AS neg_type FROM base
  UNION ALL SELECT key, s, o, sl, ol, phrase, {TEXT.format('q')}, 'INVALID', q, p, neg_type FROM negs)"""
HEAD = "'[REL] ' || candidate_relation || ' [/REL] '"
ALL = f"""{EX}, tiers AS (SELECT key, s, o, text, label, candidate_relation, sentence_relation, neg_type, 'explicit' AS complexity_tier FROM ex
  UNION ALL SELECT key, s, o, {HEAD} || '[E1]' || sl || '[/E1] ' || synonym || ' [E2]' || ol || '[/E2].', label, candidate_relation, sentence_relation, neg_type, 'implicit' FROM ex JOIN synonyms ON synonyms.p = sentence_relation
  UNION ALL SELECT key, s, o, {HEAD} || '[E1]' || sl || '[/E1]' || {pick(ds.DISTRACTORS, 'text')} || ' ' || phrase || ' [E2]' || ol || '[/E2].', label, candidate_relation, sentence_relation, neg_type, 'long_distance' FROM ex
  UNION ALL SELECT key, s, o, {HEAD} || {pick(ds.SUBORDINATES, 'text')} || '[E1]' || sl || '[/E1] ' || phrase || ' [E2]' || ol || '[/E2].', label, candidate_relation, sentence_relation, neg_type, 'nested' FROM ex),
split_ AS (SELECT *, CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, {md5_mod('key', 100)} AS h FROM tiers))"""
EX_NEEDS = (*NEEDED, "sig", "synonyms")


def keyed(star: Star, types: bool = False) -> DataFrame:
    """(key, p, s, o, subject, object): told facts with their labels; types: and their types as bits, by the same two joins."""
    kinds = ("Region", "Nation", "Customer", "Supplier", "Order")
    names = bitmaps(star, *kinds) if types else star.individuals(*kinds)
    more = lambda n: [F.col("types").alias(n)] if types else []
    rows = star.facts("inRegion", "basedIn", "placedBy").join(names.select(F.col("ind").alias("s"), F.col("label").alias("subject"), *more("subject_types")), "s").join(names.select(F.col("ind").alias("o"), F.col("label").alias("object"), *more("object_types")), "o")
    return rows.withColumn("key", F.concat_ws("|", "s", "p", "o"))


def examples(star: Star, types: bool = False, split: bool = False) -> DataFrame:
    """split: with the split of each fact, hashed once for all of its examples."""
    facts = ds.with_split(keyed(star, types)) if split else keyed(star, types)
    return ds.verifier_examples(facts, star.phrases, star.signature, ("s", "o", *(("subject_types", "object_types") if types else ()), *(("split",) if split else ())))


def split_examples(star: Star, types: bool = False) -> DataFrame:
    return ds.augment_tiers(examples(star, types, split=True), star.synonyms)


def split_forms(star: Star) -> DataFrame:
    """(text, label, split, complexity_tier, n): the split examples that are alike but for numbers, counted."""
    return ds.augmented_forms(examples(star, split=True), star.synonyms)


@book.add(sql(f"WITH {NEGS} SELECT key, neg_type, q FROM negs", *EX_NEEDS))
def hard_negatives(star):
    return ds.hard_negatives(star.signature, keyed(star)).select("key", "neg_type", "q")


COLUMNS = ["key", "text", "label", "candidate_relation", "sentence_relation", "neg_type"]


@book.add(sql(f"""WITH {EX}, led AS (SELECT ex.*, unnest({_list(ds.LEADS)}) AS lead FROM ex WHERE label = 'VALID' UNION ALL SELECT *, {pick(ds.LEADS, "key || '|' || neg_type")} FROM ex WHERE label = 'INVALID')
SELECT {', '.join(COLUMNS).replace('text', "regexp_replace(text, '^(.REL. .*? ./REL. )', chr(92) || '1' || lead) AS text")} FROM led""", *EX_NEEDS))
def verifier_examples(star):
    """With all leads."""
    return ds.verifier_examples(keyed(star), star.phrases, star.signature, leads=ds.LEADS).select(*COLUMNS)


@book.add(sql(f"WITH {ALL} SELECT {', '.join(COLUMNS)} FROM tiers WHERE complexity_tier = 'implicit'", *EX_NEEDS))
def tier_implicit(star):
    return ds.tier_implicit(examples(star), star.synonyms).select(*COLUMNS)


@book.add(sql(f"WITH {ALL} SELECT {', '.join(COLUMNS)} FROM tiers WHERE complexity_tier = 'long_distance'", *EX_NEEDS))
def tier_long_distance(star):
    return ds.tier_long_distance(examples(star)).select(*COLUMNS)


@book.add(sql(f"WITH {ALL} SELECT {', '.join(COLUMNS)} FROM tiers WHERE complexity_tier = 'nested'", *EX_NEEDS))
def tier_nested(star):
    return ds.tier_nested(examples(star)).select(*COLUMNS)


@book.add(sql(f"WITH {ALL} SELECT {', '.join(COLUMNS)}, complexity_tier FROM tiers", *EX_NEEDS))
def augment_tiers(star):
    return ds.augment_tiers(examples(star), star.synonyms).select(*COLUMNS, "complexity_tier")


SPLIT100 = f"CASE WHEN {md5_mod('text', 100)} < 70 THEN 'train' WHEN {md5_mod('text', 100)} < 85 THEN 'val' ELSE 'test' END"


@book.add(f"SELECT doc_id, {SPLIT100} AS split FROM documents")
def hash_split_100(star):
    return star.table("documents").select("doc_id", fs.hash_split(F.col("text")).alias("split"))


@book.add(f"SELECT doc_id, CASE WHEN h < 8000 THEN 'train' WHEN h < 9025 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, {md5_mod('text', 10000)} AS h FROM documents)")
def hash_split_10000(star):
    return star.table("documents").select("doc_id", fs.hash_split(F.col("text"), 0.80, 0.1025, 10000).alias("split"))


@book.add("SELECT doc_id, CASE WHEN doc_id < floor(n * 0.8) THEN 'train' WHEN doc_id < floor(n * 0.9) THEN 'val' ELSE 'test' END AS split FROM documents, (SELECT count(*) AS n FROM documents)")
def index_split(star):
    docs = star.table("documents")
    n = docs.agg(F.count("*").alias("n"))
    return docs.crossJoin(F.broadcast(n)).select("doc_id", ds.index_split(F.col("doc_id"), F.col("n")).alias("split"))


@book.add(sql(f"WITH {ALL}, by_row AS (SELECT text, CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'val' ELSE 'test' END AS split, 'fact' AS on_ FROM (SELECT text, {md5_mod('key', 100)} AS h FROM tiers)) SELECT split, count(*) FILTER (WHERE text IN (SELECT text FROM by_row WHERE split = 'train')) AS leaked FROM by_row WHERE split <> 'train' GROUP BY split", *EX_NEEDS))
def leakage_audit(star):
    return ds.leakage(split_examples(star))


@book.add(f"WITH r AS (SELECT text, CASE WHEN {md5_mod('doc_id::VARCHAR', 100)} < 70 THEN 'train' WHEN {md5_mod('doc_id::VARCHAR', 100)} < 85 THEN 'val' ELSE 'test' END AS split FROM documents) SELECT split, count(*) FILTER (WHERE text IN (SELECT text FROM r WHERE split = 'train')) AS leaked FROM r WHERE split <> 'train' GROUP BY split")
def leakage_documents(star):
    """Exact copies that a split by id tears apart."""
    return ds.leakage(star.table("documents").select("text", fs.hash_split(F.col("doc_id").cast("string")).alias("split")))


@book.add(sql(f"""WITH {ALL} SELECT split, count(*) AS total, count(*) FILTER (WHERE label = 'VALID') AS n_pos, count(*) FILTER (WHERE label = 'INVALID') AS n_neg, count(*) FILTER (WHERE neg_type = 'type_identical') AS n_identical,
count(*) FILTER (WHERE neg_type = 'partial_overlap') AS n_partial, count(*) FILTER (WHERE neg_type = 'type_incompatible') AS n_incompatible FROM split_ GROUP BY split""", *EX_NEEDS))
def split_table(star):
    return ds.split_table(split_examples(star))


@book.add(sql(f"WITH {ALL} SELECT split, candidate_relation AS relation, count(*) AS n_pos FROM split_ WHERE label = 'VALID' GROUP BY ALL", *EX_NEEDS))
def positives_by_relation(star):
    return ds.positives_by_relation(split_examples(star))


@book.add(sql(f"WITH {ALL} SELECT split, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS percent FROM split_ GROUP BY split", *EX_NEEDS))
def split_percent(star):
    return ds.split_percent(split_examples(star))


@book.add(sql(f"WITH {ALL} SELECT complexity_tier, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test FROM split_ GROUP BY 1", *EX_NEEDS))
def tier_by_split(star):
    return ds.tier_by_split(split_examples(star))


@book.add(sql(f"""WITH {ALL} SELECT 'label' AS metric, label AS key, count(*) AS value FROM split_ GROUP BY label UNION ALL SELECT 'neg_type', neg_type, count(*) FROM split_ WHERE neg_type IS NOT NULL GROUP BY neg_type
UNION ALL SELECT 'split', split, count(*) FROM split_ GROUP BY split UNION ALL SELECT 'distinct_texts', split, count(DISTINCT text) FROM split_ GROUP BY split
UNION ALL SELECT 'sentences', split, count(DISTINCT trim(regexp_replace(regexp_replace(text, '^.REL..*?./REL. ?', ''), '.(/?E[12]|/?REL)\\]', '', 'g'))) FROM split_ GROUP BY split""", *EX_NEEDS))
def dataset_stats(star):
    return ds.dataset_stats(split_examples(star))


@book.add(r"SELECT greatest(64.0, least(192.0, quantile_cont(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')), 0.99)))::DOUBLE AS budget FROM documents")
def length_budget(star):
    return ds.length_budget(star.table("documents"), "text")
