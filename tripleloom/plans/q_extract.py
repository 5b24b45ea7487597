"""Queries that extract relations from whole documents, gated by rules and by stored models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mentions as men
from ..operators import verify
from ..sources import files
from . import q_text
from .binding import Star
from .book import Book
from .q_data import split_forms
from .q_ontology import bitmaps, signature_bits
from .q_text import found_sql

book = Book()
PLACE = ["document_id", "n"]
KINDS = ("Region", "Nation", "Customer", "Supplier", "Order")


def near(star: Star) -> DataFrame:
    """Candidates of the documents by distance alone, whatever their types."""
    return men.relation_candidates(q_text.document_mentions(star), star.signature, PLACE, gated=False, window=10)


@book.add(found_sql("SELECT split_part(sid, '|', 1) AS document_id, split_part(sid, '|', 2)::INTEGER AS n, p, s, o, trigger_start, s_start, s_end, o_start, o_end FROM found"))
def extract_documents(star):
    """Every relation in the documents with its document, sentence and offsets: documents are cut into sentences first."""
    return men.relation_candidates(q_text.document_mentions(star), star.signature, PLACE).drop("text")


@book.add(found_sql("SELECT s, p, o, count(*) AS n_places, min(split_part(sid, '|', 1)) AS first_document FROM found GROUP BY ALL"))
def document_triples(star):
    """Each triple of the documents once, with the number of its places and the first document by name."""
    rows = men.relation_candidates(q_text.document_mentions(star), star.signature, PLACE)
    return rows.groupBy("s", "p", "o").agg(F.count("*").alias("n_places"), F.min("document_id").alias("first_document"))


#: DuckDB: the nearest entities on both sides of a relation within ten tokens, whatever their types.
NEAR = """, ents AS (SELECT sid, st, en, min(CASE WHEN kind = 'individual' THEN short END) AS ind, min(short) AS any_ FROM men GROUP BY sid, st, en HAVING bool_or(kind IN ('individual', 'class'))),
lr AS (SELECT t.sid, t.st AS ts, p, domain, rng, max(l.en) AS le, min(r.st) AS rs FROM trig t JOIN sig USING (p) JOIN ents l ON l.sid = t.sid AND l.en <= t.st JOIN ents r ON r.sid = t.sid AND r.st >= t.en WHERE domain IS NOT NULL AND rng IS NOT NULL GROUP BY ALL),
near_ AS (SELECT lr.sid, p, domain, rng, coalesce(l.ind, l.any_) AS s, coalesce(r.ind, r.any_) AS o FROM lr JOIN ents l ON l.sid = lr.sid AND l.en = le JOIN ents r ON r.sid = lr.sid AND r.st = rs
  WHERE (SELECT count(*) FROM toks k WHERE k.sid = lr.sid AND k.st >= l.st AND k.st < ts) <= 10 AND (SELECT count(*) FROM toks k WHERE k.sid = lr.sid AND k.st >= ts AND k.st < rs) <= 10),
ok AS (SELECT * FROM near_ WHERE EXISTS (SELECT 1 FROM types t WHERE t.ind = s AND t.cls = domain) AND EXISTS (SELECT 1 FROM types t WHERE t.ind = o AND t.cls = rng))"""
KEPT = NEAR + " SELECT split_part(sid, '|', 1) AS document_id, split_part(sid, '|', 2)::INTEGER AS n, p, s, o FROM ok"


@book.add(found_sql(KEPT))
def extract_gated(star):
    """Candidates by distance that the rule lets through: wrong-typed nearer entities go."""
    return verify.gate_by_rule(near(star), signature_bits(star), bitmaps(star, *KINDS)).select(*PLACE, "p", "s", "o")


@book.add(found_sql(KEPT))
def batch_validate(star):
    """The same by a function over Arrow batches, which tests the bits that come with each candidate."""
    rows = verify.with_types(near(star), bitmaps(star, *KINDS)).join(files.if_small(signature_bits(star)), "p")
    rows = rows.select(*PLACE, "p", "s", "o", "subject_types", "object_types", "domain_bit", "range_bit").filter("domain_bit is not null and range_bit is not null")
    return verify.batch_validate(rows, verify.types_fit).select(*PLACE, "p", "s", "o")


def stored_verifier(star: Star) -> str:
    """The path of a verifier, trained and stored in the shared folder."""
    model, _ = verify.train_verifier(split_forms(star), (0.0,))
    return verify.save_model(model, files.shared_folder(star.spark, "verifier"))


@book.add()
def extract_by_model(star):
    """Candidates by distance that a stored verifier, loaded from its folder, calls valid."""
    return verify.gate_by_model(near(star), stored_verifier(star), [*PLACE, "p", "s", "o"])
