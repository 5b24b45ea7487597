"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from tripleloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One or two of each family; the driver compares them all.
NAMES = ["subclass_closure", "abox_violations", "entity_dictionary", "display_name", "sentence_split", "detect_terms", "merge_mentions", "extract_triples", "bio_decode", "tier_nested", "leakage_audit",
         "hash_split_10000", "kg_gate", "validate_shapes", "entity_profile", "filter_regex", "triple_prf", "label_report", "entity_prf", "load_ontology", "write_splits", "batch_validate", "chain_closure", "rule_verify", "weak_stats", "dataset_stats",
         "verbalize_schema", "sample_documents", "stratified_documents", "chunk_documents", "extract_documents", "compare_files"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rounded(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    wanted = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    rows = sorted((rounded(r) for r in df.select(*[f"`{c}`" for c in wanted.columns]).collect()), key=repr)
    assert rows == sorted(map(rounded, wanted.fetchall()), key=repr)


def test_models_beat_chance(spark):
    assert registry.QUERIES["train_tagger"](spark, DATA).first()["accuracy"] > 0.9
    report = {r["label"]: r["f1"] for r in registry.QUERIES["tagger_report"](spark, DATA).collect()}
    assert report["accuracy"] > 0.95 and {"B-NATION", "I-ORDER", "O"} <= set(report)
    f1 = {r["system"]: r["f1"] for r in registry.QUERIES["train_verifier"](spark, DATA).collect()}
    assert f1["rule"] > 0.5 and f1["model"] > 0.5
    claims = registry.QUERIES["score_claims"](spark, DATA).collect()
    assert claims and all(0 <= r["p_valid"] <= 1 and r["confidence"] >= 0.5 and (r["verdict"] == "VALID") == (r["p_valid"] >= 0.5) for r in claims)
    tags = registry.QUERIES["tag_sentences"](spark, DATA).collect()
    assert {r["label"] for r in tags} <= {"REGION", "NATION", "CUSTOMER", "SUPPLIER", "ORDER"} and len(tags) > 100


def test_model_gate_and_reports(spark):
    """A stored verifier keeps candidates; its report covers all tiers and kinds of negatives."""
    kept = {tuple(r) for r in registry.QUERIES["extract_by_model"](spark, DATA).collect()}
    assert 1000 < len(kept) < 1750
    rows = {(r["metric"], r["key"]): r["value"] for r in registry.QUERIES["verifier_by_tier"](spark, DATA).collect()}
    assert {k for m, k in rows if m == "tier"} == {"explicit", "implicit", "long_distance", "nested"} and {k for m, k in rows if m == "rejected"} == {"type_identical", "partial_overlap", "type_incompatible"}
    assert all(v > 0.9 for (m, _), v in rows.items() if m == "tier")


def test_splits_leak_nothing(spark):
    assert all(r["leaked"] == 0 for r in registry.QUERIES["leakage_audit"](spark, DATA).collect())


def test_partitions_change_nothing(spark):
    names, before = ["sample_documents", "chunk_documents", "per_story"], spark.conf.get("spark.sql.shuffle.partitions")
    one = {n: sorted(map(tuple, registry.QUERIES[n](spark, DATA).collect())) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert one == {n: sorted(map(tuple, registry.QUERIES[n](spark, DATA).collect())) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
