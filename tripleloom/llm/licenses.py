"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block is a window of consecutive words, across line ends, half as long again as the template. It matches if it holds at
least `threshold` of the template's distinct words. Words are ordered by how often they stand in all documents, rarest first.
Then a matching block holds one of the template's first size - required + 1 words (prefix filter), so only blocks around such a
word are looked at; the words around it hold at least `required` template words (length filter) and enough behind it in the
order (positional filter); what is left is counted exactly, window by window. The templates are a small fixed set, so
each row is held against them where it is: nothing is shuffled, and equal texts need not meet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Label -> words of a notice.
TEMPLATES = {
    "apache": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "reserved": "all rights reserved",
}
#: Label -> phrase whose words stand consecutively.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
#: Words of a block for each word of the template.
SLACK = 1.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(parts: list[str]) -> str:
    """A pattern for any of these word sequences as whole words."""
    return f"(?<!{WORD})(?:{'|'.join(p.replace(' ', GAP) for p in parts)})(?!{WORD})"


def words_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD}+)"), F.lit(1))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD}+"))


def lowered(docs: DataFrame) -> DataFrame:
    """doc_id, text with A-Z in lower case."""
    return docs.select("doc_id", F.translate(text_or_empty(), UPPER, LOWER).alias("low"))


def width_of(template: str) -> int:
    """Words of a template's blocks."""
    return math.ceil(SLACK * len(template.split()))


def word_order(docs: DataFrame, templates: dict[str, str]) -> list[str]:
    """The templates' words by their frequency in all documents, rarest first (a fixed, small set)."""
    vocabulary = sorted({w for t in templates.values() for w in t.split()})
    values = F.array(*[F.lit(w) for w in vocabulary])
    known = docs.sparkSession.range(1).select(F.explode(values).alias("word"))
    words = lowered(docs).select(F.explode(words_in(F.col("low"))).alias("word"))
    counted = words.join(F.broadcast(known), "word").groupBy("word").agg(F.count("*").alias("n"))
    counts = {r["word"]: r["n"] for r in counted.collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def matching_blocks(low: Column, order: list[str], templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """array<struct<label, share>>: the templates that some block of the text contains, with shares of the template's words
    found in a block (a label may stand there several times). Null for texts without a word of any prefix."""
    rank = {w: i + 1 for i, w in enumerate(order)}
    sets = {label: sorted(rank[w] for w in set(t.split())) for label, t in templates.items()}
    need = {label: math.ceil(threshold * len(s) - 1e-9) for label, s in sets.items()}
    entry = "array<struct<rank:int,label:string,template:array<int>,required:int,at:int,width:int>>"
    index = F.array(*[
        F.struct(F.lit(s[i]), F.lit(label), F.array(*map(F.lit, s)), F.lit(need[label]), F.lit(i), F.lit(width_of(templates[label])))
        for label, s in sets.items() for i in range(len(s) - need[label] + 1)
    ]).cast(entry)
    first = sorted({s[i] for label, s in sets.items() for i in range(len(s) - need[label] + 1)})
    known = F.array(*[F.lit(w) for w in order])
    ranks = F.transform(words_in(low), lambda w: F.array_position(known, w).cast("int"))

    def around(ranks):
        anchors = F.filter(F.transform(ranks, lambda r, i: F.struct(r.alias("rank"), i.alias("i"))), lambda a: a["rank"].isin(first))
        blocks = F.flatten(F.transform(anchors, lambda a: F.transform(
            F.filter(index, lambda e: e["rank"] == a["rank"]),  # prefix
            lambda e: F.struct(e.alias("e"), F.slice(ranks, F.greatest(a["i"] - e["width"] + 2, F.lit(1)), 2 * e["width"] - 1).alias("block")),
        )))
        blocks = F.filter(blocks, lambda b: F.size(F.array_intersect(b["block"], b["e"]["template"])) >= b["e"]["required"])  # length
        behind = lambda b: F.size(F.filter(F.array_intersect(b["block"], b["e"]["template"]), lambda r: r > b["e"]["rank"]))
        blocks = F.filter(blocks, lambda b: 1 + F.least(F.size(b["e"]["template"]) - b["e"]["at"] - 1, behind(b)) >= b["e"]["required"])  # position
        windows = lambda b: F.transform(F.sequence(F.lit(1), F.size(b["block"])), lambda k: F.size(F.array_intersect(F.slice(b["block"], k, b["e"]["width"]), b["e"]["template"])))
        counted = F.transform(blocks, lambda b: F.struct(b["e"]["label"].alias("label"), F.array_max(windows(b)).alias("both"), b["e"]["required"].alias("required"), F.size(b["e"]["template"]).alias("size")))
        enough = F.filter(counted, lambda c: c["both"] >= c["required"])
        return F.transform(enough, lambda c: F.struct(c["label"].alias("label"), (c["both"] / c["size"]).alias("share")))

    # the words are worked out once for each text, as the one element of an array
    found = F.element_at(F.transform(F.array(ranks), around), 1)
    return F.when(low.rlike(whole([order[r - 1] for r in first])), found)


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row's whole text.

    Null text counts as empty; repeated rows and null ids stay; other columns are not read. score is the largest share of
    a template found in one block (at least the threshold), 1 where a phrase stands, else 0."""
    phrase = whole(list(PHRASES.values()))
    low, has = F.col("low"), F.col("low").rlike(phrase)
    rows = lowered(docs).select(
        "doc_id", count_words(low).cast("bigint").alias("n_words"),
        F.when(has, F.regexp_extract_all("low", F.lit(f"({phrase})"), F.lit(1))).alias("hits"),
        F.when(has, F.split("low", phrase)).alias("parts"),
        F.when(has, F.array(*[F.when(low.rlike(whole([p])), F.lit(label)) for label, p in sorted(PHRASES.items())])).alias("own"),
        matching_blocks(low, word_order(docs, templates), templates, threshold).alias("found"),
    ).select(
        "doc_id", "n_words",
        F.coalesce(F.size("hits"), F.lit(0)).alias("n"),
        count_words(F.element_at("parts", 1)).cast("bigint").alias("first_word"),
        (F.col("n_words") - count_words(F.element_at("parts", -1)) - count_words(F.element_at("hits", -1))).cast("bigint").alias("last_word"),
        "own", F.col("found.label").alias("more"), F.array_max("found.share").alias("best"),
    )
    none = F.array().cast("array<string>")
    own = F.coalesce(F.filter("own", lambda x: x.isNotNull()), none)
    return rows.select(
        "doc_id", "n_words", F.greatest("n", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB SQL: every window against every template, without filters."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    rows = ", ".join(f"('{label}', '{w}')" for label, t in templates.items() for w in sorted(set(t.split())))
    sizes = ", ".join(f"('{label}', {len(set(t.split()))}, {width_of(t)})" for label, t in templates.items())
    phrases = ", ".join(f"('{label}', '{p.split()[0]}', '{p.split()[1]}', {repr(p.split()[2]) if len(p.split()) > 2 else 'NULL'})" for label, p in PHRASES.items())
    return rf"""
WITH t(label, word) AS (VALUES {rows}),
size(label, n, width) AS (VALUES {sizes}),
p(label, w1, w2, w3) AS (VALUES {phrases}),
d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
w AS (SELECT r, regexp_extract_all(low, '{word}') AS ws FROM d),
seq AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
n AS (SELECT r, i, word, lead(word, 1) OVER x AS w2, lead(word, 2) OVER x AS w3 FROM seq WINDOW x AS (PARTITION BY r ORDER BY i)),
base AS (SELECT n.r, p.label, n.i FROM n JOIN p ON n.word = p.w1 AND n.w2 = p.w2 AND (p.w3 IS NULL OR n.w3 = p.w3)),
hit AS (SELECT r, label, n, count(DISTINCT word) OVER (PARTITION BY r, label ORDER BY i RANGE BETWEEN CURRENT ROW AND width - 1 FOLLOWING) AS shared
  FROM seq JOIN t USING (word) JOIN size USING (label)),
found AS (SELECT r, label, max(shared / n) AS share FROM hit WHERE shared >= ceil({threshold} * n - 1e-9) GROUP BY r, label),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
lab AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION SELECT r, label FROM found) GROUP BY r),
s AS (SELECT r, max(share) AS share FROM found GROUP BY r)
SELECT d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(b.n_base, 0) AS BIGINT) AS n_base, CAST(b.first_word AS BIGINT) AS first_word,
  CAST(b.last_word AS BIGINT) AS last_word, coalesce(b.base_labels, '') AS base_labels, coalesce(lab.labels, '') AS labels,
  CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(s.share, 0)::DOUBLE END AS score
FROM d JOIN w USING (r) LEFT JOIN b USING (r) LEFT JOIN lab USING (r) LEFT JOIN s USING (r)
"""
