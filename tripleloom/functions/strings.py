"""Column functions on names, labels, IRIs and marked texts. All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RDFS = "http://www.w3.org/2000/01/rdf-schema#"


def camel_to_words(c: Column) -> Column:
    """A name as words: what follows a prefix, cut before capitals behind a small letter or digit, underscores as blanks."""
    local = F.regexp_replace(c, "^[^:]*:", "")
    words = F.translate(F.regexp_replace(local, "([a-z0-9])([A-Z])", "$1 $2"), "_", " ")
    return F.when(c == "LiteralValue", "literal value").otherwise(F.lower(F.trim(F.regexp_replace(words, r"\s+", " "))))


def display_name(label: Column, name: Column) -> Column:
    """The label without bracketed parts and surrounding quotes; the name's words where nothing is left."""
    words = camel_to_words(name)
    bare = F.trim(F.regexp_replace(F.coalesce(label, words), r"\s*\([^)]*\)", ""))
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, '^"+|"+$', ""), "^[“”]+|[“”]+$", ""))
    return F.when(F.length(bare) > 0, bare).otherwise(words)


def short_iri(c: Column) -> Column:
    return F.substring_index(F.substring_index(c, "#", -1), "/", -1)


def qualify_iri(c: Column, namespace: str) -> Column:
    return F.when(c == "rdfs:subClassOf", F.lit(RDFS + "subClassOf")).otherwise(F.concat(F.lit(namespace), c))


def mark_entities(text: Column, s_start: Column, s_end: Column, o_start: Column, o_end: Column) -> Column:
    """The text with [E1]…[/E1] and [E2]…[/E2] around two spans that don't overlap (offsets from 0, ends exclusive)."""
    cut = lambda a, b: F.substr(text, a + 1, b - a)

    def both(a, b, one, c, d, two):
        tail = F.substr(text, d + 1, F.length(text))
        return F.concat(cut(F.lit(0), a), F.lit(f"[{one}]"), cut(a, b), F.lit(f"[/{one}]"), cut(b, c), F.lit(f"[{two}]"), cut(c, d), F.lit(f"[/{two}]"), tail)

    return F.when(s_start < o_start, both(s_start, s_end, "E1", o_start, o_end, "E2")).otherwise(both(o_start, o_end, "E2", s_start, s_end, "E1"))


def verifier_text(relation: Column, subject: Column, phrase: Column, obj: Column, articles: bool) -> Column:
    """The sentence that a verifier reads: with articles for classes, without for individuals."""
    parts = ["[REL] ", " [/REL] A [E1]" if articles else " [/REL] [E1]", "[/E1] ", " a [E2]" if articles else " [E2]", "[/E2]."]
    # as format_string would, which takes many times as long: a null reads as the word
    names = [F.coalesce(c.cast("string"), F.lit("null")) for c in (relation, subject, phrase, obj)]
    return F.concat(*[x for a, b in zip(map(F.lit, parts), names) for x in (a, b)], F.lit(parts[-1]))


MARKED = r"(?s)^(.*?)\[E1\](.*?)\[/E1\](.*?)\[E2\](.*?)\[/E2\](.*)$"


def parse_marked(c: Column) -> Column:
    """head, e1, mid, e2, tail of a marked text; empty strings where the marks are missing."""
    return F.struct(*[F.regexp_extract(c, MARKED, i + 1).alias(n) for i, n in enumerate(("head", "e1", "mid", "e2", "tail"))])


def strip_markers(c: Column, whole_head: bool = False) -> Column:
    """The text without marks; with whole_head also without the relation in front."""
    if whole_head:
        c = F.when(c.startswith("[REL]"), F.regexp_replace(c, r"^\[REL\].*?\[/REL\] ?", "")).otherwise(c)
    return F.trim(F.regexp_replace(c, r"\[/?E[12]\]|\[/?REL\]", ""))


#: What a text's parts begin with where it is cut before each bracket and its marks are the usual ones, and no others.
USUAL = ["", "REL]", "/REL]", "E1]", "/E1]", "E2]", "/E2]"]


def bare_texts(rows: DataFrame, text: str, name: str) -> DataFrame:
    """The rows with strip_markers(text, whole_head=True): texts with the usual marks are cut at them, which takes a fraction of the time
    of patterns; all others go by patterns."""
    parts = F.col("_parts")
    part = lambda i: F.get(parts, F.lit(i))
    usual = reduce(lambda a, b: a & b, [F.size(parts) == len(USUAL), F.length(part(0)) == 0, *[part(i).startswith(m) for i, m in enumerate(USUAL) if m], ~part(1).rlike("[\n\r\u0085\u2028\u2029]")])
    behind = lambda i: F.substr(part(i), F.lit(len(USUAL[i]) + 1))
    head = F.when(part(2).startswith("/REL] "), F.substr(part(2), F.lit(7))).otherwise(behind(2))
    bare = F.when(usual, F.trim(F.concat(head, *[behind(i) for i in range(3, len(USUAL))]))).otherwise(strip_markers(F.col(text), whole_head=True))
    return rows.withColumn("_parts", F.split(text, r"\[")).withColumn(name, bare).drop("_parts")


def type_literal(lex: Column, declared: Column) -> Column:
    """(o, o_dtype): the declared type, else by look: boolean, integer or string. Booleans in lower case."""
    look = F.trim(lex)
    kind = F.when(declared.isNotNull(), declared).when(F.lower(look).isin("true", "false"), "xsd:boolean").when(look.rlike(r"^-?[0-9]+$"), "xsd:integer").otherwise("xsd:string")
    return F.struct(F.when(kind == "xsd:boolean", F.lower(look)).otherwise(look).alias("o"), kind.alias("o_dtype"))


def sentence_id(stem: Column, number: Column) -> Column:
    return F.format_string("%s_s%03d", stem, number)


def md5_mod(key: Column, n: int) -> Column:
    """The 128-bit md5 of a text, as a number, mod n (below 2^19); by three parts, as no number type holds it."""
    digest = F.md5(key)
    part = lambda at, size: F.conv(F.substring(digest, at, size), 16, 10).cast("bigint") % n
    return ((part(1, 10) * (2**88 % n) + part(11, 11) * (2**44 % n) + part(22, 11)) % n).cast("int")


def hash_split(key: Column, train: float = 0.70, val: float = 0.15, buckets: int = 100) -> Column:
    """train, val or test by a hash of the key, so that a split never depends on order or partitions."""
    h = md5_mod(key, buckets)
    return F.when(h < round(train * buckets), "train").when(h < round((train + val) * buckets), "val").otherwise("test")


def pick(options: list[str], key: Column) -> Column:
    """One of the options by a hash of the key."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), md5_mod(key, len(options)) + 1)
