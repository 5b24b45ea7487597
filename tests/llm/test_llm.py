"""The training-data operators against the public libraries, brute force and edge cases."""

import hashlib
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tripleloom.llm import bpe, chat, decontam, licenses, pii, quality, queries, simhash, tokenfile, tokens, toxicity

DATA = "/root/testdata/sf0.001"
ODD = [
    (7, "a<|endoftext|>b  C\x1cD  \n\n x\t\ty 'S it's don'T 12 ab12 ½²   x \x85 y"), (8, ""), (None, None), (9, " lead\n"), (9, " lead\n"), (10, "\n\nx \n y"),
    (11, "日本語 テスト👍🏽 ​zero İstanbul ΣΑΣ ﬁ x̣́"), (12, "word " * 30_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x") for r in ODD], "doc_id long, text string, row_id string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_token_counts(odd, docs):
    t = library("byte_bpe_50k.json")
    for df in (odd, docs):
        got = sorted(map(tuple, tokens.token_counts(df, public_tokenizers.path("byte_bpe_50k.json")).collect()), key=repr)
        want = [(d, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in df.select("doc_id", "text").collect()]
        assert got == sorted(want, key=repr)
    assert tokens.token_counts(odd.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_bpe(odd):
    t, path = library("word_bpe_49k.json"), public_tokenizers.path("word_bpe_49k.json")
    want = []
    for d, x in ODD:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert bpe.encoder(path).encode(x or "").tolist() == ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(odd, path).collect()), key=repr) == sorted(want, key=repr)
    back = bpe.decode_table(bpe.encode_table(odd, path, ["doc_id"]), path, ["doc_id"]).collect()
    assert len(back) == len(ODD)
    assert bpe.round_trip(odd.limit(0), path).count() == 0
    with pytest.raises(ValueError, match="decoder"):
        bpe.MergeEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_of_a_whole_table(spark):
    t, path = library("word_bpe_49k.json"), public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = []
    for d, x in docs.select("doc_id", "text").collect():
        ids = t.encode(x or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(docs, path).collect()), key=repr) == sorted(want, key=repr)


def test_token_files(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = tokenfile.write_token_files(odd, path, 2, files=3)
    t, start, want = library("word_bpe_49k.json"), 0, []
    for d, x in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokenfile.read_token_files(manifest).collect()), key=repr) == sorted(want, key=repr)
    found = {}
    for row in manifest.filter("n_docs > 0").collect():
        system, place = tokenfile.file_system(row["path"])
        with system.open_input_file(place) as source:
            found |= {d: len(ids) for d, ids in tokenfile.TokenFile(source).documents({7, 12})}
    assert set(found) == {7, 12}
    assert tokenfile.read_token_files(tokenfile.write_token_files(odd.limit(0), path, 2, files=3)).count() == 0


def test_token_files_of_another_tokenizer(spark, odd):
    path, t = public_tokenizers.path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    want = [(d, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for d, x in ODD]
    got = tokenfile.read_token_files(tokenfile.write_token_files(odd, path, 2, files=2)).select("doc_id", "n_tokens")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_plain_words_as_the_library_gives_them():
    path, t = public_tokenizers.path("word_bpe_49k.json"), library("word_bpe_49k.json")
    coder = tokenfile.WordBytes(path)
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("aeiostrnÉàçñßøÿÀþDS'.,!-"), rng.integers(1, 14))) for _ in range(3000)]
    for w in [*words, " ".join(words), "Éclair naïve, garçon! don't"]:
        assert coder(w, b"") == np.array(t.encode(w, add_special_tokens=False).ids, "<u4").tobytes(), w


def test_damage_is_seen(tmp_path):
    import pyarrow as pa

    f = tmp_path / "x.zst"
    with pa.OSFile(str(f), "wb") as sink:
        tokenfile.write_file(sink, [(1, np.arange(50, dtype="<u4").tobytes())])
    data = bytearray(f.read_bytes())
    at = len(data) - 9 - 12 + 8
    data[at] ^= 1  # the frame's checksum
    f.write_bytes(data)
    with pa.OSFile(str(f)) as source, pytest.raises(ValueError):
        list(tokenfile.TokenFile(source).documents())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = c.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, DATA).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_licenses(spark):
    rows = [(1, "x\nLicensed under the Apache License, Version 2.0.\ny"), (2, None), (3, "CC-BY cc\nby; all  rights reserved general public licenses"), (3, "cc by")]
    got = {(r["doc_id"], r["n_base"], r["labels"], r["first_word"], r["last_word"]) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0, "apache", None, None), (2, 0, "", None, None), (3, 3, "cc-by,reserved", 0, 4), (3, 1, "cc-by", 0, 0)}


def test_licenses_of_wrapped_and_long_texts(spark):
    bsd = "# Redistribution and use in source and\n# binary forms, with or without\n# modification, are\n# permitted"
    apart = " filler filler filler filler filler ".join(bsd.split())
    long = "of the and " * 50_000 + "This Source Code Form is subject to the terms of the\n * Mozilla Public License, v. 2.0 " + "or with " * 1000
    rows = [(1, bsd), (2, apart), (3, long), (4, ""), (None, bsd), (1, bsd)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, low string")
    got = sorted(((r["doc_id"], r["labels"], r["score"]) for r in licenses.license_scan(df).collect()), key=repr)
    assert got == sorted([(1, "bsd", 1.0), (2, "", 0.0), (3, "mpl", 1.0), (4, "", 0.0), (None, "bsd", 1.0), (1, "bsd", 1.0)], key=repr)
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_license_windows_by_brute_force(spark):
    """Random texts of template words and others against a count over all windows."""
    rng = np.random.default_rng(11)
    vocabulary = sorted({w for t in licenses.TEMPLATES.values() for w in t.split()} | {"zebra", "yes"})
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 80)))) for i in range(150)]
    for i, t in enumerate(sorted(licenses.TEMPLATES.values()) * 6):
        words = t.split()
        for _ in range(i % 4):
            words.insert(int(rng.integers(0, len(words))), "zebra")
        rows.append((1000 + i, " ".join(w for w in words if rng.random() > 0.06)))
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = 0
    for d, text in rows:
        words, labels, best = text.split(), set(), 0.0
        for label, t in licenses.TEMPLATES.items():
            width = licenses.width_of(t)
            share = max((len(set(words[i : i + width]) & set(t.split())) for i in range(len(words))), default=0) / len(set(t.split()))
            if share >= licenses.THRESHOLD - 1e-9:
                labels.add(label)
                best = max(best, share)
        found += bool(labels)
        assert set(filter(None, got[d]["labels"].split(","))) - set(filter(None, got[d]["base_labels"].split(","))) <= labels <= set(filter(None, got[d]["labels"].split(",")))
        assert got[d]["score"] == (1.0 if got[d]["n_base"] else pytest.approx(best))
    assert found > 30


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, 2, "b", "look", '{"turn": 1, "query": "é"}', ["a", "gone"]), (1, 1, "a", "ask", '{"limit": 99, "query": "q"}', []), (1, 3, "c", "none", "[]", ["d"]), (1, 4, "d", "ask", "{", ["c"]), (None, 1, "z", "ask", "{}", [])],
        "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, "a", 5, "late"), (1, "a", 4, "first")], "conv_id long, call_id string, turn long, content string")
    rows = {r["call_id"]: r for r in chat.link_calls(calls, results, chat.SCHEMAS).collect()}
    assert {k: (r["level"], r["linked"], r["problem"]) for k, r in rows.items()} == {
        "a": (0, True, "limit: out of range"), "b": (1, False, ""), "c": (None, False, "arguments: not object"), "d": (None, False, "arguments: not JSON"),
    }
    assert rows["b"]["record"] == '{"arguments":{"query":"é","turn":1},"id":"b","name":"look","result":null,"turn":2}'
    assert '"result":"first"' in rows["a"]["record"]
    assert [r["call_id"] for r in chat.link_calls(calls, results, chat.SCHEMAS).collect()] == ["a", "b", "c", "d"]
    assert chat.link_calls(calls.limit(0), results, chat.SCHEMAS).count() == 0


def test_tool_calls_that_json_cannot_hold(spark):
    deep = '{"query": ' + "[" * 100_000 + "]" * 100_000 + "}"
    rows = [(1, 1, "a", "ask", '{"query": "\\ud800", "limit": 1}', None), (1, 2, "b", "ask", deep, []), (1, 3, "c", "ask", None, []), (1, 4, "d", None, '{"limit": NaN}', []), (1, None, "e", "ask", '{"limit": 1, "query": "x"}', [None])]
    calls = spark.createDataFrame([(*r, "n") for r in rows], "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>, level string")
    got = {r["call_id"]: r["problem"] for r in chat.link_calls(calls, spark.createDataFrame([], "conv_id long, call_id string, turn long, content string"), chat.SCHEMAS).collect()}
    assert got == {"a": "arguments: not JSON", "b": "arguments: nested too deeply", "c": "arguments: not JSON", "d": "arguments: not JSON", "e": ""}


def test_tool_calls_at_the_limit_of_nesting(spark):
    rows = [(1, n, f"c{n}", "ask", '{"query": ' + "[" * n + "]" * n + "}", []) for n in range(9_970, 10_006)]
    calls = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    got = {r["turn"]: r["problem"] for r in chat.link_calls(calls, spark.createDataFrame([], "conv_id long, call_id string, turn long, content string"), chat.SCHEMAS).collect()}
    assert len(got) == 36 and set(got.values()) <= {"limit: missing", "arguments: nested too deeply"}


def test_schemas_without_type_and_with_several(spark):
    loose = {"f": {"properties": {"a": {"minimum": 1, "maximum": 5}, "b": {"minLength": 2}, "c": {"type": ["string", "null"]}, "d": {"type": "null"}, "e": {"type": "what"}}}}
    cases = {'{"a": "x", "b": 7, "c": null, "d": null}': "", '{"a": 9}': "a: out of range", '{"b": "x"}': "b: too short", '{"c": 1}': "c: not string or null", '{"d": 0}': "d: not null", '{"e": 1}': "e: not what", '{"a": true, "b": [1]}': ""}
    calls = spark.createDataFrame([(1, i, f"c{i}", "f", a, None) for i, a in enumerate(cases)], "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    rows = chat.link_calls(calls, spark.createDataFrame([], "conv_id long, call_id string, turn long, content string"), loose).orderBy("turn").collect()
    assert [r["problem"] for r in rows] == list(cases.values())


@pytest.mark.parametrize("kind", [toxicity.Index, toxicity.WideIndex])
def test_toxicity_index_is_exact(kind):
    rng = np.random.default_rng(0)
    rows = [tuple(sorted((int(t), int(rng.integers(1, 4))) for t in rng.choice(30, rng.integers(1, 6), replace=False))) for _ in range(700)]
    ix = kind({bytes([i]): i for i in range(30)}, np.ones(30) + rng.random(30), np.ones(700), list(range(700)), 0.1, 0.0)
    ix.fill(sorted(rows))
    dense = np.zeros((700, 30))
    for i, r in enumerate(sorted(rows)):
        t, w = ix.vector(r)
        dense[i, t] = w
    for r in rows[:40]:
        t, w = ix.vector(r)
        sims = dense[:, t] @ w
        best = sorted(((-round(float(s), 9), i) for i, s in enumerate(sims) if s > 0))[: toxicity.NEIGHBOURS]
        assert ix.nearest(r) == [(-s, i) for s, i in best]
        assert best[0][1] not in [i for _, i in ix.nearest(r, best[0][1])]
    kind({}, np.zeros(0), np.zeros(0), [], 0.1, 0.0).fill([])


def test_toxicity_held_out(spark):
    rows = queries.op5_toxicity(spark, "/root/testdata/sf0.01").alias("s").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    hits = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    assert hits > sum(not r["toxic"] for r in rows) / len(rows) + 0.04
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.scores(empty, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


@pytest.mark.parametrize("portion", [toxicity.PORTION, 40])
def test_toxicity_counts_of_many_texts(monkeypatch, portion):
    monkeypatch.setattr(toxicity, "PORTION", portion)
    texts = [t or "" for _, t in ODD] + ["", "Straße STRASSEN Straßenbahn straßenbahn", "ΣΑΣ ΣΑΣΑΣΑΣΑΣ İİİİİİİİ", "abcdef abcdefg abcdefgh ABCDEFGH", "日本語日本語日本語 日本語日本語日"]
    for every in (1, 2):
        terms = sorted({w for t in texts for w in toxicity.terms_of(t)})[::every]
        got = toxicity.counts_of(texts, pa.array(terms, pa.binary()))
        want = [sorted((terms.index(w), n) for w, n in Counter(toxicity.terms_of(t)).items() if w in terms) for t in texts]
        assert [list(zip(t.tolist(), n.tolist(), strict=True)) for t, n in got] == want
    assert toxicity.counts_of([], pa.array(terms, pa.binary())) == []
    assert all(not len(t) for t, _ in toxicity.counts_of(texts, pa.array([], pa.binary())))


def test_toxicity_groups_find_what_single_texts_find(monkeypatch):
    rng = np.random.default_rng(1)
    rows = sorted(tuple((int(t), int(rng.integers(1, 4))) for t in np.unique(rng.zipf(1.3, 12) % 400)) for _ in range(900))
    ix = toxicity.WideIndex({bytes(divmod(i, 256)): i for i in range(400)}, 1 + rng.random(400), np.ones(900), list(range(900)), 0.1, 0.0)
    ix.fill(rows)
    assert (ix.row >= 0).any() and (ix.row < 0).any()
    out = [i if i % 2 else -1 for i in range(900)]
    want = [ix.nearest(r, o) for r, o in zip(rows, out, strict=True)]
    assert ix.nearest_all(rows, out) == want
    monkeypatch.setattr(toxicity, "ENTRIES", 300)
    assert ix.nearest_all(rows, out) == want and ix.nearest_all([]) == []


def test_toxicity_scoring_costs_little_beside_cutting_words(spark):
    """CPU seconds of scoring in those of cutting the same texts into terms: 4.5, and 12.4 when each text was searched alone."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    scorer = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    texts = [r["text"] or "" for r in docs.limit(1500).collect()]

    def seconds(f):
        start = time.process_time()
        f()
        return time.process_time() - start

    def score():
        scorer.known.clear()
        scorer.score(texts)

    cut = [seconds(lambda: [toxicity.terms_of(t) for t in texts]) for _ in range(5)]
    assert min(seconds(score) for _ in range(5)) < 8 * min(cut)


def test_toxicity_against_all_examples(spark):
    """Scores of a whole table against the cosine with every example, without the indexes."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scorer = toxicity.fit(docs, labels)
    got = {r["doc_id"]: (r["score"], r["evidence"]) for r in toxicity.scores(docs, labels).collect()}
    words = {}
    for r in docs.collect():
        t = r["text"] or ""
        ws = re.findall(r"[^\W\d_]+", t.lower()) if t.isascii() else toxicity.terms_of(t)
        ws = [w.encode() if isinstance(w, str) else w for w in ws]
        words[r["doc_id"]] = Counter(ws + ([toxicity.stem(w) for w in ws if len(w) > toxicity.STEM] if t.isascii() else []))
    bare = {doc for doc, ws in words.items() if not ws.keys() & scorer.chosen.terms.keys()}
    assert set(scorer.wide.ids) <= bare and not set(scorer.chosen.ids) & bare
    assert scorer.wide.terms.keys() == {w for i in scorer.wide.ids for w in words[i]}
    for ix, mine in ((scorer.chosen, words.keys() - bare), (scorer.wide, bare)):
        counts = {doc: {ix.terms[w]: n for w, n in ws.items() if w in ix.terms} for doc, ws in words.items()}
        df = np.zeros(len(ix.terms))
        for c in counts.values():
            df[list(c)] += 1
        assert np.allclose(ix.idf, np.log((1 + len(words)) / (1 + df)) + 1)

        def vector(c):
            v = np.zeros(len(ix.terms))
            for k, n in c.items():
                v[k] = (1 + np.log(n)) * ix.idf[k]
            return v / np.linalg.norm(v)

        known = np.array([vector(counts[i]) for i in ix.ids])
        for doc in mine:
            if not counts[doc]:
                assert got[doc] == (ix.none, [])
                continue
            s = known @ vector(counts[doc])
            near = sorted((-round(float(x), 9), i) for i, x in enumerate(s) if x > 0)[: toxicity.NEIGHBOURS]
            x = min(max(ix.vote([(-a, i) for a, i in near]), 1e-4), 1 - 1e-4)
            assert abs(got[doc][0] - 1 / (1 + np.exp(-(ix.scale[0] + ix.scale[1] * np.log(x / (1 - x)))))) < 1e-6
            assert len(got[doc][1]) == min(3, len(near))


def test_plain_spans_against_regexes():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        t = "".join(rng.choice(list("a@.-+1207 (5)b"), rng.integers(0, 60)))
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
            for m in re.finditer(pattern, t):
                digits = re.sub("[^0-9]", "", m[0])
                if low <= len(digits) <= high and (kind == "phone" or pii.luhn(digits)):
                    want.append((kind, *m.span()))
        assert pii.plain_spans(t) == want


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("write jane dot doe at example dot com now", "email", "jane dot doe at example dot com"), ("bob [at] mail (dot) org!", "email", "bob [at] mail (dot) org"),
        ("jаne@exаmple.com", "email", "jаne@exаmple.com"), ("call five five five one two three four five six seven", "phone", "five five five one two three four five six seven"),
        ("４１１１１１１１１１１１１１１１ x", "card", "４１１１１１１１１１１１１１１１"),
    ],
)
def test_disguises(text, kind, part):
    ((k, a, b),) = pii.disguised_spans(text, pii.plain_spans(text))
    assert (k, text[a:b]) == (kind, part)
    assert pii.redact(text) == text.replace(part, f"[{kind.upper()}]")


@pytest.mark.parametrize("text", ["look at example.com now", "we met at google.com yesterday", "a talk at arxiv.org, then tea", "dinner at eight", "version 3 dot 5 of it", "point 7 at 10.5"])
def test_clean_sentences_stay(text):
    assert pii.redact(text) == text


def test_disguises_of_known_identifiers(spark):
    """Each disguise of each identifier in a sentence of its own: the added span is the disguised text, at its place in the source."""
    mails = [("jane.roe", "mail", "com"), ("bob_77", "corp-x", "org"), ("x9", "a.b", "de")]
    ips = ["10.0.0.1", "192.168.7.30"]
    phones = ["+4930123456789", "+14155550123"]
    words = "zero one two three four five six seven eight nine".split()
    cases = []
    for user, host, end in mails:
        for at in (" at ", " [at] ", "(at)", " {at} ", " @ ", "[@]"):
            for dot in (" dot ", "[dot]", " (dot) ", "{dot}"):
                cases.append(("email", f"{user}{at}{host.replace('.', dot)}{dot}{end}"))
        cases += [("email", f"{user} at {host}.{end}"), ("email", f"{user}[at]{host}.{end}")]
    for ip in ips:
        cases += [("ip", ip.replace(".", d)) for d in (" dot ", "[.]", "(dot)", " [dot] ")]
        cases.append(("ip", ".".join(" ".join(words[int(c)] for c in p) for p in ip.split(".")).replace(".", " dot ")))
    for phone in phones:
        cases += [("phone", "plus " + " ".join(words[int(c)] for c in phone[1:])), ("phone", "plus " + "-".join(words[int(c)] for c in phone[1:]))]
    rows = [(i, f"Ça va? Please note {c} — thanks, {i}th.", k, c) for i, (k, c) in enumerate(cases)]
    got = {r["doc_id"]: r["spans"] for r in pii.span_digests(spark.createDataFrame(rows, "doc_id long, text string, kind string, part string")).collect()}
    assert [(i, got[i]) for i, t, k, c in rows if got[i] != f"{k}:{t.index(c)}:{t.index(c) + len(c)}"] == []


@pytest.mark.parametrize("part", [" ", "-", " dot a", "[ at", "one ", "1 ", "@a.b dot ", "plus 1 "])
def test_disguises_in_linear_time(part):
    import time

    began = time.process_time()
    text = "dot at one " + part * (1_000_000 // len(part))
    pii.disguised_spans(text, pii.plain_spans(text))
    assert time.process_time() - began < 8


@pytest.mark.parametrize("part", ["5 5 5 oh 1 2 3 4 5 6", "plus 4 4 nine nine 1 2 3 4 5 6 7"])
def test_numbers_with_one_spelled_word(part):
    text = f"call {part} now"
    assert pii.redact(text) == "call [PHONE] now"


def test_edit_distance():
    def brute(p, t):
        row = list(range(len(p) + 1))
        best = (row[-1], 0)
        for j, c in enumerate(t, 1):
            last, row = row, [0]
            for i, x in enumerate(p, 1):
                row.append(min(last[i] + 1, row[-1] + 1, last[i - 1] + (c != x)))
            best = min(best, (row[-1], j))
        return best

    rng = np.random.default_rng(2)
    for _ in range(400):
        p, t = ("".join(rng.choice(list("abc"), n)) for n in (rng.integers(1, 20), rng.integers(1, 60)))
        d, _ = brute(p, t)
        got = decontam.best_match(p, t, len(p))
        assert d == len(p) or got[0] == d


def anywhere(p, t):
    """Least edit distance of p to any passage of t, by the full table."""
    row = np.arange(len(p) + 1)
    best = row[-1]
    for c in t:
        last, row = row, np.zeros_like(row)
        step = np.minimum(last[1:] + 1, last[:-1] + (np.array([x != c for x in p])))
        for i in range(len(p)):
            row[i + 1] = min(step[i], row[i] + 1)
        best = min(best, row[-1])
    return int(best)


def test_decontamination(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away from the very tired hunters"
    shown = "x  İ " + item.upper().replace("BROWN", "BRAWN").replace("FOX", "FOX \n ")
    docs = spark.createDataFrame([(1, shown + " y", "n"), (2, "clean text", "n"), (3, None, "n"), (1, item[:40], "n"), (4, "banana", "n"), (5, "A b", "n"), (5, "A b", "n"), (None, "", "n")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(5, item), (6, None), (7, ""), (8, "a"), (None, "b")], "item_id long, text string")
    want = sorted([(1, 5, 1, 5, len(shown)), (5, 8, 0, 0, 1), (5, 8, 0, 0, 1)])
    for limit in (decontam.BLOCK_CHARS, 10):
        assert sorted(map(tuple, decontam.contaminated(docs, bench, limit=limit).collect())) == want
        left = decontam.without_items(docs, bench, limit=limit)
        assert left.columns == docs.columns and sorted(map(tuple, left.collect()), key=repr) == sorted(map(tuple, docs.collect()[1:]), key=repr)
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_by_brute_force(spark):
    rng = np.random.default_rng(12)
    items = [(i, "".join(rng.choice(list("abcd "), rng.integers(20, 90)))) for i in range(12)] + [(90, "ab" * 20), (91, "abcd efgh abcd efgh abcd efgh ")]
    texts = []
    for d in range(60):
        t = list(items[d % len(items)][1])
        for _ in range(rng.integers(0, 8)):
            k = int(rng.integers(0, len(t)))
            t[k : k + int(rng.integers(0, 2))] = rng.choice(list("abcdx"), rng.integers(0, 2)).tolist()
        texts.append((d, "".join(rng.choice(list("abcd "), 30)) + "".join(t) + "".join(rng.choice(list("abcd "), 30))))
    want = set()
    for d, t in texts:
        for i, p in items:
            p = decontam.normalise(p)
            n = anywhere(p, decontam.normalise(t))
            if n <= len(p) // decontam.PER_EDIT:
                want.add((d, i, n))
    got = decontam.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == want and len(got) == len(want) > 40
    whole, pattern = dict(texts), dict(items)
    for r in got:
        a, b = decontam.normalise(whole[r["doc_id"]][r["start"] : r["end"]]), decontam.normalise(pattern[r["item_id"]])
        assert anywhere(b, a) == r["distance"]


def test_bk_tree_and_components(spark, docs):
    rng = np.random.default_rng(3)
    bk, members = simhash.BKTree(3), set()
    for x in rng.integers(0, 1 << 12, 800).tolist():
        bk.add(x)
        members.add(x)
    for x in range(0, 1 << 12, 97):
        assert {v for _, v in bk.search(x)} == {m for m in members if (m ^ x).bit_count() <= 3}
    rows = simhash.simhash_components(docs).collect()
    fps = {r["doc_id"]: r["fp"] for r in rows}
    group = {d: d for d in fps}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 2 and top(a) != top(b):
                group[max(top(a), top(b))] = min(top(a), top(b))
    assert {r["doc_id"]: r["component_id"] for r in rows} == {d: top(d) for d in fps}
    assert simhash.fingerprint([], 3) == 0


def test_oversized_shards(spark):
    rng = np.random.default_rng(4)
    values = {int(x) for x in rng.integers(0, 1 << 14, 300)}
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    one = sorted(map(tuple, simhash.components(simhash.shard_links(fps, 2, 3, 1)).collect()))
    two = sorted(map(tuple, simhash.components(simhash.shard_links(fps, 2, 3, 1, tree=20)).collect()))
    assert one == two


def test_near_duplicates(spark):
    words = [f"w{i}" for i in range(200)]
    near = words[:100] + ["new"] + words[101:]
    rows = [(3, " ".join(words)), (1, " ".join(near)), (2, "other text here"), (4, " ".join(words).upper()), (None, None), (None, ""), (2, "other text here")]
    df = spark.createDataFrame([(d, t, "c", "m", "r") for d, t in rows], "doc_id long, text string, key string, _mark string, row string")
    left = simhash.drop_near_duplicates(df)
    assert left.columns == df.columns
    got = sorted(((r["doc_id"], r["key"], r["_mark"], r["row"]) for r in left.collect()), key=repr)
    assert got == sorted([(1, "c", "m", "r"), (2, "c", "m", "r"), (None, "c", "m", "r")], key=repr)
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_texts_with_one_key_are_not_lost(spark):
    texts = [(i, " ".join(f"a{i}b{j}" for j in range(30))) for i in range(40)] + [(100 + i, " ".join(f"a{i}b{j}" for j in range(30))) for i in range(5)]
    got = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), bits=4).collect()}
    assert got == set(range(40))


def kept_by_brute_force(rows, words=5, similarity=0.8):
    """Ids left when every pair of shingle sets is compared."""
    sets = {d: set(simhash.shingle_set(t, words).tolist()) for d, t in rows}
    group = {d: d for d in sets}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and (not sets[a] | sets[b] or both and both >= similarity * len(sets[a] | sets[b])) and top(a) != top(b):
                group[max(top(a), top(b))] = min(top(a), top(b))
    return sorted(d for d in sets if top(d) == d)


def edited(rng, words, share):
    """A copy with one stretch replaced, so that about `share` of the five-word shingles stay common."""
    n = len(words)
    k = int(n * (1 - share) / (1 + share))
    at = int(rng.integers(0, n - k))
    return [*words[:at], *(f"x{rng.integers(1 << 40)}" for _ in range(k)), *words[at + k :]]


def test_near_duplicates_are_all_found(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(60):  # near the threshold, on both sides
        base = [f"g{g}w{rng.integers(400)}" for _ in range(150)]
        rows += [base, edited(rng, base, 0.86), edited(rng, base, 0.82)]
    texts = [(int(i), " ".join(w)) for i, w in zip(rng.permutation(len(rows)), rows, strict=True)]
    got = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == kept_by_brute_force(texts)
    small = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").dropDuplicates(["doc_id"]).collect() if r["doc_id"] is not None]
    got = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(small, "doc_id long, text string")).collect())
    assert got == kept_by_brute_force(small)


def repeated_line(rng, repeats, pairs, others):
    """(id, text): texts of one line repeated, each with a tail of its own; each of `pairs` has a near copy."""
    line, out = [f"line{i}" for i in range(13)], []
    for g in range(pairs + others):
        tail = [f"t{rng.integers(1 << 40)}" for _ in range(60)]
        out += [line * repeats + tail] + ([line * repeats + tail[:30] + ["new"] + tail[31:]] if g < pairs else [])
    return [(int(i), " ".join(w)) for i, w in zip(rng.permutation(len(out)), out, strict=True)]


def test_near_duplicates_with_many_close_fingerprints(spark):
    texts = repeated_line(np.random.default_rng(8), 12, 20, 150)
    fps = [simhash.fingerprint(t.encode().split(), 3) & (2**64 - 1) for _, t in texts]
    assert np.median([sum((a ^ b).bit_count() <= 12 for b in fps) - 1 for a in fps]) > 2
    got = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == kept_by_brute_force(texts) and len(got) == 170


def test_near_duplicates_that_share_a_fingerprint(spark):
    texts = repeated_line(np.random.default_rng(9), 200, 5, 15)
    assert len({simhash.fingerprint(t.encode().split(), 3) for _, t in texts}) == 1
    got = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == kept_by_brute_force(texts) and len(got) == 20


def test_quality_rules(spark, odd):
    words = [f"w{i % 11}".encode() for i in range(60)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    cover = {j for found in windows.values() if len(found) > 1 for i in found for j in range(i, i + 8)}
    assert quality.repeated_words(words) == len(cover)
    base, _ = quality.statistics("a b\n\n  c#\nc# d\n  c#\n")
    assert base == (6, 9, 3, 1, 0)
    rows = quality.quality(odd, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(rows) == len(ODD) and all(not r["kept"] for r in rows)


def test_quality_of_a_whole_table(spark):
    """Statistics and base rule by plain loops; the verdict by walking every tree node by node; accuracy on the labels."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        places: dict = {}
        for i in range(len(words) - 7):
            places.setdefault(tuple(words[i : i + 8]), []).append(i)
        twice = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
        r = rows[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(twice))
        failed = len(words) < 20 or 100 * len(twice) > 30 * len(words)
        x = quality.statistics(text)[1]
        score = model.start
        for root in model.roots:
            node = root
            while model.left[node] != node:
                node = model.left[node] if x[model.feature[node]] <= model.threshold[node] else model.right[node]
            score += model.value[node]
        assert r["base_failed"] == failed and r["kept"] == (not failed and score >= 0)
    known = labels.filter("quality is not null").collect()
    assert sum((rows[r["doc_id"]]["score"] >= 0.5) == bool(r["quality"]) for r in known if r["doc_id"] in rows) / len(known) > 0.9


def test_trees_are_monotonic():
    rng = np.random.default_rng(5)
    x = rng.random((1500, 2))
    y = (x[:, 0] + 0.3 * rng.standard_normal(1500) > 0.5).astype(float)
    model = quality.train(x, y, [1, 0])
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.4)], 1)
    p = model.probability(grid)
    assert (np.diff(p) >= -1e-12).all() and ((model.probability(x) > 0.5) == y).mean() > 0.75


def test_pipeline_against_brute_force(spark):
    """run() over a whole table: what each stage keeps is worked out again by plain loops."""
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs, labels, bench = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    score = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, labels).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if score[r["doc_id"]] < 0.5]
    texts = dict(rows)
    assert len(texts) == len(rows)
    left = kept_by_brute_force([(i, t or "") for i, t in rows])
    items = [decontam.normalise(r["text"]) for r in bench.filter("text is not null and item_id is not null").collect()]

    def holds(text, p):
        budget, n = len(p) // decontam.PER_EDIT, len(p)
        found = {text.find(p[n * k // (budget + 1) : n * (k + 1) // (budget + 1)]) for k in range(budget + 1)} - {-1}
        return bool(found) and anywhere(p, text) <= budget

    left = [i for i in left if not any(len(p) >= decontam.PER_EDIT and holds(decontam.normalise(texts[i] or ""), p) for p in items)]
    t = library("word_bpe_49k.json")
    want = {i: t.encode(pii.redact(texts[i] or ""), add_special_tokens=False).ids for i in left}
    got = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"]: list(r["token_ids"]) for r in got} == want and len(got) == len(want)
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in got)


ROWS = [
    (1, None, None, None, "k"), (None, "", "en", "s", "k"), (None, None, None, None, None), (2, "plain words " * 30, "en", "s", "k"), (2, "plain words " * 30, "en", "s", "k"),
    (3, "another text, jane dot doe at example dot com", "en", "s", "k"), (4, "long text " + " ".join(f"w{i}" for i in range(60_000)), "en", "s", "k"), (5, " \n\t", None, "s", "k"),
]


@pytest.mark.parametrize("name", ["toxicity", "simhash_dedup", "decontamination", "personal_data", "bpe_encoding"])
def test_pipeline_stages_on_odd_tables(spark, name):
    """Nulls, empty and long texts, repeated rows, extra columns named like internal ones, and no rows at all."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, text2 string, key string, mark string, row string, prefix string"
    df = spark.createDataFrame([(*r[:4], r[4], "k", "m", "r", "p") for r in ROWS], schema)
    stage = dict(corpus_pipeline.STAGES)[name]
    left = stage(spark, df, DATA)
    rows = left.collect()
    assert len(rows) == (4 if name == "simhash_dedup" else len(ROWS))  # the four without words are one group
    if name != "bpe_encoding":
        assert left.columns == df.columns and all(r["mark"] == "m" and r["row"] == "r" and r["prefix"] == "p" for r in rows)
    assert stage(spark, df.limit(0), DATA).count() == 0


def test_operators_on_odd_tables(spark):
    """The same for the operators that have no such test above."""
    df = spark.createDataFrame([(*r[:2], "x", "x", "x") for r in ROWS], "doc_id long, text string, fp string, key string, score string")
    labels = spark.createDataFrame([(2, None, 1), (None, 1, 0), (77, 0, 1)], "doc_id long, quality int, toxic int")
    for f in (lambda d: toxicity.scores(d, labels), lambda d: quality.quality(d, labels), simhash.simhash_components, pii.span_digests, licenses.license_scan):
        assert f(df).count() == len(ROWS) and f(df.limit(0)).count() == 0
    classes = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(df).collect()}
    assert classes[1] == classes[5] == 1 and classes[2] == 2
    (r,) = [r for r in pii.span_digests(df).collect() if r["doc_id"] == 3]
    assert r["n_email"] == 0 and r["n_added"] == 1


def test_fingerprints_by_brute_force(spark):
    import xxhash

    rows = simhash.simhash_components(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r["doc_id"]])
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert r["fp"] & (2**64 - 1) == want


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "bpe_encoding":
            assert after.columns == docs.columns
        docs = after
    assert 0 < docs.count() < n
    for row in docs.limit(3).collect():
        assert len(row["token_ids"]) == row["n_tokens"]
