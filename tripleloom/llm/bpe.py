"""Byte-pair encoding: merge ranks in a priority queue over a doubly linked list of symbols.

Reads public files of the `tokenizers` library whose text handling is that of `WORD_TEXTS` below (composed, lower case, white
space dropped, letters by the word, no decoder); any other file is refused. Merging and decoding are done here; the library
normalises and splits texts with unusual characters.
"""

from __future__ import annotations

import hashlib
import json
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_texts

#: Distinct pre-tokens whose encoding a Python worker keeps (two generations of it, so memory is bounded).
KEEP_WORDS = 300_000
#: Blanks of Python's str.split that Unicode does not call white space.
ODD_BLANKS = re.compile("[\x1c-\x1f]")
WHITE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: The normalizer and the pre-tokenizer that this module knows.
WORD_TEXTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Texts of these characters only are composed already, and lower-casing needs no look at a letter's neighbours.
PLAIN_TEXT = re.compile(r"[\t-\r -~\x85\xa0À-ÖØ-öø-ÿ]*")
#: The pre-tokens of such a text in lower case.
PLAIN_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")


def word_texts(spec: dict) -> bool:
    """Whether a tokenizer file handles texts as `WORD_TEXTS` says."""
    return all(spec.get(k) == v for k, v in WORD_TEXTS.items())


class Memo(dict):
    """A bounded cache: the older half goes when the newer one is full."""

    def __init__(self, make, size: int = KEEP_WORDS):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others for the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class MergeEncoder:
    """Encodes and decodes as the tokenizer file says. One per Python process; see `encoder`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for k in ("decoder", "post_processor") if spec.get(k)]
        odd += [f"{k} of an added token" for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
        if model.get("type") != "BPE" or odd or not word_texts(spec):
            raise ValueError(f"{path}: not a tokenizer of the known kind ({', '.join(odd) or 'model, normalizer or pre_tokenizer'})")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.letters = byte_letters()
        #: Pair of ids, as one number -> rank; and for each rank the pair and what it becomes.
        self.width = max(self.vocab.values()) + 1
        self.ranks, self.lefts, self.rights, self.merged = {}, [], [], []
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.lefts.append(self.vocab[a])
            self.rights.append(self.vocab[b])
            self.merged.append(self.vocab[a + b])
            self.ranks[self.vocab[a] * self.width + self.vocab[b]] = rank
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.specials.items()}
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.ids_of, self.forms_of = Memo(self.packed), Memo(self.forms)

    def merge(self, letters: str) -> list[int]:
        """The ids of one pre-token, given in byte letters."""
        vocab = self.vocab
        ids = [vocab[c] for c in letters[:-1]]
        ids.append(vocab[letters[-1] + self.end])
        n = len(ids)
        rank_of, width = self.ranks.get, self.width
        # An entry is rank and place in one number; its rank tells which two symbols it was made for.
        queue = [r << 32 | i for i in range(n - 1) if (r := rank_of(ids[i] * width + ids[i + 1])) is not None]
        if not queue:
            return ids
        heapify(queue)
        lefts, rights, merged = self.lefts, self.rights, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or ids[i] != lefts[rank] or ids[j] != rights[rank]:
                continue  # one of the two symbols is gone: a stale entry
            new = ids[i] = merged[rank]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(new * width + ids[k])) is not None:
                    heappush(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank_of(ids[h] * width + new)) is not None:
                heappush(queue, r << 32 | h)
        return [x for x in ids if x >= 0]

    def ids(self, token: str) -> list[int]:
        """The ids of one pre-token, already normalised; of a special token its own."""
        if token in self.specials:
            return [self.specials[token]]
        return self.merge(token if token.isascii() and token.isprintable() else "".join([self.letters[b] for b in token.encode()]))

    def packed(self, token: str) -> bytes:
        """The ids of a pre-token as 32-bit numbers."""
        return np.array(self.ids(token), "<i4").tobytes()

    def forms(self, token: str) -> tuple[str, str]:
        """The decimal ids of a pre-token and what they decode to."""
        ids = self.ids(token)
        return " ".join(map(str, ids)), self.decode(ids)

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text, normalised, with special tokens (which the library finds in the raw text) among them."""
        if self.special.search(text):
            out, at = [], 0
            for m in self.special.finditer(text):
                out += [*self.ordinary(text[at : m.start()]), m[0]]
                at = m.end()
            return out + self.ordinary(text[at:])
        return self.ordinary(text)

    def ordinary(self, text: str) -> list[str]:
        """The same for a text without special tokens. White space parts pre-tokens and is dropped, so that the stretches
        between may be looked at one by one; only unusual ones go through the library."""
        if PLAIN_TEXT.fullmatch(text):
            return PLAIN_TOKEN.findall(text.lower())
        out: list[str] = []
        for chunk in WHITE.split(text) if ODD_BLANKS.search(text) else text.split():
            if PLAIN_TEXT.fullmatch(chunk):
                out += PLAIN_TOKEN.findall(chunk.lower())
            else:
                chunk = self.normalizer.normalize_str(chunk)
                out += [chunk[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(chunk) if b > a]
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        return np.frombuffer(b"".join(map(self.ids_of.__getitem__, self.pre_tokens(text))), "<i4")

    def decode(self, ids) -> str:
        """The vocabulary's strings one after another, joined as a file without a decoder asks for: by blanks."""
        names = self.names
        return " ".join([names[i] for i in ids if i in names])

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids, SHA-256 of the decoded text."""
        found = list(map(self.forms_of.__getitem__, self.pre_tokens(text)))
        ids, decoded = " ".join([f[0] for f in found]), " ".join([f[1] for f in found])
        n = ids.count(" ") + 1 if ids else 0
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


_ENCODERS: dict[str, MergeEncoder] = {}


def encoder(path: str) -> MergeEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = MergeEncoder(path)
    return _ENCODERS[path]


def encode_table(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """(keep…, token_ids array<int>, n_tokens) of every row's whole text; null text counts as empty."""

    def each(texts, _):
        e = encoder(path)
        ids = [e.encode(t) for t in texts]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), pa.array(sizes)]

    return map_texts(docs, keep, "token_ids array<int>, n_tokens bigint", each)


def decode_table(tokens: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """(keep…, text) from the column token_ids; null ids give an empty text."""
    kinds = dict(tokens.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string"])

    def run(batches):
        e = encoder(path)
        for b in batches:
            texts = [e.decode(ids or ()) for ids in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    return tokens.select(*keep, "token_ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The ids of a text are never held as a list: the decimal ids of a pre-token and what they decode to are worked out once per
    worker and cached pre-token, then joined. One row for each row of `docs`: repeated rows and null ids stay, null
    text counts as empty, extra columns are not read."""

    def each(texts, _):
        e = encoder(path)
        n, ids, decoded = zip(*[e.digest(t) for t in texts], strict=True)
        return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]

    return map_texts(docs, ["doc_id"], "n_tokens bigint, ids_sha256 string, decoded_sha256 string", each)
