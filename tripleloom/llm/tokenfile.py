"""Token ids in binary files of independent zstandard frames with a trailing seek table.

A file holds data frames (little-endian unsigned 32-bit ids of some documents, one after another), then a
skippable frame with the document index, then the seek table of zstandard's seekable format: for each frame its
compressed and decompressed size and the low 32 bits of XXH64 of its content. Any zstandard reader can read the
ids; one that knows the table reads only the frames it wants.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PLAIN_TEXT, PLAIN_TOKEN, Memo, byte_letters, word_texts
from .common import new_folder, session_of, text_or_empty
from .tokens import library

#: Fixed values of the public formats: skippable frames, seek table footer.
SKIP_INDEX, SKIP_TABLE, FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: A frame is closed when it holds this many bytes of ids (one document is never split).
FRAME_BYTES = 1 << 20
#: Distinct pre-tokens whose ids a Python worker keeps (two generations of it, so memory is bounded).
KEEP_PIECES = 300_000
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])


def file_system(uri: str):
    """pyarrow's file system for a folder that Spark names, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def write_file(sink, docs: Iterable[tuple[int | None, bytes]], level: int = 3) -> tuple[int, int]:
    """Writes (id, ids as bytes) in the given order; gives the numbers of documents and of ids."""
    packer = zstandard.ZstdCompressor(level=level)
    entries, index, waiting, held, total = [], [], [], 0, 0

    def close():
        nonlocal waiting, held
        data = b"".join(waiting)
        packed = packer.compress(data)
        sink.write(packed)
        entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        waiting, held = [], 0

    for doc_id, data in docs:
        if held and held + len(data) > FRAME_BYTES:
            close()
        index.append((-1 if doc_id is None else doc_id, doc_id is not None, len(entries), held // 4, len(data) // 4))
        waiting.append(data)
        held += len(data)
        total += len(data) // 4
    if waiting:
        close()
    rows = np.array(index, dtype=np.int64).reshape(-1, 5)
    packed = packer.compress(rows.astype("<i8").tobytes())
    sink.write(struct.pack("<II", SKIP_INDEX, len(packed) + 8) + packed + struct.pack("<Q", len(rows)))
    table = np.array(entries, dtype=ENTRY).tobytes()
    sink.write(struct.pack("<II", SKIP_TABLE, len(table) + 9) + table)
    sink.write(struct.pack("<IBI", len(entries), 0x80, FOOTER))
    return len(rows), total


class TokenFile:
    """Random access to one file: reads the tables at its end, then only the frames asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        count, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != FOOTER or flags != 0x80:
            raise ValueError("no seek table")
        table = source.read_at(count * ENTRY.itemsize, size - 9 - count * ENTRY.itemsize)
        self.entries = np.frombuffer(table, ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"].astype(np.int64))])
        at = int(self.starts[-1])
        magic, length = struct.unpack("<II", source.read_at(8, at))
        if magic != SKIP_INDEX:
            raise ValueError("no document index")
        body = zstandard.ZstdDecompressor().decompress(source.read_at(length - 8, at + 8))
        #: doc_id, whether it has one, frame, first id in the frame, number of ids
        self.docs = np.frombuffer(body, "<i8").reshape(-1, 5)

    def frame(self, k: int) -> bytes:
        """One frame's content, held against its checksum."""
        packed = self.source.read_at(int(self.entries["packed"][k]), int(self.starts[k]))
        data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.entries["size"][k]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.entries["check"][k]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in file order; with `wanted`, only those, and only their frames are read."""
        last, data = -1, b""
        for doc_id, real, k, start, n in self.docs.tolist():
            doc = doc_id if real else None
            if wanted is not None and doc not in wanted:
                continue
            if k != last:
                last, data = k, self.frame(k)
            yield doc, np.frombuffer(data, "<u4", n, start * 4)


class WordBytes:
    """Ids of texts as bytes, from the library. Where the file handles texts as `bpe.WORD_TEXTS` says, the pre-tokens of plain
    texts go straight to the library's model, each once while it is cached, in byte letters; for other files and
    texts with unusual characters the library encodes the whole text."""

    def __init__(self, path: str):
        self.library = library(path)
        self.model = self.library.tokenizer.model
        self.words = word_texts(self.library.spec)
        self.letters = dict(enumerate(byte_letters()))
        self.pieces = Memo(self.piece, KEEP_PIECES)

    def piece(self, token: str) -> bytes:
        letters = token if token.isascii() else token.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str, end: bytes) -> bytes:
        if self.words and PLAIN_TEXT.fullmatch(text) and not self.library.special.search(text):
            return b"".join(map(self.pieces.__getitem__, PLAIN_TOKEN.findall(text.lower()))) + end
        return np.array(self.library.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + end


_CODERS: dict[str, WordBytes] = {}


def coder_of(path: str) -> WordBytes:
    """One per Python process, so that its next task finds the words of the one before."""
    if path not in _CODERS:
        _CODERS[path] = WordBytes(path)
    return _CODERS[path]


def write_token_files(docs: DataFrame, path: str, end_id: int, folder: str | None = None, files: int | None = None) -> DataFrame:
    """Writes the ids of all rows' whole texts, `end_id` behind each, in ascending doc_id order over numbered files
    (nulls first; rows with the same id by text). Gives the manifest (shard, path, n_docs, n_ids).

    Rows are dealt to files by ranges of doc_id and a hash of the text, so that a repeated id is no hot spot. Each task
    writes under a name of its own and renames, so a repeated task changes nothing.
    """
    spark = session_of(docs)
    folder = folder or new_folder(spark, "token-files")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(files, F.asc_nulls_first("doc_id"), "tie")
    rows = rows.sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie", "text").select("doc_id", "text")
    end = struct.pack("<I", end_id)

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        coder = coder_of(path)
        system, place = file_system(folder)
        system.create_dir(place, recursive=True)
        name = f"{place}/ids-{task.partitionId():06d}.zst"
        own = f"{name}.{task.taskAttemptId()}"

        def each():
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield doc_id, coder(text, end)

        with system.open_output_stream(own) as sink:
            n_docs, n_ids = write_file(sink, each())
        system.move(own, name)
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "path": [os.path.basename(name)], "n_docs": [n_docs], "n_ids": [n_ids]})

    listing = f"{folder}/manifest"
    rows.mapInArrow(write, "shard bigint, path string, n_docs bigint, n_ids bigint").write.parquet(listing)
    return spark.read.parquet(listing).withColumn("path", F.concat(F.lit(folder + "/"), "path"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a manifest, from the files alone.

    The manifest has a row for each file, so its running sum is a small job whatever the files hold."""
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    todo = manifest.filter("n_docs > 0").select("path", F.coalesce(before, F.lit(0)).alias("start"))
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, place = file_system(path)
                with system.open_input_file(place) as source:
                    rows = []
                    for doc_id, ids in TokenFile(source).documents():
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids)))
                        start += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.repartition(n, "path").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
