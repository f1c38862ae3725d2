"""Token files: id arrays compressed one document at a time with a shared zstandard dictionary.

A file holds the documents of one shard, those without an id first (0 stands
for it), then in ascending order of id::

    magic "ZTOK0002" | sha-256 of the dictionary | n documents (u64) | of them without an id (u64) |
    doc_id (i64) x n | offset of the frame (u64) x (n + 1) | n tokens (u32) x n | frames

All numbers are little-endian; offsets count from the first frame.  A frame is
the document's ids as unsigned 32-bit integers, compressed with the dictionary.
The index makes any document readable alone, and short documents stay small
because the dictionary knows the common ids.  Next to the shards lie
``dictionary`` and, for a whole set, the manifest that ``write`` returns.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurewatch.llm import pieces
from lurewatch.llm.sampling import bounded_sample
from lurewatch.llm.scratch import Scratch, folder

MAGIC, HEAD = b"ZTOK0002", struct.Struct("<8s32sQQ")
#: Documents of a shard at most, ranges of ids at most, documents that train the dictionary, their bytes at most each (in so many windows), and the dictionary's size.
SHARD_DOCS, RANGES, SAMPLE_DOCS, SAMPLE_BYTES, WINDOWS, DICTIONARY_BYTES, LEVEL = 5000, 10_000, 1000, 1 << 14, 8, 1 << 16, 3
#: Pieces of a group of documents, and distinct pieces that a task remembers at most.
GROUP_PIECES, KNOWN_PIECES = 1_000_000, 500_000
MANIFEST = "shard long, path string, n_docs long, n_tokens long"


def _filesystem(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _put(path: str, data: bytes) -> None:
    """Writes a file whole or not at all: repeated and parallel attempts of a task leave one good file."""
    system, name = _filesystem(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, name)


def _get(path: str) -> bytes:
    system, name = _filesystem(path)
    with system.open_input_stream(name) as source:
        return source.read()


def pack(rows: list[tuple[int, int, bytes]], dictionary: bytes) -> bytes:
    """File of (doc_id, n_tokens, frame) rows, those without an id first."""
    offsets = np.concatenate([[0], np.cumsum([len(f) for _, _, f in rows])]).astype("<u8")
    return b"".join([HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest(), len(rows), sum(d is None for d, _, _ in rows)), np.array([d or 0 for d, _, _ in rows], dtype="<i8").tobytes(),
                     offsets.tobytes(), np.array([n for _, n, _ in rows], dtype="<u4").tobytes(), *(f for _, _, f in rows)])


class Reader:
    """Reads documents of one file by their place."""

    def __init__(self, data: bytes, dictionary: bytes):
        import zstandard
        magic, digest, n, self.nameless = HEAD.unpack_from(data)
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token file of this dictionary")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 8 * n).astype(np.int64)
        self.n_tokens = np.frombuffer(data, "<u4", n, at + 16 * n + 8)
        self.frames = memoryview(data)[at + 20 * n + 8:]
        self.decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> np.ndarray:
        return np.frombuffer(self.decompress(self.frames[self.offsets[i]: self.offsets[i + 1]]), "<u4")


def _tokenizer(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def _rows(docs: DataFrame, tokenizer_path: str, pattern: str) -> DataFrame:
    """doc_id, words, and ``whole``: the text if it has an added token of the tokenizer, whose string the pattern would cut."""
    added = [t.content for t in _tokenizer(tokenizer_path).get_added_tokens_decoder().values()]
    having = F.lit(False)
    for content in added:
        having = having | F.contains("text", F.lit(content))
    return docs.select("doc_id", pieces.split(F.col("text"), pattern).alias("words"), F.when(having, F.col("text")).alias("whole"))


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes themselves, the others from code point 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return {b: chr(b if b in shown else next(other)) for b in range(256)}


def _piece_ids(tokenizer):
    """Function from pieces to their ids as bytes.

    Where the tokenizer only cuts into pieces and maps bytes to letters, its
    model is asked directly, which spares the library's offsets and copies.
    """
    import json
    plan = json.loads(tokenizer.to_str())
    if plan["normalizer"] is None and (plan["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not plan["pre_tokenizer"]["add_prefix_space"]:
        letters, tokenize = _byte_letters(), tokenizer.model.tokenize
        return lambda words: (array("I", [t.id for t in tokenize(w.encode().decode("latin-1").translate(letters))]).tobytes() for w in words)
    return lambda words: (array("I", e.ids).tobytes() for at in range(0, len(words), 5000) for e in tokenizer.encode_batch(words[at : at + 5000], add_special_tokens=False))


def _encode(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids with the end id); every distinct piece is encoded once, as long as the task remembers it.

    Texts with added tokens are encoded whole: the library takes those out before it splits.
    """
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
    tokenizer, known = _tokenizer(tokenizer_path), {}
    piece_ids = _piece_ids(tokenizer)
    for table in pieces.groups(batches, "words", GROUP_PIECES):
        words, index, counts = pieces.distinct(table.column("words"))
        words = words.to_pylist()
        if len(known) + len(words) > KNOWN_PIECES:
            known = {}
        new = [w for w in words if w not in known]
        known.update(zip(new, piece_ids(new)))
        held = [known[w] for w in words]
        sizes = np.array([len(x) for x in held], dtype=np.int64) // 4
        values = np.frombuffer(b"".join(held), dtype=np.uint32)
        starts = np.cumsum(sizes) - sizes
        end = np.array([end_id], dtype=np.uint32)
        for doc_id, whole, ids in zip(table.column("doc_id").to_pylist(), table.column("whole").to_pylist(), pieces.gather(index, counts, values, starts, sizes)):
            if whole is not None:
                ids = np.array(tokenizer.encode(whole, add_special_tokens=False).ids, dtype=np.uint32)
            yield doc_id, np.concatenate([ids, end]).astype("<u4", copy=False)


def windows(ids: bytes) -> bytes:
    """All of short id arrays, else windows spread evenly over the array."""
    if len(ids) <= SAMPLE_BYTES:
        return ids
    size = SAMPLE_BYTES // WINDOWS // 4
    return b"".join(ids[4 * at : 4 * (at + size)] for at in (k * (len(ids) // 4 - size) // (WINDOWS - 1) for k in range(WINDOWS)))


def train(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 0) -> bytes:
    """Dictionary from windows of the ids of at most ``SAMPLE_DOCS`` documents (by hash of the row); empty if too few to train."""
    import zstandard

    def spread(batches):
        for _, ids in _encode(batches, tokenizer_path, end_id):
            yield pa.RecordBatch.from_arrays([pa.array([windows(ids.tobytes())])], names=["ids"])

    chosen = _rows(bounded_sample(docs, ["doc_id"], SAMPLE_DOCS), tokenizer_path, pattern)
    samples = [bytes(r["ids"]) for r in chosen.mapInArrow(spread, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples
        return b""


def write(docs: DataFrame, path: str, tokenizer_path: str, pattern: str, end_id: int = 0) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) into token files under ``path``; returns the manifest (shard, path, n_docs, n_tokens).

    Null and empty texts have the end id alone; texts may be of any length.
    Rows without an id come first.  Repeated rows are written each, columns of
    other names are ignored.  Ids are dealt into ranges, and a range is written
    in files of up to ``SHARD_DOCS`` documents, so the files in order of shard
    are in order of id.  An id with the rows of several ranges is dealt over all of them, and so are rows without one.
    An empty table gives an empty manifest and a dictionary file only.
    """
    pieces.small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train(rows, tokenizer_path, pattern, end_id)
    _put(f"{path}/dictionary", dictionary)
    n, named = rows.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    ranges = min(RANGES, max(1, -(-n // SHARD_DOCS)))
    nameless = -(-(n - named) * ranges // max(1, n))  # ranges of the rows without an id
    of_ids = max(1, ranges - nameless)
    cuts = np.array(sorted(rows.approxQuantile("doc_id", [i / of_ids for i in range(1, of_ids)], 0.1 / of_ids)) if named and of_ids > 1 else [], dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        known = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=known).compress
        held: list[tuple] = []

        def out():
            ids, n, frames = zip(*held)
            known_ids = np.array([0 if i is None else i for i in ids], dtype=np.int64)
            # an id that is a cut more than once has the ranges between them to itself
            first, last = np.searchsorted(cuts, known_ids, side="left"), np.searchsorted(cuts, known_ids, side="right")
            turn = np.arange(len(ids))
            at = np.where(last - first > 1, first + 1 + turn % np.maximum(last - first, 1), last) + nameless
            at = np.where([i is None for i in ids], turn % max(1, nameless), at)
            return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(frames, pa.binary())],
                                              names=["range", "doc_id", "n", "frame"])

        for doc_id, ids in _encode(batches, tokenizer_path, end_id):
            held.append((doc_id, len(ids), squeeze(ids.tobytes())))
            if len(held) >= 2000:
                yield out()
                held.clear()
        if held:
            yield out()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, part, held = None, 0, []

        def close():
            name = f"{path}/shard-{of:05d}-{part:05d}"
            _put(name, pack(held, shared.value))
            return pa.RecordBatch.from_arrays([pa.array([(of << 32) + part], pa.int64()), pa.array([name]), pa.array([len(held)]), pa.array([sum(n for _, n, _ in held)])], names=["shard", "path", "n_docs", "n_tokens"])

        for batch in batches:
            for r, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (r != of or len(held) >= SHARD_DOCS):
                    yield close()
                    part, held = part + 1 if r == of else 0, []
                of = r
                held.append(tuple(row))
        if held:
            yield close()

    frames = _rows(rows, tokenizer_path, pattern).mapInArrow(compress, "range int, doc_id long, n long, frame binary")
    return scratch.write(frames.repartition(nameless + of_ids, "range").sortWithinPartitions("range", "doc_id").mapInArrow(store, MANIFEST))


def read(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents of the files; ``start`` counts the ids of all documents before."""
    spark = manifest.sparkSession
    shared = spark.sparkContext.broadcast(_get(f"{path}/dictionary"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    files = manifest.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                reader = Reader(_get(name), shared.value)
                n = reader.n_tokens.astype(np.int64)
                start = base + np.cumsum(n) - n
                for at in range(0, len(reader), 500):
                    here = slice(at, min(at + 500, len(reader)))
                    ids = pa.array(reader.doc_ids[here], mask=np.arange(here.start, here.stop) < reader.nameless)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(start[here]), pa.array(n[here]), pa.array([reader.ids(i).tobytes() for i in range(here.start, here.stop)], pa.binary())],
                                                     names=["doc_id", "start", "n_tokens", "ids"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    slots = max(1, manifest.count())
    return files.repartition(slots, "shard").mapInArrow(load, schema)


def op2_token_files(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Writes all ``documents`` as token files and reports what the files hold."""
    import public_tokenizers
    tokenizer_path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    path = f"{folder(spark)}/token-files-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    manifest = write(docs, path, tokenizer_path, public_tokenizers.PATTERN)
    return read(manifest, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
