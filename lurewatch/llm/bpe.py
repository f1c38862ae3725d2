"""Byte-level BPE encoding and decoding.

Encoding: a regular expression splits every text into pieces.  The distinct
pieces that a task meets become arrays of byte ids, and the ranked merges run
over all of them at once: a round looks up all neighbouring pairs in a rank map
and merges the leftmost one of lowest rank in every piece.  Pairs that
nothing can precede, by the vocabulary's ranks, are merged beforehand.  The ids of the documents are then gathered from those
of their pieces, of which a task remembers a bounded number.  No step shuffles.

Pieces of ``LONG`` bytes or more (a line of base64, a run of letters) merge over
a linked list with a heap of pairs instead, as rounds times the
piece's length would never end; both give the same ids.

Decoding concatenates the binary pieces of the ids.

The rank map is the matrix of pairs with its sparse rows laid over one
another, so a look-up is two array accesses and one comparison.  Its size is fixed by the vocabulary file (50 thousand tokens), not by the data.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurewatch.llm import pieces

#: Bits of an id in the rank map: a pair and the token it merges to fill one long.
BITS = 21
MASK = (1 << BITS) - 1
#: Bytes from which on a piece merges over a linked list.
LONG = 512
#: Pieces of the documents handled at a time, distinct pieces that a task remembers, and new ones merged at a time.
GROUP_PIECES, KNOWN_PIECES, ROW_PIECES = 500_000, 400_000, 25_600
KEPT = "_kept"


@lru_cache(maxsize=4)
def vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


@lru_cache(maxsize=4)
def merges(path: str) -> dict[tuple[int, int], int]:
    """All pairs of tokens whose bytes together are a token."""
    ranks = vocabulary(path)
    out = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                out[left, right] = rank
    return out


def _fold_plain(ids: list[int], pairs: dict) -> list[int]:
    while len(ids) > 1:
        rank, at = min((pairs.get(p, 1 << 62), i) for i, p in enumerate(zip(ids, ids[1:])))
        if rank == 1 << 62:
            break
        ids = [*ids[:at], rank, *ids[at + 2 :]]
    return ids


@lru_cache(maxsize=4)
def whole_pieces(path: str) -> dict[bytes, int]:
    """Tokens that merging by rank doesn't reach; a piece equal to one is that token all the same."""
    ranks, pairs = vocabulary(path), merges(path)
    return {t: r for t, r in ranks.items() if len(t) > 1 and _fold_plain([ranks[t[i : i + 1]] for i in range(len(t))], pairs) != [r]}


@lru_cache(maxsize=4)
def _certain(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (left and right id) of the pairs that merge whenever they stand side by side, and what they merge to.

    No pair that ends in their left token or begins with their right one has a
    rank as low, so nothing can take either token first.  For the same reason two such pairs never overlap.
    """
    pairs = merges(path)
    ending: dict[int, int] = {}
    beginning: dict[int, int] = {}
    for (left, right), rank in pairs.items():
        ending[right] = min(ending.get(right, rank), rank)
        beginning[left] = min(beginning.get(left, rank), rank)
    never = 1 << 62
    found = sorted((left << BITS | right, rank) for (left, right), rank in pairs.items() if rank < ending.get(left, never) and rank < beginning.get(right, never))
    return np.array([k for k, _ in found], np.int64), np.array([r for _, r in found], np.int32)


def merge_certain(ids: np.ndarray, piece: np.ndarray, certain: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many pieces one after the other, and the piece of each, after all certain merges."""
    keys, ranks = certain
    while len(keys) and len(ids) > 1:
        key = ids[:-1].astype(np.int64) << BITS | ids[1:]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = np.flatnonzero((keys[at] == key) & (piece[:-1] == piece[1:]))
        if not len(hit):
            break
        ids[hit] = ranks[at[hit]]
        ids, piece = np.delete(ids, hit + 1), np.delete(piece, hit + 1)
    return ids, piece


def merge_long(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same merges over a linked list, for a piece of any length: a heap holds the pairs by rank and place."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    place = n.bit_length()
    heap = [rank << place | i for i, p in enumerate(zip(ids, ids[1:])) if (rank := pairs.get(p)) is not None]
    heapify(heap)
    while heap:
        least = heappop(heap)
        rank, i = least >> place, least & ((1 << place) - 1)
        j = after[i]
        if ids[i] < 0 or j >= n or pairs.get((ids[i], ids[j])) != rank:
            continue  # one of the two has merged since
        ids[i], ids[j] = rank, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (new := pairs.get((rank, ids[k]))) is not None:
                heappush(heap, new << place | i)
        h = before[i]
        if h >= 0 and (new := pairs.get((ids[h], rank))) is not None:
            heappush(heap, new << place | h)
    return [x for x in ids if x >= 0]


@lru_cache(maxsize=4)
def _places(path: str) -> tuple[list[int], list[int]]:
    """The pairs as a sparse matrix whose rows are laid over one another.

    ``shift[left]`` is where a row begins, and ``entries[shift[left] + right]``
    holds left and merged id of a pair, or an impossible left.
    """
    rows: dict[int, list[tuple[int, int]]] = {}
    for (left, right), rank in merges(path).items():
        rows.setdefault(left, []).append((right, rank))
    ids = max(vocabulary(path).values()) + 1
    if ids > MASK:
        raise ValueError(f"ids beyond {MASK}")
    taken = np.zeros(4 * (ids + sum(map(len, rows.values()))), bool)
    shift = np.zeros(ids, np.int64)
    entries = np.full(len(taken), MASK << BITS, np.int64)
    start = 0
    for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        at = np.array([right for right, _ in row])
        if len(row) == 1:
            break  # these fill what is free
        while True:
            offsets = np.arange(start, start + 256)
            fits = ~taken[offsets[:, None] + at[None, :]].any(1)
            if fits.any():
                break
            start += 256
        shift[left] = offsets[fits.argmax()]
        taken[shift[left] + at] = True
        entries[shift[left] + at] = [left << BITS | rank for _, rank in row]
    single = [(left, *row[0]) for left, row in sorted(rows.items()) if len(row) == 1]
    for (left, right, rank), place in zip(single, np.flatnonzero(~taken)[: len(single)]):
        shift[left], entries[place], taken[place] = place - right, left << BITS | rank, True
    return shift.tolist(), entries[: int(np.flatnonzero(taken).max()) + 1].tolist() if taken.any() else []


def merge_ranked(ids: np.ndarray, piece: np.ndarray, shift: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many pieces one after the other, and the piece of each, after all merges (``_places`` as arrays).

    A round merges the leftmost pair of lowest rank in every piece at once; pieces in which none merges are done.
    """
    if not len(entries):
        return ids, piece
    done, none = [], MASK + 1
    while len(ids):
        heads = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        at = shift[ids[:-1]] + ids[1:]
        rank = entries[np.clip(at, 0, len(entries) - 1)] ^ (ids[:-1].astype(np.int64) << BITS)
        pair = (piece[:-1] == piece[1:]) & (at >= 0) & (at < len(entries)) & (rank <= MASK)
        rank = np.append(np.where(pair, rank, none), none)
        least = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), heads)
        merging = least >> 32 < none
        going = np.repeat(merging, np.diff(np.append(heads, len(ids))))
        done.append((ids[~going], piece[~going]))
        hit = least[merging] & 0xFFFFFFFF
        ids = ids.copy()
        ids[hit] = rank[hit]
        going[hit + 1] = False
        ids, piece = ids[going], piece[going]
    if not done:
        return ids, piece
    ids, piece = map(np.concatenate, zip(*done))
    order = np.argsort(piece, kind="stable")
    return ids[order], piece[order]


def _pieces(path: str) -> list[bytes]:
    """Token bytes by id."""
    return [token for token, _ in sorted(vocabulary(path).items(), key=lambda x: x[1])]


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _concatenate(piece: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(piece.__getitem__, ids.tolist()))


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text, and ``ids``: binary, unsigned 32-bit little-endian.

    With ``decoded``, the ids are decoded again in the same task (see ``decode``).

    Null and empty texts have no ids (empty binary).  Repeated rows are encoded
    each; columns of any other name and type are kept, except that columns
    named ``ids`` and, with ``decoded``, ``decoded`` give way to the results.
    Pieces of any length are encoded.  An empty table gives no rows.
    """
    pieces.small_batches(docs.sparkSession)
    results = ["ids", "decoded"] if decoded else ["ids"]
    kept = [c for c in docs.columns if c not in (text_col, *results)]
    shared = docs.sparkSession.sparkContext.broadcast(_pieces(vocabulary_path)) if decoded else None
    # by number, so that no name can clash; a row of new pieces has no document
    packed = F.struct(F.lit(0).alias("none"), *[_named(c).alias(f"c{i}") for i, c in enumerate(kept)]).alias(KEPT)
    words = docs.select(packed, pieces.split(_named(text_col), pattern).alias("words"))
    ranks, whole, pairs, certain = vocabulary(vocabulary_path), whole_pieces(vocabulary_path), merges(vocabulary_path), _certain(vocabulary_path)
    byte_ids = [ranks.get(bytes([b]), -1) for b in range(256)]
    if min(byte_ids) < 0:
        raise ValueError("the vocabulary lacks single bytes")
    document = T.StructField(KEPT, words.schema[KEPT].dataType)
    table = np.array(byte_ids, dtype=np.int32)
    shift, entries = (np.array(x, np.int64) for x in _places(vocabulary_path))

    def merged(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces one after the other, and how many each has."""
        sizes = np.array([len(w) for w in some])
        ids, piece = table[np.frombuffer(b"".join(some), np.uint8)], np.repeat(np.arange(len(some)), sizes)
        done = {i: [whole[w]] if w in whole else merge_long([byte_ids[b] for b in w], pairs) for i, w in enumerate(some) if len(w) >= LONG or w in whole}
        if done:
            lists = [done.get(i, ids[e - n : e]) for i, (e, n) in enumerate(zip(np.cumsum(sizes), sizes))]
            ids, piece = np.concatenate(lists).astype(np.int32), np.repeat(np.arange(len(some)), [len(x) for x in lists])
        ids, piece = merge_ranked(*merge_certain(ids, piece, certain), shift, entries)
        return ids.astype("<u4"), np.bincount(piece, minlength=len(some)).astype(np.int64)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of the documents, gathered from those of their pieces; each piece that isn't remembered is merged once for its group."""
        of: dict[str, int] = {}
        values, starts, sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for group in pieces.groups(batches, "words", GROUP_PIECES):
            words, index, counts = pieces.distinct(group.column("words"))
            words = words.to_pylist()
            if len(of) + len(words) > KNOWN_PIECES:
                of.clear()
                values, starts, sizes = values[:0], starts[:0], sizes[:0]
            new = [w.encode() for w in words if w not in of]
            for w in words:
                of.setdefault(w, len(of))
            found = [merged(new[at : at + ROW_PIECES]) for at in range(0, len(new), ROW_PIECES)]
            if found:
                ids, n = (np.concatenate(x) for x in zip(*found))
                starts, sizes = np.concatenate([starts, len(values) + np.cumsum(n) - n]), np.concatenate([sizes, n])
                values = np.concatenate([values, ids])
            number = np.fromiter((of[w] for w in words), np.int32, len(words))
            places = number[index] if len(words) else index
            part = group.column(KEPT).combine_chunks()
            keys = pa.concat_arrays(part.chunks) if isinstance(part, pa.ChunkedArray) else part
            at, held, size = 0, [], 0

            def out() -> pa.RecordBatch:
                columns = [held, [_concatenate(shared.value, np.frombuffer(x, "<u4")) for x in held]] if decoded else [held]
                return pa.RecordBatch.from_arrays([keys.slice(at, len(held)), *(pa.array(c, pa.binary()) for c in columns)], names=[KEPT, *results])

            for ids in pieces.gather(places, counts, values, starts, sizes):
                held.append(ids.tobytes())
                size += len(held[-1])
                if size > 1 << 22 or len(held) == pieces.BATCH_DOCS:
                    yield out()
                    at, held, size = at + len(held), [], 0
            if held:
                yield out()

    encoded = words.mapInArrow(tokens, T.StructType([document, *(T.StructField(c, T.BinaryType()) for c in results)]))
    return encoded.select(*[F.col(KEPT)[f"c{i}"].alias(c) for i, c in enumerate(kept)], *results)


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """Adds ``decoded``: the binary pieces of ``ids``, concatenated.  Null ids decode to nothing; an unknown id raises."""
    plain = [_named(c) for c in encoded.columns if c != "decoded"]
    schema = T.StructType([*encoded.select(*plain).schema.fields, T.StructField("decoded", T.BinaryType())])
    shared = encoded.sparkSession.sparkContext.broadcast(_pieces(vocabulary_path))  # the vocabulary file: a fixed size

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_concatenate(shared.value, np.frombuffer(ids.as_buffer(), dtype="<u4")) if ids.is_valid and ids.as_buffer().size else b"" for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.select(*plain).mapInArrow(join, schema)


def op4_bpe(spark, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes of every whole text of ``documents``."""
    import public_tokenizers
    path = vocabulary_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
