"""Cost-balanced packing of documents into training sequences.

A piece of L tokens costs ``linear * L + quadratic * L * L``: attention inside a piece is quadratic,
everything else linear. Documents are cut into full sequences first; what is left of each is assigned
in descending order to the sequence of lowest cost that still has room for it, among all of the block. A
piece for which none has room is cut to fill the roomiest sequences. The tokens of a block that do not fill whole sequences go into
sequences whose lengths are powers of two, which need no padding.

A block is up to ``BLOCK_TOKENS`` tokens of consecutive documents of one partition, so packing needs no
shuffle, its memory is bounded, and a lost executor's blocks are packed again to the same result.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, vocabulary_path
from .words import tidy

BLOCK_TOKENS = 2_000_000
_ODD = re.compile("[^\t\n\r -~À-ſ¡¿«»–—‘’“”…€]")
_EDGE = 200_000


class Encoder:
    """Ids of a byte-level vocabulary file, special strings inside texts read as the library reads them.

    Texts of common Latin characters go through the faster library over the same ranks (the tests hold
    the two against each other); all others, and very long ones, through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        import public_tokenizers

        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if len(text) > _EDGE or _ODD.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pack_lengths(lengths: np.ndarray, size: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces (document, start, length, sequence) of one block, in the order they stand in their sequences.

    Full pieces of ``size`` get sequences of their own. Ties go to the document that comes first and to
    the sequence opened first. Documents of no tokens get no piece.
    """
    cost = lambda n: linear * n + quadratic * n * n
    whole = lengths // size
    doc = np.repeat(np.arange(len(lengths)), whole)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)) * size
    seq = np.arange(len(doc))
    rest = lengths - whole * size
    order = np.argsort(-rest, kind="stable")
    order = order[rest[order] > 0]
    total = int(rest.sum())
    bins = total // size
    tail = total - bins * size
    room = [size] * bins
    base = len(doc)
    # the tail's sequences: one for each power of two in it, never opened for balance
    tails = [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]
    room += tails
    # lengths descend, so a sequence with room for one document has room for all that follow: those are in
    # ``heap`` by cost, and the others wait in ``parked``, the roomiest first, until the lengths come down to them
    heap = [(0.0, b) for b in range(bins)]
    parked: list[tuple[int, int, float]] = []
    out: list[tuple[int, int, int, int]] = []
    left: list[tuple[int, int, int]] = []
    for d in order:
        n = int(rest[d])
        while parked and -parked[0][0] >= n:
            _, b, c = heapq.heappop(parked)
            heapq.heappush(heap, (c, b))
        if not heap:
            left.append((d, int(whole[d]) * size, n))
            continue
        c, b = heapq.heappop(heap)
        out.append((d, int(whole[d]) * size, n, b))
        room[b] -= n
        if room[b] >= n:
            heapq.heappush(heap, (c + cost(n), b))
        elif room[b]:
            heapq.heappush(parked, (-room[b], b, c + cost(n)))
    free = [b for b in sorted(range(len(room)), key=lambda b: (-room[b], b)) if room[b]]
    at = 0
    for d, s, n in left:
        while n:
            b = free[at]
            take = min(n, room[b])
            out.append((d, s, take, b))
            room[b] -= take
            s, n = s + take, n - take
            if not room[b]:
                at += 1
    got = np.array(out, np.int64).reshape(-1, 4)
    return (np.concatenate([doc, got[:, 0]]), np.concatenate([start, got[:, 1]]), np.concatenate([np.full(len(doc), size), got[:, 2]]), np.concatenate([seq, got[:, 3] + base]))


@tidy
def _pack(batches, vocabulary: str, end_id: int, size: int, with_ids: bool):
    encode = encoder(vocabulary_path(vocabulary))
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    keys: list = []
    ids: list[np.ndarray] = []
    held = opened = 0

    def flush():
        nonlocal opened, held
        lengths = np.array([len(x) for x in ids], np.int64)
        doc, start, length, seq = pack_lengths(lengths, size)
        order = np.argsort(seq, kind="stable")
        doc, start, length, seq = doc[order], start[order], length[order], seq[order]
        ends = np.cumsum(length)
        first = np.append(True, seq[1:] != seq[:-1]) if len(seq) else np.zeros(0, bool)
        offset = ends - length - np.repeat((ends - length)[first], np.diff(np.append(np.flatnonzero(first), len(seq))))
        pieces = [ids[d][s : s + n].astype("<u4").tobytes() for d, s, n in zip(doc, start, length)]
        cols = [pa.array([keys[d] for d in doc], pa.int64()), start, length, np.array([zlib.crc32(x) for x in pieces], np.int64), lengths[doc], (part << 36) + opened + seq, offset]
        cols += [pa.array(pieces, pa.binary())] * with_ids
        opened += int(seq.max()) + 1 if len(seq) else 0
        keys.clear()
        ids.clear()
        held = 0
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in cols], names)

    end = np.array([end_id], np.uint32)
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.concatenate([encode(text.as_py() or ""), end])
            keys.append(key)
            ids.append(x)
            held += len(x)
            if held >= BLOCK_TOKENS:
                yield flush()
    if keys:
        yield flush()


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 1, size: int = 2048, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ``with_ids`` the ids too.

    Null and empty texts are one piece, the end id. Every row is a document of its own, so rows that
    repeat an id, or have none, are each packed whole. Texts of any length are cut into full sequences.
    Other columns are ignored. No rows give no pieces.
    """
    small_batches(docs.sparkSession)
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(functools.partial(_pack, vocabulary=vocabulary, end_id=end_id, size=size, with_ids=with_ids), kind)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
