"""Token counts by heap-and-linked-list byte-pair merging.

For each word the initial symbols go into a linked list and every adjacent pair that merges goes into
a heap by (rank, place). The lowest is popped, checked against the list, merged, and its two new
neighbour pairs are pushed. The count is symbols minus merges; no token id is made.

Counts follow the library's reading of the vocabulary file: special strings inside a text are one
token each; the rest is normalised (NFC, white space, lower case), split into words and written as
bytes with an end-of-word mark. Texts of common Latin characters take a short path whose rules are
the same; any other text is normalised and split by the library itself.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, vocabulary_path
from .words import tidy

#: Words kept with their counts in one worker; the cache starts anew when full.
CACHE = 300_000
_LETTER = "ß-öø-įĲ-ňŊ-ž"
_ODD = re.compile(f"[^\t\n\r -~À-ÖØ-ß{_LETTER}¡¿«»–—‘’“”…€]")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LETTER}]+|[0-9]|[^\s0-9a-z{_LETTER}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class MergeCounter:
    """Counts tokens of whole texts for one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        self.tail = model["end_of_word_suffix"] or ""
        self.ranks: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[a] << 32 | ids[b]] = (rank, ids[a + b])
        shown = byte_symbols()
        self.inner = [ids[c] for c in shown]
        self.final = [ids[c + self.tail] for c in shown]
        self.byte_of = {c: b for b, c in enumerate(shown)}
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.library = Tokenizer.from_file(path)
        self.cache: dict[str, int] = {}

    def merge(self, raw: bytes) -> int:
        """Tokens of one word, given as bytes."""
        n = len(raw)
        if n < 2:
            return n
        ranks = self.ranks
        sym = [self.inner[b] for b in raw]
        sym[-1] = self.final[raw[-1]]
        heap = []
        for i in range(n - 1):
            hit = ranks.get(sym[i] << 32 | sym[i + 1])
            if hit is not None:
                heap.append((hit[0], i, hit[1], sym[i + 1]))
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        made, pop, push = 0, heapq.heappop, heapq.heappush
        while heap:
            rank, i, new, right = pop(heap)
            j = after[i]
            if j >= n or sym[i] < 0 or sym[j] != right:
                continue
            hit = ranks.get(sym[i] << 32 | right)
            if hit is None or hit[0] != rank:
                continue
            sym[i], sym[j] = new, -1
            made += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                hit = ranks.get(new << 32 | sym[k])
                if hit is not None:
                    push(heap, (hit[0], i, hit[1], sym[k]))
            h = before[i]
            if h >= 0:
                hit = ranks.get(sym[h] << 32 | new)
                if hit is not None:
                    push(heap, (hit[0], h, hit[1], new))
        return n - made

    def _words(self, text: str) -> list[str]:
        if not _ODD.search(text):
            return _WORDS.findall(text.lower())
        norm = self.library.normalizer.normalize_str(text)
        return [bytes(map(self.byte_of.__getitem__, w)).decode("utf-8") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]

    def count(self, text: str) -> int:
        if self.special is not None and "<|" in text:
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        words = self._words(text)
        cache = self.cache
        try:
            return sum(map(cache.__getitem__, words))
        except KeyError:
            pass
        total = 0
        for w in words:
            n = cache.get(w)
            if n is None:
                n = self.merge(w.encode("utf-8"))
                if len(w) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[w] = n
            total += n
        return total


@functools.cache
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


@tidy
def _count(batches, vocabulary: str):
    count = counter(vocabulary_path(vocabulary)).count
    for batch in batches:
        text = batch.column(1)
        size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
        n = [count(x.as_py() or "") for x in text]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), size, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs``; no shuffle.

    Null and empty texts have 0 bytes and 0 tokens. Rows with null or repeated ids are counted like any
    other. Whole texts are counted whatever their length. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(functools.partial(_count, vocabulary=vocabulary), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_bpe_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
