"""Token ids of every text by a public byte-level BPE vocabulary.

Method. A text is cut by the vocabulary's pattern. Each piece becomes a doubly linked list of byte symbols, and a
priority queue of merge ranks is worked off, skipping entries whose symbols have since changed. Pieces repeat, so
their ids are kept per worker. Decoding concatenates the vocabulary's strings.

Defined results: NULL and empty texts have an empty list. Special tokens are ordinary text. Very long pieces cost
n log n. Unpaired surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.runtime import spread

#: Fixed value: the pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the public vocabularies lie unless told otherwise.
VOCABULARIES = "/opt/tokenizers"
#: Pieces kept per worker, of at most KEEP_CHARS each: a bound of memory, not of what is encoded.
KEEP, KEEP_CHARS = 400_000, 40


class Bpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.strings = {i: b for b, i in ranks.items()}
        self.cut = regex.compile(PATTERN).findall
        self.kept: dict[str, tuple[int, ...]] = {}

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        sym: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            r = ranks.get(data[i : i + 2])
            if r is not None:
                queue.append((r, i, data[i : i + 2]))
        heapq.heapify(queue)
        while queue:
            _, i, joined = heapq.heappop(queue)
            a = sym[i]
            if a is None:
                continue
            j = right[i]
            # Stale: the left symbol has grown, or its right neighbour is another one by now.
            if j >= n or a + sym[j] != joined:
                continue
            sym[i], sym[j] = joined, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                both = joined + sym[k]
                r = ranks.get(both)
                if r is not None:
                    heapq.heappush(queue, (r, i, both))
            h = left[i]
            if h >= 0:
                both = sym[h] + joined
                r = ranks.get(both)
                if r is not None:
                    heapq.heappush(queue, (r, h, both))
        return [ranks[s] for s in sym if s is not None]

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        self.extend(out, text)
        return out.tolist()

    def extend(self, out: array, text: str | None) -> None:
        if not text:
            return
        kept, add = self.kept, out.extend
        for p in self.cut(text):
            ids = kept.get(p)
            if ids is None:
                ids = array("i", self.piece(p.encode("utf-8", "replace")))
                if len(p) <= KEEP_CHARS:
                    if len(kept) >= KEEP:
                        kept.clear()
                    kept[p] = ids
            add(ids)

    def decode(self, ids) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


@lru_cache(4)
def load(path: str) -> Bpe:
    """A vocabulary from a rank file: a base64 string and a rank on each line."""
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if b})


def encode_column(df: DataFrame, row_id: str, text: str, vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken", into: str = "ids") -> DataFrame:
    """row_id and the ids of its text, one row for each row of `df`; no shuffle of a table of many parts. `vocabulary` must be readable on
    every executor."""
    schema = f"`{row_id}` {df.schema[row_id].dataType.simpleString()}, `{into}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in batches:
            ids, ends = array("i"), array("i", [0])
            for t in b.column(1).to_pylist():
                bpe.extend(ids, t)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[row_id, into])

    return spread(df.select(row_id, F.col(text))).mapInArrow(run, schema)


def decode_column(df: DataFrame, row_id: str, ids: str, vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken", into: str = "text") -> DataFrame:
    """row_id and the text that its ids stand for; a NULL list gives an empty text."""
    schema = f"`{row_id}` {df.schema[row_id].dataType.simpleString()}, `{into}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], names=[row_id, into])

    return df.select(row_id, F.col(ids)).mapInArrow(run, schema)
