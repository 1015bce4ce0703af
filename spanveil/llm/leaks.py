"""Documents that contain passages of held-out test items.

Method. Texts are folded to lower-case words (look-alike letters, accents, invisible characters, punctuation and
line marks do not count). Characters q-grams shared with an item are counted in overlapping diagonal bands; by the
q-gram lemma, a passage of PASSAGE words with at most EDITS words exchanged, added or left out keeps a known number
of q-grams on one band, so only bands that reach it are kept. They are verified by banded alignment of the words.

The items are a stated query set. Passages that several items share (a prompt template) stand in the index once, with
the list of their items, so a template costs one search and not one for each item. The items are held in blocks of
bounded size, each block against all documents; the documents are not shuffled, unless there are fewer parts of them
than cores. A Python worker builds the index of a block once. Hits are expanded in slices of bounded size.

Defined results: NULL and empty texts and items match nothing. An item shorter than a passage must be there whole and
unedited; one of under four letters and digits is no evidence. Repeated rows give one row.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanveil.llm.lookalike import ALIKE, tables
from spanveil.runtime import spread

#: Lengths of q-grams tried for an item: the longest that leaves its passages at least one shared q-gram.
QS = (18, 9, 4)
PASSAGE = 12
EDITS = 1
#: Width of a diagonal band in characters; bands overlap by half.
BAND = 48
#: Words that the alignment may drift from the band's diagonal.
DRIFT = 7
#: Characters of items in one block, each block being one more scan of the documents. The index of a block takes about
#: forty bytes for each character that stands in a passage of its own.
BLOCK_CHARS = 8_000_000
#: Hits expanded at once, each about a hundred bytes.
SLICE = 1_000_000
#: Characters of documents looked at in one go.
CHUNK_CHARS = 1_000_000


@lru_cache(1)
def fold_table() -> np.ndarray:
    """For each code point the folded character, 32 for what parts words, 0 for what vanishes. Shapes are taken
    together over both cases (as B and the Cyrillic Ve are alike, so are their small letters here)."""
    alike: dict[int, int] = {}
    for row in ALIKE.strip().splitlines():
        latin, *others = row.split()
        for o in others:
            alike[ord(o.lower())] = ord(latin.lower())
    out = np.full(0x30001, 32, np.uint32)
    gone = tables()[0]
    for cp in range(0x30000):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cp in gone and gone[cp] is None or cat in ("Mn", "Me"):
            out[cp] = 0
        elif cat[0] in "LN":
            base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)).lower()[:1] or ch
            out[cp] = alike.get(ord(base), ord(base)) if base.isalnum() else 32
    out[0] = 1  # parts documents
    return out


def fold(text: str) -> np.ndarray:
    """Folded characters, words parted by one 32; 1 where the text had NUL."""
    cps = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    a = fold_table()[np.minimum(cps, 0x30000)]
    a = a[a != 0]
    space = a == 32
    return a[~(space & np.concatenate([[False], space[:-1]]))]


def grams(a: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit value for the q-gram at each position."""
    n = len(a) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = a.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h *= np.uint64(0x100000001B3)
        h += x[k : k + n]
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h


def words_of(a: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Words and the positions where they start."""
    part = a <= 32
    starts = np.flatnonzero(~part & np.concatenate([[True], part[:-1]]))
    return a.astype(np.uint32).tobytes().decode("utf-32-le").replace("\x01", " ").split(), starts


class Index:
    """Postings of the q-grams of items that share one q, over the distinct passages of the items.

    Items are cut into segments that hold each distinct passage (PASSAGE words, or a whole shorter item) once: words whose
    passages all stood in earlier segments are not indexed again. `owners` lists the items of each passage.
    """

    def __init__(self, items: list[tuple[object, list[str]]], q: int):
        self.q = q
        self.ids = [i for i, _ in items]
        self.words: list[list[str]] = []
        #: For each segment, the place of its first passage among all passages.
        self.passage: list[int] = []
        known: dict[str, int] = {}
        owners: list[list[int]] = []
        for k, (_, words) in enumerate(items):
            size = min(PASSAGE, len(words))
            fresh_from = None
            for s in range(len(words) - size + 1):
                key = " ".join(words[s : s + size])
                at = known.get(key)
                if at is None:
                    at = known[key] = len(owners)
                    owners.append([k])
                    if fresh_from is None:
                        fresh_from = s
                        self.passage.append(at)
                else:
                    if owners[at][-1] != k:
                        owners[at].append(k)
                    if fresh_from is not None:
                        self.words.append(words[fresh_from : s - 1 + size])
                        fresh_from = None
            if fresh_from is not None:
                self.words.append(words[fresh_from:])
        # Passages of the same items share one list.
        lists: dict[tuple[int, ...], int] = {}
        self.owner = np.array([lists.setdefault(tuple(x), len(lists)) for x in owners], np.int64)
        self.lists = [np.array(x, np.int64) for x in lists]
        keys, segment, pos = [], [], []
        self.starts, bound = [], []
        for k, words in enumerate(self.words):
            a = np.frombuffer(" ".join(words).encode("utf-32-le"), np.uint32)
            self.starts.append(words_of(a)[1])
            bound.append(_least_shared(words, q))
            h = grams(a, q)
            keys.append(h)
            segment.append(np.full(len(h), k, np.int32))
            pos.append(np.arange(len(h), dtype=np.int32))
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.segment = np.concatenate(segment)[order] if segment else np.zeros(0, np.int32)
        self.pos = np.concatenate(pos)[order] if pos else np.zeros(0, np.int32)
        self.bound = np.array(bound, np.int64)
        #: Characters of the longest passage of any item.
        self.reach = max((_longest(w) for w in self.words), default=1)
        bits = 22
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self.keys >> self.shift] = True

    def find(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """(place in texts, place in ids) of what leaked."""
        a = fold("\x00".join(t.replace("\x00", " ") for t in texts))
        edges = np.concatenate([[-1], np.flatnonzero(a == 1), [len(a)]])
        h = grams(a, self.q)
        at = np.flatnonzero(self.seen[h >> self.shift])
        k = np.searchsorted(self.keys, h[at])
        k[k == len(self.keys)] = 0
        good = self.keys[k] == h[at] if len(self.keys) else np.zeros(0, bool)
        at, k = at[good], k[good]
        if not len(at):
            return
        # Whatever the item, a passage brings its least number of q-grams within its length: sparse hits go first.
        ahead = np.searchsorted(at, at + self.reach)
        dense = ahead - np.arange(len(at)) >= self.bound.min()
        cover = np.zeros(len(at) + 1, np.int64)
        np.add.at(cover, np.flatnonzero(dense), 1)
        np.add.at(cover, ahead[dense], -1)
        kept = np.cumsum(cover)[:-1] > 0
        at, k = at[kept], k[kept]
        if not len(at):
            return
        doc = np.searchsorted(edges, at, side="left") - 1
        # Slices end between documents; a document of more hits than a slice is gone through by ranges of segments.
        total = np.cumsum(self.count[k])
        begins = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(at)]])
        lo = 0
        while lo < len(begins) - 1:
            base = total[begins[lo] - 1] if begins[lo] else 0
            hi = lo + 1
            while hi < len(begins) - 1 and total[begins[hi + 1] - 1] - base <= SLICE:
                hi += 1
            part = slice(begins[lo], begins[hi])
            hits = int(total[begins[hi] - 1] - base)
            yield from self._matched(a, edges, at[part], k[part], doc[part], -(-hits // SLICE))
            lo = hi

    def _postings(self, k: np.ndarray, share: int, shares: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in k, posting) of every posting of the q-grams k whose segment falls into this share."""
        if shares == 1:
            n = self.count[k]
            return np.repeat(np.arange(len(k)), n), np.repeat(self.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        low, high = (len(self.words) * x // shares for x in (share, share + 1))
        # The postings of a q-gram lie by segment, so a share is a range of each.
        distinct, back = np.unique(k, return_inverse=True)
        ends = [np.searchsorted(self.segment[f : f + c], (low, high)) + f for f, c in zip(self.first[distinct].tolist(), self.count[distinct].tolist())]
        first, last = np.array(ends, np.int64).reshape(-1, 2)[back].T
        n = last - first
        return np.repeat(np.arange(len(k)), n), np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def _matched(self, a: np.ndarray, edges: np.ndarray, at: np.ndarray, k: np.ndarray, doc: np.ndarray, shares: int) -> Iterator[tuple[int, int]]:
        done: dict[int, set[int]] = {}
        doc_words: dict[int, tuple[dict[str, list[int]], np.ndarray]] = {}
        for share in range(shares):
            reps, post = self._postings(k, share, shares)
            if not len(reps):
                continue
            for x, passages in self._aligned(a, edges, at[reps], doc[reps], self.segment[post].astype(np.int64), self.pos[post].astype(np.int64), doc_words):
                lists = done.setdefault(x, set())
                lists.update(self.owner[passages].tolist())
        for x, lists in done.items():
            for y in np.unique(np.concatenate([self.lists[i] for i in lists])).tolist():
                yield x, y

    def _aligned(self, a, edges, at, doc, segment, pos, doc_words) -> Iterator[tuple[int, list[int]]]:
        """(document, passages) for the bands that hold enough q-grams and stand the alignment."""
        # A document and a segment need the segment's least number of q-grams, and a word that a passage can end with
        # and one it can begin with: most segments that share a template with the document leave here.
        pair = doc * len(self.words) + segment
        pairs, n = np.unique(pair, return_counts=True)
        good = n >= self.bound[pairs % len(self.words)]
        good[good] = [self._ends(a, edges, *divmod(x, len(self.words)), doc_words) for x in pairs[good].tolist()]
        if not good.any():
            return
        keep = good[np.searchsorted(pairs, pair)]
        at, doc, segment, pos = at[keep], doc[keep], segment[keep], pos[keep]
        half = BAND // 2
        band = (at - edges[doc] - 1 - pos) // half
        doc, segment, band, place = _sorted(*(np.concatenate([x, y]) for x, y in ((doc, doc), (segment, segment), (band, band - 1), (pos, pos))))
        group = np.cumsum(np.concatenate([[True], (doc[1:] != doc[:-1]) | (segment[1:] != segment[:-1]) | (band[1:] != band[:-1])]))
        # Hits of the same band within the length of a passage, from each hit on.
        line = group * (1 << 34) + place
        shared = np.searchsorted(line, line + self.reach) - np.arange(len(line))
        keep = np.flatnonzero(shared >= self.bound[segment])
        if not len(keep):
            return
        last = np.concatenate([np.flatnonzero(np.diff(group[keep])), [len(keep) - 1]])
        first = np.concatenate([[0], last[:-1] + 1])
        for f, g in zip(keep[first].tolist(), keep[last].tolist()):
            x, y, b = int(doc[f]), int(segment[f]), int(band[f])
            lo, hi = np.searchsorted(self.starts[y], (place[f] - self.reach // 2, place[g] + self.reach + self.reach // 2)).tolist()
            got = aligned(self.words[y], self.starts[y], lo, hi, *doc_words[x], (b + 1) * half)
            if got:
                yield x, [self.passage[y] + p for p in got]

    def _ends(self, a: np.ndarray, edges: np.ndarray, x: int, y: int, doc_words: dict) -> bool:
        if x not in doc_words:
            words, starts = words_of(a[edges[x] + 1 : edges[x + 1]])
            where: dict[str, list[int]] = {}
            for j, w in enumerate(words):
                where.setdefault(w, []).append(j)
            doc_words[x] = where, starts
        has, words = doc_words[x][0].__contains__, self.words[y]
        size = min(PASSAGE, len(words))
        return any(map(has, words[size - 1 :])) and any(map(has, words[: len(words) - size + 1]))


def _sorted(*columns: np.ndarray) -> list[np.ndarray]:
    """Columns of whole numbers sorted by the first, then the second and so on; as one number each where that fits."""
    low = [int(c.min()) for c in columns]
    size = [int(c.max()) - x + 1 for c, x in zip(columns, low)]
    if math.prod(size) >= 1 << 62:
        order = np.lexsort(columns[::-1])
        return [c[order] for c in columns]
    key = np.zeros(len(columns[0]), np.int64)
    for c, x, n in zip(columns, low, size):
        key = key * n + (c - x)
    key.sort()
    out = []
    for x, n in zip(low[::-1], size[::-1]):
        key, rest = np.divmod(key, n)
        out.append(rest + x)
    return out[::-1]


def _longest(words: list[str]) -> int:
    size = min(PASSAGE, len(words))
    return max(sum(map(len, words[s : s + size])) + size for s in range(len(words) - size + 1))


def _least_shared(words: list[str], q: int) -> int:
    """The q-gram lemma's bound: of a passage's q-grams, those that no EDITS words can touch; of a short item, all."""
    size = min(PASSAGE, len(words))
    edits = EDITS if size == PASSAGE else 0
    best = None
    for s in range(len(words) - size + 1):
        w = sorted(len(x) for x in words[s : s + size])
        left = sum(w) + size - 1 - q + 1 - sum(x + q for x in w[size - edits :])
        best = left if best is None else min(best, left)
    return best or 0


def indexes(items: list[tuple[object, str]]) -> list[Index]:
    """One index for each q in use. An item of fewer characters than the smallest q is no evidence and left out."""
    by_q: dict[int, list[tuple[object, list[str]]]] = {}
    for item_id, text in items:
        words = words_of(fold(text.replace("\x00", " ")))[0]
        q = next((q for q in QS if words and _least_shared(words, q) >= 1), None)
        if q:
            by_q.setdefault(q, []).append((item_id, words))
    return [Index(x, q) for q, x in by_q.items()]


def aligned(item: list[str], item_starts: np.ndarray, lo: int, hi: int, where: dict[str, list[int]], doc_starts: np.ndarray, diagonal: int) -> list[int]:
    """The passages among the item's words lo to hi (by their first words) that stand in the document, within DRIFT words
    of where the diagonal leads: alignment over the equal words of the band, with at most one single word exchanged, added
    or left out in a stretch of PASSAGE words."""
    size = min(PASSAGE, len(item))
    expect = np.searchsorted(doc_starts, item_starts[lo:hi] + diagonal).tolist()
    # For the equal words (i, j): first word of the longest chain that ends here without an edit, and with one.
    rows: list[dict[int, tuple[int, int]]] = [{}, {}]
    out: set[int] = set()
    for i in range(lo, hi):
        now: dict[int, tuple[int, int]] = {}
        at = where.get(item[i])
        if at is not None:
            one, two = rows[-1], rows[-2]
            mid = expect[i - lo]
            for k in range(bisect_left(at, mid - DRIFT), len(at)):
                j = at[k]
                if j > mid + DRIFT:
                    break
                plain = edited = i
                if j - 1 in one:
                    plain, edited = one[j - 1]
                for near, back in ((one, j - 2), (two, j - 1), (two, j - 2)):
                    if back in near and size == PASSAGE:
                        edited = min(edited, near[back][0])
                w = i - size + 1
                if plain <= w or edited <= w and (w < plain - 1 or j - i + plain - 2 in where.get(item[w], ())):
                    # All of the passage from word w on but one edit inside it, its first word being there.
                    out.add(w)
                now[j] = plain, edited
        rows = [rows[-1], now]
    return sorted(out)


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, str]]]:
    block, chars = [], 0
    for r in items.where(F.col(text) != "").select(item_id, text).toLocalIterator():
        if block and chars + len(r[1]) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((r[0], r[1]))
        chars += len(r[1])
    if block:
        yield block


def leaked(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """item_id, doc_id: the documents that hold the item or a passage of it."""
    schema = f"item_id {items.schema[item_id].dataType.simpleString()}, doc_id {docs.schema[doc_id].dataType.simpleString()}"
    rows = spread(docs.where(F.col(text) != "").select(doc_id, text))
    sc = docs.sparkSession.sparkContext
    out = None
    for block in _blocks(items, item_id, item_text):
        shared = sc.broadcast(block)
        part = rows.mapInArrow(_search(shared, to_arrow_type(items.schema[item_id].dataType)), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out.distinct()


#: Indexes of the blocks that this Python worker has built, by the number of their broadcast: the last few.
_BUILT: dict[object, list[Index]] = {}


def _built(shared) -> list[Index]:
    key = getattr(shared, "_jid", None) or id(shared)
    key = (key, len(shared.value), shared.value[0][0], shared.value[-1][0])
    if key not in _BUILT:
        while len(_BUILT) >= 2:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[key] = indexes(shared.value)
    return _BUILT[key]


def _search(shared, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _built(shared)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= CHUNK_CHARS):
                    chars += len(texts[end])
                    end += 1
                for index in built:
                    found = list(index.find(texts[at:end]))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([index.ids[y] for _, y in found], id_type), ids.take(pa.array([at + x for x, _ in found]))], names=["item_id", "doc_id"])
                at = end

    return run
