"""Passages of held-out items in documents, found by greedy string tiling.

Items become numbers of words, and hashes of all runs of `min_words` words (Karp-Rabin). Documents are scanned in Arrow
batches: a rolling hash over the word numbers is joined with the seeds of the items. Of the seeds on one diagonal only the
first is kept, found from groups of equal runs, so that a text and an item of one repeated word make few seeds and not all
pairs of runs; its match is extended by comparing running hashes. The longest matches are marked first, each only where
neither side is marked yet and compared word for word. So passages come out whole also where their order was changed.
Documents are neither shuffled nor collected.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.common import slices, spread, stored
from quire.llm.words import MARK, words

MIN_WORDS = 12
#: Bytes of item text that are broadcast at once; a larger set of items is worked off in blocks of about so much.
BLOCK_BYTES = 32 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(numbers: np.ndarray) -> np.ndarray:
    x = numbers.astype(np.int64).view(np.uint64) + np.uint64(8)
    x = (x ^ (x >> np.uint64(7))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(31))


def run_hashes(numbers: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of `k` numbers, modulo 2^64."""
    n = len(numbers) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = _mixed(numbers)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _BASE + x[i : i + n]
    return out


def powers(n: int) -> np.ndarray:
    """_BASE^0 .. _BASE^(n-1), modulo 2^64."""
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def running(numbers: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Sums of mixed number times power before each place; a run's part of them is its hash times a power."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(numbers) * power[: len(numbers)], dtype=np.uint64)])


class Items:
    """Seeds of a block of items. `numbers` are the words of all items, each followed by -3; `places` those of the runs with hash
    `hashes[g]` are `places[bounds[g] : bounds[g + 1]]`, in order."""

    def __init__(self, rows: list[tuple[int, str]], k: int):
        self.k, self.vocabulary, self.ids, sizes, parts = k, {}, [], [], []
        for item_id, text in rows:
            parts.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words((text or "").replace(MARK, " "))] + [-3], np.int64))
            self.ids.append(item_id)
            sizes.append(len(parts[-1]) - 1)
        self.sizes = np.array(sizes, np.int64)
        self.numbers = np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes + 1)])[: len(rows)].astype(np.int64)
        known = np.concatenate([[0], np.cumsum(self.numbers >= 0)])
        at = np.flatnonzero(known[k:] - known[:-k] == k) if len(self.numbers) >= k else np.zeros(0, np.int64)
        h = run_hashes(self.numbers, k)[at]
        order = np.argsort(h, kind="stable")
        self.places = at[order]
        self.hashes, first = np.unique(h[order], return_index=True)
        self.bounds = np.concatenate([first, [len(at)]]).astype(np.int64)


def first_seeds(starts: np.ndarray, groups: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in the text, place in the items) of equal runs that are first on their diagonal. `groups`: of which hash the run at
    each of `starts` is. A pair is not first if the run before is of a group that has the place before; which places of a group
    remain depends on the two groups only, so it is found once for each two that follow each other."""
    none = len(items.hashes)
    before = np.full(len(starts), none)
    follows = np.flatnonzero(np.diff(starts) == 1) + 1
    before[follows] = groups[follows - 1]
    codes, which = np.unique(before * (none + 1) + groups, return_inverse=True)
    left = []
    for code in codes.tolist():
        b, g = divmod(code, none + 1)
        places = items.places[items.bounds[g] : items.bounds[g + 1]]
        if b != none:
            places = places[~np.isin(places - 1, items.places[items.bounds[b] : items.bounds[b + 1]], assume_unique=True)]
        left.append(places)
    count = np.array([len(x) for x in left])
    offset = np.concatenate([[0], np.cumsum(count)])
    n = count[which]
    at = np.repeat(starts, n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    flat = np.concatenate([*left, np.zeros(0, np.int64)]).astype(np.int64)
    return at, flat[np.repeat(offset[which], n) + inner]


def lengths(at: np.ndarray, place: np.ndarray, text: np.ndarray, item: np.ndarray, k: int) -> np.ndarray:
    """How many words from `at` in the text and from `place` in the items are equal, given that `k` are: by halving over running
    hashes."""
    power = powers(max(len(text), len(item)) + 1)
    a, b = running(text, power), running(item, power)
    low, high = np.full(len(at), k), np.minimum(len(text) - at, len(item) - place)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = (a[at + mid] - a[at]) * power[place] == (b[place + mid] - b[place]) * power[at]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def tile(text: np.ndarray, item: np.ndarray, at: np.ndarray, place: np.ndarray, n: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (position in `text`, position in `item`, length) of the tiles of `k` words or more.

    `at`, `place`, `n`: matches that cannot be longer. Of equally long ones the first in the text goes first, then the one whose
    diagonal is first."""
    heap = [(-int(c), int(t), int(t - p)) for t, p, c in zip(at, place, n, strict=True)]
    heapq.heapify(heap)
    used_text, used_item, tiles = np.zeros(len(text), bool), np.zeros(len(item), bool), []
    free = min(len(text), len(item))
    while heap and free >= k:
        n, t, d = heapq.heappop(heap)
        n = -n
        taken = used_text[t : t + n] | used_item[t - d : t - d + n]
        if not taken.any():
            differ = np.flatnonzero(text[t : t + n] != item[t - d : t - d + n])
            if len(differ):  # equal hashes of different words: what is equal on either side goes back
                for a, b in zip(np.concatenate([[0], differ + 1]), np.concatenate([differ, [n]]), strict=True):
                    if b - a >= k:
                        heapq.heappush(heap, (-int(b - a), t + int(a), d))
                continue
            tiles.append((t, t - d, n))
            used_text[t : t + n] = used_item[t - d : t - d + n] = True
            free -= n
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a >= k:
                heapq.heappush(heap, (-int(b - a), t + int(a), d))
    return tiles


def scan_batch(texts: list[str | None], items: Items) -> list[tuple[int, int, int, int, int]]:
    """(document, item, tiles, words in tiles, longest tile) of each pair with a tile; documents and items by position."""
    k, get = items.k, items.vocabulary.get
    found = words(MARK.join((t or "").replace(MARK, " ") for t in texts))
    # unknown words -1, the mark between documents -2
    numbers = np.array([-2 if w == MARK else get(w, -1) for w in found], np.int64)
    if len(numbers) < k or not len(items.hashes):
        return []
    known = np.concatenate([[0], np.cumsum(numbers >= 0)])
    starts = np.flatnonzero(known[k:] - known[:-k] == k)
    h = run_hashes(numbers, k)[starts]
    group = np.minimum(np.searchsorted(items.hashes, h), len(items.hashes) - 1)
    hit = items.hashes[group] == h
    starts, group = starts[hit], group[hit]
    if not len(starts):
        return []
    at, place = first_seeds(starts, group, items)
    n = lengths(at, place, numbers, items.numbers, k)
    ends = np.flatnonzero(numbers == -2)
    doc = np.searchsorted(ends, at)
    begin = np.concatenate([[0], ends + 1])
    of = np.searchsorted(items.begins, place, "right") - 1
    pair = doc * len(items.ids) + of
    order = np.argsort(pair, kind="stable")
    out = []
    for part in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1):
        d, i = int(doc[part[0]]), int(of[part[0]])
        stop = ends[d] if d < len(ends) else len(numbers)
        first = items.begins[i]
        tiles = tile(numbers[begin[d] : stop], items.numbers[first : first + items.sizes[i]], at[part] - begin[d], place[part] - first, n[part], k)
        if tiles:
            out.append((d, i, len(tiles), sum(t[2] for t in tiles), max(t[2] for t in tiles)))
    return out


def leaks(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, min_coverage: float = 0.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item that share a run of `min_words` words: `doc_id`, `item_id`, `tiles`, `words`,
    `longest`, `coverage` (share of the item's words that lie in tiles; rows below `min_coverage` are dropped).

    Words are compared without case, markup, references and punctuation. Null and empty texts share nothing, nor do items of
    fewer than `min_words` words. Repeated rows of documents or items give repeated rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    small = items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text"))
    size = small.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    rows = spread(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    schema = f"doc_id {kind}, item_id {item_kind}, tiles int, words int, longest int, coverage double"
    out = None
    for b in range(blocks):
        block = small if blocks == 1 else small.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        held = spark.sparkContext.broadcast(Items([tuple(r) for r in block.collect()], min_words))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                got = scan_batch(batch.column(1).to_pylist(), held.value)
                if got:
                    d, i, n, w, longest = (np.array(x) for x in zip(*got, strict=True))
                    size = held.value.sizes[i]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(d)), pa.array([held.value.ids[x] for x in i]), pa.array(n, pa.int32()), pa.array(w, pa.int32()), pa.array(longest, pa.int32()), pa.array(w / size)],
                        ["doc_id", "item_id", "tiles", "words", "longest", "coverage"],
                    )

        part = rows.mapInArrow(run, schema)
        if blocks > 1:  # one block of items is held at a time
            part = stored(part, "leaks")
            held.unpersist()
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("coverage") >= min_coverage)
