"""Benchmark passages in documents: q-gram lemma filtering and banded alignment.

Texts are lower-cased and every run of other than letters and digits becomes one space. An item of m
characters that a document holds with at most e edits shares at least m - q + 1 - q * e of its q-grams
with the document, all within a band of e + 1 diagonals. So shared q-grams are counted in overlapping
bands of 2 * (e + 1) diagonals, which hold any such window whole; bands that reach the bound are verified
by a banded alignment that gives the edits and the place. e is `EDITS` of m, at most what leaves the
bound above zero.

Shared grams are counted on pairs of a text's and an item's places, at most `PAIRS` of them at a time. A
text that has more with the whole block is counted item by item, and by looking up for each place of the
item and each band whether the gram stands in the text there; this takes time by the lengths of the two,
not by their product, so that text and items of one repeated letter or line stay bounded. No gram and no
band is left out. An alignment takes time by the square of its item's length.

The benchmark is the stated query set: it is read in blocks of at most about `BLOCK_CHARS` characters (or
one longer item), each broadcast in turn; the documents are scanned where they lie and are not shuffled.

Defined results: null and empty texts and items match nothing; an item shorter than q characters counts
only as a whole run of words; repeated rows and null ids give matches of their own; an empty table on
either side gives no match; letters and digits are those of Unicode, so that symbols such as emoji count
as a space; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import slices, small_batches, unused, written

Q, EDITS = 12, 0.06
BLOCK_CHARS = 2_000_000
#: Characters of documents that are scanned at a time.
SCAN_CHARS = 1_000_000
#: Pairs of places, or of places and bands, that are held at a time.
PAIRS = 1_000_000
TABLE_BITS = 22
BASE = 0x9E3779B97F4A7C15
EDGE = np.uint32(0x7FFFFFFF)
#: No code point from here on is a letter or a digit.
PLANE = 0x33480


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    chars = [chr(c) for c in range(PLANE)]
    lower = [x if len(x := c.lower()) == 1 else c for c in chars]
    return np.array([c.isalnum() for c in chars]), np.array([ord(c) for c in lower], np.uint32)


TABLES: list[np.ndarray] = []


def normal(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normal code points and the position of each in codes; EDGE stays as it is."""
    if not TABLES:
        TABLES.extend(letter_tables())
    low = codes < PLANE
    safe = np.where(low, codes, 0)
    keep = np.where(low, TABLES[0][safe], codes == EDGE)
    at = np.flatnonzero(keep | np.r_[False, keep[:-1]])
    kept = keep[at]
    return np.where(kept, np.where(low[at], TABLES[1][safe[at]], codes[at]), np.uint32(32)).astype(np.uint32), at


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of each q-gram, by doubling: of 1, 2, 4 and 8 characters, then of q from two of 8."""
    with np.errstate(over="ignore"):
        h, size = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 1
        while 2 * size <= q:
            h = h[:-size] * np.uint64(BASE) ^ (h[size:] >> np.uint64(29)) + h[size:]
            size *= 2
        if size < q:
            h = h[: -(q - size)] * np.uint64(BASE) ^ (h[q - size :] >> np.uint64(31)) + h[q - size :]
        return h * np.uint64(0xBF58476D1CE4E5B9)


def align(item: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the cheapest place of item in each region; a region has as many columns as item and its diagonals together."""
    big, m = np.int64(1) << 32, len(item)
    width = regions.shape[1] - m
    k = np.arange(width, dtype=np.int64)
    cost = np.repeat(k[None], len(regions), axis=0)  # edits * big + diagonal of the start
    for i in range(m):
        over = cost + (regions[:, i : i + width] != item[i]) * big
        over[:, :-1] = np.minimum(over[:, :-1], cost[:, 1:] + big)
        cost = np.minimum.accumulate(over - k * big, axis=1) + k * big
    end = cost.argmin(axis=1)
    best = cost[np.arange(len(regions)), end]
    return best >> 32, best & 0xFFFFFFFF, m + end


def apart(places: list[tuple]) -> list[tuple]:
    """Of overlapping places (edits, first, end, ..) those with the fewest edits."""
    kept, first, end = [], [], []
    for place in sorted(places, key=lambda p: (*p[:3], -p[3])):
        k = bisect_left(first, place[1])
        if (k == len(first) or place[2] <= first[k]) and (k == 0 or end[k - 1] <= place[1]):
            kept.append(place)
            first.insert(k, place[1])
            end.insert(k, place[2])
    return kept


class Benchmark:
    """The q-grams of a block of items, and each item's edits and bound."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        self.ids, self.codes, self.short = [], [], []
        for key, text in zip(ids, texts, strict=True):
            codes = normal(code_points(text))[0] if text else np.zeros(0, np.uint32)
            codes = codes[int(len(codes) > 0 and codes[0] == 32) : len(codes) - int(len(codes) > 1 and codes[-1] == 32)]
            if len(codes) >= Q:
                self.ids.append(key)
                self.codes.append(codes)
            elif len(codes):
                self.short.append((key, "".join(map(chr, codes))))
        self.m = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.minimum((EDITS * self.m).astype(np.int64), (self.m - Q) // Q)
        self.bound = self.m - Q + 1 - Q * self.edits
        hashes = [grams(c) for c in self.codes]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.item = np.repeat(np.arange(len(hashes)), np.array([len(h) for h in hashes], np.int64))[order].astype(np.int64)
        self.at = (np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64))[order]
        self.grams, self.first = np.unique(flat[order], return_index=True)
        self.count = np.diff(np.r_[self.first, len(flat)])
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.grams >> np.uint64(64 - TABLE_BITS)] = True

    def search(self, texts: list[str]) -> list[tuple]:
        """(row, item_id, start, end, edits, shared) of every match; places in characters of the text."""
        joined = code_points("\0".join(texts)).copy()
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        joined[starts[1:-1] - 1] = EDGE
        codes, where = normal(joined)
        low = np.searchsorted(where, starts[:-1])  # each text's first place in codes
        high = np.r_[low[1:] - 1, len(codes)]
        found = self.short_matches(codes, where, low, high, starts) if self.short else []
        if not self.ids or len(codes) < Q:
            return found
        h = grams(codes)
        pos = np.flatnonzero(self.table[h >> np.uint64(64 - TABLE_BITS)])
        k = np.minimum(np.searchsorted(self.grams, h[pos]), len(self.grams) - 1)
        hit = self.grams[k] == h[pos]
        pos, k = pos[hit], k[hit]
        if not len(pos):
            return found
        doc = np.searchsorted(low, pos, side="right") - 1
        firsts = np.flatnonzero(np.r_[True, np.diff(doc) != 0])
        sums = np.add.reduceat(self.count[k], firsts)
        best: dict[tuple[int, int], list] = {}
        at = 0
        while at < len(firsts):
            end, pairs = at, 0
            while end < len(firsts) and (end == at or pairs + sums[end] <= PAIRS):
                pairs += sums[end]
                end += 1
            some = slice(firsts[at], firsts[end] if end < len(firsts) else len(pos))
            bands = self.bands_of_pairs(doc[some], pos[some], k[some], low) if pairs <= PAIRS else self.bands_by_item(int(doc[some.start]), pos[some], k[some], low)
            self.verify(bands, codes, low, high, best)
            at = end
        for (d, j), places in best.items():
            found += [(d, self.ids[j], int(where[a] - starts[d]), int(where[z - 1] + 1 - starts[d]), cost, n) for cost, a, z, n in apart(places)]
        return found

    def bands_of_pairs(self, doc: np.ndarray, pos: np.ndarray, k: np.ndarray, low: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, band, place of a hit's diagonal, shared grams) of each band that reaches its bound, from all pairs of places."""
        times = self.count[k]
        flat = np.repeat(self.first[k], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        item, at, pos, doc = self.item[flat], self.at[flat], np.repeat(pos, times), np.repeat(doc, times)
        # Diagonals are counted from the text's first place, shifted so as not to be negative.
        step = self.edits[item] + 1
        band = (pos - low[doc] - at + self.m[item]) // step
        doc, item, at, band, pos = (np.r_[x, x] for x in (doc, item, at, band, pos))
        band[len(band) // 2 :] -= 1
        order = np.lexsort((at, band, item, doc))
        doc, item, at, band, pos = doc[order], item[order], at[order], band[order], pos[order]
        group = np.r_[True, (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(band) != 0)]
        fresh = group | np.r_[True, np.diff(at) != 0]
        first = np.flatnonzero(group)
        last = np.r_[first[1:], len(group)]
        shared = np.add.reduceat(fresh.astype(np.int64), first)
        for i in np.flatnonzero(shared >= self.bound[item[first]]):
            middle = (first[i] + last[i]) // 2
            yield int(doc[first[i]]), int(item[first[i]]), int(band[first[i]]), int(pos[middle] - at[middle]), int(shared[i])

    def bands_by_item(self, d: int, pos: np.ndarray, k: np.ndarray, low: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """The same for one text, an item at a time: each place of the item is looked up in the bands of the text."""
        order = np.lexsort((pos, k))
        own, place = np.unique(k[order], return_inverse=True)
        pos = pos[order] - low[d]
        wide = int(pos.max()) + int(self.m.max()) + 2 * int(self.edits.max()) + 4
        keys = place * wide + pos  # sorted: by gram, then by place in the text
        sizes = self.count[own]
        flat = np.repeat(self.first[own], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        gram = np.repeat(np.arange(len(own)), sizes)
        by_item = np.argsort(self.item[flat], kind="stable")
        item, at, gram = self.item[flat][by_item], self.at[flat][by_item], gram[by_item]
        edges = np.flatnonzero(np.r_[True, np.diff(item) != 0, True])
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            j = int(item[a])
            if z - a < self.bound[j]:  # no band can hold more grams than the whole text
                continue
            step, m = int(self.edits[j]) + 1, int(self.m[j])
            ats, bases = at[a:z], gram[a:z] * wide
            last_band = (int(pos.max()) + m) // step
            many = max(1, PAIRS // (z - a))
            for b in range(-1, last_band + 1, many):
                band = np.arange(b, min(b + many, last_band + 1))
                start = np.maximum(ats[:, None] + band * step - m, 0)
                end = ats[:, None] + (band + 2) * step - m
                hit = np.minimum(np.searchsorted(keys, bases[:, None] + start), len(keys) - 1)
                there = (keys[hit] >= bases[:, None] + start) & (keys[hit] < bases[:, None] + end)
                shared = there.sum(axis=0)
                for c in np.flatnonzero(shared >= self.bound[j]):
                    rows = np.flatnonzero(there[:, c])
                    row = rows[len(rows) // 2]
                    yield d, j, int(band[c]), int(low[d] + keys[hit[row, c]] - bases[row] - ats[row]), int(shared[c])

    def verify(self, bands: Iterator[tuple[int, int, int, int, int]], codes: np.ndarray, low: np.ndarray, high: np.ndarray, best: dict) -> None:
        """Add to best, by text and item, the (edits, first, end, shared) of the places that the bands hold."""
        left = []
        for d, j, b, a, shared in bands:
            m = int(self.m[j])
            a = max(int(low[d]), min(a, int(high[d]) - m))  # as near to the hit as the text allows
            if a + m <= high[d] and np.array_equal(codes[a : a + m], self.codes[j]):
                best.setdefault((d, j), []).append((0, a, a + m, shared))
            else:
                left.append((d, j, b, shared))
        done = {key: sorted((p[1], p[2], p[0]) for p in apart(places)) for key, places in best.items()}
        left.sort()
        for (d, j), group in groupby(left, key=lambda t: t[:2]):
            e, m = int(self.edits[j]), int(self.m[j])
            start, stop, width = int(low[d]), int(high[d]), 3 * (e + 1) + e
            # The fewest edits that the shared grams allow come first: what has more is then not looked at beside them.
            bands = sorted((-(-(m - Q + 1 - shared) // Q), start + b * (e + 1) - m - e, shared) for _, _, b, shared in group)
            bands = [t for t in bands if min(stop, t[1] + m + width) - max(start, t[1]) >= m - e]  # else the text ends before the item could
            near, at, many = done.get((d, j), []), 0, 1
            while at < len(bands):
                some = [t for t in bands[at : at + many] if not self.beside(near, t, e, m, width)]
                at, many = at + many, min(2 * many, max(1, PAIRS // (m + width)), 256)
                if not some:
                    continue
                # Outside the text there is nothing that an item's character could equal.
                regions = np.full((len(some), m + width), EDGE, np.uint32)
                for row, (_, lo, _) in zip(regions, some, strict=True):
                    row[max(0, start - lo) : max(0, min(stop - lo, m + width))] = codes[max(lo, start) : max(start, min(stop, lo + m + width))]
                for cost, a, z, (_, lo, shared) in zip(*(x.tolist() for x in align(self.codes[j], regions)), some, strict=True):
                    if cost <= e:
                        place = (cost, max(lo + a, start), min(lo + z, stop), shared)
                        best.setdefault((d, j), []).append(place)
                        insort(near, (place[1], place[2], cost))

    @staticmethod
    def beside(near: list[tuple[int, int, int]], band: tuple[int, int, int], e: int, m: int, width: int) -> bool:
        """Whether each place of the band overlaps one that was found with as few edits as the band can have at least."""
        least, lo, _ = band
        k = bisect_left(near, (lo + width - m - e,))
        while k < len(near) and near[k][0] < lo + m - e:
            if near[k][1] > lo + width and near[k][2] <= least:
                return True
            k += 1
        return False

    def short_matches(self, codes: np.ndarray, where: np.ndarray, low: np.ndarray, high: np.ndarray, starts: np.ndarray) -> list[tuple]:
        found = []
        for d, (a, z) in enumerate(zip(low, high, strict=True)):
            text = " " + codes[a:z].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") + " "
            for key, words in self.short:
                at = text.find(f" {words} ")
                while at >= 0:
                    found.append((d, key, int(where[a + at] - starts[d]), int(where[a + at + len(words) - 1] + 1 - starts[d]), 0, 0))
                    at = text.find(f" {words} ", at + 1)
        return found


def blocks(benchmark: DataFrame) -> Iterator[Benchmark]:
    """The benchmark in blocks of a bounded size; equal items are dealt like others."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = size // BLOCK_CHARS + 1
    if count > 1:
        items = written(items, "benchmark")  # the numbers of the rows have to stay
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("row"), F.lit(count)) == k).collect()
        yield Benchmark([r["item_id"] for r in rows], [r["text"] for r in rows])


def scan(shared, texts: list[str]) -> Iterator[tuple]:
    """The matches in texts, a bounded number of characters at a time."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SCAN_CHARS):
            size += len(texts[end])
            end += 1
        for d, *rest in shared.value.search(texts[at:end]):
            yield (at + d, *rest)
        at = end


def over_blocks(docs: DataFrame, benchmark: DataFrame, made: Callable, columns: list, schema) -> Iterator[DataFrame]:
    scanned = unused(docs, "scanned")
    small_batches(docs.sparkSession)
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in slices(whole)):
                texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
                yield from made(batch, list(scan(shared, texts)))

        yield docs.select(*columns, F.col("text").alias(scanned)).mapInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per match: doc_id, item_id, start, length, edits, shared_grams."""
    names = ["doc_id", "item_id", "start", "length", "edits", "shared_grams"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def made(batch: pa.RecordBatch, found: list[tuple]) -> Iterator[pa.RecordBatch]:
        if found:
            ids = batch.column(0).to_pylist()
            rows = [(ids[d], item, a, z - a, edits, n) for d, item, a, z, edits, n in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    out = None
    for part in over_blocks(docs, benchmark, made, [F.col("doc_id").cast("long")], "doc_id long, item_id long, start long, length long, edits int, shared_grams int"):
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item."""

    def made(batch: pa.RecordBatch, found: list[tuple]) -> Iterator[pa.RecordBatch]:
        clean = np.ones(batch.num_rows, bool)
        clean[[f[0] for f in found]] = False
        kept = batch.filter(pa.array(clean))
        yield pa.RecordBatch.from_arrays(kept.columns[:-1], batch.schema.names[:-1])

    names = docs.columns
    for block in over_blocks(docs, benchmark, made, names, docs.schema):
        docs = block
    return docs
