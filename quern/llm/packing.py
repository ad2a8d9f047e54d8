"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

The lengths of all pieces give a histogram with at most `CAPACITY` rows, whatever the corpus. On it the
configuration linear program (cover every length's count by patterns of lengths that fit a sequence) is
solved by multiplicative weights: a length's price falls as it is covered ahead of the rest, and an
unbounded-knapsack dynamic program prices the next pattern. The fractional solution is rounded down to
whole sequences within the counts, and what is left is filled a sequence at a time, around the longest
piece, by the same program over the pieces that are left, or best fit decreasing where that takes fewer. The plan is then small: each piece finds its place from its length and its rank among the
pieces of that length, which is counted in chunks and never over one whole group.

Defined results: null and empty texts are the end token alone; repeated rows and null ids give pieces of
their own; an empty table gives no sequence; a document longer than a sequence is cut into pieces of the
full length, of which only the first may be shorter; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import slices, small_batches, written

CAPACITY, END_ID = 1024, 2
TOKENIZER = "byte_bpe_50k.json"
#: Rounds of multiplicative weights for each solution of the linear program, its learning rate, the power
#: of a length that its price starts from, how far long pieces lead, and the share of all ids to cover.
ROUNDS, RATE, PRICE_POWER, LEAD, COVER = 300, 0.3, 1.05, 0.3, 0.98
#: Shares of the program's rounds from which a rounding is tried.
KEEP = (1.0, 0.8, 0.5, 0.2, 0.02)
#: Characters and id bytes that a worker's memory of token ids holds before it is emptied.
CACHE_BYTES = 64 << 20
#: Pieces per chunk when ranks are counted.
CHUNK_ROWS = 50_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it shows, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Encoder:
    """Token ids as little-endian bytes; remembers the ids of words, as BPE never merges across them.

    A text is cut before every space that follows other than white space, which is a boundary of the
    tokenizer's words too, and a cut not met before goes to the tokenizer's model word by word. Any
    other text, and one with a special token's string, is encoded as a whole.
    """

    def __init__(self, name: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.model, letters = self.tokenizer.model, byte_letters()
        self.letters, self.space = str.maketrans({chr(b): x for b, x in enumerate(letters)}), letters[32]
        self.of_cut: dict[str, bytes | None] = {"": None}
        self.of_word: dict[str, bytes] = {}
        self.held = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of_letters(self, letters: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def spaced(self, word: str) -> bytes:
        """The ids of a space and a word of letters alone."""
        found = self.of_cut.get(word)
        if found is None:
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            self.of_cut[word] = found = self.of_letters(self.space + letters)
            self.held += len(word) + len(found)
        return found

    def word(self, word: str) -> bytes:
        found = self.of_word.get(word)
        if found is None:
            self.of_word[word] = found = self.of_letters(word.encode().decode("latin-1").translate(self.letters))
            self.held += len(word) + len(found)
        return found

    def learn(self, cuts: list[str]) -> None:
        """Have the ids of these cuts, each without the space that it begins with, in memory."""
        if self.held > CACHE_BYTES:
            self.of_cut, self.of_word, self.held = {"": None}, {}, 0
        known = self.of_cut
        for c in cuts:
            if c in known:
                continue
            if c.isalpha():
                self.spaced(c)
            elif c[-1].isspace():
                known[c] = None
            else:
                first, *rest = self.words.findall(" " + c)
                head = self.spaced(first[1:]) if first[1:].isalpha() else self.word(first)
                known[c] = head + b"".join(map(self.word, rest))
                self.held += len(c) + len(known[c])

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            part = text.split(" ")
            if not part[0] and len(part) > 1 or part[0][-1:].isspace() or any(s in text for s in self.specials):
                out.append(self.whole(text))
                continue
            first, rest = part[0], part[1:]
            try:
                ids = b"".join(map(self.of_cut.__getitem__, rest))
            except (KeyError, TypeError):  # a cut not met yet, or white space before a space
                self.learn(rest)
                found = list(map(self.of_cut.__getitem__, rest))
                if None in found:
                    out.append(self.whole(text))
                    continue
                ids = b"".join(found)
            out.append(b"".join(map(self.word, self.words.findall(first))) + ids)
        return out


ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """This worker's encoder; it outlives a task."""
    if name not in ENCODERS:
        ENCODERS[name] = Encoder(name)
    return ENCODERS[name]


def cut(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids."""
    n = len(ids) // 4
    count = -(-n // capacity)
    edges = [0, *(n - capacity * k for k in range(count - 1, -1, -1))]
    return [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, row): row is a number of its own for each piece."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in (part for whole in batches for part in slices(whole)):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = encoder(tokenizer).encode(texts)
            out = [(doc, *p) for doc, x in zip(batch.column("doc_id").to_pylist(), ids, strict=True) for p in cut(x + end, capacity)]
            columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.arange(row, row + len(out)))], ["doc_id", "piece", "start", "length", "ids_crc32", "row"])
            row += len(out)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, row long")


def best_pattern(prices: np.ndarray) -> Counter:
    """The multiset of lengths of the highest price within the capacity: unbounded knapsack by dynamic programming.

    prices[k] is that of length k, from 0 to the capacity; 0 where there is none.
    """
    capacity = len(prices) - 1
    value, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        options = value[c - 1 :: -1] + prices[1 : c + 1] if c > 1 else prices[1:2]
        best = int(options.argmax())
        if options[best] > value[c - 1]:
            value[c], pick[c] = options[best], best + 1 if prices[best + 1] > 0 else 0
        else:
            value[c] = value[c - 1]
    found, c = Counter(), capacity
    while c > 0:
        if not pick[c]:
            c -= 1
        else:
            found[int(pick[c])] += 1
            c -= int(pick[c])
    return found


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[Counter, float]]:
    """Patterns and how many sequences take each: the configuration linear program by multiplicative weights.

    A length's price starts near its share of a sequence and is multiplied up or down as its cover falls
    behind or runs ahead of its target; long pieces have a target ahead of the rest, as short ones fill
    the gaps that these leave.
    """
    total = (lengths * counts).sum()
    if total <= capacity:
        return []
    step = max(total / capacity / rounds, 1.0)
    covered, out = np.zeros(len(lengths)), []
    start = (lengths / capacity) ** PRICE_POWER
    place = {int(x): i for i, x in enumerate(lengths)}
    prices = np.zeros(capacity + 1)
    for _ in range(4 * rounds):
        done = (lengths * covered).sum() / total
        wanted = counts - covered >= 1e-9
        if done >= COVER or not wanted.any():
            break
        target = np.minimum(1, done * (1 + LEAD * lengths / capacity))
        prices[lengths] = start * np.exp(RATE * (target - covered / counts)) * wanted
        pattern = Counter({place[x]: n for x, n in best_pattern(prices).items()})
        take = min(step, *((counts[i] - covered[i]) / n for i, n in pattern.items()))
        take = np.floor(take) if take >= 1 else take
        for i, n in pattern.items():
            covered[i] += n * take
        out.append((pattern, float(take)))
    return out


Bins = list[tuple[tuple[tuple[int, int], ...], int]]


def filled(lengths: list[int], left: list[int], capacity: int) -> Bins:
    """Patterns (index of a length, how many) and their times for what rounding leaves: around the longest piece what fills it best.

    The fill is a knapsack by dynamic programming as well, over sets of sums kept as the bits of a number;
    of equal fills it takes the longest pieces, so that short ones stay for the gaps of later sequences.
    """
    out, left = [], list(left)
    for top in range(len(lengths) - 1, -1, -1):
        while left[top]:
            left[top] -= 1
            room = capacity - lengths[top]
            full, sums, steps = 1 << room, 1, []
            for k in range(top, -1, -1):
                n, pack = min(left[k], room // lengths[k]), 1
                while n > 0:  # by powers of two, which give each number of pieces up to n
                    pack = min(pack, n)
                    before, sums = sums, (sums | sums << pack * lengths[k]) & (2 * full - 1)
                    if sums != before:
                        steps.append((k, pack, before))
                    n, pack = n - pack, 2 * pack
                if sums & full:
                    break
            left[top] += 1
            bin_, at = Counter({top: 1}), sums.bit_length() - 1
            for k, pack, before in reversed(steps):
                if not before >> at & 1:
                    bin_[k] += pack
                    at -= pack * lengths[k]
            times = min(left[k] // n for k, n in bin_.items())
            for k, n in bin_.items():
                left[k] -= n * times
            out.append((tuple(sorted(bin_.items())), times))
    return out


def best_fit(lengths: list[int], left: list[int], capacity: int) -> Bins:
    """The same by best fit decreasing; sequences of one pattern are handled together."""
    room: dict[int, list[tuple[dict[int, int], int]]] = {}
    for k in range(len(lengths) - 1, -1, -1):
        n, size = left[k], lengths[k]
        for r in sorted(room):
            while r >= size and n and room.get(r):
                bin_, times = room[r].pop()
                each = min(r // size, n)
                many = min(times, n // each)
                if many < times:
                    room[r].append((bin_, times - many))
                room.setdefault(r - each * size, []).append((bin_ | {k: each}, many))
                n -= each * many
        if n:
            each = capacity // size
            for e, many in ((each, n // each), (n % each, 1)):
                if e and many:
                    room.setdefault(capacity - e * size, []).append(({k: e}, many))
    return [(tuple(sorted(bin_.items())), times) for bins in room.values() for bin_, times in bins]


def rounded(solution: list[tuple[Counter, float]], lengths: np.ndarray, counts: np.ndarray, capacity: int) -> Bins:
    """Whole sequences of a fractional solution, within the counts, and the better filling of what is left."""
    sums: Counter = Counter()
    for pattern, x in solution:
        sums[tuple(sorted(pattern.items()))] += x
    out, left = [], counts.tolist()
    for pattern, x in sums.most_common():
        take = min(int(x + 1e-9), *(left[i] // n for i, n in pattern))
        if take > 0:
            out.append((pattern, take))
            for i, n in pattern:
                left[i] -= n * take
    return out + min((fill(lengths.tolist(), left, capacity) for fill in (filled, best_fit)), key=lambda bins: sum(t for _, t in bins))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: how many}) and how many sequences take each; together they take every piece once.

    The last rounds of the program serve what the first ones left over, so the solution is also rounded
    from its first `KEEP` shares of the rounds, and the one with the fewest sequences is taken.
    """
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    solution = fractional(lengths, counts, capacity)
    tries = [rounded(solution[: int(np.ceil(share * len(solution)))], lengths, counts, capacity) for share in KEEP] if len(lengths) else [[]]
    out: Counter = Counter()
    for pattern, times in min(tries, key=lambda bins: sum(t for _, t in bins)):
        out[pattern] += times
    return [({int(lengths[i]): n for i, n in pattern}, times) for pattern, times in out.items()]


def placed(cut_docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of pieces() with sequence_id and offset."""
    spark = cut_docs.sparkSession
    histogram = {r["length"]: r["count"] for r in cut_docs.groupBy("length").count().collect()}
    made = plan({k: v for k, v in histogram.items() if k < capacity}, capacity)
    entries, first, seen = [], 0, Counter()
    for pattern, times in made:
        offset = 0
        for length, n in pattern.items():
            entries.append((length, seen[length], n, first, offset))
            seen[length] += n * times
            offset += n * length
        first += times
    table = np.array(sorted(entries), np.int64).reshape(-1, 5)
    # Bounded by the patterns of the plan, whatever the corpus.
    shared = spark.sparkContext.broadcast((table, (table[:, 0] << 44) + table[:, 1], first))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, keys, full_from = shared.value
        for batch in batches:
            length, rank, row = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank", "row"))
            sequence, offset = full_from + row, np.zeros(len(row), np.int64)
            part = np.flatnonzero(length < capacity)
            if len(part):
                e = table[np.searchsorted(keys, (length[part] << 44) + rank[part], side="right") - 1]
                at = rank[part] - e[:, 1]
                sequence[part] = e[:, 3] + at // e[:, 2]
                offset[part] = e[:, 4] + at % e[:, 2] * length[part]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    chunks = sum(histogram.values()) // CHUNK_ROWS + 32
    rows = cut_docs.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.where(F.col("length") < capacity).groupBy("length", "chunk").count()
    starts = starts.select("length", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "chunk").orderBy("row")
    short = rows.where(F.col("length") < capacity).withColumn("at", F.row_number().over(inside)).join(starts, ["length", "chunk"])
    short = short.select(*names, "row", (F.col("before") + F.col("at") - 1).alias("rank"))
    full = rows.where(F.col("length") == capacity).select(*names, "row", F.lit(0).cast("long").alias("rank"))
    return short.union(full).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """A row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return placed(written(pieces(docs, capacity, tokenizer, end_id), "pieces"), capacity)
