"""Near copies by SimHash and BK-trees at a similarity, for the pipeline: operator 9 with wide shards and a check.

Two documents are linked when the sets of their 5-word shingles (words between ASCII white space, A-Z
lower-cased, XXH64 with seed 42) have a Jaccard similarity of `LEAST` or more. At 0.8 their SimHash
fingerprints differ in some 10 of 64 bits, which is too many for shards of agreeing bits. So a shard is
here the set of documents that agree on one of `BANDS` bands of `ROWS` min-hashes, which a pair at 0.8 does
with a chance of 0.998. As in operator 9, each shard's BK-tree is built by a task, written to the shared
folder and sent whole to every task that searches fingerprints in it. Only fingerprints within `RADIUS`
bits are candidates, and each pair of candidates is verified on its shingle sets before it links.

Documents of equal shingle sets are one node, and a task that holds a shard holds the sets of its nodes.
Two sets at `LEAST` share one of their rarest shingles (the prefix filter: one in five and one more of each,
by their number in the shard), so only such candidates are verified, those nearest to the shard's middle
first, and none that a chain of links has joined already. A shard gives links, never pairs. A shard above
`LIMIT` shingles is cut into parts with a tree each, in which its own and all later parts are searched.

Defined results: null and empty texts and texts of white space are equal to one another; a text of fewer
words than a shingle has is one shingle; repeated rows and null ids take part; an empty table gives an
empty result; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import simhash
from quern.llm.common import left_join_by_parts, map_batches, utf8, written

SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 16, 5
#: Shingles of a shard's nodes that one task takes.
LIMIT = 4_000_000
#: Bits in which the fingerprints of a similar pair may differ: of 64 a pair at 0.8 differs in 9.7 on average, with
#: a standard deviation of 2.9, and an unrelated pair in 32.
RADIUS = 24
#: Fixed odd factors and offsets of the min-hashes.
FACTORS, OFFSETS = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes of a UTF-8 text's shingles, sorted."""
    words = text.translate(simhash.LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) > SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, simhash.SEED) for s in grams], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else float(len(a) == len(b) == 0)


def buckets(found: np.ndarray) -> list[int]:
    """One number per band of min-hashes of a shingle set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(least, (found[at : at + 4096] * FACTORS[:, None] + OFFSETS[:, None]).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of a shingle set."""
    ones = np.zeros(simhash.BITS, np.int64)
    for at in range(0, len(found), 4096):
        ones += np.unpackbits(found[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found)).tobytes(), "big")


def signed(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, node, fp, size, buckets) of every row; rows of equal shingle sets have one node, and size is theirs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in utf8(batch.column("t"))]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED) for s in sets], np.uint64).view(np.int64)
        lists = [np.array(buckets(s), np.uint64).view(np.int64) for s in sets]
        prints = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("i"), batch.column("h"), pa.array(nodes), pa.array(prints), pa.array([len(s) for s in sets], pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "text_hash", "node", "fp", "size", "buckets"])

    cols = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    return map_batches(cols, run, "doc_id long, text_hash long, node long, fp long, size long, buckets array<long>")


def prefix_index(sets: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The rarest shingles of each set, so many that sets at LEAST share one; and the sets of each shingle: edges and positions."""
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.empty(len(times), np.int64)
    order[np.argsort(times, kind="stable")] = np.arange(len(times))
    rare, at = [], 0
    for s in sets:
        rare.append(np.sort(order[number[at : at + len(s)]])[: len(s) - int(np.ceil(LEAST * len(s) - 1e-9)) + 1])
        at += len(s)
    flat, owner = np.concatenate(rare), np.repeat(np.arange(len(sets)), [len(x) for x in rare])
    by = np.lexsort((owner, flat))
    return rare, np.searchsorted(flat[by], np.arange(len(times) + 1)), owner[by]


def shard_links(nodes: list[int], prints: list[int], sets: list[np.ndarray], tree: simhash.BKTree | None = None, later: list[bool] | None = None) -> list[tuple[int, int]]:
    """Pairs of similar nodes of one shard whose chains connect all that are similar in it.

    tree holds the fingerprints of the shard, and is made where none is given. Of a shard in parts, later says
    which nodes are of the later part: only these are searched for, among the others, whose tree it is then.
    """
    ones = np.array([[v >> b & 1 for b in range(simhash.BITS)] for v in prints]).sum(axis=0)
    middle = sum(1 << b for b in range(simhash.BITS) if 2 * ones[b] > len(prints))
    later = later or [False] * len(nodes)
    apart = any(later)
    # From the middle outwards, so that the first of a component are those that most others are similar to.
    order = sorted(range(len(nodes)), key=lambda k: (later[k], (prints[k] ^ middle).bit_count(), nodes[k]))
    nodes, prints, sets, later = ([x[k] for k in order] for x in (nodes, prints, sets, later))
    rare, edges, owners = prefix_index(sets)
    sizes, label, out = np.array([len(s) for s in sets]), np.arange(len(nodes)), []
    tree = tree or simhash.tree_of(list(dict.fromkeys(prints)))
    place, holders = {v: k for k, v in enumerate(tree.values)}, [[] for _ in tree.values]
    for at, value in enumerate(prints):
        if later[at] or not apart:
            near = np.zeros(len(nodes), bool)
            near[[k for n in tree.near(value, RADIUS) for k in holders[n]]] = True
            shares = np.zeros(len(nodes), bool)
            for t in rare[at].tolist():
                shares[owners[edges[t] : edges[t + 1]]] = True
            fits = np.minimum(sizes, sizes[at]) >= LEAST * np.maximum(sizes, sizes[at]) - 1e-9
            left = np.flatnonzero(near & shares & fits)
            while len(left):
                other, left = left[0], left[1:]
                if similarity(sets[at], sets[other]) >= LEAST:
                    out.append((nodes[at], nodes[other]))
                    label[label == label[at]] = label[other]
                    left = left[label[left] != label[at]]
        if not later[at]:
            holders[place[value]].append(at)
    return out


def linked(members: DataFrame, trees: DataFrame, parts: int) -> DataFrame:
    """Links (a, b) of nodes from members (bucket, i, j, own, node, fp, text) by the trees (bucket, i, j, tree) they are searched in."""

    def search(pdf: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        out, tree = [], {(x.bucket, x.i, x.j): x.tree for x in sent.itertuples()}
        for shard, rows in pdf.groupby(["bucket", "i", "j"], sort=False):
            if len(rows) > 1 and shard in tree:
                later = (rows["own"] > shard[1]).tolist()
                out += shard_links(rows["node"].tolist(), [int(v) & simhash.MASK for v in rows["fp"]], [shingles(t.encode()) for t in rows["text"]], simhash.BKTree.unpacked(tree[shard]), later)
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    part = F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(parts))
    return members.withColumn("part", part).groupBy("part").cogroup(trees.withColumn("part", part).groupBy("part")).applyInPandas(search, "a long, b long")


def groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, root) of every row; rows that a chain of similar pairs links have one root."""
    rows = written(signed(docs, text, id_col), "signed")
    nodes = written(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("buckets").alias("buckets"), F.first("size").alias("size"), F.min("text_hash").alias("text_hash"), F.count(F.lit(1)).alias("n")), "nodes")
    placed = nodes.select("node", "fp", "size", F.explode("buckets").alias("bucket"))
    same = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in range(2)]
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), *same).where("n > 1")
    # Near copies agree on several bands; of the buckets with the same nodes one is enough.
    shared = written(shared.groupBy("n", "total", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket", "total"), "buckets")
    members = written(placed.join(shared, "bucket"), "members")
    # A task sees one part of a bucket, or two of a large one, and the tree of the first.
    last = F.when(F.col("total") <= LIMIT, F.lit(0)).otherwise(F.ceil(F.col("total") * 2 / LIMIT).cast("int") - 1)
    own = F.pmod(F.xxhash64("node"), last + 1).cast("int")
    dealt = members.withColumn("own", own)
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    pairs = pairs.select("node", "fp", "bucket", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), members.count() // 2_000 + 1)
    shards = dealt.select(F.col("bucket").alias("path"), F.col("own").cast("long").alias("key"), "fp").distinct()
    trees = simhash.shard_trees(shards, parts, 1).select(F.col("path").alias("bucket"), F.col("key").cast("int").alias("i"), "tree")
    sent = trees.join(shared, "bucket").select("bucket", "i", F.explode(F.sequence("i", last)).alias("j"), "tree")
    # One text of each node that is in a shard, copies being put together before they meet.
    wanted = members.select("node").distinct().join(nodes.select("node", "text_hash"), "node")
    texts = docs.groupBy(F.xxhash64(text).alias("text_hash")).agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("text")).join(wanted, "text_hash").select("node", "text")
    with_texts = pairs.join(texts, "node")
    found = simhash.components(written(linked(with_texts, sent, parts), "links").distinct())
    roots = nodes.select("node", "n").join(found, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return left_join_by_parts(rows.select("doc_id", "text_hash", "node"), roots, ["node"], "n", total).select("doc_id", "text_hash", "root")


def deduplicated(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs with one row kept of each group of near copies: that of the smallest id, nulls last."""
    return simhash.one_of_each(docs, written(groups(docs, text, id_col), "components"), text, id_col)
