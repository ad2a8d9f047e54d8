"""SimHash near-duplicates, linked through BK-trees over shards of the distinct fingerprints.

Fingerprints are 64 bits over the XXH64 hashes (seed 42) of 3-word shingles, and link at `radius` or
fewer differing bits. Two such fingerprints agree on one of radius + 1 bands of bits, so a shard is the
set of fingerprints that agree on a band; each shard has its own BK-tree, whose children are keyed by
their Hamming distance to the parent, and a search follows only the edges within the radius. Trees are
built by tasks, written to the shared folder, and then sent whole to every task that searches a part of
the shard's fingerprints in it (`PROBES` each). This is the broadcast of a shard tree without the driver,
as the fingerprints of all documents must not meet there. A shard above `SHARD_LIMIT` is split anew by
bands of its remaining bits, which loses no pair. A search gives one link per member to the member's
local root, never all pairs.

Defined results: null and empty texts and texts of white space have the fingerprint zero and link like
any other; repeated rows each give a row; rows with a null id take part, and component_id is the
smallest id that is not null (null if there is none); an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import left_join_by_parts, map_batches, shared_dir, utf8, written

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 2
#: Above so many fingerprints a shard is split by bands of the bits that its members need not share.
SHARD_LIMIT = 8192
SPLITS = 3
#: Fingerprints that a task searches in a tree at a time.
PROBES = 2048
MASK = (1 << BITS) - 1


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text: words between ASCII white space, A-Z lower-cased."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_digest
    rows = np.frombuffer(b"".join([digest(s, seed) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(rows), 4096):
        ones += np.unpackbits(rows[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp long, text_hash long) of every row; fp is the fingerprint as a signed 64-bit number."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t) for t in utf8(batch.column("t"))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("i"), pa.array(values), batch.column("h")], ["doc_id", "fp", "text_hash"])

    cols = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    return map_batches(cols, run, "doc_id long, fp long, text_hash long")


def bands(bits: list[int], parts: int) -> list[list[int]]:
    return [bits[i::parts] for i in range(parts)]


def mask_of(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def masks(level: int, radius: int) -> list[tuple[int, list[int]]]:
    """(parent's number, bits that members of a shard share) of each band at this level of splitting."""
    if level == 0:
        return [(0, part) for part in bands(list(range(BITS)), radius + 1)]
    out = []
    for number, (_, shared) in enumerate(masks(level - 1, radius)):
        rest = [b for b in range(BITS) if b not in set(shared)]
        out += [(number, shared + part) for part in bands(rest, radius + 1)]
    return out


class BKTree:
    """Children keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Positions of the members within radius of value."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            todo += [child for key, child in self.children[at].items() if d - radius <= key <= d + radius]
        return found

    def add(self, value: int) -> int:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        at = 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = new
                break
            at = below
        return new


    def packed(self) -> bytes:
        """The tree as bytes: values, then each member's parent and the edge's key, by position."""
        parent, edge = np.zeros(len(self.values), np.uint32), np.zeros(len(self.values), np.uint8)
        for at, below in enumerate(self.children):
            for key, child in below.items():
                parent[child], edge[child] = at, key
        return np.array(self.values, np.uint64).tobytes() + parent.tobytes() + edge.tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> BKTree:
        n = len(data) // 13
        tree = cls()
        tree.values = np.frombuffer(data, np.uint64, n).tolist()
        tree.children = [{} for _ in range(n)]
        for child, (at, key) in enumerate(zip(np.frombuffer(data, np.uint32, n, 8 * n).tolist(), data[12 * n :], strict=True)):
            if child:
                tree.children[at][key] = child
        return tree


def tree_of(values: list[int]) -> BKTree:
    tree = BKTree()
    for value in values:
        tree.add(value)
    return tree


def tree_links(tree: BKTree, probes: range, radius: int) -> list[tuple[int, int]]:
    """(member, local root) for the members that the probes, positions of members, connect within radius."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    for at in probes:
        for other in tree.near(tree.values[at], radius):
            a, b = find(other), find(at)
            root[max(a, b)] = min(a, b)
    return [(tree.values[x], tree.values[r]) for x in list(root) if (r := find(x)) != x]


def shard_trees(members: DataFrame, shards: int, least: int = 2) -> DataFrame:
    """(path, key, tree, n) of each shard of members (path, key, fp) with `least` fingerprints or more; written."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["path", "key", "fp"], kind="stable")
        path, key, fp = (pdf[c].to_numpy() for c in ("path", "key", "fp"))
        edges = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (key[1:] != key[:-1]), True])
        spans = [(lo, hi) for lo, hi in zip(edges[:-1], edges[1:], strict=True) if hi - lo >= least]
        trees = [tree_of([int(v) & MASK for v in fp[lo:hi]]).packed() for lo, hi in spans]
        return pd.DataFrame({"path": [path[lo] for lo, _ in spans], "key": [key[lo] for lo, _ in spans], "tree": trees, "n": [hi - lo for lo, hi in spans]}).astype({"path": "int64", "key": "int64", "n": "int64"})

    by_shard = members.withColumn("shard", F.pmod(F.xxhash64("path", "key"), F.lit(shards))).groupBy("shard")
    return written(by_shard.applyInPandas(build, "path long, key long, tree binary, n long"), "trees")


def searched(trees: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that the members of each tree have within radius; a tree goes to a task for each part of its members."""

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple[int, int]] = []
        for data, part in zip(batch.column("tree").to_pylist(), batch.column("part").to_pylist(), strict=True):
            tree = BKTree.unpacked(data)
            out += tree_links(tree, range(part * PROBES, min((part + 1) * PROBES, len(tree.values))), radius)
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    parts = trees.select("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PROBES))).alias("part"))
    large = parts.where(F.length("tree") > 13 * PROBES)
    # The parts of a large tree are dealt to tasks one by one; small trees stay where they were read.
    dealt = large.repartition(F.xxhash64("tree"), "part").union(parts.where(F.length("tree") <= 13 * PROBES))
    return map_batches(dealt, search, "a long, b long")


def shard_links(distinct: DataFrame, radius: int, shards: int, limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp that connect all those within radius."""

    def keyed(rows: DataFrame, level: int) -> DataFrame:
        options = [
            F.struct(F.lit(number).alias("path"), F.lit(parent).alias("parent"), F.col("fp").bitwiseAND(F.lit(mask_of(bits))).alias("key"))
            for number, (parent, bits) in enumerate(masks(level, radius))
        ]
        out = rows.withColumn("o", F.explode(F.array(*options)))
        if level:
            out = out.where("o.parent = path")
        return out.select("fp", F.col("o.path").alias("path"), F.col("o.key").alias("key"))

    rows, found = keyed(distinct.select("fp"), 0), None
    for level in range(SPLITS):
        hot, cold = None, rows
        if level < SPLITS - 1:
            hot = written(rows.groupBy("path", "key").count().where(F.col("count") > limit).select("path", "key"), "hot")
            if hot.isEmpty():
                hot = None
            else:
                cold = rows.join(hot, ["path", "key"], "left_anti")
        links = searched(shard_trees(cold, shards), radius)
        found = links if found is None else found.union(links)
        if hot is None:
            break
        rows = keyed(rows.join(hot, ["path", "key"], "left_semi"), level + 1)
    return found.distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node reachable over links (a, b), for every node that has a link.

    Alternates large-star and small-star steps; each round is checkpointed to the shared folder.
    """
    shared_dir(links.sparkSession)
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct().checkpoint()
        parents = edges.select(F.col("v").alias("u")).distinct()
        many = edges.groupBy("u").count().where("count > 1").select("u")
        if many.union(edges.join(parents, "u", "left_semi").select("u")).isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp, text_hash, component_id, root) of every row; root is a fingerprint of the component."""
    signed = written(fingerprints(docs, text, id_col), "fingerprints")
    distinct = signed.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).checkpoint()
    sums = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (radius + 1) * sums[0] // 20_000 + 1)
    found = components(shard_links(distinct, radius, shards))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = rooted.join(first, "root").select("fp", "n", "component_id", "root").checkpoint()
    return left_join_by_parts(signed, of_fp, ["fp"], "n", sums[1]).select("doc_id", "fp", "text_hash", "component_id", "root")


def deduplicated(docs: DataFrame, radius: int = RADIUS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs with one row kept of each component: that of the smallest id, nulls last."""
    return one_of_each(docs, written(near_duplicates(docs, radius, text, id_col), "components"), text, id_col)


def one_of_each(docs: DataFrame, groups: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs with one row kept of each root in groups (doc_id, text_hash, root)."""
    parts = [F.col("doc_id").isNull().alias("kn"), F.coalesce("doc_id", F.lit(0)).alias("ki"), F.col("text_hash").alias("kh")]
    keep = groups.groupBy("root").agg(F.min(F.struct(*parts)).alias("k")).select("k.*")
    key = [F.col(id_col).isNull(), F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.xxhash64(text)]

    def kept(of: DataFrame, how: str, rows: DataFrame = docs) -> DataFrame:
        return rows.join(of, (key[0] == of["kn"]) & (key[1] == of["ki"]) & (key[2] == of["kh"]), how)

    repeated = groups.select(*parts).groupBy("kn", "ki", "kh").count().where("count > 1").select("kn", "ki", "kh")
    if repeated.isEmpty():
        return kept(keep, "left_semi")
    # Of rows with one id and text each task keeps one before they meet.
    same = kept(keep.join(repeated, ["kn", "ki", "kh"]), "left_semi")
    one = same.groupBy(*(k.alias(f"k{n}") for n, k in enumerate(key))).agg(F.first(F.struct(*(F.col(c).alias(f"c{n}") for n, c in enumerate(docs.columns)))).alias("row"))
    back = one.select(*(F.col(f"row.c{n}").alias(c) for n, c in enumerate(docs.columns)))
    return kept(keep.join(repeated, ["kn", "ki", "kh"], "left_anti"), "left_semi").union(back)
