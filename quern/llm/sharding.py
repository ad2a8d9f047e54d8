"""Resharding by minimum-cost flow: documents move from old shards to new capacities with the fewest bytes moved.

Each old shard is a row of blocks (by a hash of the row and of its number, so that equal rows spread), and
its documents have a place in bytes within it: the bytes of the blocks before, and of the rows before in
the block. From the old shards' sizes and the new capacities a flow is solved in which bytes that stay
cost nothing and bytes that move cost one each. An old shard's bytes are then handed out in order, first
to itself and then to the shards that its flow goes to, so only the blocks that lie on a border are cut,
between two documents; every other block goes to a shard as a whole. The files of the shards that change
are then rewritten, in files of about `FILE_BYTES`; those of other shards stay as they are. A table
without old files has the files of all shards written.

All that depends on the number of documents runs on Spark: sizes are sums over blocks, only the rows of
cut blocks meet in windows, and no window is larger than a block. The driver sees one number per old and
new shard, and what is broadcast has at most `MOST_BLOCKS` rows. Rows are numbered as they are read, so
docs has to be a table in files, or one that gives the same rows in the same order when it is read again;
the rows written are counted against those read, and a difference is an error.

Defined results: null and empty texts have the size of the row's overhead alone; repeated rows each have
a place, and ties between equal rows in a slot's order are broken in any way; an empty table gives no
rows and no file; extra columns keep their values in the files, apart from those named like the columns
added here (old_shard, block, shard), which are replaced.
"""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import new_path, written

SHARDS, OLD_SHARDS, OVERHEAD = 24, 16, 8
#: Rows per block, about, which bounds what a task sorts; and blocks in all, beyond which they grow.
BLOCK_ROWS, MOST_BLOCKS = 20_000, 1 << 18
#: Bytes of texts in a file, about.
FILE_BYTES = 128 << 20


def row_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def row_crc(text: str = "text") -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8"))


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by at most one and sum to the total."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def cheapest_flow(supply: list[int], capacity: list[int], stays: list[int | None]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard, of least total cost; stays[i] is the new shard that is old shard i.

    Successive shortest paths with potentials over source, old shards, new shards and sink.
    """
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for i, x in enumerate(supply):
        edge(source, i, x, 0)
        for j in range(m):
            edge(i, n + j, x, int(stays[i] != j))
    for j, x in enumerate(capacity):
        edge(n + j, sink, x, 0)
    potential = [0] * len(graph)
    while True:
        best, came = {source: 0}, {}
        heap = [(0, source)]
        while heap:
            d, a = heappop(heap)
            if d > best[a]:
                continue
            for k, (b, room, cost, _) in enumerate(graph[a]):
                to = d + cost + potential[a] - potential[b]
                if room > 0 and to < best.get(b, 1 << 62):
                    best[b], came[b] = to, (a, k)
                    heappush(heap, (to, b))
        if sink not in best:
            break
        potential = [p + best.get(v, best[sink]) for v, p in enumerate(potential)]
        path, at = [], sink
        while at != source:
            path.append(came[at])
            at = came[at][0]
        push = min(graph[a][k][1] for a, k in path)
        for a, k in path:
            graph[a][k][1] -= push
            graph[graph[a][k][0]][graph[a][k][3]][1] += push
    return {(i, e[0] - n): supply[i] - e[1] for i in range(n) for e in graph[i] if n <= e[0] < n + m and supply[i] > e[1]}


def borders(flow: dict[tuple[int, int], int], stays: list[int | None]) -> list[tuple[int, int, int, int]]:
    """(old shard, first byte, end, new shard): each old shard's bytes handed out, first to itself."""
    out, at = [], {}
    for (i, j), size in sorted(flow.items(), key=lambda x: (x[0][0], stays[x[0][0]] != x[0][1], x[0][1])):
        low = at.get(i, 0)
        out.append((i, low, low + size, j))
        at[i] = low + size
    return out


def in_blocks(docs: DataFrame, old: Column, blocks: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with old_shard and block."""
    number = F.xxhash64(F.lit(1), F.col(id_col), row_crc(text), F.monotonically_increasing_id())
    return docs.withColumns({"old_shard": old.cast("int"), "block": F.pmod(number, F.lit(blocks)).cast("int")})


def reshard(docs: DataFrame, old: Column, capacities: int | list[int], path: str, old_count: int, id_col: str = "doc_id", text: str = "text", stored: bool = True) -> tuple[list[int], dict[tuple[int, int], int]]:
    """Write the files of every shard that changes under path (shard=N); the shards changed and the flow in bytes.

    stored: whether the old shards have files; without, those of unchanged shards are written as well.

    old is an integer column from 0 to old_count - 1, and new shard k is old shard k for every k that
    both have. capacities: a list of bytes, or a number of shards that are to be of even size.
    """
    spark = docs.sparkSession
    rows = docs.count()
    blocks = min(max(64, rows // BLOCK_ROWS // old_count + 1), MOST_BLOCKS // old_count)
    blocked = in_blocks(docs, old, blocks, id_col, text)
    sums = blocked.groupBy("old_shard", "block").agg(F.sum(row_size(text)).alias("bytes")).checkpoint()
    before = Window.partitionBy("old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    found = {r["old_shard"]: r["n"] for r in sums.groupBy("old_shard").agg(F.sum("bytes").alias("n")).collect()}
    supply = [found.get(i, 0) for i in range(old_count)]
    capacity = even(sum(supply), capacities) if isinstance(capacities, int) else capacities
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards can't hold all bytes")
    stays = [i if i < len(capacity) else None for i in range(old_count)]
    flow = cheapest_flow(supply, capacity, stays)
    shares = spark.createDataFrame(borders(flow, stays), "share_of int, low long, high long, shard int")
    changed = sorted({x for i, j in flow if i != j for x in (i, j) if x < len(capacity)} | {j for _, j in flow if j >= old_count})
    # A block that lies within one share as a whole goes to its shard; of the others the rows are placed one by one.
    inside = (F.col("old_shard") == F.col("share_of")) & (F.col("before") >= F.col("low")) & (F.col("before") + F.col("bytes") <= F.col("high"))
    mapped = starts.join(F.broadcast(shares), inside, "left").select("old_shard", "block", "before", "shard").checkpoint()
    kept = [c for c in docs.columns if c not in ("old_shard", "block", "shard")]
    # The row's own columns travel as one, so that none of their names meets one of those added here.
    carried = blocked.select(F.struct(*kept).alias("doc"), "old_shard", "block", F.col(id_col).alias("id"), row_crc(text).alias("crc"), row_size(text).alias("size"))
    carried = carried.join(F.broadcast(mapped), ["old_shard", "block"])
    own = Window.partitionBy("old_shard", "block").orderBy(F.col("id").asc_nulls_last(), "crc").rowsBetween(Window.unboundedPreceding, -1)
    cut = carried.where("shard is null").drop("shard").withColumn("at", F.coalesce(F.sum("size").over(own), F.lit(0)))
    # One share per pair of old and new shard, as many as the shards allow; a document goes where its middle lies.
    middle = F.col("before") + F.col("at") + F.floor(F.col("size") / 2)
    cut = cut.join(F.broadcast(shares), (F.col("old_shard") == F.col("share_of")) & (middle >= F.col("low")) & (middle < F.col("high")))
    placed = carried.where("shard is not null").select("doc", "old_shard", "block", "shard").union(cut.select("doc", "old_shard", "block", "shard"))
    if stored:
        placed = placed.where(F.col("shard").isin(changed))
    # At least a few parts of a shard, so that one shard is not one task.
    parts = max(8, -(-sum(supply) // max(1, len(capacity)) // FILE_BYTES))
    files = placed.repartition(parts * len(capacity), "shard", F.pmod(F.xxhash64("old_shard", "block"), F.lit(parts)))
    files.select("doc.*", "old_shard", "block", "shard").write.partitionBy("shard").parquet(path)
    if not stored and rows and (wrote := spark.read.parquet(path).count()) != rows:
        raise RuntimeError(f"{wrote} rows written of {rows}: the input was not read twice alike")
    return changed, flow


def slots(spark: SparkSession, path: str, schema, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row in the files at path."""
    stored = spark.read.schema(schema).parquet(path)
    rows = stored.select(F.col(id_col), row_size(text).alias("size"), row_crc(text).alias("text_crc32"), "shard", "old_shard", "block")
    rows = written(rows, "shard-rows")
    counts = rows.groupBy("shard", "old_shard", "block").count()
    before = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "old_shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "old_shard", "block").orderBy(F.col(id_col).asc_nulls_last(), "text_crc32")
    numbered = rows.withColumn("at", F.row_number().over(own)).join(starts, ["shard", "old_shard", "block"])
    return numbered.select(F.col(id_col), "size", "text_crc32", "shard", (F.col("before") + F.col("at") - 1).alias("slot"))


def sharded(docs: DataFrame, shards: int = SHARDS, old_count: int = OLD_SHARDS) -> DataFrame:
    """docs resharded from old_count shards by hash to even ones by bytes, from the files written."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "shards")
    columns = docs.select("doc_id", "text")
    reshard(columns, F.pmod(F.xxhash64("doc_id"), F.lit(old_count)), shards, path, old_count, stored=False)
    schema = columns.withColumns({"old_shard": F.lit(0), "block": F.lit(0), "shard": F.lit(0)}).schema
    out = slots(spark, path, schema)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
