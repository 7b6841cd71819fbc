"""Resharding by minimum-cost flow.

Old shards are those of a manifest, or else the files that hold the documents
now, in the order of their paths; new ones are numbered from 0. Old shards are
sources of a flow and new shards its sinks; a byte costs nothing where it is
(old shard i is shard i) and one unit anywhere else. The solved flow says how
many bytes of each old shard stay and how many go where, which is the least
that can move.

A shard's bytes are a line, its files and their documents in order. The flow
cuts it into stretches, one for each shard that takes from it; a document goes
where its middle lies. So a stretch is a range of rows, and a document's shard
and slot follow from its file and row number alone: only the cuts travel, and
no shard is ever ordered in one task. Then the shards that change are written
anew, and a new manifest says where all shards are: a shard that keeps all and
gets nothing stays where it was, shards that end empty or are no more are not
in it, and no file that the old manifest names is touched before.

Law `bytes`: sizes differ from the capacities by the sizes of the documents on
the borders of stretches. Null text: size 8, checksum 0. Null ids and repeated
rows: every row has its own place. Empty table: empty result, no shard. Extra
columns: ignored by the plan, whatever their names; kept in the files.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

SHARDS = 24
#: Rows of a file that are put in order together, around a cut.
BLOCK_ROWS = 65_536
BROADCAST_FILES = 100_000
#: Bytes of a shard that one task writes, at the corpus' mean size of a row.
FILE_BYTES = 64 << 20


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """The cheapest flow that empties all supplies into demands of the same
    total, by successive shortest paths with potentials. The graph has a node
    for each shard, whatever the data."""
    m, n = len(supply), len(demand)
    source, sink, nodes = m + n, m + n + 1, m + n + 2
    graph: list[list[list[int]]] = [[] for _ in range(nodes)]  # [to, room, cost, index of the way back]

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, x in enumerate(supply):
        edge(source, i, x, 0)
        for j in range(n):
            edge(i, m + j, min(x, demand[j]), cost[i][j])
    for j, x in enumerate(demand):
        edge(m + j, sink, x, 0)
    height = [0] * nodes
    while True:
        far, via = [None] * nodes, [None] * nodes
        far[source], queue = 0, [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e, (b, room, price, _) in enumerate(graph[a]):
                step = d + price + height[a] - height[b]
                if room and (far[b] is None or step < far[b]):
                    far[b], via[b] = step, (a, e)
                    heapq.heappush(queue, (step, b))
        if far[sink] is None:
            break
        height = [h + (f if f is not None else far[sink]) for h, f in zip(height, far)]
        at, room = sink, None
        while at != source:
            a, e = via[at]
            room = graph[a][e][1] if room is None else min(room, graph[a][e][1])
            at = a
        at = sink
        while at != source:
            a, e = via[at]
            graph[a][e][1] -= room
            graph[at][graph[a][e][3]][1] += room
            at = a
    flow = [[0] * n for _ in range(m)]
    for i in range(m):
        for b, room, _, back in graph[i]:
            if m <= b < m + n:
                flow[i][b - m] = graph[b][back][1]
    return flow


def even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def transfers(sizes: list[int], capacities: list[int]) -> list[dict[int, int]]:
    """Bytes from each old shard to new ones, the fewest that move. Old shards
    beyond the new ones stay nowhere: to the flow they are one source, which
    is then dealt out in their order. So the graph follows the new shards."""
    n = len(capacities)
    supply = sizes[:n] + [sum(sizes[n:])]
    solved = min_cost_flow(supply, capacities, [[int(i != j) for j in range(n)] for i in range(len(supply))])
    found = [{j: x for j, x in enumerate(row) if x} for row in solved[: min(n, len(sizes))]]
    rest = [[j, x] for j, x in enumerate(solved[-1]) if x]
    for size in sizes[n:]:
        own: dict[int, int] = {}
        while size:
            j, room = rest[0]
            own[j] = take = min(size, room)
            size -= take
            rest[0][1] -= take
            if not rest[0][1]:
                rest.pop(0)
        found.append(own)
    return found


def affected(flow: list[dict[int, int]], shards: int) -> set[int]:
    """New shards whose file differs from the old shard of the same number."""
    changed = set(range(len(flow), shards))
    for i, row in enumerate(flow):
        changed |= {j for j in row if j != i}
        if i < shards and (not row or set(row) != {i}):
            changed.add(i)
    return changed


@dataclass(frozen=True)
class Shard:
    """Where a shard is, a folder or a file; slots: the column that holds
    them, or None where they are the rows' numbers in the file."""

    path: str
    slots: str | None = None

    def holds(self, file: str) -> bool:
        return unquote(file) == self.path or "/" + "/".join(self.path.rsplit("/", 2)[1:]) + "/" in unquote(file)


Manifest = dict[int, Shard]


@dataclass
class Plan:
    """cuts: (file, starts, shards, firsts), the first row of each stretch of
    a file, its shard, and its first slot; rows: of each new shard; kept: the
    new shards that stay as they are; file_rows: rows for a file of FILE_BYTES."""

    flow: list[dict[int, int]]
    cuts: list[tuple[str, list[int], list[int], list[int]]]
    rows: list[int]
    kept: Manifest
    file_rows: int


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, file and row of every document."""
    rows = base.located(docs)
    file, row = rows.columns[-2:]
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.col(file).alias("file"), F.col(row).alias("row"))


def _first_rows(sized: DataFrame, offsets: list[tuple[str, int]]) -> dict[tuple[str, int], int]:
    """For each (file, offset in its bytes) the first row whose middle lies
    there or beyond. Only the blocks of rows around them are put in order."""
    wanted = sized.sparkSession.createDataFrame(offsets, "file string, offset long")
    lines = sized.join(F.broadcast(wanted.select("file").distinct()), "file", "left_semi").withColumn("block", F.floor(F.col("row") / F.lit(BLOCK_ROWS)))
    blocks = lines.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    blocks = blocks.selectExpr("file", "block", "bytes", "sum(bytes) OVER (PARTITION BY file ORDER BY block) - bytes AS begin")
    cut = blocks.join(F.broadcast(wanted), "file").where("begin <= offset AND offset < begin + bytes").select("file", "block", "begin", "offset")
    near = lines.join(F.broadcast(cut), ["file", "block"])
    near = near.selectExpr("*", "begin + sum(size) OVER (PARTITION BY file, block, offset ORDER BY row) - size + size div 2 AS middle")
    after = F.coalesce(F.min(F.when(F.col("middle") >= F.col("offset"), F.col("row"))), F.max("row") + 1)
    return {(r.file, r.offset): r.after for r in near.groupBy("file", "offset").agg(after.alias("after")).collect()}


def planned(sized: DataFrame, shards: int, old: Manifest | None = None) -> Plan | None:
    """Where all rows of sized(size, file, row) go; None if rows of a file are
    missing. The driver holds one entry for each file and each cut."""
    totals = sized.groupBy("file").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("row").alias("last")).collect()
    totals.sort(key=lambda r: r.file.encode("utf-8", "surrogatepass"))
    if any(r.n != r.last + 1 for r in totals):
        return None
    if old is None:
        old = {i: Shard(unquote(r.file)) for i, r in enumerate(totals)}
        files = {i: [r] for i, r in enumerate(totals)}
    else:
        files = defaultdict(list)
        for r in totals:
            files[next(i for i, x in old.items() if x.holds(r.file))].append(r)
    sizes = [sum(r.bytes for r in files.get(i, ())) for i in range(max(files, default=-1) + 1)]
    flow = transfers(sizes, even(sum(sizes), shards))
    # the stretches of each file: (bytes of it where they begin, shard)
    stretches: dict[str, list[tuple[int, int]]] = {}
    for i, row in enumerate(flow):
        ends, at = [], 0
        for j in sorted(row, key=lambda j: (j != i, j)):
            ends.append((at := at + row[j], j))
        begin, k = 0, 0
        for r in files.get(i, ()):
            own = [(0, ends[k][1])]
            while k < len(ends) - 1 and ends[k][0] < begin + r.bytes:
                own.append((ends[k][0] - begin, ends[k + 1][1]))
                k += 1
            stretches[r.file] = own
            begin += r.bytes
            if k < len(ends) - 1 and ends[k][0] == begin:
                k += 1
    offsets = [(f, at) for f, own in stretches.items() for at, _ in own[1:]]
    found = _first_rows(sized, offsets) if offsets else {}
    cuts, rows = [], [0] * shards
    for r in (r for i in sorted(files) for r in files[i]):
        own = stretches[r.file]
        starts = [0] + [found[r.file, at] for at, _ in own[1:]]
        firsts = []
        for (_, j), a, b in zip(own, starts, [*starts[1:], r.n]):
            firsts.append(rows[j])
            rows[j] += b - a
        cuts.append((r.file, starts, [j for _, j in own], firsts))
    changed = affected(flow, shards)
    file_rows = max(1, FILE_BYTES * sum(rows) // max(1, sum(sizes)))
    return Plan(flow, cuts, rows, {i: x for i, x in old.items() if i < shards and i not in changed}, file_rows)


def with_places(rows: DataFrame, plan: Plan, file: str = "file", row: str = "row") -> DataFrame:
    """rows with the columns shard and slot, in place of file and row."""
    where, shard, slot = base.fresh(rows, "where", "shard", "slot")
    table = rows.sparkSession.createDataFrame([(f, (a, b, c)) for f, a, b, c in plan.cuts], f"{file} string, `{where}` struct<starts: array<long>, shards: array<int>, firsts: array<long>>")
    out = rows.join(base.maybe_broadcast(table, len(plan.cuts), BROADCAST_FILES), file)
    k = f"(size(filter({where}.starts, x -> x <= {row})) - 1)"  # of empty stretches that share a start, the last holds the row
    return out.withColumn(shard, F.expr(f"{where}.shards[{k}]")).withColumn(slot, F.expr(f"{where}.firsts[{k}] + {row} - {where}.starts[{k}]")).drop(where, file, row)


def reshard(docs: DataFrame, shards: int = SHARDS, old: Manifest | None = None) -> tuple[DataFrame, Plan, DataFrame]:
    """doc_id, size, text_crc32, shard and slot of every document, the plan
    behind them, and docs as the plan numbers its rows."""
    docs = base.filed(docs)
    sized = base.stored(measured(docs), "sized")
    plan = planned(sized, shards, old)
    if plan is None:  # a scan of parts of files
        return reshard(base.stored(docs, "to-shard"), shards)
    return with_places(sized, plan), plan, docs


def rewrite_affected(docs: DataFrame, plan: Plan, folder: str) -> Manifest:
    """Write the new shards that change below folder, each row with its slot
    in a last column, and return the manifest of all that have rows."""
    changed = [j for j, n in enumerate(plan.rows) if n and j not in plan.kept]
    if not changed:
        return dict(plan.kept)
    rows = base.located(docs)
    rows = with_places(rows, plan, *rows.columns[-2:])
    shard, slot = rows.columns[-2:]
    (by,) = base.fresh(rows, "of_shard")
    target = f"{folder}/shards-{uuid.uuid4().hex}"
    rows = rows.where(F.col(shard).isin(changed)) if plan.kept else rows
    # a task for each file: the files of the shards before, and those before in its own
    before, files = {}, 0
    for j in changed:
        before[j], files = files, files + -(-plan.rows[j] // plan.file_rows)
    task = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col(shard)) + F.floor(F.col(slot) / plan.file_rows)
    dealt = rows.repartitionById(files, task.cast("int")).withColumn(by, F.col(shard)).drop(shard).sortWithinPartitions(by, slot)
    dealt.write.partitionBy(by).parquet(target)
    return plan.kept | {j: Shard(f"{target}/{by}={j}", slot) for j in changed}


def documents_of(spark: SparkSession, manifest: Manifest, schema: T.StructType) -> DataFrame:
    """The documents of all shards, as one scan."""
    return spark.read.schema(schema).parquet(*[x.path for x in manifest.values()]) if manifest else spark.createDataFrame([], schema)


def read_shards(spark: SparkSession, manifest: Manifest, schema: T.StructType) -> DataFrame:
    """The columns of schema, and last shard and slot, of all shards."""
    shard, place = base.fresh(spark.createDataFrame([], schema), "shard", "slot")
    out = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(shard, T.IntegerType()), T.StructField(place, T.LongType())]))
    for j, x in sorted(manifest.items()):
        fields = schema.fields if x.slots is None else [*schema.fields, T.StructField(x.slots, T.LongType())]
        rows = spark.read.schema(T.StructType(fields)).parquet(x.path)
        slot = rows.metadataColumn("_metadata").getField("row_index") if x.slots is None else F.col(x.slots)
        out = out.union(rows.select(*[F.col(base.quoted(c)) for c in schema.names], F.lit(j).alias(shard), slot.alias(place)))
    return out


def _digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, old: Manifest | None = None) -> Manifest:
    """Plan, write what changes below folder, and return the manifest. old:
    the shards that docs, as documents_of() reads them, is in now."""
    _, plan, rows = reshard(docs, shards, old)
    return rewrite_affected(rows, plan, folder)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the shards with all columns of docs, and returns the digest of
    what is read back from them."""
    manifest = write_shards(docs, f"{base.shared_folder(spark)}/lectern")
    back = read_shards(spark, manifest, T.StructType([docs.schema["doc_id"], docs.schema["text"]]))
    text = F.coalesce(F.col("text"), F.lit(""))
    return _digest(back.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "shard", "slot"))


def sharded(docs: DataFrame) -> DataFrame:
    return _digest(reshard(docs)[0])


def op7_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(base.table(spark, sf_dir, "documents"))
