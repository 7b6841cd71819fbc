"""MinHash near-duplicates: banded minima, checked signatures, exact sets.

1. One pass hashes each text's distinct shingles, takes BANDS * ROWS universal
   hash minima of them and a digest of the whole set. Texts of equal sets are
   one class, whatever their number, and only classes go on.
2. Classes that share a band (ROWS minima) meet. Of those that meet, a pair
   stays if enough bytes of the two signatures agree and one set is not too
   small for the other. A group of classes leaves links that span what its
   pairs reach, never all pairs; alternating large-star and small-star joins
   them to clusters of candidates.
3. A cluster's texts are read again and their full sets compared: again only
   spanning links leave, each confirmed exactly, and the stars give the
   components.

A link at the threshold shares no band with odds of 2e-8, and fails the bytes
with odds of 2e-8; higher ones less.

Groups and clusters of any size are compared whole. One that is too large for
a task is dealt to parts that all hold the same few hubs; what the hubs connect
is one component, and only the rest meets every part. So a large group of
copies costs a pass, and no member is left out.

Null and empty texts, and those without words, are alone; so each gives its
own id, and a null id no id. Null doc_id: takes its group's least id, never
gives it; kept if its group has no id. Repeated rows: the same group, each row
kept if its id is the least. Very long texts: memory follows one text. Empty
table: empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, buffers, components

SHINGLE = 3
#: Least similarity of a link in percent.
PERCENT = 85
BANDS, ROWS = 24, 4
#: Bytes of two signatures that agree at least; 82 of 96 are expected at the threshold.
AGREE = 60
#: Classes of a band, and shingles (with MEMBER for each class) of a cluster, that one task compares.
BAND_LIMIT, CLUSTER_LIMIT, MEMBER = 4096, 1 << 20, 32
HUBS = 8
#: Bits of the map of rows that are read again: 8 MB for every task.
SIEVE_BITS = 1 << 26
#: Up to so many classes of a band are compared all at once.
SMALL = 16

_rng = np.random.Generator(np.random.PCG64(20250713))
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_SALT = _rng.integers(1, 2**63, BANDS + 2, dtype=np.uint64)


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within a text, and where
    each text's begin."""
    data = buffers.LOWER[data]
    starts, ends, first = buffers.spans(data, at, buffers.NOT_SPACE)
    words = buffers.word_hashes(data, starts, ends)
    counts = np.diff(first)
    begin = buffers.whole_windows(first, size)
    hashes, owner = [buffers.window_hashes(words, size)[begin]], [np.searchsorted(first, begin, "right") - 1]
    for k in range(1, size):  # a text of fewer words is one shingle
        short = np.flatnonzero(counts == k)
        hashes.append(buffers.window_hashes(words, k)[first[short]] if len(short) else np.zeros(0, np.uint64))
        owner.append(short)
    h, text = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    once = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]) if len(h) else np.zeros(0, bool)
    return h[once], np.searchsorted(text[once], np.arange(len(at)))


def minima(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over sets that are not empty."""
    out = np.zeros((len(begin), len(_A)), np.uint64)
    with np.errstate(over="ignore"):
        for i, (a, b) in enumerate(zip(_A, _B)):
            out[:, i] = np.minimum.reduceat(h * a + b, begin)
    return out


def bands_and_bytes(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band, and one byte for each minimum."""
    by_band = buffers.mixed(low).reshape(len(low), BANDS, ROWS)
    with np.errstate(over="ignore"):
        keys = _SALT[:BANDS] + np.zeros((len(low), BANDS), np.uint64)
        for r in range(ROWS):
            keys = buffers.mixed(keys + by_band[:, :, r])
    return keys, (buffers.mixed(low) >> np.uint64(56)).astype(np.uint8)


def printed(docs: DataFrame) -> DataFrame:
    """(doc_id, file, row, d1, d2, n, keys, bytes) of every row of a scan; the
    last two are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in buffers.slices(batch):
                h, begin = shingle_sets(data, at)
                n = np.diff(begin)
                some = np.flatnonzero(n)
                digest = np.zeros((2, len(n)), np.uint64)
                with np.errstate(over="ignore"):
                    for d in range(2) if len(some) else ():
                        digest[d, some] = np.add.reduceat(buffers.mixed(h ^ _SALT[BANDS + d]), begin[some])
                keys, marks = bands_and_bytes(minima(h, begin[some]))
                there = np.where(n > 0, BANDS, 0)
                at_key = pa.array(np.concatenate([[0], np.cumsum(there)]).astype(np.int32), mask=np.concatenate([n == 0, [False]]))
                lists = pa.ListArray.from_arrays(at_key, pa.array(keys.reshape(-1).view(np.int64)))
                raw, turn = [None] * len(n), marks.tobytes()
                for k, i in enumerate(some.tolist()):
                    raw[i] = turn[k * len(_A) : (k + 1) * len(_A)]
                columns = [*rows.columns[:3], *(pa.array(d.view(np.int64)) for d in digest), pa.array(n), lists, pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "file", "row", "d1", "d2", "n", "keys", "bytes"])

    return docs.select("doc_id", "file", "row", "text").mapInArrow(run, "doc_id long, file string, row long, d1 long, d2 long, n long, keys array<long>, bytes binary")


# ---------------------------------------------------------------- in a task


def _bytes_agree(marks: np.ndarray, n: np.ndarray, i: int | np.ndarray, j: np.ndarray) -> np.ndarray:
    fit = 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
    return fit & (np.count_nonzero(marks[i] == marks[j], axis=1) >= AGREE)


def links_by_bytes(group: np.ndarray, n: np.ndarray, load: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Links (two arrays of row numbers) that span the agreeing pairs of every
    run of rows of one group."""
    marks = np.frombuffer(b"".join(load.to_pylist()), np.uint8).reshape(-1, len(_A))
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    length = np.diff(np.concatenate([begin, [len(group)]]))
    a, b = [], []
    small = np.flatnonzero(np.repeat(length <= SMALL, length))
    for lag in range(1, min(SMALL, len(small))):
        x, y = small[:-lag], small[lag:]
        same = group[x] == group[y]
        if not same.any():
            break
        x, y = x[same], y[same]
        hit = _bytes_agree(marks, n, x, y)
        a.append(x[hit])
        b.append(y[hit])
    for r in np.flatnonzero(length > SMALL).tolist():
        left = np.arange(begin[r], begin[r] + length[r])
        while len(left):
            frontier, left = [int(left[0])], left[1:]
            while frontier and len(left):
                i = frontier.pop()
                hit = _bytes_agree(marks, n, i, left)
                a.append(np.full(int(hit.sum()), i))
                b.append(left[hit])
                frontier += left[hit].tolist()
                left = left[~hit]
    none = [np.zeros(0, np.int64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def spanning(h: np.ndarray, begin: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that span all pairs of sets at the threshold, by exact counts of
    common members. Members of the sets that are still alone are kept as
    postings, which shrink as sets are reached."""
    sizes = np.diff(begin)
    m = len(sizes)
    owner = np.repeat(np.arange(m), sizes)
    member = np.unique(h, return_inverse=True)[1]
    order = np.argsort(member, kind="stable")
    posted = owner[order]
    ends = np.cumsum(np.bincount(member, minlength=1))
    alone, count = sizes > 0, int(np.count_nonzero(sizes))
    kept, a, b = count, [], []
    for seed in range(m):
        if not alone[seed]:
            continue
        alone[seed], count = False, count - 1
        frontier = [seed]
        while frontier and count:
            if 2 * count < kept:  # postings of sets that were reached are of no more use
                live = alone[posted]
                sums = np.concatenate([[0], np.cumsum(live)])
                ends, posted, kept = sums[ends], posted[live], count
            i = frontier.pop()
            v = member[begin[i] : begin[i + 1]]
            start = np.where(v > 0, ends[v - 1], 0)
            each = ends[v] - start
            at = np.repeat(start - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
            common = np.bincount(posted[at], minlength=m)
            hit = np.flatnonzero(alone & (100 * common >= PERCENT * (sizes[i] + sizes - common)))
            a += [i] * len(hit)
            b += hit.tolist()
            alone[hit], count = False, count - len(hit)
            frontier += hit.tolist()
    return a, b


def links_by_sets(group: np.ndarray, n: np.ndarray, load: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the pairs of texts of one group whose sets are near."""
    hashes, sizes = [], []
    for _, data, at in buffers.slices(pa.RecordBatch.from_arrays([load], names=["text"])):
        h, begin = shingle_sets(data, at)
        hashes.append(h)
        sizes.append(np.diff(begin))
    h, begin = np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    edges = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    a, b = [], []
    for i, j in zip(edges.tolist(), edges[1:].tolist()):
        if j - i > 1:
            x, y = spanning(h[begin[i] : begin[j]], begin[i : j + 1] - begin[i])
            a += [k + i for k in x]
            b += [k + i for k in y]
    return np.array(a, np.int64), np.array(b, np.int64)


def _run(rows: DataFrame, compare: Callable) -> DataFrame:
    """Links (a, b) within each group of rows(grp, node, n, load). A task holds
    the runs of one batch, or one group that spans batches."""

    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        grp, node, n = (table.column(i).to_numpy() for i in range(3))
        a, b = compare(grp, n, table.column("load").chunk(0))
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            grp = batch.column("grp").to_numpy()
            cut = int(np.searchsorted(grp, grp[-1], "left"))
            if held and held[-1].column("grp")[0].as_py() != grp[-1]:
                yield from emit([*held, batch.slice(0, cut)] if cut else held)
                held, batch = [], batch.slice(cut)
            elif not held and cut:
                yield from emit([batch.slice(0, cut)])
                batch = batch.slice(cut)
            held.append(batch)
        if held:
            yield from emit(held)

    dealt = rows.repartition("grp").sortWithinPartitions("grp")
    return dealt.select("grp", "node", "n", "load").mapInArrow(run, "a long, b long")


# ------------------------------------------------------------- between tasks


def spanning_links(members: DataFrame, loads: DataFrame, compare: Callable, limit: int) -> DataFrame:
    """Links that span the near pairs of every group, of any size. members is
    stored (grp, node, weight) and loads is stored (node, n, load)."""
    sizes = members.groupBy("grp").agg(F.count("*").alias("many"), F.ceil(F.sum("weight") / limit).cast("int").alias("parts")).where("many > 1").select(F.col("grp").alias("grp_"), "parts")
    sized = base.stored(members.join(sizes, F.col("grp") == F.col("grp_")).select("grp", "node", "weight", "parts"), "sized")

    def loaded(rows: DataFrame) -> DataFrame:
        return rows.join(loads.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_")).select("grp", "node", "n", "load")

    links = base.stored(_run(loaded(sized.where("parts = 1")), compare), "near")
    hot = sized.where("parts > 1")
    if not hot.limit(1).count():
        return links
    # every part of a large group holds the same hubs
    part = F.pmod(F.xxhash64("node", "grp"), F.col("parts"))
    block = lambda *of: F.xxhash64("grp", *of).alias("grp")
    hubs = hot.groupBy("grp").agg(F.max("parts").alias("parts"), F.array(*[F.min(F.struct(F.xxhash64("node", F.lit(k)), "node")).getField("node") for k in range(HUBS)]).alias("hubs"))
    hubs = hubs.select("grp", F.explode(F.array_distinct("hubs")).alias("node"), F.sequence(F.lit(0), F.col("parts") - 1).alias("part")).select("grp", "node", F.explode("part").alias("part"))
    first = hubs.select(block("part"), "node").union(hot.select(block(part.cast("int")), "node")).distinct()
    links = base.stored(links.union(_run(loaded(first), compare)), "near")
    # what is now one component needs no more comparing; the rest meets all
    reached = components.least_reachable(links).select(F.col("a").alias("node_"), "b")
    known = base.stored(hot.join(reached, F.col("node") == F.col("node_"), "left").select("grp", "node", "weight", "parts", F.coalesce("b", "node").alias("top")), "known")
    main = known.groupBy("grp", "top").agg(F.count("*").alias("many")).groupBy("grp").agg(F.max_by("top", F.struct("many", "top")).alias("main")).select(F.col("grp").alias("grp_"), "main")
    rest = base.stored(known.join(main, F.col("grp") == F.col("grp_")).where("top <> main").select("grp", "node", "weight", "parts"), "rest")
    others = rest.groupBy("grp").agg(F.ceil(F.sum("weight") / limit).cast("int").alias("others")).select(F.col("grp").alias("grp_"), "others")
    across = lambda rows: rows.join(others, F.col("grp") == F.col("grp_"))
    turn = F.pmod(F.xxhash64("node", "grp", F.lit(1)), F.col("others")).cast("int")
    guests = across(known).select("grp", "node", part.cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"))
    homes = across(rest).select("grp", "node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), turn.alias("other"))
    second = guests.unionByName(homes).select(block("part", "other"), "node").distinct()
    return base.stored(links.union(_run(loaded(second), compare)), "near")


def sieved(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs(file, row, text) without most rows that are not wanted(file_,
    row_): a bitmap of hashed places, of one size whatever the number of rows,
    goes to all tasks, so that texts of no cluster are not shuffled. What it
    lets through besides, the join that follows takes out."""
    place = lambda *of: F.pmod(F.xxhash64(*of), F.lit(SIEVE_BITS))
    bits = wanted.select(place("file_", "row_").alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toArrow()
    words = np.zeros(SIEVE_BITS >> 6, np.uint64)
    words[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy()
            there = shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
            yield batch.filter(pa.array(there.astype(bool))).select(["file", "row", "text"])

    return docs.select("file", "row", "text", place("file", "row").alias("at")).mapInArrow(run, "file string, row long, text string")


def _tops(links: DataFrame) -> DataFrame:
    """(node, top) of every linked node."""
    reached = components.least_reachable(links)
    return base.stored(reached.select(F.col("a").alias("node"), F.col("b").alias("top")).union(reached.select("b", "b").distinct()), "tops")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    docs = base.filed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    docs = base.located(docs).toDF("doc_id", "text", "file", "row")
    prints = base.stored(printed(docs), "prints")
    classes = prints.where("n > 0").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("file", "row")).alias("place"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bytes").alias("bytes")
    )
    classes = base.stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    bands = classes.select(F.explode("keys").alias("grp"), "node", F.lit(1).alias("weight"))
    candidates = spanning_links(bands, classes.select("node", "n", F.col("bytes").alias("load")), links_by_bytes, BAND_LIMIT)
    clusters = _tops(candidates)

    own = classes.select(F.col("node").alias("node_"), "n", "place")
    placed = base.stored(clusters.join(own, F.col("node") == F.col("node_")).select("top", "node", "n", F.col("place.file").alias("file_"), F.col("place.row").alias("row_")), "clusters")
    texts = sieved(docs, placed).join(placed, (F.col("file") == F.col("file_")) & (F.col("row") == F.col("row_"))).select("node", "n", F.col("text").alias("load"))
    members = placed.select(F.col("top").alias("grp"), "node", (F.col("n") + MEMBER).alias("weight"))
    links = spanning_links(members, base.stored(texts, "texts"), links_by_sets, CLUSTER_LIMIT)

    tops = _tops(links).select(F.col("node").alias("node_"), "top")
    known = base.stored(classes.join(tops, F.col("node") == F.col("node_"), "left").select("d1", "d2", "least_id", F.coalesce("top", "node").alias("top")), "known")
    least = known.groupBy("top").agg(F.min("least_id").alias("component_id")).select(F.col("top").alias("top_"), "component_id")
    found = base.stored(known.join(least, F.col("top") == F.col("top_")).select(F.col("d1").alias("d1_"), F.col("d2").alias("d2_"), "component_id"), "groups-of")
    rows = prints.select("doc_id", "d1", "d2", "n")
    linked = rows.where("n > 0").join(found, (F.col("d1") == F.col("d1_")) & (F.col("d2") == F.col("d2_")))
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone)


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(base.table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least.component_id, d.doc_id = least.component_id AS kept
FROM documents AS d JOIN least ON least.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
