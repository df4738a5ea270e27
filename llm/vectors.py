"""Embedding near-duplicates by range search in robust-pruned flat graphs.

Vectors of one label are clustered around sampled centroids, and each belongs
to its two nearest clusters; a cluster with more than SHARD vectors is dealt at
random into several shards. Each shard builds a robust-pruned graph over its vectors, and the
adjacency lists that a vector has in its shards are united. Then each vector is searched
for in every shard of its two clusters: a greedy search starts at the shard's medoid and at the vector's own
place, if it has one there, and expands the best candidates; whatever lies within the range is expanded as well, so
that it leads to the rest of the range. Hits are checked in double precision.

A linked pair need not share one of its two clusters, so the graphs alone would compare a share of the pairs that falls
as clusters grow in number. Every other cluster that can hold a linked vector, by bounds that miss none (``_open``), is
scanned in full: its home vectors against the vector, in blocks.

A hit in the second cluster counts only if it is not in the first one too, so each
link is counted once. Shards return sums and a spanning forest of their links, never
all pairs. Equal vectors of a label are one vertex with a weight. ``audit`` measures the recall.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link
with nothing, as do vectors of different lengths. Repeated rows count as rows of their own; a row with a null id has a
null component and is kept. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.components import connected_components
from llm.store import stored

#: Vectors in a shard at most (on average, where a cluster is dealt out); clusters aim at half of it.
SHARD = 2048
#: Clusters of a label at most, and over all labels sampled centroids at most.
MOST_CLUSTERS, MOST_CENTROIDS = 256, 2048
#: Sampled vectors for each centroid; cosine of centroids that are merged.
PER_CENTROID, MERGE = 32, 0.75
#: Components of all sampled vectors at most (single precision: 128 MB on the driver); longer vectors have fewer samples for each centroid.
SAMPLE_VALUES = 32_000_000
#: Neighbours kept, candidates pruned, pruning slack; candidates that a search keeps expanding.
DEGREE, POOL, ALPHA, BEAM = 24, 64, 1.2, 24
#: Queries searched together in a shard.
QUERIES = 512
#: Components of the vectors in a block of whole clusters that is scanned, and as many of its queries; home vectors in one product.
FAR_VALUES, FAR_COLUMNS = 4_000_000, 8192


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def robust_prune(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency lists, made symmetric so that every vector can be reached.

    Candidates are a vector's nearest POOL and others at growing ranks up to the farthest, which give the
    long edges; chosen are those not much nearer to an earlier chosen one.
    """
    n = len(x)
    near = 1.0 - x @ x.T
    np.fill_diagonal(near, np.inf)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    ranks = np.arange(n - 1)
    if n - 1 > POOL:
        ranks = np.unique(np.concatenate([ranks[:POOL], np.geomspace(POOL, n - 1, POOL).astype(np.int64) - 1]))
    order = np.argsort(near, axis=1, kind="stable")[:, ranks]
    dist = np.take_along_axis(near, order, axis=1)
    pool = len(ranks)
    alive = np.ones((n, pool), bool)
    kept = np.zeros((n, pool), bool)
    for k in range(pool):
        rows = np.flatnonzero(alive[:, k] & (kept.sum(axis=1) < DEGREE))
        if len(rows) == 0:
            continue
        kept[rows, k] = True
        chosen = order[rows, k]
        to_chosen = near[chosen[:, None], order[rows]]
        alive[rows] &= ALPHA * to_chosen > dist[rows]
    a, k = np.nonzero(kept)
    b = order[a, k]
    key = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.split(key % n, np.searchsorted(key // n, np.arange(1, n)))


def greedy_range_search(x: np.ndarray, flat: np.ndarray, first: np.ndarray, q: np.ndarray, own: np.ndarray, medoid: int, least: float) -> np.ndarray:
    """Boolean (queries, vectors): the vectors found with a cosine of at least ``least``.

    flat[first[i] : first[i + 1]] are the neighbours of vector i; own is a query's own place or -1.
    """
    m, n = len(q), len(x)
    seen, hit = np.zeros((m, n), bool), np.zeros((m, n), bool)
    # the BEAM best vectors that each query has seen, and which of them need no expansion any more
    ids, best, done = np.zeros((m, BEAM), np.int64), np.full((m, BEAM), -np.inf), np.ones((m, BEAM), bool)

    def look(rows, cols):
        """New pairs, in order of queries, with their cosines."""
        key = np.unique(rows * n + cols)
        key = key[~seen.ravel()[key]]
        seen.ravel()[key] = True
        rows, cols = key // n, key % n
        cosine = np.empty(len(key))
        for s in range(0, len(key), 50_000):
            cosine[s : s + 50_000] = np.einsum("ij,ij->i", q[rows[s : s + 50_000]], x[cols[s : s + 50_000]])
        hit[rows, cols] = cosine >= least
        return rows, cols, cosine

    def take(rows, cols, cosine):
        """Put new pairs on the lists of their queries; those in range are returned, and expanded whatever the lists hold."""
        inside = cosine >= least - 1e-6
        some, counts = np.unique(rows, return_counts=True)
        if len(some):
            place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = np.repeat(np.arange(len(some)), counts)
            wide = BEAM + int(counts.max())
            i, c, d = np.zeros((len(some), wide), np.int64), np.full((len(some), wide), -np.inf), np.ones((len(some), wide), bool)
            i[:, :BEAM], c[:, :BEAM], d[:, :BEAM] = ids[some], best[some], done[some]
            i[at, BEAM + place], c[at, BEAM + place], d[at, BEAM + place] = cols, cosine, inside
            top = np.argpartition(-c, BEAM - 1, axis=1)[:, :BEAM]
            ids[some], best[some], done[some] = (np.take_along_axis(z, top, axis=1) for z in (i, c, d))
        return rows[inside], cols[inside]

    every = np.arange(m)
    known = own >= 0
    rows, cols = take(*look(np.concatenate([every, every[known]]), np.concatenate([np.full(m, medoid), own[known]])))
    while True:
        waiting = np.where(done, -np.inf, best)
        k = waiting.argmax(axis=1)
        go = np.flatnonzero(waiting[every, k] > -np.inf)  # a query goes on while one of its BEAM best is open
        done[go, k[go]] = True
        rows, cols = np.concatenate([rows, go]), np.concatenate([cols, ids[go, k[go]]])
        if len(rows) == 0:
            return hit
        size = first[cols + 1] - first[cols]
        step = max(1, 2_000_000 // max(1, int(size.max())))
        inside = []
        for s in range(0, len(rows), step):
            z = size[s : s + step]
            ends = np.cumsum(z)
            at = np.arange(ends[-1]) + np.repeat(first[cols[s : s + step]] - ends + z, z)
            inside.append(take(*look(np.repeat(rows[s : s + step], z), flat[at])))
        rows, cols = (np.concatenate(c) for c in zip(*inside, strict=True))


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; of centroids closer than MERGE only that of the larger cluster stays, so that no crowd of copies is torn apart."""
    random = np.random.default_rng(k)
    chosen, gap = [0], np.maximum(0, 1 - x @ x[0])
    while len(chosen) < min(k, len(x)) and gap.sum() > 1e-9:
        chosen.append(int(random.choice(len(x), p=gap / gap.sum())))
        gap = np.minimum(gap, np.maximum(0, 1 - x @ x[chosen[-1]]))
    c = x[chosen]
    for _ in range(8):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    kept: list[int] = []
    for j in np.argsort(-np.bincount((x @ c.T).argmax(axis=1), minlength=len(c)), kind="stable"):
        if not kept or (c[kept] @ c[j]).max() < MERGE:
            kept.append(int(j))
    return c[kept]


def _centroids(classes: DataFrame, shard: int) -> dict:
    """Sampled vectors of each (label, length): a bounded number, the same for the same table."""
    counts = {(r["label"], r["dim"]): r["n"] for r in classes.groupBy("label", "dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label", "dim").limit(MOST_CENTROIDS // 2).collect()}
    wanted = {k: min(MOST_CLUSTERS, max(1, MOST_CENTROIDS // max(1, len(counts))), -(-2 * n // shard)) for k, n in counts.items()}
    per = min(PER_CENTROID, SAMPLE_VALUES / max(1, sum(w * k[1] for k, w in wanted.items())))
    rate = classes.sparkSession.createDataFrame([(k[0], k[1], min(1.0, per * w / counts[k])) for k, w in wanted.items()] or [(0, 0, 0.0)], "label long, dim int, rate double")
    drawn = classes.join(F.broadcast(rate), ["label", "dim"]).where(F.pmod(F.xxhash64("rep"), F.lit(1_000_003)) / 1_000_003.0 < F.col("rate")).select("label", "dim", "rep", F.col("v").cast("array<float>").alias("v")).toArrow()
    if drawn.num_rows == 0:
        return {}
    label, dim, rep = (drawn[c].to_numpy() for c in ("label", "dim", "rep"))
    lists = drawn["v"].combine_chunks()
    at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    order = np.lexsort((rep, dim, label))
    cuts = np.flatnonzero((np.diff(label[order]) != 0) | (np.diff(dim[order]) != 0)) + 1
    found = {}
    for rows in np.split(order, cuts):
        k = (int(label[rows[0]]), int(dim[rows[0]]))
        found[k] = _cluster(_unit(np.stack([values[at[i] : at[i + 1]] for i in rows]).astype(np.float64)), wanted[k])
    return found


def _open(cosine: np.ndarray, one: np.ndarray, two: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray, least: float) -> np.ndarray:
    """Boolean (vectors, clusters): clusters besides a vector's two whose home vectors may be within its range.

    cosine is that of vectors and centroids, low and high the least and largest cosine of a cluster's home vectors with its centroid
    (2 and -2 for a cluster without any). A home vector of cluster j is no nearer to the vector's own centroid than to j's, so
    it lies beyond the plane between them; and its angle to centroid j differs from the vector's by the range's angle at most.
    """
    found = np.tile(low <= high, (len(cosine), 1))
    if least > 0:
        gap = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
        found &= cosine[np.arange(len(cosine)), one][:, None] - cosine <= np.sqrt(max(0.0, 1 - least * least)) * gap[one] + 1e-6
    angle, turn = np.arccos(np.clip(cosine, -1, 1)), np.arccos(np.clip(least, -1, 1))
    found &= angle <= np.arccos(np.clip(low, -1, 1)) + turn + 1e-6
    found &= angle >= np.arccos(np.clip(high, -1, 1)) - turn - 1e-6
    found[np.arange(len(cosine)), one] = False
    found[np.arange(len(cosine)), two] = False
    return found


def _far_blocks(c: np.ndarray, sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each cluster: similar clusters share a block of about ``room`` vectors, larger ones are cut."""
    first, parts = np.zeros(len(c), np.int32), np.ones(len(c), np.int32)
    left, at, block, filled = set(range(len(c))), 0, 0, 0
    while left:
        left.discard(at)
        if filled and filled + sizes[at] > room:
            block, filled = block + 1, 0
        first[at], parts[at] = block, max(1, -(-int(sizes[at]) // room))
        filled += int(sizes[at])
        if parts[at] > 1:
            block, filled = block + int(parts[at]), 0
        if left:
            rest = np.array(sorted(left))
            at = int(rest[(c[rest] @ c[at]).argmax()])
    return first, parts


def _far(placed: DataFrame, centroids: dict, least: float) -> DataFrame:
    """(rep, n, to) of the links between vectors that share none of their clusters."""
    homes = placed.where("c2 >= 0").groupBy("label", "dim", "c1").agg(F.count("*").alias("n"), F.min("own").alias("low"), F.max("own").alias("high")).collect()
    known: dict = {}
    for k, c in centroids.items():
        if len(c) > 2:
            known[k] = [c, np.full(len(c), 2.0), np.full(len(c), -2.0), np.zeros(len(c), np.int64)]
    for r in homes:
        if (r["label"], r["dim"]) in known:
            _, low, high, sizes = known[(r["label"], r["dim"])]
            low[r["c1"]], high[r["c1"]], sizes[r["c1"]] = r["low"], r["high"], r["n"]
    cut = {k: _far_blocks(c, sizes, max(1, FAR_VALUES // k[1])) for k, (c, _, _, sizes) in known.items()}

    def reach(batches):
        for batch in batches:
            label, dim = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
            for k in sorted(set(zip(label.tolist(), dim.tolist(), strict=True)) & set(known)):
                rows = batch.take(pa.array(np.flatnonzero((label == k[0]) & (dim == k[1]))))
                c, low, high, _ = known[k]
                first, parts = cut[k]
                one, two = rows.column("c1").to_numpy(), rows.column("c2").to_numpy()
                found = _open(_unit(_matrix(rows.column("v"))) @ c.T, one, two, c, low, high, least)
                asks = [np.unique(np.concatenate([np.zeros(0, np.int32), *(np.arange(first[j], first[j] + parts[j], dtype=np.int32) for j in np.flatnonzero(row))])) for row in found]
                ends = np.append(0, np.cumsum([len(a) for a in asks])).astype(np.int32)
                draw = (rows.column("rep").to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                home = first[one] + (draw % parts[one].astype(np.uint64)).astype(np.int32)
                far = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(asks).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(rows.column(x) for x in columns), pa.array(home.astype(np.int32)), far], names=[*columns, "home", "far"])

    columns = ["label", "dim", "rep", "copies", "c1", "c2", "v"]
    reached = stored(placed.where("c2 >= 0").mapInArrow(reach, "label long, dim int, rep long, copies long, c1 int, c2 int, v array<double>, home int, far array<int>"), "reached")
    asks = reached.select(*columns, F.explode("far").alias("f"))
    blocks = asks.groupBy("label", "dim", "f").agg(F.ceil(F.count("*") * F.col("dim") / FAR_VALUES).cast("int").alias("blocks"))
    asks = asks.join(blocks, ["label", "dim", "f"]).withColumn("b", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("blocks")).cast("int"))
    targets = reached.select(*columns, F.col("home").alias("f")).join(blocks, ["label", "dim", "f"]).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = ["label", "dim", "f", "b"]
    order = [*cell, "asks", "rep", "copies", "c1", "c2", "v"]
    mixed = targets.withColumn("asks", F.lit(False)).select(*order).union(asks.withColumn("asks", F.lit(True)).select(*order))

    def scan(batches):
        for table in _groups(batches, cell):
            ask = table["asks"].to_numpy(zero_copy_only=False).astype(bool)
            c, low, high, _ = known[(table["label"][0].as_py(), table["dim"][0].as_py())]
            t, q = table.filter(pa.array(~ask)), table.filter(pa.array(ask))
            del table
            t = t.take(pa.array(np.argsort(t["c1"].to_numpy(), kind="stable")))
            x, y = _unit(_matrix(t["v"])), _unit(_matrix(q["v"]))
            rep, weight, second = t["rep"].to_numpy(), t["copies"].to_numpy(), t["c2"].to_numpy()
            q_rep, one, two = q["rep"].to_numpy(), q["c1"].to_numpy(), q["c2"].to_numpy()
            bounds = np.searchsorted(t["c1"].to_numpy(), np.arange(len(c) + 1))
            roots = _Forest()
            for s in range(0, len(q), QUERIES):
                e = min(s + QUERIES, len(q))
                found = _open(y[s:e] @ c.T, one[s:e], two[s:e], c, low, high, least)
                n, to = np.zeros(e - s, np.int64), q_rep[s:e].copy()
                for j in np.flatnonzero(found.any(axis=0) & (np.diff(bounds) > 0)):
                    rows = s + np.flatnonzero(found[:, j])
                    for a in range(bounds[j], bounds[j + 1], FAR_COLUMNS):
                        r, k = np.nonzero(y[rows] @ x[a : min(a + FAR_COLUMNS, bounds[j + 1])].T >= least - 1e-9)
                        r, k = rows[r], a + k
                        new = (second[k] != one[r]) & (second[k] != two[r])  # not met in a graph
                        r, k = r[new], k[new]
                        for z in range(0, len(r), 50_000):
                            rz, kz = r[z : z + 50_000], k[z : z + 50_000]
                            hit = np.einsum("ij,ij->i", y[rz], x[kz]) >= least
                            rz, kz = rz[hit], kz[hit]
                            np.add.at(n, rz - s, weight[kz])
                            np.minimum.at(to, rz - s, rep[kz])
                            roots.join(q_rep[rz], rep[kz])
                some = n > 0
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(q_rep[s:e][some]), pa.array(n[some]), pa.array(to[some])], names=["rep", "n", "to"])
            a, b = roots.edges()
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.zeros(len(a), np.int64)), pa.array(b)], names=["rep", "n", "to"])

    return mixed.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(scan, "rep long, n long, to long")


def near_vectors(rows: DataFrame, least: float = 0.93, shard: int = SHARD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept) of each row."""
    v = F.col(vec_col).cast("array<double>")
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    plain = stored(plain.select("id", "label", "v", good.alias("good"), F.xxhash64("label", "v").alias("h")), "vectors")
    key = ["label", "h", "v"]
    classes = plain.where("good").groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = stored(classes.withColumn("dim", F.size("v")), "classes")
    centroids = _centroids(classes, shard)

    def assign(batches):
        for batch in batches:
            label, dim = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
            one, two, near = np.zeros(len(label), np.int32), np.full(len(label), -1, np.int32), np.ones(len(label))
            for k in set(zip(label.tolist(), dim.tolist(), strict=True)):
                at = np.flatnonzero((label == k[0]) & (dim == k[1]))
                c = centroids.get(k)
                if c is None or len(c) == 1:
                    continue
                cosine = _unit(_matrix(batch.column("v").take(pa.array(at)))) @ c.T
                one[at], near[at] = cosine.argmax(axis=1), cosine.max(axis=1)
                cosine[np.arange(len(at)), one[at]] = -2
                two[at] = cosine.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(one), pa.array(two), pa.array(near)], names=[*batch.schema.names, "c1", "c2", "own"])

    fields = "label long, rep long, copies long, dim int, v array<double>"
    placed = stored(classes.select("label", "rep", "copies", "dim", "v").mapInArrow(assign, fields + ", c1 int, c2 int, own double"), "clusters")
    member = placed.withColumn("c", F.explode(F.when(F.col("c2") < 0, F.array("c1")).otherwise(F.array("c1", "c2"))))
    sizes = member.groupBy("label", "dim", "c").agg(F.ceil(F.count("*") / shard).cast("int").alias("subs"))
    member = member.join(sizes, ["label", "dim", "c"]).withColumn("s", F.pmod(F.xxhash64("rep"), F.col("subs")).cast("int"))
    cell = ["label", "dim", "c", "s"]

    def build(batches):
        for table in _groups(batches, cell):
            rep = table["rep"].to_numpy()
            lists = robust_prune(_unit(_matrix(table["v"])))
            size = np.array([len(x) for x in lists], np.int32)
            flat = rep[np.concatenate(lists)] if size.sum() else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(flat))], names=["rep", "near"])

    ordered = member.select(*cell, "rep", "v").repartition(*cell).sortWithinPartitions(*cell)
    graph = ordered.mapInArrow(build, "rep long, near array<long>")
    union = graph.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # the lists of two shards
    targets = member.join(union, "rep").select(*cell, "rep", "copies", "c1", "c2", "v", "near")
    blocks = F.ceil(F.count("*").over(_window("label", "dim", "c")) / (2 * shard)).cast("int")
    asks = member.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
    both = asks.select(*[c for c in cell if c != "s"], F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("s"), "b", "rep", "copies", "c1", "c2", "v")
    every = sizes.join(asks.groupBy("label", "dim", "c").agg(F.max("blocks").alias("blocks")), ["label", "dim", "c"])
    targets = targets.join(every.select("label", "dim", "c", "blocks"), ["label", "dim", "c"]).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = ["label", "dim", "c", "s", "b"]
    columns = [*cell, "asks", "rep", "copies", "c1", "c2", "v", "near"]
    mixed = targets.withColumn("asks", F.lit(False)).select(*columns).union(both.withColumns({"asks": F.lit(True), "near": F.lit(None).cast("array<long>")}).select(*columns))

    def search(batches):
        for table in _groups(batches, cell):
            ask = table["asks"].to_numpy(zero_copy_only=False).astype(bool)
            t, q = table.filter(pa.array(~ask)), table.filter(pa.array(ask))
            if not len(t) or not len(q):
                continue
            rep, q_rep, c = t["rep"].to_numpy(), q["rep"].to_numpy(), table["c"][0].as_py()
            x, y = _unit(_matrix(t["v"])), _unit(_matrix(q["v"]))
            near = t["near"].combine_chunks()
            flat, size = near.flatten().to_numpy(), np.diff(near.offsets.to_numpy())
            by = np.argsort(rep)
            at = by[np.minimum(np.searchsorted(rep, flat, sorter=by), len(rep) - 1)]
            here = rep[at] == flat
            owner = np.repeat(np.arange(len(rep)), size)[here]
            first = np.searchsorted(owner, np.arange(len(rep) + 1))
            place = by[np.minimum(np.searchsorted(rep, q_rep, sorter=by), len(rep) - 1)]
            own = np.where(rep[place] == q_rep, place, -1)
            mean = x.mean(axis=0)
            medoid = int((x @ mean).argmax())
            weight, primary = t["copies"].to_numpy(), t["c1"].to_numpy()
            second, q_first = t["c2"].to_numpy(), q["c1"].to_numpy()
            roots = _Forest()
            for s in range(0, len(q), QUERIES):
                hit = greedy_range_search(x, at[here], first, y[s : s + QUERIES], own[s : s + QUERIES], medoid, least)
                rows_, cols = np.nonzero(hit)
                other = rep[cols] != q_rep[s : s + QUERIES][rows_]
                rows_, cols = rows_[other], cols[other]
                home = q_first[s : s + QUERIES][rows_]
                new = (home == c) | ((primary[cols] != home) & (second[cols] != home))  # not seen in the first cluster
                n = np.bincount(rows_, weights=weight[cols] * new, minlength=len(hit)).astype(np.int64)
                low = q_rep[s : s + QUERIES].copy()
                np.minimum.at(low, rows_, rep[cols])
                roots.join(q_rep[s : s + QUERIES][rows_], rep[cols])
                yield pa.RecordBatch.from_arrays([pa.array(q_rep[s : s + QUERIES]), pa.array(n), pa.array(low)], names=["rep", "n", "to"])
            a, b = roots.edges()
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.zeros(len(a), np.int64)), pa.array(b)], names=["rep", "n", "to"])

    found = mixed.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(search, "rep long, n long, to long")
    if any(len(c) > 2 for c in centroids.values()):
        found = found.union(_far(placed, centroids, least))
    found = stored(found, "hits")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    known = classes.select(*key, "rep", "copies").join(links, "rep", "left").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    known = known.select(*key, F.lit(True).alias("good"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = plain.join(known, [*key, "good"], "left")
    part = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"), F.coalesce(part == F.col("id"), F.lit(True)).alias("kept"))


class _Forest:
    """Union-find over ids whose roots are the smallest."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite the ends of edges; ends known to be together cost one pass in numpy."""
        while len(a):
            ids, back = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = np.array([self.find(i) for i in ids.tolist()])[back]
            ra, rb = root[: len(a)], root[len(a) :]
            apart = ra != rb
            if not apart.any():
                return
            a, b = ra[apart], rb[apart]
            for x, y in set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)):
                x, y = self.find(x), self.find(y)
                if x != y:
                    self.up[max(x, y)] = min(x, y)
            return

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = [(x, self.find(x)) for x in list(self.up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64)


def _window(*columns):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def _groups(batches, key: list[str]):
    """The whole groups of rows that are sorted by ``key``, one table at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in key:
            c = batch.column(batch.schema.get_field_index(k)).to_numpy()
            change[1:] |= c[1:] != c[:-1]
            if held:
                change[0] |= c[0] != held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py()
        cuts = np.flatnonzero(change)
        start = 0
        for cut in cuts.tolist():
            if cut > start:
                held.append(batch.slice(start, cut - start))
            if held:
                yield pa.Table.from_batches(held).combine_chunks()
            held, start = [], cut
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def audit(rows: DataFrame, found: DataFrame, least: float = 0.93, one_in: int = 100, block: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row (links, found, recall): the found links of the rows whose id is divisible by ``one_in`` against brute force over all rows, in blocks."""
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    plain = plain.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*").over(_window("label")) / block)).cast("int")
    plain = plain.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    asks = plain.where(F.col("id") % one_in == 0).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["label", "b"]
    mixed = plain.select(*key, F.lit(False).alias("asks"), "id", "v").union(asks.select(*key, F.lit(True), "id", "v"))

    def count(batches):
        for table in _groups(batches, key):
            ask = table["asks"].to_numpy(zero_copy_only=False).astype(bool)
            t, q = table.filter(pa.array(~ask)), table.filter(pa.array(ask))
            if len(t) and len(q):
                hits = _unit(_matrix(q["v"])) @ _unit(_matrix(t["v"])).T >= least
                hits &= q["id"].to_numpy()[:, None] != t["id"].to_numpy()[None, :]
                yield pa.RecordBatch.from_arrays([q["id"].combine_chunks(), pa.array(hits.sum(axis=1).astype(np.int64))], names=["id", "n"])

    true = mixed.repartition(*key).sortWithinPartitions(*key).mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    both = true.join(found.select(F.col(id_col).alias("id"), "n_links"), "id")
    return both.agg(F.sum("n").alias("links"), F.sum(F.least("n", "n_links")).alias("found")).withColumn("recall", F.when(F.col("links") > 0, F.col("found") / F.col("links")).otherwise(1.0))


def op2_robust_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of the whole ``embeddings`` table."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
