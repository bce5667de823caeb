"""Most similar vectors for every vector by balanced posting lists (p3).

1. A bounded sample fits the lists: it is split into clusters again and again until no cluster exceeds its share, so the lists
   are balanced; the leaf means are the centroids. Every row is then indexed, not only the sample.
2. Centroids are searched through an in-memory neighbour graph (best-first, in numpy batches). A vector goes to its
   nearest list and, if it lies near a boundary, also to lists whose centroid is hardly farther (distance ratio) unless that
   centroid is nearer to an already chosen centroid than to the vector. Queries are the vectors themselves, so the same
   lists are searched for them.
3. In each list all vectors meet in matrix products; a query's results are merged over its lists. Lists that would exceed
   the memory of a task are cut into blocks that meet pairwise, so nothing is dropped.

Exact copies (equal direction) are one class: copies that hold more than a thousandth of all rows are reduced to one row before the
shuffle (at most 1,000 such classes are broadcast), smaller groups inside their lists.

Defined results: null, zero, non-finite and wrongly sized vectors (not of the most frequent length) have no neighbours and
are nobody's neighbour; similarities are cosines in double precision; ties go to the smaller id; repeated rows (equal id)
count once; with fewer than k other vectors there are fewer results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.plans.runtime import materialize

#: Rows that fit the lists: a twentieth of all, within these bounds (100 MB at 384 dimensions); at least 8 for a list.
LEAST_SAMPLE, SAMPLE_ROWS = 8_192, 65_536
#: Rows a list should hold before replication.
LIST_ROWS = 1000
#: Rows of one list that meet in one task; larger lists are cut into blocks of this size.
BLOCK_ROWS = 20_000
#: A list is searched if its centroid is at most this much farther than the nearest one; at most this many.
RATIO = 1.1
MOST_LISTS = 3
#: A further list is skipped if its centroid is this much nearer to a chosen centroid than to the vector.
COVER = 0.3
DEGREE, BEAM, EXPAND = 12, 10, 8
HEAVY = 1000


def planes(x: np.ndarray) -> list[bytes]:
    """Float32 rows as byte planes: the planes that carry no information compress away in the shuffle."""
    p = np.ascontiguousarray(x.astype("<f4").view(np.uint8).reshape(len(x), -1, 4).transpose(0, 2, 1))
    return [r.tobytes() for r in p]


def from_planes(rows: list[bytes]) -> np.ndarray:
    p = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), 4, -1).transpose(0, 2, 1)
    return np.ascontiguousarray(p).view("<f4")[:, :, 0]


def directions(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _vectors(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and float32 rows of the usable vectors of a batch."""
    vectors = vectors.cast(pa.list_(pa.float32()))
    lengths = vectors.value_lengths().fill_null(-1).to_numpy()
    keep = np.flatnonzero((lengths == dim) & ids.is_valid().to_numpy(zero_copy_only=False))
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
    flat = vectors.take(pa.array(keep)).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float32)
    x = flat.reshape(len(keep), dim)
    size = (x.astype(np.float64) ** 2).sum(1)
    ok = np.isfinite(size) & (size > 0)
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[keep][ok], x[ok]


def _keys(x: np.ndarray) -> list[int]:
    """Signed 64-bit hashes of the directions."""
    u = directions(x).astype(np.float32) + np.float32(0)
    return [xxhash.xxh64_intdigest(r.tobytes()) - (1 << 63) for r in u]


def fit_lists(sample: np.ndarray, leaf: int, seed: int = 0) -> np.ndarray:
    """Centroids of a balanced tree of clusters with at most ``leaf`` sample rows each."""
    rng = np.random.default_rng(seed)
    u = directions(sample).astype(np.float32)
    todo, leaves = [np.arange(len(u))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            leaves.append(rows)
            continue
        k = min(8, max(2, len(rows) // leaf))
        x = u[rows]
        c = x[rng.choice(len(rows), k, replace=False)]
        cap = math.ceil(1.5 * len(rows) / k)
        for _ in range(6):
            sims = x @ c.T
            label = _balanced(sims, cap)
            for j in range(k):
                if (label == j).any():
                    m = x[label == j].sum(0)
                    c[j] = m / max(1e-12, float(np.sqrt((m * m).sum())))
        parts = [rows[label == j] for j in range(k)]
        todo += [p for p in parts if len(p)]
    c = np.stack([u[r].sum(0) for r in leaves])
    return (c / np.maximum(1e-12, np.sqrt((c * c).sum(1, keepdims=True)))).astype(np.float32)


def _balanced(sims: np.ndarray, cap: int) -> np.ndarray:
    """Nearest cluster, where a full cluster passes its least clear members on to their next choice."""
    sims = sims.copy()
    while True:
        label = sims.argmax(1)
        sizes = np.bincount(label, minlength=sims.shape[1])
        over = np.flatnonzero(sizes > cap)
        if not len(over):
            return label
        for j in over:
            mine = np.flatnonzero(label == j)
            others = np.delete(sims[mine], j, axis=1).max(1)
            if not np.isfinite(others).any():
                return label
            lose = mine[np.argsort(sims[mine, j] - others, kind="stable")[: len(mine) - cap]]
            sims[lose, j] = -np.inf


class CentroidGraph:
    """Neighbour graph over the centroids with best-first search for batches of queries."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        n = len(centroids)
        degree = min(DEGREE, n - 1)
        near = []
        for a in range(0, n, 1024):
            s = centroids[a : a + 1024] @ centroids.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
            near.append(np.argpartition(-s, degree - 1, axis=1)[:, :degree] if degree else np.zeros((len(s), 0), np.int64))
        self.near = np.concatenate(near)
        self.entries = np.arange(n) if n <= 64 else np.unique(np.linspace(0, n - 1, max(64, 2 * math.isqrt(n))).astype(int))

    def search(self, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, similarity) of about the ``most`` nearest centroids of every query, nearest first."""
        out_i, out_s = [], []
        for a in range(0, len(q), 512):
            i, s = self._search(q[a : a + 512], most)
            out_i.append(i)
            out_s.append(s)
        return np.concatenate(out_i), np.concatenate(out_s)

    def _search(self, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(q), np.arange(len(q))[:, None]
        s = q @ self.c[self.entries].T
        beam = min(max(BEAM, most), len(self.c))
        width = min(beam, s.shape[1])
        top = np.argpartition(-s, width - 1, axis=1)[:, :width]
        ids, sims = self.entries[top], np.take_along_axis(s, top, 1)
        seen = np.zeros((n, len(self.c)), bool)
        seen[:, self.entries] = True
        open_ = np.ones(ids.shape, bool)
        if len(self.entries) < len(self.c):
            for _ in range(EXPAND):
                at = np.where(open_, sims, -3).argmax(1)
                open_[rows[:, 0], at] = False
                nb = self.near[ids[rows[:, 0], at]]
                fresh = ~seen[rows, nb]
                seen[rows, nb] = True
                ns = np.where(fresh, np.einsum("nd,nkd->nk", q, self.c[nb]), -3)
                ids, sims, open_ = np.concatenate([ids, nb], 1), np.concatenate([sims, ns], 1), np.concatenate([open_, fresh], 1)
                if ids.shape[1] > beam:
                    keep = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
                    ids, sims, open_ = (np.take_along_axis(v, keep, 1) for v in (ids, sims, open_))
        order = np.lexsort((ids, -sims), axis=1)[:, :most]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def lists(self, q: np.ndarray) -> list[np.ndarray]:
        """Each query's lists: the nearest, and those within the distance ratio that a nearer chosen one doesn't cover."""
        ids, sims = self.search(q, min(2 * MOST_LISTS, len(self.c)))
        dist = np.sqrt(np.maximum(0, 2 - 2 * sims))
        ok = dist <= RATIO * dist[:, :1] + 1e-9
        cc = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nid,njd->nij", self.c[ids], self.c[ids])))
        chosen = np.zeros(ids.shape, bool)
        chosen[:, 0] = True
        for j in range(1, ids.shape[1]):
            covered = (chosen[:, :j] & (cc[:, j, :j] < COVER * dist[:, j : j + 1])).any(1)
            chosen[:, j] = ok[:, j] & ~covered & (chosen[:, :j].sum(1) < MOST_LISTS)
        return [i[c] for i, c in zip(ids, chosen, strict=True)]


def _top(u: np.ndarray, v: np.ndarray, ids_u: np.ndarray, ids_v: np.ndarray, k: int, least: float) -> tuple[list, list, list]:
    """Top k of v for every row of u (cosine, ties to the smaller id), without the row itself."""
    a, b, s = [], [], []
    v32 = v.astype(np.float32)
    for at in range(0, len(u), 512):
        q = u[at : at + 512]
        sims = q.astype(np.float32) @ v32.T
        sims[ids_u[at : at + 512, None] == ids_v[None, :]] = -3
        if least > -1:
            i, j = np.nonzero(sims >= least - 1e-5)
        else:
            kk = min(k, sims.shape[1])
            edge = -np.partition(-sims, kk - 1, axis=1)[:, kk - 1]
            i, j = np.nonzero(sims >= np.maximum(edge, -2)[:, None] - 1e-5)
        exact = np.round(np.einsum("nd,nd->n", q[i], v[j]), 7)
        keep = np.flatnonzero(exact >= least)
        order = keep[np.lexsort((ids_v[j[keep]], -exact[keep], i[keep]))]
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, i)
        keep = np.arange(len(i)) - first < k
        a.append(ids_u[at + i[keep]])
        b.append(ids_v[j[keep]])
        s.append(exact[keep])
    return a, b, s


def _search_list(k: int, least: float):
    def run(t: pa.Table) -> pa.Table:
        left, right = t["part_a"][0].as_py(), t["part_b"][0].as_py()
        ids, keys, part = t["id"].to_numpy(), t["key"].to_numpy(), t["part"].to_numpy()
        order = np.lexsort((ids, keys))
        first = order[np.r_[True, keys[order][1:] != keys[order][:-1]]]
        u = directions(from_planes([t["vec"][int(i)].as_py() for i in first]))
        ids, part = ids[first], part[first]
        x, y = np.flatnonzero(part == left), np.flatnonzero(part == right)
        found = _top(u[x], u[y], ids[x], ids[y], k, least)
        if left != right:
            found = tuple(p + q for p, q in zip(found, _top(u[y], u[x], ids[y], ids[x], k, least), strict=True))
        cols = [np.concatenate(c) if c else np.zeros(0) for c in found]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64()), "similarity": pa.array(cols[2], pa.float64())})

    return run


def _sample(src: DataFrame, members: DataFrame, rows: int, most: int) -> DataFrame:
    """At most ``most`` rows (and nearly as many), the same on every run and whatever the partitions: whole buckets of a hash of the id,
    from the first on, as long as their rows together don't exceed the bound."""
    buckets = max(1, -(-64 * rows // most))
    bucket = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(buckets))
    # about 128 buckets can matter
    sizes = members.select("id").distinct().filter(bucket < 128).groupBy(bucket.alias("bucket")).count().orderBy("bucket").collect()
    upto, total = 0, 0
    for r in sizes:
        if total + r["count"] > most:
            break
        upto, total = r["bucket"] + 1, total + r["count"]
    return src.filter(bucket < upto).dropDuplicates(["id"])


def nearest(df: DataFrame, id_col: str, vector_col: str, k: int = 5, least: float = -1.0, sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, neighbour, similarity): up to k most similar other vectors of at least the similarity ``least`` for every vector."""
    spark = df.sparkSession
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vec")).filter("id is not null and vec is not null")
    empty = spark.createDataFrame([], "id long, neighbour long, similarity double")
    # one row for each length of vector that occurs, so the most frequent length is known whatever the data
    sizes = src.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes or sizes[0]["n"] < 1:
        return empty
    dim = sizes[0]["n"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = _vectors(b.column(0), b.column(1), dim)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_keys(x), pa.int64())], names=["id", "key"])

    members = materialize(src.mapInArrow(hashed, "id long, key long").distinct(), "vectors")
    rows = members.count()
    if not rows:
        return empty
    counts = members.groupBy("key").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    counts = materialize(counts, "classes")
    heavy = {r["key"]: r["class_id"] for r in counts.filter(F.col("n") > max(2, rows // HEAVY)).collect()}

    sample_rows = min(sample_rows, max(LEAST_SAMPLE, rows // 20))
    lists = max(1, min(rows // list_rows, sample_rows // 8))
    got = _sample(src, members, rows, sample_rows).toArrow()
    sample = _vectors(got["id"].combine_chunks(), got["vec"].combine_chunks(), dim)[1]
    if not len(sample):
        sample = np.ones((1, dim), np.float32)
    graph = CentroidGraph(fit_lists(sample, max(1, math.ceil(len(sample) / lists))))
    share = np.zeros(len(graph.c))
    for c in graph.lists(directions(sample).astype(np.float32)):
        share[c] += 1
    parts = np.maximum(1, np.ceil(share / len(sample) * rows / block_rows)).astype(np.int64)
    # at most sample_rows / 8 centroids and 1,000 keys
    held = spark.sparkContext.broadcast((graph, parts, heavy))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, parts, heavy = held.value
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                ids, x = _vectors(b.column(0).slice(at, 2048), b.column(1).slice(at, 2048), dim)
                if not len(ids):
                    continue
                keys = _keys(x)
                keep = np.array([heavy.get(key, i) == i for key, i in zip(keys, ids, strict=True)])
                ids, x, keys = ids[keep], x[keep], np.array(keys, np.int64)[keep]
                if not len(ids):
                    continue
                chosen = graph.lists(directions(x).astype(np.float32))
                vec = planes(x)
                out: list[list] = [[] for _ in range(7)]
                for r, cs in enumerate(chosen):
                    for c in cs:
                        n = int(parts[c])
                        mine = int(keys[r] % n)
                        for other in range(n):
                            for col, v in zip(out, (int(c), min(mine, other), max(mine, other), mine, int(ids[r]), int(keys[r]), vec[r]), strict=True):
                                col.append(v)
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["list", "part_a", "part_b", "part", "id", "key", "vec"])

    posted = src.mapInArrow(post, "list int, part_a int, part_b int, part int, id long, key long, vec binary")
    hits = posted.groupBy("list", "part_a", "part_b").applyInArrow(_search_list(k, least), "a long, b long, similarity double")
    # a pair found in several lists has the same similarity there
    best = hits.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    classes = materialize(best.withColumn("rank", rank).filter(F.col("rank") <= k).select("a", "b", "similarity"), "class_neighbours")
    return _expand(members, counts, classes, k)


def _expand(members: DataFrame, counts: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """From classes to rows. A class's first k + 1 ids are enough of it for anyone."""
    placed = members.join(counts, "key").select("id", "class_id", "n")
    salted = placed.withColumn("salt", F.when(F.col("n") > 1000, F.pmod(F.xxhash64("id"), F.lit(64))).otherwise(F.lit(0)))
    inner = salted.withColumn("r", F.row_number().over(Window.partitionBy("class_id", "salt").orderBy("id"))).filter(F.col("r") <= k + 1)
    heads = inner.withColumn("r", F.row_number().over(Window.partitionBy("class_id").orderBy("id"))).filter(F.col("r") <= k + 1).groupBy("class_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    heads = materialize(heads, "heads")
    own = heads.filter(F.size("ids") > 1).select("class_id", F.lit(1.0).alias("similarity"), "ids")
    near = classes.join(heads.withColumnRenamed("class_id", "b"), "b").select(F.col("a").alias("class_id"), "similarity", "ids")
    every = own.unionByName(near).select("class_id", "similarity", F.explode("ids").alias("neighbour"))
    # at most (k + 1)^2 entries for a class
    ordered = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("d"), F.col("neighbour").alias("i")))), 1, k + 1)
    lists = every.groupBy("class_id").agg(ordered.alias("found"))
    mine = placed.join(lists, "class_id").select("id", F.slice(F.filter("found", lambda f: f["i"] != F.col("id")), 1, k).alias("found"))
    return mine.select("id", F.explode("found").alias("f")).select("id", F.col("f.i").alias("neighbour"), (-F.col("f.d")).alias("similarity"))
