"""Parent-child rows to full hierarchies by fragment contraction.

1. Rows are range-partitioned by (locality key, id), so a tree mostly stays in one block and a hot key is split over
   several. In each block the chains are contracted with array pointer doubling: every node learns the last node of
   its chain inside the block (``top``), the distance to it and, for a top, the edge that leaves the block.
2. The tops whose edge leaves the block form the quotient forest: one row for each, far fewer than nodes. It is solved
   by the same step, recursively, until it fits one bounded block; where a level contracts badly, a pointer-jumping
   join halves its path lengths first, so the number of levels is logarithmic in the depth.
3. Solutions are joined back on ``top``. Cycles inside a block never reach a top; cycles across blocks show in the
   quotient. Both report the smallest id on the cycle, which every edge carries as a running minimum.

Defined results: a null id is no node; rows repeated with one id count once (the smallest non-null parent is taken where
they differ); a null or missing parent makes a root with depth 0; on or below a cycle depth is -1, root the smallest id
on it, path null. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.plans.runtime import blocks_for, materialize, unique_join

#: Rows of one block, and of the quotient that one task may solve alone (about 40 bytes a row).
BLOCK_ROWS = 100_000
LOCAL_ROWS = 500_000
#: Solutions up to this many rows are broadcast (about 32 bytes a row); larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000

_EDGE = "node long, next long, w long, m long, seg array<long>"
_FRAGMENT = "node long, top long, dist long, pmin long, exit long, exit_w long, exit_m long, cyc long, path array<long>, exit_seg array<long>"
_BIG = np.iinfo(np.int64).max


def contract(node: np.ndarray, nxt: np.ndarray, has: np.ndarray, w: np.ndarray, m: np.ndarray) -> dict[str, np.ndarray]:
    """Contract one block of edges node -> nxt (where ``has``), each with weight w and minimum m.

    Ids are unique. Returns for each node the index of its top, distance and minimum over the edges walked, whether the
    chain ends in a cycle, and that cycle's minimum."""
    n = len(node)
    order = np.argsort(node, kind="stable")
    at = np.searchsorted(node[order], nxt)
    at[at == n] = 0
    inside = has & (node[order][at] == nxt) if n else has
    hop = np.where(inside, order[at], np.arange(n)) if n else np.arange(0)
    hop1 = hop
    dist = np.where(inside, w, 0)
    count = inside.astype(np.int64)
    least = np.where(inside, m, _BIG)
    first_inside = inside.copy()
    steps = 1
    while True:
        if not first_inside[hop].any():
            break
        dist = dist + np.where(first_inside[hop], dist[hop], 0)
        count = count + np.where(first_inside[hop], count[hop], 0)
        least = np.minimum(least, least[hop])
        hop = hop[hop]
        steps *= 2
        if steps > 2 * n + 2:
            break
    cyclic = first_inside[hop] if n else np.zeros(0, bool)
    # where a chain has a cycle, hop is on it by now, and the minimum from there covers exactly the cycle
    return {"top": hop, "dist": dist, "least": least, "inside": first_inside, "cyclic": cyclic, "cyc": least[hop], "hop1": hop1, "steps": count}


def _paths(node: np.ndarray, hop1: np.ndarray, steps: np.ndarray, seg: list, sane: np.ndarray) -> list:
    """Ids from a node's top down to the node, with the segments that its edges skip; None on cycles."""
    out: list = [None] * len(node)
    for i in sane[np.argsort(steps[sane], kind="stable")]:
        out[i] = [int(node[i])] if hop1[i] == i else [*out[hop1[i]], *(seg[i] or ()), int(node[i])]
    return out


def _contract_batches(with_path: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        e = pa.Table.from_batches(parts)

        def values(name: str, null: int) -> np.ndarray:
            return e[name].combine_chunks().fill_null(null).to_numpy(zero_copy_only=False)

        node, nxt, w, m = values("node", 0), values("next", 0), values("w", 0), values("m", _BIG)
        has = e["next"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        c = contract(node, nxt, has, w, m)
        leaves = has & ~c["inside"] & ~c["cyclic"]

        def masked(mask: np.ndarray, of: np.ndarray) -> pa.Array:
            return pa.array(of, pa.int64(), mask=~mask)

        ids = pa.list_(pa.int64())
        paths, segs = pa.nulls(len(node), ids), pa.nulls(len(node), ids)
        if with_path:
            seg = e["seg"].to_pylist()
            sane = np.flatnonzero(~c["cyclic"])
            paths = pa.array(_paths(node, c["hop1"], c["steps"], seg, sane), ids)
            segs = pa.array([s if k else None for s, k in zip(seg, leaves, strict=True)], ids)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(node),
                pa.array(node[c["top"]]),
                pa.array(c["dist"]),
                masked(c["least"] != _BIG, c["least"]),
                masked(leaves, nxt),
                masked(leaves, w),
                masked(leaves, m),
                masked(c["cyclic"], c["cyc"]),
                paths,
                segs,
            ],
            names=["node", "top", "dist", "pmin", "exit", "exit_w", "exit_m", "cyc", "path", "exit_seg"],
        )

    return run


def _next():
    """Where a top's edge leads in the quotient. One that leads onto a cycle becomes a loop with that cycle's minimum."""
    return F.when(F.col("f_cyc").isNull(), F.col("f_top")).otherwise(F.col("node"))


def _below_top():
    return F.coalesce(F.expr("slice(f_path, 2, greatest(size(f_path) - 1, 0))"), F.array().cast("array<long>"))


def _solve(edges: DataFrame, rows: int, with_path: bool, local_rows: int, block_rows: int) -> DataFrame:
    """(node, root, depth, cyc, path above the node) for each node of a quotient; all nodes have an edge."""
    blocks = 1 if rows <= local_rows else blocks_for(rows, block_rows)
    # half of the nodes (by a coin) are placed with the node they point to, so at least a quarter contracts whatever the
    # order of ids; the second range key splits the children of a hot node over several blocks
    place = F.when(F.xxhash64("node", F.lit(rows)) % 2 == 0, F.col("node")).otherwise(F.col("next"))
    placed = edges.coalesce(1) if blocks == 1 else edges.withColumn("place", place).repartitionByRange(blocks, "place", "node").drop("place")
    frag = placed.mapInArrow(_contract_batches(with_path), _FRAGMENT)
    above = F.concat(F.array("exit"), F.coalesce("exit_seg", F.array().cast("array<long>"))) if with_path else F.lit(None).cast("array<long>")
    if blocks > 1:
        frag = materialize(frag, "quotient")
    tops = frag.filter((F.col("node") == F.col("top")) & F.col("cyc").isNull())
    if blocks == 1:
        # the tops' edges lead out of the quotient: their targets are roots
        solved = tops.select(F.col("node").alias("t"), F.col("exit").alias("root"), F.col("exit_w").alias("depth"), F.lit(None).cast("long").alias("tcyc"), above.alias("up"))
        return _expand(frag, solved, with_path, None)
    far = frag.select(F.col("node").alias("exit"), F.col("top").alias("f_top"), F.col("dist").alias("f_dist"), F.col("pmin").alias("f_min"), F.col("cyc").alias("f_cyc"), F.col("path").alias("f_path"))
    met = materialize(unique_join(tops, far, "exit", "node", "left"), "met")
    empty = F.array().cast("array<long>")
    inner = met.select(
        "node",
        F.when(F.col("f_top").isNull(), F.col("exit")).otherwise(_next()).alias("next"),
        (F.col("exit_w") + F.coalesce("f_dist", F.lit(0))).alias("w"),
        F.coalesce("f_cyc", F.least("exit_m", F.coalesce("f_min", "exit_m"))).alias("m"),
        # between the new edge's ends: the far fragment's path below its top, then the old edge's own segment
        (F.concat(_below_top(), F.coalesce("exit_seg", empty)) if with_path else F.lit(None).cast("array<long>")).alias("seg"),
    )
    if tops.count() > rows // 2:
        inner = _jump(materialize(inner, "inner"))
    inner = materialize(inner, "inner")
    # an edge is done when it ends at a root or a cycle and no other edge leads to it
    ends = inner.select(F.col("node").alias("next"), F.lit(1).alias("goes_on"))
    aims = inner.filter("next <> node").select(F.col("next").alias("node"), F.lit(1).alias("aim")).distinct()
    split = materialize(unique_join(inner, ends, "next", "node", "left").join(aims, "node", "left"), "split")
    loop = F.col("next") == F.col("node")
    over = F.col("aim").isNull() & (F.col("goes_on").isNull() | loop)
    direct = split.filter(over).select(
        F.col("node").alias("t"),
        F.when(~loop, F.col("next")).alias("root"),
        F.col("w").alias("depth"),
        F.when(loop, F.col("m")).alias("tcyc"),
        (F.concat(F.array("next"), F.coalesce("seg", empty)) if with_path else F.lit(None).cast("array<long>")).alias("up"),
    )
    rest = split.filter(~over).select("node", "next", "w", "m", "seg")
    left = rest.count()
    shorter = F.expr("slice(path, 1, size(path) - 1)") if with_path else F.lit(None).cast("array<long>")
    solved = direct.unionByName(_solve(rest, left, with_path, local_rows, block_rows).select(F.col("node").alias("t"), "root", "depth", F.col("cyc").alias("tcyc"), shorter.alias("up"))) if left else direct
    return _expand(frag, solved, with_path, None)


def _jump(edges: DataFrame) -> DataFrame:
    """One pointer-jumping step: each edge is prolonged by the edge at its end, so path lengths halve."""
    # a loop meets nothing further
    far = edges.select(F.col("node").alias("to"), F.col("next").alias("n2"), F.col("w").alias("w2"), F.col("m").alias("m2"), F.col("seg").alias("s2"))
    j = unique_join(edges.withColumn("to", F.when(F.col("next") != F.col("node"), F.col("next"))), far, "to", "node", "left")
    looped = (F.col("n2") == F.col("next")) & F.col("n2").isNotNull()
    # a prolonged edge passes its old end, which then belongs to the segment; one that leads to a loop becomes a loop
    return j.select(
        "node",
        F.when(looped, F.col("node")).otherwise(F.coalesce("n2", "next")).alias("next"),
        (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"),
        F.when(looped, F.col("m2")).otherwise(F.least("m", F.coalesce("m2", "m"))).alias("m"),
        F.when(F.col("n2").isNull() | looped | F.col("seg").isNull(), F.col("seg")).otherwise(F.concat("s2", F.array("next"), "seg")).alias("seg"),
    )


def _expand(frag: DataFrame, solved: DataFrame, with_path: bool, rows: int | None) -> DataFrame:
    if solved is None:
        solved = frag.sparkSession.createDataFrame([], "t long, root long, depth long, tcyc long, up array<long>")
    right = F.broadcast(solved) if rows is not None and rows <= BROADCAST_ROWS else solved
    j = frag.join(right, frag["top"] == right["t"], "left")
    cyc = F.coalesce(frag["cyc"], F.col("tcyc"))
    path = F.when(cyc.isNull(), F.concat(F.coalesce("up", F.array().cast("array<long>")), frag["path"])) if with_path else F.lit(None).cast("array<long>")
    return j.select(
        "node",
        F.when(cyc.isNull(), F.coalesce("root", frag["top"])).alias("root"),
        (frag["dist"] + F.coalesce("depth", F.lit(0))).alias("depth"),
        cyc.alias("cyc"),
        path.alias("path"),
    )


def hierarchy(
    df: DataFrame,
    id_col: str = "id",
    parent_col: str = "parent_id",
    locality_col: str | None = None,
    with_path: bool = False,
    block_rows: int = BLOCK_ROWS,
    local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """One row for each distinct id: (node, parent, root, depth[, path]); path runs from the root to the node."""
    key = F.col(locality_col) if locality_col else F.lit(0)
    nodes = (
        df.select(F.col(id_col).cast("long").alias("node"), F.col(parent_col).cast("long").alias("next"), key.alias("k"))
        .filter(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.min("next").alias("next"), F.min("k").alias("k"))
    )
    nodes = materialize(nodes, "nodes")
    rows = nodes.count()
    blocks = blocks_for(rows, block_rows)
    placed = nodes.repartitionByRange(blocks, "k", "node") if blocks > 1 else nodes.coalesce(1)
    edges = placed.select("node", "next", F.lit(1).cast("long").alias("w"), F.col("next").alias("m"), F.lit(None).cast("array<long>").alias("seg"))
    frag = materialize(edges.mapInArrow(_contract_batches(with_path), _FRAGMENT), "fragments")
    tops = frag.filter(F.col("exit").isNotNull())
    far = frag.select(F.col("node").alias("exit"), F.col("top").alias("f_top"), F.col("dist").alias("f_dist"), F.col("pmin").alias("f_min"), F.col("cyc").alias("f_cyc"), F.col("path").alias("f_path"))
    met = materialize(unique_join(tops, far, "exit", "node"), "met")
    quotient = met.select(
        "node",
        _next().alias("next"),
        (F.col("f_dist") + 1).alias("w"),
        F.coalesce("f_cyc", F.least("exit", F.coalesce("f_min", "exit"))).alias("m"),
        (_below_top() if with_path else F.lit(None).cast("array<long>")).alias("seg"),
    )
    left = quotient.count()
    solved, count = None, None
    if left:
        above = F.expr("slice(path, 1, size(path) - 1)") if with_path else F.lit(None).cast("array<long>")
        deep = _solve(quotient, left, with_path, local_rows, block_rows).select(F.col("node").alias("t"), "root", "depth", F.col("cyc").alias("tcyc"), above.alias("up"))
        solved, count = materialize(deep, "solved"), left
    full = _expand(frag, solved, with_path, count)
    parents = nodes.select("node", F.col("next").alias("parent"))
    out = full.join(parents, "node").select(
        "node",
        "parent",
        F.coalesce("cyc", "root").alias("root"),
        F.when(F.col("cyc").isNotNull(), F.lit(-1)).otherwise(F.col("depth")).cast("int").alias("depth"),
        *(["path"] if with_path else []),
    )
    return out
