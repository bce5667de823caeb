"""Filling containers of fixed capacity by harmonic packing (p7).

A length s belongs to class k = floor(capacity / s): k items of the class fit one container, and k + 1 don't. Items are spread over
workers by a hash, and every worker fills its classes independently: each container of class k takes exactly k items of the class,
the largest left (its last one may take fewer). Classes alone would leave room empty (a class-1 text of 1,100 tokens has a container of
2,048 to itself), so each container's remainder, which is too small for its own class, is at once filled with the largest items of
higher classes that fit. With GROUP_ITEMS items a worker that comes close to the least possible number, tokens / capacity
(query p7_fill); what a worker loses is a part-filled container or two.

There is one shuffle, of ids and lengths, and no plan on the driver; a length or class of a third of all rows is spread like all others.

Texts over the capacity are cut into full containers and a rest, which is packed like an item. Defined results: null
texts and texts of 0 tokens need no container and give no row; equal texts under different ids are different items; rows delivered
twice (equal id) are two items; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.tokens import VOCABULARY, count_tokens
from lexloom.plans.runtime import blocks_for, materialize

CAPACITY = 2048
#: Items that one task packs (about 2 MB).
GROUP_ITEMS = 50_000


def harmonic(tokens: np.ndarray, capacity: int, fill: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(container, class of the container) of every item; lengths lie between 1 and the capacity. Containers are numbered from 0."""
    order = np.argsort(-tokens, kind="stable")
    left = np.bincount(tokens, minlength=capacity + 1)
    # items of one length follow each other in ``order``; the next one to take of each length
    at = np.concatenate([[0], np.cumsum(left[::-1])])[::-1][1:].tolist()
    left = left.tolist()
    # the nearest length at or below s of which items are left
    down = [s if left[s] else -1 for s in range(capacity + 1)]
    down[0] = 0

    def find(s: int) -> int:
        path = []
        while down[s] != s:
            path.append(s)
            s = s - 1 if down[s] < 0 else down[s]
        for p in path:
            down[p] = s
        return s

    container, label = np.empty(len(tokens), np.int64), np.empty(len(tokens), np.int64)
    number = 0

    def take(s: int) -> None:
        i = order[at[s]]
        container[i], label[i] = number, k
        at[s] += 1
        left[s] -= 1
        if not left[s]:
            down[s] = -1

    largest = find(capacity)
    while largest:
        k = capacity // largest
        least = capacity // (k + 1)  # lengths of class k lie above
        room, s = capacity, largest
        for _ in range(k):
            s = find(s)
            if s <= least:
                break
            take(s)
            room -= s
        while fill and room and (s := find(min(room, capacity))):
            take(s)
            room -= s
        number += 1
        largest = find(largest)
    return container, label


def _items(df: DataFrame, id_col: str, text_col: str, capacity: int, path: str) -> DataFrame:
    """(doc, piece_no, token_start, tokens): whole texts, or full pieces and the rest of texts over the capacity."""
    counted = count_tokens(df, id_col, text_col, (), path).filter("tokens > 0").withColumnRenamed(id_col, "doc")
    n = F.ceil(F.col("tokens") / capacity).cast("int")
    cut = counted.select("doc", "tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece_no"))
    return materialize(
        cut.select("doc", "piece_no", (F.col("piece_no") * capacity).cast("long").alias("token_start"), F.least(F.lit(capacity), F.col("tokens") - F.col("piece_no") * capacity).cast("long").alias("tokens")),
        "items",
    )


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str = VOCABULARY, fill: bool = True, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(container_id, class, doc, piece_no, token_start, tokens). Without ``fill`` remainders stay empty, as in plain harmonic packing."""
    items = _items(df, id_col, text_col, capacity, path)
    groups = blocks_for(items.count(), group_items)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc", "ascending"), ("piece_no", "ascending")])
        container, label = harmonic(t["tokens"].to_numpy(), capacity, fill)
        group = t["group"][0].as_py()
        return pa.table({"container_id": pa.array(container + (group << 32)), "class": pa.array(label.astype(np.int32)), **{c: t[c] for c in ("doc", "piece_no", "token_start", "tokens")}})

    kind = dict(items.dtypes)["doc"]
    grouped = items.withColumn("group", F.pmod(F.xxhash64("doc", "piece_no"), F.lit(groups)).cast("long")).groupBy("group")
    return grouped.applyInArrow(run, f"container_id long, class int, doc {kind}, piece_no int, token_start long, tokens long")
