"""Near-duplicate texts by banded signatures, each candidate verified (p6).

Texts are sets of ``width`` consecutive words (runs of letters and digits, lower case), and two texts match if
intersection / union reaches ``threshold``.

1. Texts with the same words form a class at once; only a class's smallest id (its representative) goes on.
2. A text's shingles are thrown into BINS bins by many hash functions; each bin keeps one. Two texts keep the same one in a bin with
   a probability of intersection / union.
3. Bins form bands of a few, the more the higher the threshold; texts with the same key in a band meet. Work grows so with the
   pairs that are alike by chance to the power of a band's bins, not with the lengths of common shingles' lists. Some bands make up a
   cell, the unit of one task: as many as keep it bounded, and one band is cut by its keys if it alone is too large.
4. A pair leaves a cell if its sizes can match and enough of CHECK_BITS one-bit values of other bins agree; it is a candidate if it
   leaves HITS cells. There are so many cells that a pair just at the threshold fails this with a probability of at most MISS;
   for one above it that is less by many orders of magnitude.
5. Candidates are verified exactly on the whole texts.

Defined results: null texts and texts without a letter or digit match nothing; a text of fewer than ``width`` words is one
shingle of all its words; ties do not arise; repeated rows (equal id) count once; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.pairing import pairs_within
from lexloom.plans.components import components
from lexloom.plans.runtime import materialize

#: Bins of a text's signature, and shingles thrown for each.
BIN_BITS = 11
BINS = 1 << BIN_BITS
LOAD = 5
#: Two texts' bins are the same with intersection / union times this at least (less than 1 in 100 bins takes another's shingle).
ALIKE = 0.99
#: Probability that a pair at the threshold is no candidate.
MISS = 1e-9
HITS = 2
MOST_ROWS = 16
MOST_BANDS = 8
CHECK_BITS = 32
#: Share of the pairs at the threshold that the check bits let pass.
CHECK_KEEPS = 0.9
#: Band keys of one cell (4 to 10 bytes each with ids and check bits).
CELL_ENTRIES = 9_000_000
#: Texts whose signatures are packed into one row a cell, and those computed at once (16 MB).
CHUNK = 8_192
BLOCK = 2_048
#: Pairs that a cell gathers at least before equal ones are merged.
EVENTS = 3_000_000
#: Copies up to this many are left out by broadcast (about 70 bytes each); more by shuffle of the texts.
BROADCAST_COPIES = 500_000
#: Candidate pairs up to this many are sent to the texts by broadcast (about 50 bytes each); more by shuffle.
BROADCAST_PAIRS = 200_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_M32 = np.uint32(0x2C1B3C6D)
_FACTORS = np.random.default_rng(7).integers(0, 1 << 31, LOAD * BINS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_PROBES = np.random.default_rng(8).integers(0, BINS, (64, BINS))


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of a normalised text."""

    def __init__(self, width: int):
        self.width, self.words = width, {}

    def __call__(self, norm: str) -> np.ndarray:
        words = self.words
        if len(words) > 2_000_000:
            words.clear()
        seq = norm.split(" ")
        try:
            h = np.array([words[w] for w in seq], np.uint64)
        except KeyError:
            for w in seq:
                if w not in words:
                    words[w] = xxhash.xxh64_intdigest(w)
            h = np.array([words[w] for w in seq], np.uint64)
        k = min(self.width, len(h))
        m = len(h) - k + 1
        s = h[:m] * _M1
        for i in range(1, k):
            s = (s ^ (s >> np.uint64(29))) * _M2 + h[i : i + m] * _M3
        s ^= s >> np.uint64(32)
        s *= _M1
        s ^= s >> np.uint64(29)
        s.sort()
        return s[np.concatenate([[True], s[1:] != s[:-1]])]


def normal_words(c):
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def _tail(n: int, p: float, least: int) -> float:
    """Probability of ``least`` or more successes in n trials."""
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least, n + 1))


class Plan:
    """Bins a band (rows), cells, bands a cell, and check bits that must agree, for a threshold."""

    def __init__(self, threshold: float, bands: int):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must lie in (0, 1]")
        same = threshold * ALIKE
        self.threshold, self.bands = threshold, bands
        self.agree = max(x for x in range(CHECK_BITS + 1) if _tail(CHECK_BITS, (1 + same) / 2, x) >= CHECK_KEEPS)
        kept = _tail(CHECK_BITS, (1 + same) / 2, self.agree)
        for self.rows in range(MOST_ROWS, 0, -1):
            hit = kept * (1 - (1 - same**self.rows) ** bands)
            most = BINS // (self.rows * bands)
            self.cells = next((c for c in range(HITS, most + 1) if sum(math.comb(c, k) * hit**k * (1 - hit) ** (c - k) for k in range(HITS)) <= MISS), 0)
            if self.cells:
                break
        else:
            raise ValueError(f"threshold {threshold} is too low for {BINS} bins")
        random = np.random.default_rng(6)
        self.checked = random.integers(0, BINS, (self.cells, CHECK_BITS))
        self.factors = random.integers(0, 1 << 31, self.rows).astype(np.uint32) * np.uint32(2) + np.uint32(1)

    def size_class(self, n: np.ndarray) -> np.ndarray:
        """Quarters of the ratio that sizes of a match may have: classes of a match differ by 4 at most."""
        step = max(1e-3, -math.log(self.threshold) / 4) * (1 + 1e-9)
        return np.minimum(255, np.log(n) / step).astype(np.uint8)

    def signature(self, winners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, cell, band) keys of 32 bits and (text, cell, byte) check bits of texts' winners."""
        used = winners[:, : self.cells * self.bands * self.rows].reshape(len(winners), -1, self.rows)
        key = used[:, :, 0] * self.factors[0]
        for x in range(1, self.rows):
            key ^= key >> np.uint32(15)
            key = key * _M32 + used[:, :, x] * self.factors[x]
        key ^= key >> np.uint32(16)
        key *= _M32
        key ^= key >> np.uint32(13)
        bits = ((winners ^ (winners >> np.uint32(15))) * _FACTORS[:BINS] >> np.uint32(31)).astype(np.uint8)
        return key.reshape(len(winners), self.cells, self.bands), np.packbits(bits[:, self.checked], axis=2)


def bin_winners(s: np.ndarray, out: np.ndarray) -> None:
    """Fill ``out`` with one shingle for each bin. Two texts have the same one in a bin with about the probability intersection / union.

    Every round throws all shingles into the bins; the first round that hits a bin decides it, in a round the lowest hash. So many rounds
    are made that LOAD shingles are thrown for each bin; the few bins left take the shingle of another one."""
    token = (s >> np.uint64(32)).astype(np.uint32)[::-1]
    rounds = -(-LOAD * BINS // len(token))
    h = _FACTORS[:rounds][::-1, None] * token
    h ^= h >> np.uint32(15)
    h *= _M32
    out[:] = 0
    # of equal indices the last one counts: the first round, the lowest hash
    out[(h >> np.uint32(32 - BIN_BITS)).ravel()] = np.broadcast_to(token | np.uint32(1), h.shape).ravel()
    empty = np.flatnonzero(out == 0)
    if len(empty):
        full = out.copy()
        for probe in _PROBES:
            out[empty] = full[probe[empty]]
            empty = empty[out[empty] == 0]
            if not len(empty):
                break


def _planes(x: np.ndarray, width: int = 0) -> bytes:
    """The lower bytes of integers, all first bytes, then all second ones: what hardly varies compresses well. width 0: as many as are used."""
    width = width or next(w for w in range(1, 9) if w == 8 or not (x >> (8 * w)).any())
    return np.ascontiguousarray(x.reshape(-1, 1).view(np.uint8)[:, :width].T).tobytes()


def _from_planes(b, count: int, kind) -> np.ndarray:
    x = np.frombuffer(b, np.uint8).reshape(-1, count)
    out = np.zeros((count, np.dtype(kind).itemsize), np.uint8)
    out[:, : len(x)] = x.T
    return out.view(kind).ravel()


def _signature_batches(width: int, plan: Plan, parts: int):
    """Rows (kind, cell, part) with the ids, size classes, check bits and band keys of up to CHUNK texts. Where a cell has several parts
    (one band then) a text goes to the part that its key names."""

    def packed(kind: str, ids: list[int], sizes: list[int], keys: list[np.ndarray], checks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(ids, kind="stable")
        i, n = np.array(ids, np.int64)[order], plan.size_class(np.array(sizes))[order]
        key, check = np.concatenate(keys)[order], np.concatenate(checks)[order]
        for cell in range(plan.cells):
            out: list[list] = [[] for _ in range(4)]
            part = (key[:, cell, 0] >> np.uint32(24)) % np.uint32(parts)
            for x in range(parts):
                at = np.flatnonzero(part == x) if parts > 1 else slice(None)
                out[0].append(_planes(np.diff(i[at], prepend=0)))
                out[1].append(n[at].tobytes())
                out[2].append(np.ascontiguousarray(check[at, cell].T).tobytes())
                out[3].append(b"".join(_planes(np.ascontiguousarray(key[at, cell, y]), 3) for y in range(plan.bands)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * parts, pa.string()), pa.array([cell] * parts, pa.int32()), pa.array(range(parts), pa.int32()), *(pa.array(c, pa.binary()) for c in out)],
                names=["kind", "cell", "part", "ids", "sizes", "checks", "keys"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, winners, held = Shingler(width), np.zeros((BLOCK, BINS), np.uint32), {}
        for b in batches:
            kinds = np.array(b.column(0).to_pylist(), object)
            for kind in sorted(set(kinds)):
                mine = np.flatnonzero(kinds == kind)
                for start in range(0, len(mine), BLOCK):
                    rows = mine[start : start + BLOCK]
                    ids, sizes, keys, checks = held.setdefault(kind, ([], [], [], []))
                    for x, row in enumerate(rows):
                        s = shingle(b.column(2)[row].as_py())
                        bin_winners(s, winners[x])
                        ids.append(b.column(1)[row].as_py())
                        sizes.append(len(s))
                    key, check = plan.signature(winners[: len(rows)])
                    keys.append(key)
                    checks.append(check)
                    if len(ids) >= CHUNK:
                        yield from packed(kind, *held.pop(kind))
            while sum(len(x[0]) for x in held.values()) >= 2 * CHUNK:
                kind = max(held, key=lambda k: len(held[k][0]))
                yield from packed(kind, *held.pop(kind))
        for kind, x in held.items():
            yield from packed(kind, *x)

    return run


def match_cell(ids: np.ndarray, sizes: np.ndarray, checks: np.ndarray, keys: Iterator[np.ndarray], agree: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (smaller id, larger id), each once, that share a band's key, could match by their sizes and agree in enough check bits."""
    pairs, held = [np.zeros(0, np.int64)], 0
    for key in keys:
        run = key.astype(np.uint64)
        run <<= np.uint64(32)
        run |= np.arange(len(ids), dtype=np.uint32)
        run.sort()
        rank, key = run.astype(np.uint32), (run >> np.uint64(32)).astype(np.uint32)
        del run
        starts = np.flatnonzero(key[1:] == key[:-1])
        for first in range(0, len(starts), EVENTS // 10):
            left, step = starts[first : first + EVENTS // 10], 1
            while len(left):
                # all pairs ``step`` apart in a run of equal keys; only these can have another one step further
                i, j = rank[left], rank[left + step]
                ok = np.abs(sizes[i].astype(np.int16) - sizes[j]) <= 4
                i, j = i[ok], j[ok]
                ok = (np.bitwise_count(checks[i] ^ checks[j]) <= CHECK_BITS - agree) & (ids[i] != ids[j])
                i, j = i[ok].astype(np.int64), j[ok].astype(np.int64)
                pairs.append((np.minimum(i, j) << 32) | np.maximum(i, j))
                held += len(i)
                if held > max(EVENTS, len(pairs[0])):
                    pairs, held = [np.unique(np.concatenate(pairs))], 0
                step += 1
                left = left[left + step < len(key)]
                left = left[key[left] == key[left + step]]
    found = np.unique(np.concatenate(pairs))
    a, b = ids[found >> 32], ids[found & 0xFFFFFFFF]
    return np.minimum(a, b), np.maximum(a, b)


def _match_cells(plan: Plan):
    def run(t: pa.Table) -> pa.Table:
        sizes = np.frombuffer(b"".join(t["sizes"].to_pylist()), np.uint8)
        counts = pc.binary_length(t["sizes"]).to_pylist()
        ends = np.cumsum([0, *counts])
        ids, checks = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.uint32)
        for x, (d, c, n) in enumerate(zip(t["ids"], t["checks"], counts, strict=True)):
            ids[ends[x] : ends[x + 1]] = np.cumsum(_from_planes(d.as_buffer(), n, np.int64)) if n else 0
            checks[ends[x] : ends[x + 1]] = _from_planes(c.as_buffer(), n, np.uint32) if n else 0

        def keys() -> Iterator[np.ndarray]:
            for y in range(plan.bands):
                key = np.empty(len(sizes), np.uint32)
                for x, (k, n) in enumerate(zip(t["keys"], counts, strict=True)):
                    key[ends[x] : ends[x + 1]] = _from_planes(k.as_buffer()[3 * n * y : 3 * n * (y + 1)], n, np.uint32) if n else 0
                yield key

        a, b = match_cell(ids, sizes, checks, keys(), plan.agree)
        return pa.table({"kind": pa.array([t["kind"][0].as_py()] * len(a), pa.string()), "a": pa.array(a), "b": pa.array(b)})

    return run


def _verify_batches(width: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for b in batches:
            sims = []
            for x, y in zip(b.column(3), b.column(4), strict=True):
                s, t = shingle(x.as_py()), shingle(y.as_py())
                common = len(np.intersect1d(s, t, assume_unique=True))
                sims.append(common / (len(s) + len(t) - common))
            keep = pa.array([v >= threshold - 1e-12 for v in sims], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sims, pa.float64())], names=["kind", "a", "b", "similarity"]).filter(keep)

    return run


def near_duplicates(df: DataFrame, id_col: str, text_col: str, kind_col: str | None = None, threshold: float = 0.8, width: int = 5, cell_entries: int = CELL_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (kind, id, class_id) for every text with a word, class_id being the smallest id with the same words;
    links (kind, a, b, similarity) between classes, a < b. Only texts of one kind are compared."""
    kind = F.col(kind_col).cast("string") if kind_col else F.lit("")
    keyed = materialize(
        df.select(kind.alias("kind"), F.col(id_col).cast("long").alias("id"), normal_words(F.col(text_col)).alias("norm"))
        .filter("id is not null and kind is not null and norm <> ''")
        .withColumns({"h1": F.xxhash64("norm"), "h2": F.xxhash64(F.lit(7), "norm")}),
        "normalised",
    )
    hashes = ["kind", "h1", "h2"]
    classes = keyed.groupBy(*hashes).agg(F.min("id").alias("class_id"))
    placed = materialize(keyed.select("id", *hashes).join(classes, hashes).distinct(), "members")
    members = placed.select("kind", "id", "class_id")
    spark = df.sparkSession
    texts = placed.filter("id = class_id").groupBy("kind").count().agg(F.max("count")).first()[0]
    if not texts:
        return members, spark.createDataFrame([], "kind string, a long, b long, similarity double")
    copies = placed.filter("id <> class_id").select("id", *hashes)
    if copies.count() <= BROADCAST_COPIES and keyed.count() == placed.count():
        reps = keyed.join(F.broadcast(copies), ["id", *hashes], "left_anti").select("kind", "id", "norm")
    else:
        firsts = keyed.groupBy(*hashes).agg(F.min(F.struct("id", "norm")).alias("m"))
        reps = materialize(firsts.select("kind", "m.id", "m.norm"), "representatives")
    plan, parts = Plan(threshold, max(1, min(MOST_BANDS, cell_entries // texts))), -(-texts // cell_entries)
    signatures = reps.mapInArrow(_signature_batches(width, plan, parts), "kind string, cell int, part int, ids binary, sizes binary, checks binary, keys binary")
    met = signatures.groupBy("kind", "cell", "part").applyInArrow(_match_cells(plan), "kind string, a long, b long")
    found = met.groupBy("kind", "a", "b").count().filter(F.col("count") >= HITS).drop("count")
    pairs = materialize(found, "candidates")
    count = pairs.count()
    side = lambda c: pairs.select("kind", "a", "b", F.lit(c).alias("side"), F.col(c).alias("id"))
    sides = side("a").unionByName(side("b"))
    sides = F.broadcast(sides) if count <= BROADCAST_PAIRS else sides
    both = reps.select("kind", "id", "norm").join(sides, ["kind", "id"]).groupBy("kind", "a", "b").agg(F.min(F.when(F.col("side") == "a", F.col("norm"))).alias("x"), F.min(F.when(F.col("side") == "b", F.col("norm"))).alias("y"))
    links = materialize(both.mapInArrow(_verify_batches(width, threshold), "kind string, a long, b long, similarity double"), "links")
    return members, links


def duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, id, class_id, links, group_id): one row per document. links counts the other classes its class is linked to, group_id is
    the smallest id of everything connected. Ids of different kinds may coincide, so components run on (kind, id) hashes."""
    key = lambda c: F.xxhash64("kind", c)
    comp = components(links.select(key("a").alias("a"), key("b").alias("b")))
    ends = links.select("kind", F.col("a").alias("class_id")).unionByName(links.select("kind", F.col("b").alias("class_id")))
    degree = ends.groupBy("kind", "class_id").agg(F.count("*").alias("links"))
    placed = degree.withColumn("node", key("class_id")).join(comp, "node")
    names = placed.groupBy("component").agg(F.min("class_id").alias("group_id"))
    known = placed.join(names, "component").select("kind", "class_id", "links", "group_id")
    return members.join(known, ["kind", "class_id"], "left").select("kind", "id", "class_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "class_id").alias("group_id"))


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, id_a, id_b): links and copies expanded to their documents, smaller id first."""
    m = lambda c, i: members.select("kind", F.col("class_id").alias(c), F.col("id").alias(i))
    copies = pairs_within(members.withColumnRenamed("id", "doc"), ["kind", "class_id"], "doc").select("kind", "id_a", "id_b")
    cross = links.join(m("a", "x"), ["kind", "a"]).join(m("b", "y"), ["kind", "b"]).select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return copies.unionByName(cross)
