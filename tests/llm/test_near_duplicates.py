import random
import re
import time

import numpy as np
import pytest

from lexloom.llm import near_duplicates as nd
from lexloom.llm.near_duplicates import all_pairs, duplicate_groups, near_duplicates


def brute(rows, t, w):
    sets = {}
    for i, x in rows:
        words = re.findall(r"[^\W_]+", (x or "").lower())
        if words:
            sets[i] = {tuple(words[k : k + w]) for k in range(max(1, len(words) - w + 1))}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def texts(seed, n=150):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            words = re.findall(r"\w+", r.choice(rows)[1] or "a b c")
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                words[r.randrange(len(words))] = r.choice(vocab)
            if r.random() < 0.3:
                words = words[: max(1, len(words) * 3 // 4)]
        else:
            words = r.choices(vocab, k=r.choice([1, 2, 3, 10, 30, 60, 120]))
        rows.append((i, r.choice([" ", "  ", ",\r\n"]).join(words).upper() if r.random() < 0.3 else " ".join(words)))
    return rows + [(1000, None), (1001, ""), (1002, " - "), (1003, "É 1²"), (1004, "é, 1²")]


@pytest.mark.parametrize("seed,t,w,cell", [(1, 0.6, 3, 10**6), (2, 0.8, 5, 10**6), (3, 0.6, 3, 300), (4, 0.7, 2, 100)])
def test_matches_brute_force(spark, seed, t, w, cell):
    rows = texts(seed)
    df = spark.createDataFrame([(i, x, 0) for i, x in rows + rows[:3]], "id long, body string, similarity int")
    members, links = near_duplicates(df, "id", "body", None, t, w, cell)
    want = brute(rows, t, w)
    assert {(r.id_a, r.id_b) for r in all_pairs(members, links).collect()} == want
    group = {r.id: r.group_id for r in duplicate_groups(members, links).collect()}
    assert len(group) == len([x for _, x in rows if re.search(r"[^\W_]", x or "")])
    parent = {i: i for i in group}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in want:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert group == {i: root(i) for i in group}


def test_empty(spark):
    members, links = near_duplicates(spark.createDataFrame([], "id long, body string"), "id", "body")
    assert members.collect() == [] and links.collect() == []


def test_texts_of_common_shingles(spark):
    """Every shingle is in about a tenth of the texts: work must not grow with the lengths of their lists."""
    r = random.Random(5)
    phrases = [" ".join(f"v{i}x{k}" for k in range(10)) + " and the" for i in range(300)]
    picks = [r.sample(range(300), 30) for _ in range(24_000)]
    planted = {(i, 24_000 + i) for i in range(40)}
    picks += [p[:24] + r.sample([x for x in range(300) if x not in p], 6) for p in picks[:40]]  # 24 of 36 phrases in common
    df = spark.createDataFrame([(i, " ".join(phrases[x] for x in p)) for i, p in enumerate(picks)], "id long, body string").repartition(8)
    began = time.time()
    links = near_duplicates(df, "id", "body", None, 0.6, 3)[1].collect()
    assert {(x.a, x.b) for x in links} == planted
    assert time.time() - began < 40


@pytest.mark.parametrize("threshold", [0.6, 0.8])
@pytest.mark.parametrize("bands", [1, 8])
def test_pairs_at_the_threshold_meet_in_cells(threshold, bands):
    """The cells in which pairs just at the threshold meet are as many as the plan's bound takes them to be."""
    plan, r, winners, met = nd.Plan(threshold, bands), np.random.default_rng(1), np.zeros((2, nd.BINS), np.uint32), []
    for n in [5, 10, 50, 400, 3000] * 40:
        x = r.integers(1, 1 << 63, n).astype(np.uint64) << np.uint64(1)
        for side, s in enumerate((x, x[: round(threshold * n)])):
            nd.bin_winners(np.sort(s), winners[side])
        key, check = plan.signature(winners)
        met.append(((key[0] == key[1]).any(1) & (np.bitwise_count(check[0] ^ check[1]).sum(1) <= nd.CHECK_BITS - plan.agree)).sum())
    assert min(met) >= nd.HITS
    same = threshold * nd.ALIKE
    hit = nd._tail(nd.CHECK_BITS, (1 + same) / 2, plan.agree) * (1 - (1 - same**plan.rows) ** bands)
    assert np.mean(met) >= 0.97 * hit * plan.cells and np.std(met) <= 1.1 * (plan.cells * hit * (1 - hit)) ** 0.5


def test_repeated_and_copied_rows(spark, monkeypatch):
    """Copies left out by broadcast, by shuffle, and rows delivered twice give the same pairs."""
    rows = texts(6)
    want = brute(rows, 0.6, 3)
    for least, again in ((10**6, []), (0, []), (10**6, rows[:40] * 2)):
        monkeypatch.setattr(nd, "BROADCAST_COPIES", least)
        df = spark.createDataFrame(rows + again, "id long, body string")
        assert {(x.id_a, x.id_b) for x in all_pairs(*near_duplicates(df, "id", "body", None, 0.6, 3)).collect()} == want
