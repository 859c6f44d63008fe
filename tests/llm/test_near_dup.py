"""Near-duplicates against all pairs, in groups that share bands without being alike."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightwell.llm import near_dup

WORDS = [f"w{i}" for i in range(20000)]


def by_brute_force(texts, similar=0.8):
    """The least index of each text's component, over all pairs."""
    owner, cell, n = near_dup.cells([t.encode() for t in texts])
    _, at = np.unique(cell, return_inverse=True)
    often = np.bincount(at)
    name = np.cumsum(often > 1) - 1
    have = np.zeros((len(texts), int((often > 1).sum())), np.float32)
    mine = often[at] > 1
    have[owner[mine], name[at[mine]]] = 1
    shared = have @ have.T
    alike = shared / np.maximum(n[:, None] + n[None, :] - shared, 1) >= similar
    of = list(range(len(texts)))

    def top(i):
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(alike, 1)), strict=True):
        a, b = sorted((top(i), top(j)))
        of[b] = a
    return [top(i) for i in range(len(texts))]


def variants(count, length, changes, seed, of=WORDS):
    rng = random.Random(seed)
    base = [rng.choice(WORDS) for _ in range(length)]
    out = []
    for _ in range(count):
        t = list(base)
        for _ in range(changes):
            t[rng.randrange(length)] = rng.choice(of)
        out.append(" ".join(t))
    return list(dict.fromkeys(out))


def found(spark, texts):
    docs = near_dup._keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = docs.join(near_dup.near_classes(docs).select("k1", "k2", "class_id"), ["k1", "k2"]).select("doc_id", "class_id").collect()
    got = dict(map(tuple, rows))
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize(("count", "length", "changes", "of"), [(3000, 60, 2, WORDS), (1200, 60, 2, WORDS[:3]), (800, 120, 3, WORDS)])
def test_variants_of_one_text(spark, count, length, changes, of):
    """Of variants of one text that share most bands, those alike are found, whatever the group's size."""
    texts = variants(count, length, changes, 7, of)
    assert found(spark, texts) == by_brute_force(texts)


def test_crowded_bands_by_rare_cells(spark, monkeypatch):
    """The way for large bands finds the links too, down to blocks of two."""
    monkeypatch.setattr(near_dup, "SMALL", 1)
    monkeypatch.setattr(near_dup, "BLOCK", 2)
    monkeypatch.setattr(near_dup, "HOT", 3)
    texts = variants(150, 60, 2, 3, WORDS[:5]) + variants(150, 30, 1, 4)
    assert found(spark, texts) == by_brute_force(texts)


def test_rare_bands_join_all_similar_pairs(spark):
    """Every similar pair, of equal and of unequal length, shares a rare band."""
    rng = random.Random(2)
    texts = []
    for length in (5, 9, 30, 80, 200):
        for t in variants(12, length, 1, length):
            texts += [t, " ".join(t.split()[: max(5, int(length * rng.uniform(0.82, 1)))])]
    table = spark.createDataFrame(list(enumerate(texts)), "cid long, text string")
    bands = {}
    for r in near_dup.rare_bands(table).collect():
        bands.setdefault(r["cid"], {})[r["band"]] = r["side"], r["at"]
    raw = [t.encode() for t in texts]
    i, j = np.triu_indices(len(texts), 1)
    alike = near_dup.weighted_jaccard([raw[x] for x in i], [raw[x] for x in j]) >= 0.8
    assert alike.sum() > 100
    n = near_dup.cells(raw)[2]

    def meet(a, b):
        needed = (n[a] + n[b]) * 0.8 / 1.8 - 1e-9
        for band in bands[a].keys() & bands[b].keys():
            (side, at), (other, of) = bands[a][band], bands[b][band]
            if (side == 2 or side != other) and min(n[a] - at, n[b] - of) >= needed:
                return True
        return False

    assert all(meet(a, b) for a, b in zip(i[alike], j[alike], strict=True))


def test_sketches_count_differing_coordinates(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, (50, near_dup.K), dtype=np.uint64)
    b = np.where(rng.random(a.shape) < 0.5, a, rng.integers(0, 2**64, a.shape, dtype=np.uint64))
    rows = [(x.tolist(), y.tolist()) for x, y in zip(near_dup.sketches(a), near_dup.sketches(b), strict=True)]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select(near_dup.differing(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r["n"] for r in got] == ((a ^ b) & np.uint64(15) != 0).sum(1).tolist()


@pytest.mark.parametrize("bound", [0, 50_000])
def test_what_is_broadcast(spark, monkeypatch, bound):
    """Of many classes only what is marked as small is broadcast, and both ways give all links."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    seen, write = [], near_dup.materialize

    def watched(df, label):
        if label not in ("near-classes", "near-result"):
            seen.append(spark.conf.get(threshold))
        return write(df, label)

    monkeypatch.setattr(near_dup, "materialize", watched)
    for name in ("PLANNED", "BROADCAST_ROWS", "FEW_LINKS"):
        monkeypatch.setattr(near_dup, name, bound)
    before = spark.conf.get(threshold)
    texts = variants(60, 60, 2, 3, WORDS[:5]) + variants(60, 30, 1, 4)
    assert found(spark, texts) == by_brute_force(texts)
    assert spark.conf.get(threshold) == before
    assert seen and set(seen) == {before if bound else "-1"}


def test_counts_of_slots_are_few_rows(spark, monkeypatch):
    """A task sends its counts of rare cells in PARTS rows, however many cells it has."""
    sent = []
    made = type(spark.range(1)).mapInPandas

    def watched(df, run, schema, *more, **named):
        out = made(df, run, schema, *more, **named)
        sent.append((df.rdd.getNumPartitions(), out))
        return out

    texts = spark.createDataFrame(list(enumerate(variants(200, 60, 2, 5))), "cid long, text string").coalesce(2)
    monkeypatch.setattr(type(texts), "mapInPandas", watched)
    near_dup.rare_bands(texts)
    tasks, counts = sent[0]
    assert counts.count() <= tasks * near_dup.PARTS


def test_join_of_many_classes_is_merged(spark, monkeypatch):
    """What the caller joins is planned after the settings are back, so many classes carry a hint of their own."""
    monkeypatch.setattr(near_dup, "PLANNED", 0)
    docs = spark.createDataFrame(list(enumerate(variants(20, 30, 1, 6))), "doc_id long, text string")
    plan = near_dup.keep_one(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
