import random

import numpy as np
import pytest

from quarry.llm import jaccard_join as J
from quarry.llm.components import components


def brute(texts, words, percent):
    sets = [set() for _ in texts]
    for s, t in zip(sets, texts, strict=True):
        w = (t or "").lower().split()
        s.update([tuple(w)] if 0 < len(w) < words else (tuple(w[i : i + words]) for i in range(len(w) - words + 1)))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def corpus(seed):
    """Near copies from very near to just too far, copies around hubs, shared passages, short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(70)]
    texts = []
    for size in (3, 4, 5, 8, 20, 60, 200, 700):
        for _ in range(4):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            texts += [" ".join(edited(rng, base, rng.choice([0, 1, 1, 2, 3, max(1, size // 40), max(1, size // 25)]))) for _ in range(rng.randint(0, 6))]
    hub = [word() for _ in range(150)]
    texts += [" ".join(edited(rng, hub, 3)) for _ in range(60)] + [" ".join(hub)]
    texts += [" ".join(passage + [word() for _ in range(rng.choice([5, 12, 30]))]) for _ in range(60)]
    texts += ["", None, "one", "ONE", "one two three", *[texts[0]] * 5, texts[0].upper()]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 4, 85), (2, 5, 80), (3, 4, 85)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, words, percent):
    monkeypatch.setattr(J, "SPLIT", 20 if seed == 3 else J.SPLIT)  # so that groups are dealt into blocks
    monkeypatch.setattr(J, "LISTED", {1: 16, 2: 2, 3: 4}[seed])
    monkeypatch.setattr(J, "SHARED", {1: J.SHARED, 2: 100, 3: 30}[seed])
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in J.classes(docs, words, percent).collect()}
    assert rows == brute(texts, words, percent)


@pytest.mark.parametrize(("bits", "hot"), [(3, J.HOT), (64, 5), (3, 5)])
def test_short_names_and_hot_signatures_change_nothing(spark, monkeypatch, bits, hot):
    monkeypatch.setattr(J, "DEALT", 3)
    texts = corpus(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in J.classes(docs, 4, 85, bits, hot).collect()}
    assert rows == brute(texts, 4, 85)


def test_a_band_has_the_parts_that_cost_least():
    chosen = {p: {J.partitions(b, p)[1] for b in range(8, 20)} for p in (80, 85, 95)}
    assert chosen[95] == {2} and chosen[80] == {3}  # many elements to a signature, and few
    for p in (80, 85, 95):
        for b in range(20):
            n, parts, spare = J.partitions(b, p)
            k = J.most_apart(J.bands(p)[b][1], p)
            assert n - spare == (k // 2 + 1 if k else 1)


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        kept = len(a) - int(rng.integers(0, len(a) * (100 - percent) // 100 + 1))
        b = np.unique(np.concatenate([a[:kept], rng.integers(0, 1 << 63, int(rng.integers(0, len(a) // 6 + 1)), dtype=np.uint64)]))
        if 100 * kept >= percent * (len(a) + len(b) - kept):
            assert set(J.signatures(a, percent)) & set(J.signatures(b, percent))
            x, y = J.bitmap(a, percent), J.bitmap(b, percent)
            far = int(np.bitwise_count(np.bitwise_xor(*J._folded([x, y], min(len(x), len(y))))).sum())
            assert far <= len(a) + len(b) - 2 * kept <= J._allowed(np.array([len(a)]), np.array([len(b)]), percent)[0]


def test_groups_over_batches(spark):
    rng = random.Random(4)
    rows = [(c, [rng.randrange(40) for _ in range(6)]) for c in range(60)] + [(5, [1, 1, 2])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = J.groups(spark.createDataFrame(rows, "c long, sigs array<long>")).collect()
        dealt = J.groups(spark.createDataFrame(rows, "c long, sigs array<long>"), 9).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = {}
    for c, sigs in rows:
        for s in sigs:
            held.setdefault(s, set()).add(c)
    assert sorted((r.sig, r.c, r.leader) for r in got) == sorted((s, c, min(cs)) for s, cs in held.items() if len(cs) > 1 for c in cs)
    hot = {s for s, cs in held.items() if sum(x.count(s) for _, x in rows) >= 9}
    assert hot and {(r.sig, r.c, r.leader) for r in dealt} - {(r.sig, r.c, r.leader) for r in got} <= {(s, c, c) for s in hot for c in held[s]} and {(r.sig, r.c, r.leader) for r in dealt} >= {(r.sig, r.c, r.leader) for r in got}


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
