from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from sablelens.llm import mixing
from sablelens.llm.exact_dedup import exact_duplicates
from sablelens.llm.mixing import Mix, _hypergeometric, mix, mixed_documents, splitting_tree, taken_words
from tests.llm.conftest import prose


def brute(rows):
    fold = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").encode().translate(fold)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def check(df, rows, block):
    got = exact_duplicates(df, block=block).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute(rows)
    kept = [r for r in got if r["kept"]]
    assert len({r["text_sha256"] for r in got}) == len(kept) == len({(r["n_blocks"], r["identity"]) for r in got})


def test_exact_dedup_edge_cases(odd):
    check(odd, [(r["doc_id"], r["text"]) for r in odd.collect()], 4096)


def test_exact_dedup_naming_levels(make):
    """Small blocks make many levels; prefixes of each other and texts that differ in one block are told apart."""
    base = prose(1, 60)
    texts = [base, base.upper(), base + " x", base[:-1] + "!", "!" + base[1:], base[:32], base[:64], base[:33], "é" * 40, "É" * 40] + [prose(k % 3, 25) for k in range(12)]
    rows = list(enumerate(texts))
    check(make(rows), rows, 16)


def test_exact_dedup_empty(make):
    assert exact_duplicates(make([])).count() == 0


def test_mix_targets_and_taken(make):
    rows = [(k, prose(k, 5 + k % 40), "en", f"s{k % 5}") for k in range(400)] + [(1000 + k, prose(k, 20), "en", None) for k in range(10)]
    out = taken_words(mix(make(rows), shard_words=1000)).collect()
    assert len(out) == 410
    sources = {i: s for i, _, _, s in rows}
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in out:
        s = sources[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        targets[s] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    # Water filling by hand: weights 5, 2, 1 in order, the null source last.
    weights = dict(zip(["s0", "s1", "s2", "s3", "s4", None], [5, 2, 1, 5, 2, 1], strict=True))
    left, want = set(weights), {}
    total = 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(want.values())) / sum(weights[s] for s in left)
        over = [s for s in left if level * weights[s] > 2 * sizes[s] + 1e-9]
        if not over:
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left.discard(s)
    want |= {s: level * weights[s] for s in left}
    for s in weights:
        assert abs(targets[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - targets[s]) <= 25, s
    assert set(map(repr, out)) == set(map(repr, taken_words(mix(make(rows[::-1]).repartition(3), shard_words=1000)).collect()))


def test_splitting_tree_is_exact_and_fair(spark):
    quotas = [1000, 0, 37, 4096, 1]
    root = spark.createDataFrame([(quotas,)], "quotas array<long>")
    leaves = [r["quotas"] for r in splitting_tree(root, 4).collect()]
    assert len(leaves) == 16 and [sum(x) for x in zip(*leaves, strict=True)] == quotas
    assert max(sum(x) for x in leaves) - min(sum(x) for x in leaves) <= 4
    assert all(180 <= x[3] <= 330 for x in leaves)


def test_splitting_tree_has_a_small_plan(spark, monkeypatch):
    """The driver holds the plan: some 7,000 characters a level (40,000 before), and no more levels than SPREAD in one."""
    root = spark.createDataFrame([([30, 0, 7],)], "quotas array<long>")
    size = lambda depth: len(splitting_tree(root, depth)._jdf.queryExecution().analyzed().toString())
    assert size(6) < 80_000
    monkeypatch.setattr(mixing, "SPREAD", 2)
    deep = splitting_tree(root, 5)
    assert len(deep._jdf.queryExecution().analyzed().toString()) < 1.5 * size(1)
    leaves = [r["quotas"] for r in deep.collect()]
    assert len(leaves) == 32 and [sum(x) for x in zip(*leaves, strict=True)] == [30, 0, 7]


def test_hypergeometric_draws(spark):
    """Against the distribution's mean and variance, and its whole range."""
    df = spark.range(4000).select(_hypergeometric(F.lit(50).cast("long"), F.lit(20).cast("long"), F.lit(10).cast("long"), (F.col("id") + 0.5) / 4000).alias("x"))
    xs = [r["x"] for r in df.collect()]
    mean = sum(xs) / len(xs)
    assert abs(mean - 4) < 0.01 and min(xs) >= 0 and max(xs) <= 10
    assert abs(sum((x - mean) ** 2 for x in xs) / len(xs) - 10 * 0.4 * 0.6 * 40 / 49) < 0.02


def test_mix_edge_cases(odd, make):
    made = mix(odd)
    assert isinstance(made, Mix)
    out = taken_words(made).collect()
    assert len(out) == odd.count() and sum(r["size"] for r in out if r["doc_id"] in (4, 5)) == 80_000
    assert taken_words(mix(make([]))).count() == 0 and mixed_documents(make([])).count() == 0
    rows = mixed_documents(odd)
    assert rows.columns == odd.columns and rows.where("text IS NULL").count() == 0
