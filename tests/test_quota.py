"""quota_sample (set-based) against a sequential model of the batch loop."""

import random

from slicekit.operators import sample as N

QUOTA, BATCH = 3, 4


def sequential(cands, existing, req, bonus, quota, batch):
    """cands: [(id, tags or None)] in visiting order; returns accepted ids."""
    buckets = {}
    for tags in existing:
        for ph in (tags or ["none"]):
            buckets[ph] = buckets.get(ph, 0) + 1
    if all(buckets.get(b, 0) >= quota for b in req):
        return []
    out, i = [], 0
    while i < len(cands) and not all(buckets.get(b, 0) >= quota for b in req):
        for cid, tags in cands[i:i + batch]:
            if tags is None:
                continue
            phs = tags or ["none"]
            adv = any(p in req and buckets.get(p, 0) < quota for p in phs) or any(p in bonus for p in phs)
            if adv:
                out.append(cid)
                for p in phs:
                    if p in req or p in bonus:
                        buckets[p] = buckets.get(p, 0) + 1
        i += batch
    return out


import pytest


@pytest.mark.parametrize("quota,batch,seed", [(QUOTA, BATCH, 7), (5, 7, 11), (1, 1, 13)])
def test_quota_sample_matches_sequential_model(spark, quota, batch, seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "c", "x", "z"]
    req, bonus = ("a", "b", "c"), ("x",)
    cand_rows, ex_rows, cases = [], [], {}
    for case in range(40):
        lang = f"L{case}"
        n = rng.randint(0, 30)
        ids = [f"{lang}-{i}" for i in range(n)]
        rows = []
        for cid in ids:
            u = rng.random()
            tags = None if u < 0.1 else [rng.choice(vocab) for _ in range(rng.randint(0, 3))]
            rows.append((cid, tags))
        ex = []
        for j in range(rng.randint(0, 4)):
            ex.append((f"{lang}-ex{j}", [rng.choice(vocab) for _ in range(rng.randint(0, 2))]))
        cases[lang] = (rows, ex)
        cand_rows += [(cid, lang, None if t is None else (t,)) for cid, t in rows]
        ex_rows += [(cid, lang, (t,)) for cid, t in ex]
    schema = "id string, lang string, tags struct<linguistic_phenomena: array<string>>"
    cand = spark.createDataFrame(cand_rows, schema)
    ex = spark.createDataFrame(ex_rows, schema)
    buckets = {lang: (req, bonus) for lang in cases}
    acc = N.quota_sample(cand, ex, buckets, quota, spark, batch_size=batch, seed=42)
    got = {}
    for r in acc.select("id", "lang").collect():
        got.setdefault(r.lang, set()).add(r.id)
    import hashlib
    for lang, (rows, exl) in cases.items():
        order = sorted(rows, key=lambda t: (hashlib.md5(f"42:{t[0]}".encode()).hexdigest(), t[0]))
        exp = sequential(order, [t for _, t in exl], req, bonus, quota, batch)
        assert got.get(lang, set()) == set(exp), lang


def test_seeded_sample_is_stable_and_bounded(spark):
    df = spark.range(0, 500).selectExpr("cast(id as string) as id", "cast(id % 3 as string) as dataset")
    a = N.seeded_sample(df, 10, seed=1).collect()
    b = N.seeded_sample(df.repartition(7), 10, seed=1).collect()
    assert sorted((r.id, r.position) for r in a) == sorted((r.id, r.position) for r in b)
    assert len(a) == 30
