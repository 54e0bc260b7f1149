"""Packing against a plain best fit with look-ahead, and the query over its whole table."""

import random

from pyspark.sql import functions as F

from terseframe.llm import var_pack


def brute(sizes, caps, overhead):
    left, bins = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), []
    while left:
        item = left.pop(0)
        fits = [(room, b) for b, (room, _) in enumerate(bins) if room >= sizes[item]]
        if not fits:
            costs = []
            for cap in caps:
                if cap >= sizes[item]:
                    fill = sizes[item]
                    for j in left:
                        fill += sizes[j] if sizes[j] <= cap - fill else 0
                    costs.append(((cap + overhead) / max(1, fill), cap))
            bins.append((min(costs)[1], []))
            fits = [(bins[-1][0], len(bins) - 1)]
        room, b = min(fits)
        bins[b] = (room - sizes[item], bins[b][1] + [item])
    return [(min(c for c in caps if c >= sum(sizes[i] for i in items)), items) for _, items in bins]


def test_bins_equal_a_plain_best_fit():
    rnd = random.Random(21)
    for _ in range(40):
        caps = sorted(rnd.sample([4, 8, 16, 33, 64, 128], rnd.randrange(1, 5)))
        sizes = [rnd.randrange(1, max(caps) + 1) for _ in range(rnd.randrange(60))]
        overhead = rnd.choice([0, 3, 32])
        assert sorted(var_pack.pack_sizes(sizes, tuple(caps), overhead)) == sorted(brute(sizes, caps, overhead))


def test_sequences_of_a_table(spark):
    rnd = random.Random(22)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(rnd.choice([0, 1, 5, 20, 70, 300])))) for i in range(120)] + [(5, "again"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(3)))
    got = var_pack.pack(df, capacities=(16, 64, 256), overhead=5, runs=3).collect()
    want = []
    for g in range(3):
        docs = sorted(((r.doc_id, r.text) for r in df.filter(F.col("g") == g).collect()), key=lambda r: r[0])
        cut = [(d, at, n, t) for d, t in docs for at, n in var_pack.pieces(len((t or "").split()) + 1, 256)]
        for cap, items in brute([c[2] for c in cut], [16, 64, 256], 5):
            chosen = [cut[i] for i in items]
            text = " ".join(w for _, at, n, t in chosen for w in [*(t or "").split(), "<end>"][at : at + n])
            want.append((cap, sorted((d, at, n) for d, at, n, _ in chosen), sorted(text.split())))
    assert sorted((r.capacity, sorted(zip(r.doc_ids, r.firsts, r.lengths)), sorted(r.text.split())) for r in got) == sorted(want)
    assert all(r.used == sum(r.lengths) == len(r.text.split()) for r in got)


def test_query_packs_every_word_once(spark, sf):
    from terseframe.llm.queries import QUERIES

    seen: dict = {}
    bins: dict = {}
    for r in QUERIES["op8_packing"](spark, sf).collect():
        seen.setdefault(r.doc_id, []).append((r.first, r.length))
        bins.setdefault((r.bin_id, r.capacity, r.used), []).append(r.length)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        at = 0
        for first, length in sorted(seen.pop(r.doc_id)):
            assert first == at
            at += length
        assert at == len(r.text.encode().split()) + 1
    assert not seen and all(sum(n) == used <= cap and cap == min(c for c in var_pack.CAPACITIES if c >= used) for (_, cap, used), n in bins.items())
