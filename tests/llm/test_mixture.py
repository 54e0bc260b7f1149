"""The mixture against a scheduler that plans every period slot by slot."""

import hashlib
import random

from terseframe.llm import pfair_mix


def brute(rows, targets, block):
    targets = {pfair_mix.OTHER: 1} | targets
    names = list(targets)
    own = {c: [] for c in names}
    for doc_id, source in rows:
        own[source if source in targets and source != pfair_mix.OTHER else pfair_mix.OTHER].append(doc_id)
    key = lambda d: (hashlib.md5(("" if d is None else str(d)).encode()).hexdigest(), d is not None, d or 0)
    own = {c: sorted(ids, key=key) for c, ids in own.items()}
    have = [-(-len(own[c]) // block) for c in names]
    out, base, period = [], 0, 0
    while any(h > period * targets[c] for h, c in zip(have, names)):
        takes = [min(targets[c], max(0, h - period * targets[c])) for h, c in zip(have, names)]
        slots, done = sum(takes), [0] * len(names)
        for t in range(slots):
            ready = [(-(-(done[i] + 1) * slots // a), i) for i, a in enumerate(takes) if a > done[i] and done[i] * slots // a <= t]
            due, i = min(ready)
            number = period * targets[names[i]] + done[i]
            for rank in range(number * block, min((number + 1) * block, len(own[names[i]]))):
                out.append((own[names[i]][rank], names[i], rank, number, base + t, base + done[i] * slots // takes[i], base + due))
            done[i] += 1
        base, period = base + slots, period + 1
    return out


def test_against_a_plain_scheduler(spark):
    rnd = random.Random(12)
    rows = [(i, rnd.choices(["a", "b", "c", "other", None], [9, 3, 1, 2, 1])[0]) for i in range(900)] + [(3, "a"), (3, "a"), (None, "b"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    for targets, block in (({"a": 2, "b": 3, "c": 1}, 4), ({"b": 1}, 7), ({"a": 5, "b": 1, pfair_mix.OTHER: 2}, 1)):
        got = pfair_mix.mix(df, targets, block_docs=block).select("doc_id", "mix_class", "mix_rank", "mix_block", "mix_slot", "mix_release", "mix_deadline")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows, targets, block), key=str)
