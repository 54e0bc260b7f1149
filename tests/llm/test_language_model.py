"""The bigram model against a brute force, also for words that share half of their hash."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import xxhash

from terseframe.llm import ngram_trie

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [w.decode() for w in (text or "").translate(LOWER).encode().split()]


def brute(rows, discount=ngram_trie.DISCOUNT):
    train = [tokens(t) + ["\n"] for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    count = Counter(w for t in train for w in t)
    total, types = sum(count.values()), len(count)
    pairs = Counter(p for t in train for p in zip(["\r", *t], t))
    context, follow = Counter(), Counter()
    for (a, _), n in pairs.items():
        context[a] += n
        follow[a] += 1
    out = []
    for i, t in rows:
        words = tokens(t) + ["\n"]
        base = [(count[w] + 0.1) / (total + 0.1 * (types + 1)) for w in words]
        score = 0.0
        for a, w, p in zip(["\r", *words], words, base):
            rest = discount * follow[a] / context[a] if context[a] else 1.0
            seen = (pairs[a, w] - discount) / context[a] if pairs[a, w] else 0.0
            score += math.log10(seen + rest * p)
        out.append((i, i is not None and not zlib.crc32(str(i).encode()) % 10, len(words), sum(count[w] > 0 for w in words), total, sum(map(math.log10, base)), score))
    return out


def same(got, want):
    got, want = sorted(map(tuple, got), key=str), sorted(want, key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], rel_tol=1e-9) and abs(g[6] - w[6]) <= ngram_trie.STEP * w[2]


def twins():
    """Pairs of words whose hashes share the upper 32 bits."""
    names = [f"w{i}" for i in range(400_000)]
    upper = np.array([xxhash.xxh3_64_intdigest(n.encode()) >> 32 for n in names])
    order = np.argsort(upper, kind="stable")
    return [(names[a], names[b]) for a, b in zip(order, order[1:]) if upper[a] == upper[b]][:6]


def test_against_brute_force(spark):
    rnd = random.Random(6)
    pairs = twins()
    assert len(pairs) >= 3
    words = ["The", "of", "river", "\u0130x", "a,", "b"] + [w for p in pairs for w in p]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(40)))) for i in range(300)] + [(3, "river of"), (None, "of the"), (500, None), (501, "")]
    # successors that share their context and half of their hash, and contexts that do
    for a, b in pairs:
        rows += [(600, f"of {a} of {b} of {a}"), (601, f"{a} of {a} of {b} the {b} unseen {b} of")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(ngram_trie.score_held_out(df).collect(), brute(rows))
    model = ngram_trie.train(df, shard_chars=1500)
    assert model.shards > 3
    found = ngram_trie.score(df, model)
    same([(r[0], None, r[1], r[2], None, r[3], r[4]) for r in found.collect()], [(w[0], None, w[2], w[3], None, *w[5:]) for w in brute_all(rows)])


def brute_all(rows):
    """Trained on every row: ids that are never held out."""
    kept = [(None, t) for _, t in rows]
    return [(i, *w[1:]) for (i, _), w in zip(rows, brute(kept))]


def test_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    same(ngram_trie.score_held_out(df).collect(), brute([tuple(r) for r in df.collect()]))
