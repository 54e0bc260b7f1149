"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit SimHash is cut into three segments of 22, 21 and 21 bits, each read as a word of
the perfect binary Golay code (23, 12). A segment's keys are the indices of the codewords
to which the segment and its one-bit neighbours decode: one to six keys. Two segments that
differ in at most two bits share a key, because the word half way between them is a
neighbour of both. Of at most four differing bits only one segment can hold more than two,
so some two of the three segments share a key each. Rows are keyed by those pairs of keys;
fingerprints that meet are verified by their exact distance.

Buckets are runs of a sorted stream. Short runs are compared by vectorised shifts; long
ones (dense groups of near copies) by a breadth-first walk that leaves each found
fingerprint out of later comparisons, so that a dense group costs about its size. Only a
spanning set of verified links leaves a task, never all pairs. Equal fingerprints are
collapsed before keying. A run holds 8 bytes per distinct fingerprint of one key.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import materialize
from .common import ascii_words, components, fresh

SHINGLE = 4
SEED = 42
RADIUS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b101011100011  # generator polynomial of the (23, 12) Golay code
RUN = 48  # longest run compared by shifts
_U = np.uint64


def simhash(text: str | None) -> int:
    """Fingerprint of one text as a signed 64-bit number."""
    words = ascii_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends - 1).tolist()
    if n < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, stops[SHINGLE - 1 :])]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = np.array(hashes[at : at + 65536], dtype="<u8")
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


@F.pandas_udf(LongType())
def simhash_column(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def _decoder() -> np.ndarray:
    """Error pattern of each of the 2048 syndromes: every pattern of at most three bits, once."""
    one = [1 << i for i in range(23)]
    two = [a | b for i, a in enumerate(one) for b in one[:i]]
    three = [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
    patterns = np.array([0, *one, *two, *three])
    table = np.zeros(2048, np.int64)
    table[_syndrome(patterns)] = patterns
    return table


ERRORS = _decoder()


def segment_keys(segment: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each segment, padded: (n, width + 1) codeword indices, and which of them count."""
    flips = np.array([0, *(1 << i for i in range(width))])
    near = segment[:, None] ^ flips[None, :]
    keys = (near ^ ERRORS[_syndrome(segment)[:, None] ^ _syndrome(flips)[None, :]]) >> 11
    keys.sort(axis=1)
    fresh_key = np.ones(keys.shape, bool)
    fresh_key[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return keys, fresh_key


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every pair of segment keys of the fingerprints."""
    bits = fps.view(_U) if fps.dtype == np.int64 else fps
    segs = [segment_keys(((bits >> _U(at)) & _U((1 << w) - 1)).astype(np.int64), w) for at, w in SEGMENTS]
    rows, keys = [], []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (ki, mi), (kj, mj) = segs[i], segs[j]
        # compact the counted keys to the left, at most six each
        ki, mi = _left(ki, mi)
        kj, mj = _left(kj, mj)
        both = (mi[:, :, None] & mj[:, None, :]).reshape(len(bits), -1)
        code = ((ki[:, :, None] << 12) | kj[:, None, :]).reshape(len(bits), -1) | (pair << 24)
        r, c = np.nonzero(both)
        rows.append(r)
        keys.append(code[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def _left(keys: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(~mask, axis=1, kind="stable")
    most = int(mask.sum(axis=1).max(initial=0))
    order = order[:, :most]
    return np.take_along_axis(keys, order, 1), np.take_along_axis(mask, order, 1)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 4096):
            part = fps[at : at + 4096]
            rows, keys = bucket_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(part[rows])], ["k", "fp"])


def _near(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= RADIUS


def walk(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the distance graph over distinct fingerprints."""
    left, a, b = fps, [], []
    while len(left):
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            at = queue.pop()
            for x in at:
                hit = _near(left, x)
                if hit.any():
                    found = left[hit]
                    a.append(np.full(len(found), x))
                    b.append(found)
                    queue.append(found)
                    left = left[~hit]
                    if not len(left):
                        break
    none = np.empty(0, _U)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _run_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside whole runs of equal keys."""
    cut = np.flatnonzero(np.diff(keys)) + 1
    starts, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))
    size = stops - starts
    a, b = [], []
    short = np.repeat(size <= RUN, size)
    k, f = keys[short], fps[short]
    lag = 1
    while lag < len(k):
        same = k[lag:] == k[:-lag]
        if not same.any():
            break
        hit = np.flatnonzero(same & _near(f[lag:], f[:-lag]))
        a.append(f[hit])
        b.append(f[hit + lag])
        lag += 1
    for s, e in zip(starts[size > RUN], stops[size > RUN]):
        x, y = walk(fps[s:e])
        a.append(x)
        b.append(y)
    none = np.empty(0, _U)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by key; the last run of a batch may go on in the next."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def out(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = _run_links(keys, fps)
        pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.empty((0, 2), _U)
        return pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, i].astype(_U).view(np.int64)) for i in (0, 1)], ["a", "b"]
        )

    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        fps = batch.column(1).to_numpy(zero_copy_only=False).view(_U)
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        if kept and (last == 0 and kept[0][0][0] == keys[-1]):
            kept.append((keys, fps))  # the run goes on
            continue
        done = [*kept, (keys[:last], fps[:last])]
        kept = [(keys[last:], fps[last:])]
        whole = np.concatenate([x for x, _ in done]), np.concatenate([y for _, y in done])
        if len(whole[0]):
            yield out(*whole)
    if kept:
        yield out(np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept]))


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Verified links (a, b) that span every group of near fingerprints; `fps` has a column fp."""
    keyed = fps.select("fp").distinct().mapInArrow(_keyed, "k int, fp long")
    return keyed.repartition("k").sortWithinPartitions("k").mapInArrow(_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str | Column = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fp (signed fingerprint), component_id (least doc_id reachable), one row per row of `docs`.

    Null and empty texts have fingerprint zero and link like any other. A null doc_id takes
    part with its fingerprint but never names a component; a component of null ids only has
    a null name. Repeated rows stay rows. Other columns are ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), simhash_column(text).alias("fp"))
    rows = materialize(rows)
    ids = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(fingerprint_links(rows))
    named = ids.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked")
    )
    least = named.filter("linked").groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root", "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id")
    )
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group: the one with the least doc_id.

    Rows that repeat a kept doc_id stay. Documents with a null doc_id stay.
    """
    found = near_duplicates(docs).filter("doc_id = component_id").select("doc_id").distinct()
    key = fresh(docs, "kept_id")
    kept = docs.join(found.withColumnRenamed("doc_id", key), F.col("doc_id") == F.col(key), "left")
    return kept.filter(F.col(key).isNotNull() | F.col("doc_id").isNull()).select(*docs.columns)
