"""A bigram language model in Elias-Fano tries, trained and queried in parallel.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text ends with one end token.
Smoothing is absolute discounting towards the word model p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)):
p(w | v) = (c(v w) - D) / c(v) + D * T(v) / c(v) * p(w), T(v) the distinct successors of v.
It sums to one over the training words and one unknown. The trie holds the first term;
words and contexts, in shards of their own, give the second.

Tries are cut into shards by a hash of the whole n-gram, so that a frequent context is
spread over all shards and none grows with it. A shard has three levels: contexts as a
monotone sequence of 64-bit word hashes, monotone pointers to the end of each context's
successors, and the successors as one monotone sequence of (context place, upper bits of the word's
hash), with the log of the smoothed term in 16 bits each. A query finds the context's place and
searches the successor between its pointers. Word and context shards hold 64-bit hashes and exact
counts. A word is its 64-bit hash; among the successors of one context in one shard it is told by the upper 48
bits of it, or by as many as 64 bits leave beside the context's place (44 at a million contexts). Two
successors that agree in these count as one: with S successors, some S^2 / 2^45 of them.

Words are counted first, bigrams in a second pass. Training sends, per task and shard, one
packed sorted array of distinct n-grams with counts. Each shard is merged by one task and
written as a file to the shared folder. Scoring
is one pass over the texts: each task memory-maps the shards it asks (a store without files
of its own is copied to a temporary file first) and moves nothing over the network but the
files' pages. The number of shards follows the number of characters, so a shard's size stays.
"""

import os
import tempfile
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import ascii_words
from .elias_fano import EliasFano, load, store

DISCOUNT = 0.8
SUCCESSOR_BITS = 48
STEP = 1 / 2048  # of quantised log10 probabilities, 16 bits
FOLDS = 10
SHARD_CHARS = 32_000_000
CHUNK_TOKENS = 2_500_000
END, START = xxhash.xxh3_64_intdigest(b"end\n"), xxhash.xxh3_64_intdigest(b"start\n")  # no word holds a line end
_U = np.uint64


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of hashes."""
    x = a * _U(0x9E3779B97F4A7C15) ^ (b + (a >> _U(29)))
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Chunk:
    """Texts turned into token numbers of one growing word table; 0 is the end, 1 the start."""

    def __init__(self) -> None:
        self.table: defaultdict[bytes, int] = defaultdict()
        self.table.default_factory = self.table.__len__
        self.table[b"end\n"], self.table[b"start\n"] = 0, 1
        self.ids: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.tokens = 0

    def add(self, text: str | None) -> None:
        words = ascii_words(text)
        ids = np.empty(len(words) + 2, np.int32)
        ids[0], ids[-1] = 1, 0
        ids[1:-1] = np.fromiter(map(self.table.__getitem__, words), np.int32, len(words))
        self.ids.append(ids)
        self.sizes.append(len(ids) - 1)
        self.tokens += len(ids) - 1

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word number, first, second word of each bigram, tokens per text)."""
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.table), _U, len(self.table))
        whole = np.concatenate(self.ids)
        sizes = np.array(self.sizes, np.int64)
        heads = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        first, second = np.ones(len(whole), bool), np.ones(len(whole), bool)
        second[heads] = False
        first[heads + sizes] = False
        return hashes, whole[first], whole[second], sizes


def _groups(shard: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) of every shard that occurs; places keep their order."""
    shard = shard.astype(np.uint16) if n < 65536 else shard  # sorted by digits
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(n + 1))
    for s in range(n):
        if cuts[s] < cuts[s + 1]:
            yield s, order[cuts[s] : cuts[s + 1]]


def _word_blobs(chunk: Chunk, n_shards: int) -> Iterator[tuple[int, bytes]]:
    hashes, _, second, _ = chunk.arrays()
    n = np.bincount(second, minlength=len(hashes))
    some = np.flatnonzero(n)
    h, c = hashes[some], n[some]
    for s, at in _groups((h % _U(n_shards)).astype(np.int64), n_shards):
        yield s, store([h[at], c[at].astype(np.uint32)])


def _pair_blobs(chunk: Chunk, n_shards: int) -> Iterator[tuple[int, bytes]]:
    hashes, first, second, _ = chunk.arrays()
    pairs, c = np.unique(first.astype(np.int64) << 32 | second, return_counts=True)
    a, b = hashes[pairs >> 32], hashes[pairs & 0xFFFFFFFF]
    shard, own = (_mix(a, b) % _U(n_shards)).astype(np.int64), b >> _U(64 - SUCCESSOR_BITS)
    upper, lower = (own >> _U(16)).astype(np.uint32), (own & _U(0xFFFF)).astype(np.uint16)
    for s, at in _groups(shard, n_shards):
        at = at[np.argsort(a[at], kind="stable")]
        ctx, start = np.unique(a[at], return_index=True)
        runs = np.diff(np.concatenate((start, [len(at)])))
        n = c[at]
        small = np.minimum(n, 255).astype(np.uint8)  # larger counts follow apart
        yield s, store([ctx, runs.astype(np.uint32), upper[at], lower[at], small, n[n >= 255].astype(np.uint64)])


def _count_rows(blobs: Callable[[Chunk, int], Iterator[tuple[int, bytes]]], n_shards: int) -> Callable[..., Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(chunk: Chunk) -> pa.RecordBatch:
            rows = list(blobs(chunk, n_shards))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "blob"]
            )

        chunk = Chunk()
        for batch in batches:
            for text in batch.column(0):
                chunk.add(text.as_py())
                if chunk.tokens >= CHUNK_TOKENS:
                    yield out(chunk)
                    chunk = Chunk()
        if chunk.ids:
            yield out(chunk)

    return run


# --- shard files

def _files(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)


def write_shard(folder: str, name: str, data: bytes) -> None:
    """Written under a name of its own, then renamed: a task that runs twice leaves the same file."""
    fs, base = _files(folder)
    fs.create_dir(base, recursive=True)
    own = f"{base}/.{name}-{os.getpid()}-{os.urandom(6).hex()}"
    with fs.open_output_stream(own) as f:
        f.write(data)
    fs.move(own, f"{base}/{name}")


class Shards:
    """Reads shard files: memory-mapped where they are local, else through a temporary copy."""

    def __init__(self, folder: str):
        self.fs, self.base = _files(folder)

    def load(self, name: str) -> list[np.ndarray] | None:
        path = f"{self.base}/{name}"
        if isinstance(self.fs, pyarrow.fs.LocalFileSystem):
            return load(np.memmap(path, np.uint8, "r")) if os.path.exists(path) else None
        if self.fs.get_file_info(path).type != pyarrow.fs.FileType.File:
            return None
        with tempfile.TemporaryFile() as copy:  # gone when the map is
            with self.fs.open_input_stream(path) as f:
                while part := f.read(1 << 22):
                    copy.write(part)
            copy.flush()
            return load(np.memmap(copy, np.uint8, "r"))


class Trie:
    """Levels of one shard: contexts, pointers to the ends of their successors, successors with probabilities."""

    def __init__(self, parts: list[np.ndarray]):
        self.contexts, self.pointers, self.successors = (EliasFano.of(parts[i : i + 4]) for i in (0, 4, 8))
        self.quantised = parts[12]

    @staticmethod
    def bits(contexts: int) -> int:
        """Bits of a successor's hash that stand beside the place of its context."""
        return min(SUCCESSOR_BITS, 64 - max(1, contexts).bit_length())

    @staticmethod
    def build(contexts: np.ndarray, runs: np.ndarray, successors: np.ndarray, prob: np.ndarray) -> list[np.ndarray]:
        """Arrays of a shard from sorted context hashes, successors per context, (place, hash bits) of each and their probabilities."""
        ends = np.cumsum(runs)
        levels = [
            EliasFano.build(contexts.astype(_U), 1 << 64),
            EliasFano.build(ends.astype(_U), int(ends[-1]) + 1 if len(ends) else 1),
            EliasFano.build(successors, max(1, len(contexts)) << Trie.bits(len(contexts))),
        ]
        q = np.clip(np.round(-np.log10(prob) / STEP), 0, 65535).astype(np.uint16)
        return [x for level in levels for x in level.parts()] + [q]

    def prob(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Smoothed term of each pair of word hashes, 0 where the shard does not hold it."""
        out = np.zeros(len(a))
        ctx, back = np.unique(a, return_inverse=True)
        place = self.contexts.find(ctx)
        known = place >= 0
        lo, hi = np.zeros(len(ctx), np.int64), np.zeros(len(ctx), np.int64)
        hi[known] = self.pointers.get(place[known]).astype(np.int64)
        after = known & (place > 0)
        lo[after] = self.pointers.get(place[after] - 1).astype(np.int64)
        some = np.flatnonzero(known[back])
        at_ctx, bits = back[some], self.bits(self.contexts.n)
        key = place[at_ctx].astype(_U) << _U(bits) | (b[some] >> _U(64 - bits))
        at = self.successors.find(key, lo[at_ctx], hi[at_ctx])
        hit = at >= 0
        out[some[hit]] = 10 ** (-STEP * self.quantised[at[hit]].astype(np.float64))
        return out


@dataclass
class Model:
    """Where the shards lie, and the totals of training."""

    folder: str
    shards: int
    tokens: int
    types: int
    texts: int
    discount: float = DISCOUNT

    def word_prob(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.tokens + 0.1 * (self.types + 1))

    def counts(self, hashes: np.ndarray, level: str = "w") -> np.ndarray:
        """Of each word hash: its training count ("w") or its distinct successors ("c"); 0 where unknown."""
        files, out = Shards(self.folder), np.zeros(len(hashes), np.int64)
        for s, at in _groups((hashes % _U(self.shards)).astype(np.int64), self.shards):
            if (parts := files.load(f"{level}{s}")) is not None:
                hit = EliasFano.of(parts[:4]).find(hashes[at])
                known = hit >= 0
                out[at[known]] = parts[4][hit[known]]
        return out

    def pair_prob(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        files, out = Shards(self.folder), np.zeros(len(a))
        for s, at in _groups((_mix(a, b) % _U(self.shards)).astype(np.int64), self.shards):
            if (parts := files.load(f"p{s}")) is not None:
                out[at] = Trie(parts).prob(a[at], b[at])
        return out

    def context_counts(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.where(hashes == _U(START), self.texts, counts)

    def score(self, chunk: Chunk) -> list[np.ndarray]:
        """n_tokens, n_known, base_score and score of the chunk's texts."""
        hashes, first, second, sizes = chunk.arrays()
        counts = self.counts(hashes)
        word = self.word_prob(counts)
        pairs, back = np.unique(first.astype(np.int64) << 32 | second, return_inverse=True)
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        total, types = self.context_counts(hashes, counts), self.counts(hashes, "c")
        rest = np.where(total > 0, self.discount * types / np.maximum(total, 1), 1.0)
        log10 = np.log10(self.pair_prob(hashes[a], hashes[b]) + rest[a] * word[b])[back]
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        sums = lambda x: np.add.reduceat(x, starts)
        return [sizes, sums((counts > 0)[second].astype(np.int64)), sums(np.log10(word)[second]), sums(log10)]


def _blobs(table: pa.Table) -> list[list[np.ndarray]]:
    return [load(np.frombuffer(x.as_py(), np.uint8)) for x in table.column("blob")]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


def _count_shard(folder: str, level: str) -> Callable[[pa.Table], pa.Table]:
    """Adds up packed (hashes, counts) and writes them as a shard of exact counts."""

    def run(table: pa.Table) -> pa.Table:
        shard, blobs = table.column("shard")[0].as_py(), _blobs(table)
        h, c = _summed(np.concatenate([b[0] for b in blobs]), np.concatenate([b[1] for b in blobs]).astype(np.int64))
        write_shard(folder, f"{level}{shard}", store([*EliasFano.build(h, 1 << 64).parts(), c.astype(np.uint64)]))
        return pa.table({"tokens": [int(c.sum())], "types": [len(h)]})

    return run


def _pair_shard(model: Model) -> Callable[[pa.Table], pa.Table]:
    """Writes a trie shard; returns the successors it counted, packed for the context shards."""

    def run(table: pa.Table) -> pa.Table:
        shard, blobs = table.column("shard")[0].as_py(), _blobs(table)
        whole = np.unique(np.concatenate([b[0] for b in blobs]))
        bits = Trie.bits(len(whole))
        keys, counts = [], []
        for ctx, runs, upper, lower, small, large in blobs:
            n = small.astype(np.int64)
            n[small == 255] = large.astype(np.int64)
            own = upper.astype(_U) << _U(16) | lower.astype(_U)
            keys.append(np.repeat(np.searchsorted(whole, ctx).astype(_U), runs) << _U(bits) | own >> _U(SUCCESSOR_BITS - bits))
            counts.append(n)
        del blobs
        key, n = _summed(np.concatenate(keys), np.concatenate(counts))
        del keys, counts
        runs = np.bincount((key >> _U(bits)).astype(np.int64), minlength=len(whole))
        total = model.context_counts(whole, model.counts(whole))
        prob = (n - model.discount) / np.repeat(total, runs)
        write_shard(model.folder, f"p{shard}", store(Trie.build(whole, runs, key, prob)))
        owner = whole
        rows = [(s, store([owner[i], runs[i].astype(np.uint32)])) for s, i in _groups((owner % _U(model.shards)).astype(np.int64), model.shards)]
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    return run


def train(docs: DataFrame, discount: float = DISCOUNT, shard_chars: int = SHARD_CHARS) -> Model:
    """Words and bigrams of every text of `docs` (null: empty), as shard files in the shared folder."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_texts, chars = texts.agg(F.count("*"), F.sum(F.length("text"))).first()
    folder = scratch_path(docs.sparkSession, "ngrams")
    shards = 1 + (chars or 0) // shard_chars
    model = Model(folder, shards, 0, 0, n_texts, discount)
    if not n_texts:
        return model
    pack = "shard int, blob binary"
    words = texts.mapInArrow(_count_rows(_word_blobs, shards), pack)
    model.tokens, model.types = words.groupBy("shard").applyInArrow(
        _count_shard(folder, "w"), "tokens long, types long"
    ).agg(F.sum("tokens"), F.sum("types")).first()
    pairs = texts.mapInArrow(_count_rows(_pair_blobs, shards), pack)
    contexts = pairs.groupBy("shard").applyInArrow(_pair_shard(model), pack)
    contexts.groupBy("shard").applyInArrow(_count_shard(folder, "c"), "tokens long, types long").agg(F.sum("types")).first()
    return model


def _score_rows(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list, chunk: Chunk) -> pa.RecordBatch:
            cols = [pa.array(x) for x in model.score(chunk)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *cols], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

        ids, chunk = [], Chunk()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc_id.as_py())
                chunk.add(text.as_py())
                if chunk.tokens >= CHUNK_TOKENS:
                    yield out(ids, chunk)
                    ids, chunk = [], Chunk()
        if ids:
            yield out(ids, chunk)

    return run


def held_out(key: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of `docs`; null texts count as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score_rows(model), "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score_held_out(docs: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """The query's contract: train on the rows that are not held out, score all.

    A null doc_id is not held out; repeated rows count as often as they appear. Without
    training texts (N = V = 0) every token has the probability of the one unknown word.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))), discount)
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
