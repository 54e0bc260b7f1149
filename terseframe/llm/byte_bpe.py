"""Byte-level BPE by a rank file: encoding and decoding with DuckDB queries inside each partition.

A text is cut by the tokenizer's pattern; every match is encoded by itself. A match that is a
token takes that token. The others become token-position rows, one per byte, that a
recursive query joins with the merge table (every pair of tokens that together make up a token),
contracting each word's pair of least rank, the leftmost first, until no pair is left. A word is known by its number, a
token by its byte offset, so a contraction changes one row and empties the next one; the
recursion goes on until no word has a pair. Words of up to SHORT bytes contract one pair a round. Longer
ones take fewer rounds: where no token that holds the new one has a
lower rank (`calm`, a fixed property of the merge table), contracting one place can't bring a pair forward that comes before
the other places of the same rank, and all of them are contracted in the same round; of each row only the last state is kept. Decoding joins
ids with the vocabulary and puts the bytes together by an ordered aggregation.

Words are encoded once per worker and kept in a table of bounded size; this saves time and
changes no result. Texts go through in slices of characters, words in groups of bytes, ids in groups of rows, so a
worker holds little beside its batch. A word without a cut costs its length times its
rounds of contraction: nothing is cut off, but a run of 10^5 letters takes minutes.
"""

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import methodcaller

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, short_batches

SLICE_CHARS = 4_000_000
SHORT = 48
LONG_TEXT = 8_000_000  # longer texts are cut lazily
GROUP_BYTES = 250_000
GROUP_IDS = 250_000
KEPT_WORDS = 250_000
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

ENCODE_SHORT = """
WITH RECURSIVE t(round, w, pos, tok) AS (
  SELECT 0, w, pos, tok FROM word_bytes
  UNION ALL
  (WITH live AS (SELECT round, w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS next_tok FROM t
  ), least AS (
    SELECT w, min(merged::BIGINT << 32 | pos) AS b, arg_min(size, merged::BIGINT << 32 | pos) AS size
    FROM live JOIN merges ON first = tok AND second = next_tok GROUP BY w
  )
  SELECT round + 1, live.w, pos, CASE WHEN pos = b & 4294967295 THEN (b >> 32)::INT ELSE tok END
  FROM live JOIN least ON least.w = live.w WHERE pos <= b & 4294967295 OR pos >= (b & 4294967295) + size)
)
SELECT w, tok FROM t JOIN (SELECT w, max(round) AS round FROM t GROUP BY w) USING (w, round) ORDER BY w, pos
"""
ENCODE = """
WITH RECURSIVE t(w, pos, tok) USING KEY (w, pos) AS (
  SELECT w, pos, tok FROM word_bytes
  UNION ALL
  (WITH live AS (
    SELECT w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS next_tok, lead(pos) OVER (PARTITION BY w ORDER BY pos) AS next_pos
    FROM t WHERE tok >= 0
  ), pairs AS MATERIALIZED (
    SELECT w, pos, next_pos, merged, calm FROM live JOIN merges ON first = tok AND second = next_tok
  ), least AS (
    SELECT w, min(merged::BIGINT << 32 | pos) AS b FROM pairs GROUP BY w
  ), same AS (
    SELECT w, pos, next_pos, merged, row_number() OVER (PARTITION BY w ORDER BY pos) AS i,
      lag(next_pos) OVER (PARTITION BY w ORDER BY pos) IS DISTINCT FROM pos AS head
    FROM pairs JOIN least USING (w) WHERE merged = b >> 32 AND (calm OR pos = b & 4294967295)
  ), chosen AS (
    SELECT w, pos, next_pos, merged FROM (
      SELECT *, i - max(CASE WHEN head THEN i END) OVER (PARTITION BY w ORDER BY pos) AS place FROM same
    ) WHERE place % 2 = 0
  ), put AS (
    SELECT w, pos, merged AS tok FROM chosen UNION ALL SELECT w, next_pos, -1 FROM chosen
  )
  SELECT live.w, live.pos, coalesce(put.tok, live.tok)
  FROM live SEMI JOIN least ON least.w = live.w LEFT JOIN put ON put.w = live.w AND put.pos = live.pos)
)
SELECT w, tok FROM t WHERE tok >= 0 ORDER BY w, pos
"""
DECODE = """
SELECT d, unhex(array_to_string(list(hex ORDER BY pos), '')) AS bytes
FROM given_ids JOIN vocabulary USING (id) GROUP BY d ORDER BY d
"""


@dataclass(frozen=True)
class Tokenizer:
    """Ids with their bytes, the pattern that cuts texts, and the merge table that follows from the ranks."""

    pattern: str
    tokens: dict[bytes, int]
    merges: tuple[np.ndarray, ...]  # first, second, merged, calm, size of merged in bytes
    key: str

    @staticmethod
    def of(lines: list[bytes], pattern: str) -> "Tokenizer":
        """From the lines of a rank file: base64 of the token, a blank, its rank."""
        tokens = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        if missing := [i for i in range(256) if bytes([i]) not in tokens]:
            raise ValueError(f"the rank file lacks the bytes {missing}")
        pairs = [(tokens[t[:i]], tokens[t[i:]], n, len(t)) for t, n in tokens.items() for i in range(1, len(t)) if t[:i] in tokens and t[i:] in tokens]
        first, second, merged, size = np.array(pairs, np.int32).reshape(-1, 4).T
        lower = np.concatenate([first[merged < first], second[merged < second]])
        key = hashlib.sha256(pattern.encode() + b"\n" + b"\n".join(lines)).hexdigest()
        return Tokenizer(pattern, tokens, (first, second, merged, ~np.isin(merged, lower), size), key)


def stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all stretches, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Engine:
    """One worker's DuckDB connection with the merge table and the vocabulary, and the words encoded so far."""

    _made: dict[str, "Engine"] = {}

    @staticmethod
    def get(tokenizer: Tokenizer) -> "Engine":
        if tokenizer.key not in Engine._made:
            Engine._made.clear()
            Engine._made[tokenizer.key] = Engine(tokenizer)
        return Engine._made[tokenizer.key]

    def __init__(self, tokenizer: Tokenizer):
        import duckdb

        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB"})
        self.cut = regex.compile(tokenizer.pattern)
        self.tokens = tokenizer.tokens
        self.byte_ids = np.array([tokenizer.tokens[bytes([i])] for i in range(256)], np.int32)
        self._table("merges", dict(zip(("first", "second", "merged", "calm", "size"), tokenizer.merges)))
        ids = np.fromiter(tokenizer.tokens.values(), np.int32, len(tokenizer.tokens))
        self.known = np.zeros(int(ids.max()) + 1, bool)
        self.known[ids] = True
        self._table("vocabulary", {"id": ids, "hex": [t.hex() for t in tokenizer.tokens]})
        self._forget()

    def _table(self, name: str, columns: dict) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _ask(self, name: str, columns: dict, sql: str) -> dict:
        self.con.register(name, pa.table(columns))
        found = self.con.execute(sql).fetchnumpy()
        self.con.unregister(name)
        return found

    def _forget(self) -> None:
        self.words: defaultdict[str, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.starts, self.flat = np.zeros(1, np.int64), np.empty(0, np.int32)

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each word, all tokens in order) of words that are no tokens themselves."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        whole = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        rows = {
            "w": np.repeat(np.arange(len(words), dtype=np.int32), sizes),
            "pos": (np.arange(len(whole)) - np.repeat(starts, sizes)).astype(np.int32), "tok": whole,
        }
        found = self._ask("word_bytes", rows, ENCODE_SHORT if sizes.max() <= SHORT else ENCODE)
        return np.bincount(found["w"], minlength=len(words)), found["tok"].astype(np.int32)

    def _learn(self) -> None:
        """Encodes the words numbered since the last call."""
        new = [w.encode("utf-8", "surrogatepass") for w in islice(self.words, len(self.starts) - 1, None)]
        at = np.array([i for i, w in enumerate(new) if w not in self.tokens], np.int64)
        size = np.array([len(new[i]) for i in at], np.int64)
        sizes, made = np.ones(len(new), np.int64), []
        for part in (size <= SHORT, size > SHORT):
            cuts = np.flatnonzero(np.diff(np.cumsum(size[part]) // GROUP_BYTES)) + 1
            for group in np.split(at[part], cuts):
                if len(group):
                    sizes[group], ids = self._merge([new[i] for i in group])
                    made.append((group, ids))
        starts = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.empty(starts[-1], np.int32)
        whole = np.ones(len(new), bool)
        whole[at] = False
        flat[starts[:-1][whole]] = [self.tokens[w] for w, own in zip(new, whole) if own]
        for group, ids in made:
            flat[stretches(starts[group], sizes[group])] = ids
        self.starts = np.concatenate((self.starts, self.starts[-1] + starts[1:]))
        self.flat = np.concatenate((self.flat, flat))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each text, all ids in order)."""
        if len(self.words) > KEPT_WORDS:
            self._forget()
        places = []
        for text in texts:
            words = self.cut.findall(text) if len(text) < LONG_TEXT else map(methodcaller("group"), self.cut.finditer(text))
            places.append(np.fromiter(map(self.words.__getitem__, words), np.int64))
        self._learn()
        whole = np.concatenate([*places, np.empty(0, np.int64)])
        sizes = np.diff(self.starts)[whole]
        upto = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([len(p) for p in places])]
        return np.diff(upto, prepend=0), self.flat[stretches(self.starts[whole], sizes)]

    def decode(self, sizes: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The bytes of each sequence; `sizes` has its number of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("ids outside of the vocabulary")
        out: list[list[bytes]] = [[] for _ in sizes]
        of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        for a in range(0, len(ids), GROUP_IDS):
            part = ids[a : a + GROUP_IDS]
            rows = {"d": of[a : a + GROUP_IDS], "pos": np.arange(len(part), dtype=np.int32), "id": part}
            found = self._ask("given_ids", rows, DECODE)
            for d, b in zip(found["d"].tolist(), found["bytes"]):
                out[d].append(bytes(b))
        return [b"".join(x) for x in out]


def _slices(batch: pa.Array) -> Iterator[list[str]]:
    texts, chars = [], 0
    for x in batch:
        texts.append(x.as_py() or "")
        chars += len(texts[-1])
        if chars >= SLICE_CHARS:
            yield texts
            texts, chars = [], 0
    if texts:
        yield texts


def load_tokenizer(path: str, pattern: str) -> Tokenizer:
    """From a rank file at a path that the driver can read; its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return Tokenizer.of(f.read().splitlines(), pattern)


def _prepare(spark: SparkSession) -> None:
    short_batches(spark, BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def encode(docs: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """`docs` with the column found_ids, the token ids of the whole text as array<int>; null texts count as empty.

    Special tokens are ordinary text. Repeated rows stay rows; other columns are left alone.
    """
    _prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        engine = Engine.get(shared.value)
        for batch in batches:
            sizes, flat = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for texts in _slices(batch):
                n, found = engine.encode(texts)
                sizes.append(n)
                flat.append(found)
            ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)))

    return docs.withColumn(fresh(docs, "found_ids"), ids.asNondeterministic()(F.col(text).cast("string")))


def decode(rows: DataFrame, tokenizer: Tokenizer, ids: str = "found_ids") -> DataFrame:
    """`rows` with the column found_bytes, the bytes that the ids stand for; null and empty lists give no bytes.

    An id outside of the vocabulary, or null, raises an error.
    """
    _prepare(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(tokenizer)

    @F.arrow_udf("binary")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        engine = Engine.get(shared.value)
        for batch in batches:
            flat = batch.flatten()
            if flat.null_count:
                raise ValueError("null ids")
            sizes = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            yield pa.array(engine.decode(sizes, flat.to_numpy(zero_copy_only=False)), pa.binary())

    return rows.withColumn(fresh(rows, "found_bytes"), text.asNondeterministic()(F.col(ids).cast("array<int>")))


def digests(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """The query's contract: doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = decode(encode(rows, tokenizer), tokenizer)
    return out.select(
        "doc_id", F.size("found_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("found_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("found_bytes", 256).alias("decoded_sha256"),
    )
