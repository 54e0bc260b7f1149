"""Document quality from a linear-chain conditional random field over lines.

Every line is good (1) or bad (0). A line's features are character shares, word shape and
repetition, and the same features of the lines before and after it. The chain is fitted to
labelled documents, all lines of one bearing its label and every document counting alike.
Forward-backward gives each line's probability of good; their mean, weighted by line
length, is the document's score. The features do not depend on language, source or id.

The fit uses a bounded sample: the first `max_docs` labelled documents of each class in the
order of a hash. Their features are made on the executors, only those reach the driver. Scoring
is one pass over the texts without a shuffle.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DOCS = 3000
THRESHOLD = 0.3
FOLDS = 5
CHUNK = 500
CHUNK_CHARS = 4_000_000  # of the texts scored together
MAX_LINES = 2000

# byte classes: 0 upper, 1 lower, 2 digit, 3 space, 4 common punctuation, 5 other ASCII sign, 6 beyond ASCII
CLASSES = np.full(256, 5, np.uint8)
CLASSES[65:91], CLASSES[97:123], CLASSES[48:58], CLASSES[128:] = 0, 1, 2, 6
CLASSES[[9, 10, 11, 12, 13, 32]] = 3
CLASSES[list(b".,;:?!'\"()-")] = 4
N_BASE = 14
N_FEATURES = 3 * N_BASE + 3


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, line weights, lines per text); an empty or null text is one empty line."""
    texts = ["" if t is None else t for t in texts]
    per = np.array([t.count("\n") + 1 for t in texts], np.int64)
    whole = "\n".join(texts)
    lines = whole.split("\n")
    data = np.frombuffer(whole.encode("utf-8", "surrogatepass") + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = (ends - starts).astype(np.float64)
    kinds = CLASSES[data]
    share = [np.add.reduceat(kinds == c, starts, dtype=np.int64) for c in range(7)]
    share[3] = share[3] - 1  # the line's own end
    safe = np.maximum(size, 1)
    words, distinct, again = np.zeros(len(lines)), np.zeros(len(lines)), np.zeros(len(lines))
    first = np.concatenate(([0], np.cumsum(per)[:-1]))
    for d, n in zip(first.tolist(), per.tolist()):
        seen = set()
        for i in range(d, d + n):
            line = lines[i]
            parts = line.split()
            words[i] = len(parts)
            distinct[i] = len(set(parts))
            if parts:
                again[i] = line in seen
                seen.add(line)
    many = np.maximum(words, 1)
    base = np.stack([
        np.log1p(words) / 5, share[0] / safe, share[2] / safe, share[5] / safe, share[4] / safe, share[6] / safe,
        distinct / many, again, np.minimum(size / many, 40) / 20, words == 0, share[0] > 0.3 * size,
        share[5] > 0.04 * size, distinct < 0.5 * words, np.log1p(np.maximum(words - distinct, 0)) / 5,
    ], axis=1)
    before, after = np.zeros_like(base), np.zeros_like(base)
    before[1:], after[:-1] = base[:-1], base[1:]
    head, tail = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
    head[first], tail[first + per - 1] = True, True
    before[head], after[tail] = 0, 0
    x = np.concatenate([base, before, after, head[:, None], tail[:, None], np.ones((len(lines), 1))], axis=1)
    return x.astype(np.float32), size + 1, per


def chains(per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line order by place in the chain, long chains first, and the number of lines at each place."""
    order = np.argsort(-per, kind="stable")
    first = np.concatenate(([0], np.cumsum(per)[:-1]))[order]
    alive = np.searchsorted(-per[order], -np.arange(per.max(initial=0)), side="left")
    return np.concatenate([first[:n] + t for t, n in enumerate(alive)]) if len(alive) else first, alive


def forward_backward(score: np.ndarray, move: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line, log Z of each chain, expected moves (chains, 2, 2); score: (lines, 2)."""
    idx, alive = chains(per)
    at = np.concatenate(([0], np.cumsum(alive)))
    s = score[idx]
    fwd, bwd = np.empty_like(s), np.zeros_like(s)
    for t, n in enumerate(alive):
        here = slice(at[t], at[t] + n)
        if t == 0:
            fwd[here] = s[here]
        else:
            prev = fwd[at[t - 1] : at[t - 1] + n]
            fwd[here] = s[here] + np.logaddexp(prev[:, :1] + move[0], prev[:, 1:] + move[1])
    for t in range(len(alive) - 2, -1, -1):
        n = alive[t + 1]
        nxt = slice(at[t + 1], at[t + 1] + n)
        ahead = s[nxt] + bwd[nxt]
        bwd[at[t] : at[t] + n] = np.logaddexp(ahead[:, :1] + move[:, 0], ahead[:, 1:] + move[:, 1])
    both = fwd + bwd
    log_z = np.logaddexp(both[:, 0], both[:, 1])
    good = np.empty(len(s))
    good[idx] = np.exp(both[:, 1] - log_z)
    moves = np.zeros((len(per), 2, 2))
    for t in range(1, len(alive)):
        n = alive[t]
        nxt = slice(at[t], at[t] + n)
        prev = fwd[at[t - 1] : at[t - 1] + n]
        joint = prev[:, :, None] + move[None] + (s[nxt] + bwd[nxt])[:, None, :]
        moves[:n] += np.exp(joint - log_z[nxt][:, None, None])
    order = np.argsort(-per, kind="stable")
    z, m = np.empty(len(per)), np.empty_like(moves)
    z[order], m[order] = log_z[: len(per)], moves
    return good, z, m


@dataclass
class Chain:
    """A fitted chain: emission weights of good against bad, and the score of each move."""

    weight: np.ndarray
    move: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        x, size, per = line_features(texts)
        emit = np.zeros((len(x), 2))
        emit[:, 1] = x @ self.weight
        good, _, _ = forward_backward(emit, self.move, per)
        starts = np.concatenate(([0], np.cumsum(per)[:-1]))
        return np.clip(np.add.reduceat(good * size, starts) / np.add.reduceat(size, starts), 0.0, 1.0)


def fit_chain(x: np.ndarray, per: np.ndarray, labels: np.ndarray, rounds: int = 250, ridge: float = 1e-4) -> Chain:
    """Penalised likelihood by Adam steps on the exact gradient; without both classes all scores are 0.5."""
    weight, move = np.zeros(N_FEATURES), np.zeros((2, 2))
    if len(set(labels.tolist())) < 2:
        return Chain(weight, move)
    line_doc = np.repeat(np.arange(len(per)), per)
    y = labels[line_doc]
    share = np.where(labels == 1, 0.5 / max((labels == 1).sum(), 1), 0.5 / max((labels == 0).sum(), 1)) / per
    seen = np.zeros((len(per), 2, 2))
    seen[np.arange(len(per)), labels, labels] = per - 1
    first, second = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for step in range(1, rounds + 1):
        emit = np.zeros((len(x), 2))
        emit[:, 1] = x @ weight
        good, _, moves = forward_backward(emit, move, per)
        g = np.concatenate([
            x.T @ ((y - good) * share[line_doc]) - ridge * weight,
            ((seen - moves) * share[:, None, None]).sum(axis=0).ravel() - ridge * move.ravel(),
        ])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        go = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weight, move = weight + go[:N_FEATURES], move + go[N_FEATURES:].reshape(2, 2)
    return Chain(weight, move)


def held_out(key: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, label in zip(batch["text"], batch["label"]):
            x, _, per = line_features([text])
            rows.append((x.tobytes(), int(per[0]), int(label)))
        yield pd.DataFrame(rows, columns=["x", "n", "label"])


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> Chain:
    """Fit on at most `max_docs` labelled, not held out documents of each class, balanced.

    A document labelled both good and bad counts as good. Of rows that repeat a doc_id the least text is
    taken; texts of more than `max_lines` lines are scored like all others but not learnt from, so what
    comes to the driver is bounded: at most 2 * max_docs * max_lines lines of features.
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    picked = None
    for label in (0, 1):
        some = known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")  # at most 2 * max_docs ids
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    texts = texts.filter(F.coalesce(lines, F.lit(1)) <= max_lines).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = texts.select("text", "label").mapInPandas(_features, "x binary, n int, label int").collect()
    if not rows:
        return Chain(np.zeros(N_FEATURES), np.zeros((2, 2)))
    rows.sort(key=lambda r: (r["label"], r["n"], bytes(r["x"])))  # the same sums in any order of tasks
    x = np.concatenate([np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, N_FEATURES) for r in rows])
    return fit_chain(x.astype(np.float64), np.array([r["n"] for r in rows]), np.array([r["label"] for r in rows]))


def score_column(model: Chain, text: str | Column = "text") -> Column:
    """Quality of a text, 0 to 1; null and empty texts get the score of one empty line."""

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        parts, held, size = [], [], 0
        for text in texts.tolist():
            if held and (len(held) >= CHUNK or size >= CHUNK_CHARS):
                parts.append(model.score(held))
                held, size = [], 0
            held.append(text)
            size += len(text or "")
        if held:
            parts.append(model.score(held))
        return pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return quality(text)


def score_documents(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; repeated rows and null ids stay rows."""
    model = fit(docs, labels, max_docs)
    rows = docs.select("doc_id", "text").withColumn("score", score_column(model))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Documents with a score of at least THRESHOLD, all columns as they are."""
    return docs.filter(score_column(fit(docs, labels, max_docs), docs["text"]) >= THRESHOLD)
