"""Variable-capacity best-fit packing of documents into training sequences.

A document holds its whitespace words and one end mark. Pieces of at most the largest capacity are
packed; a longer document is cut into full pieces and a rest, nothing is dropped. Runs of
consecutive documents are packed apart. In a run, pieces go from long to short: each to the
open bin with the least room that still takes it; when none does, a bin of the least-cost
permitted length is opened: the one for which cost per filled place is least, after filling
it ahead with the longest pieces left. Last, every bin is downsized to the least permitted
length that holds its contents. A sequence costs its length plus a fixed overhead.
"""

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


CAPACITIES = (256, 512, 1024, 2048, 4096)
OVERHEAD = 32
RUN_DOCS = 2048


def pieces(n: int, largest: int) -> list[tuple[int, int]]:
    """(first place, length) of the pieces of a document of n places."""
    return [(at, min(largest, n - at)) for at in range(0, n, largest)]


def pack_sizes(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> list[tuple[int, list[int]]]:
    """Bins (capacity, item numbers) of items no longer than the largest capacity; ties go to the earlier item."""
    caps = sorted(capacities)
    left = sorted((n, -i) for i, n in enumerate(sizes))  # the longest, earliest item is last
    rooms: list[tuple[int, int]] = []  # (room, bin) of open bins
    bins: list[list[int]] = []

    def ahead(cap: int, size: int) -> int:
        """Places filled if the bin took the longest pieces left, one after the other."""
        fill, end = size, len(left)
        while True:
            end = min(bisect_right(left, (cap - fill, 1)), end) - 1
            if end < 0:
                return fill
            fill += left[end][0]

    while left:
        size, item = left.pop()
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            cap = min((c for c in caps if c >= size), key=lambda c: ((c + overhead) / max(1, ahead(c, size)), c))
            room, b = cap, len(bins)
            bins.append([])
        bins[b].append(-item)
        if room > size:
            insort(rooms, (room - size, b))
    out = []
    for items in bins:
        used = sum(sizes[i] for i in items)
        out.append((next(c for c in caps if c >= used), items))
    return out


SEQUENCE = (
    "bin_id string, capacity int, used int, doc_ids array<long>, firsts array<long>, lengths array<long>, text string"
)


def _packer(capacities: tuple[int, ...], overhead: int, end_mark: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["pack_at", "pack_id"], kind="stable")
        cut, words_of = [], []
        for doc, (key, text) in enumerate(zip(group["pack_id"], group["pack_text"])):
            words = [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").split()]
            words_of.append([*words, end_mark])
            cut += [(doc, None if pd.isna(key) else int(key), at, n) for at, n in pieces(len(words) + 1, max(capacities))]
        rows = []
        for cap, items in pack_sizes([p[3] for p in cut], capacities, overhead):
            chosen = [cut[i] for i in items]
            text = " ".join(w for doc, _, at, n in chosen for w in words_of[doc][at : at + n])
            rows.append((
                f"{chosen[0][1]}:{chosen[0][2]}:{group['pack_at'].iloc[chosen[0][0]]}", cap, sum(p[3] for p in chosen), [p[1] for p in chosen],
                [p[2] for p in chosen], [p[3] for p in chosen], text,
            ))
        return pd.DataFrame(rows, columns=["bin_id", "capacity", "used", "doc_ids", "firsts", "lengths", "text"])

    return run


def stored_order(docs: DataFrame, run_docs: int = RUN_DOCS) -> tuple[list[Column], Column]:
    """Runs of consecutive rows of a table read from files, and each row's place."""
    place = F.col("_metadata.row_index")
    return [F.col("_metadata.file_path"), F.floor(place / run_docs)], place


def pack(
    docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, end_mark: str = "<end>",
    run: list[Column] | None = None, place: Column | None = None, runs: int = 200,
) -> DataFrame:
    """One row per sequence: bin_id, capacity, used, doc_ids, firsts, lengths (of the pieces, in order), text.

    `run` are the columns that make up one packed run and `place` the order in it
    (`stored_order` for tables on disk); by default `runs` hash groups of doc_id, to be
    chosen so that a group fits a task. Null and empty texts hold the end mark only. A null
    doc_id is packed like any other. Repeated rows are packed as often as they appear. An
    empty table gives no rows; other columns of `docs` are ignored.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    if run is None:
        run, place = [F.pmod(F.xxhash64("doc_id"), F.lit(runs))], F.coalesce(F.col("doc_id"), F.lit(-1))
    keys = [f"pack_run{i}" for i in range(len(run))]
    rows = docs.select(
        *[c.alias(k) for k, c in zip(keys, run)], place.cast("long").alias("pack_at"),
        F.col("doc_id").cast("long").alias("pack_id"), F.col("text").cast("string").alias("pack_text"),
    )
    return rows.groupBy(*keys).applyInPandas(_packer(tuple(capacities), overhead, end_mark), SEQUENCE)


def piece_rows(sequences: DataFrame) -> DataFrame:
    """One row per piece: bin_id, capacity, used, slot, doc_id, first, length."""
    each = F.posexplode(F.arrays_zip("doc_ids", "firsts", "lengths")).alias("slot", "p")
    rows = sequences.select("bin_id", "capacity", "used", each)
    return rows.select(
        "bin_id", "capacity", "used", "slot", F.col("p.doc_ids").alias("doc_id"),
        F.col("p.firsts").alias("first"), F.col("p.lengths").alias("length"),
    )
