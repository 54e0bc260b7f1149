"""Repair of conversation structure at the least cost, by dynamic programming and path ranking.

Rows are sorted by conversation and turn over range partitions and numbered, so that a
conversation of any length is a stretch of numbers. It is cut into blocks of BLOCK numbers, and a
block is held as a string of one letter a row (fault and role initial). Four states say what may come next: nothing
kept yet, after a system row, after a user row, after an assistant row.

Cost: a block is a 4 x 4 matrix of least costs between its two ends. Matrices of neighbouring blocks
are multiplied (minimum, plus) by doubling over the blocks of a conversation, which gives every block the least cost of all that
follows it; inside the block the costs of its nodes (row, state) follow backwards.

Path: an arc is optimal where its cost and the cost of its end make up the cost of its
node. Nodes are ranked by the least audit of 1, 2, 4, ... letters that starts there: a rank
of 2k letters is the pair of the rank of k letters and the rank at the end of the pointer
over k letters, and pointers are doubled. Of a node's optimal arcs the one with the least letter, then the
least rank of its end is taken; doubled pointers then give every step of the path at
once. From a state, each letter leads to one state only, so a path is fixed by its entry
into a block, and the maps from entry to exit state are put together by doubling as well.

Blocks are arrays in tasks; between blocks, everything is a join on conversation and block. The texts move
twice: to be sorted, and to be hashed in order by a stream over sorted rows that holds one row at a time.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from ..session import materialize
from .common import short_batches

BLOCK = 1024
CHUNK = 256
SPACE = r"\x20\x09-\x0D"
MOST = (1 << 63) - 1

ROLES = ("user", "assistant")
DELETE, WRITE, DIRT = 4, 3, 3  # costs of a deletion, of a new role or row, and of a truncated row that stays
FAR = 1 << 50
FORCED = np.array([2, 2, 3, 2])  # state after a row that is given the role that fits
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])  # by initial (s, u, a, other) and state
END = np.array([0, 2 * WRITE, WRITE, 0])  # cost of ending in a state: rows to be written
LETTERS = "DIKR"


# --- one block of rows

def _numbers(kinds: list[str]) -> np.ndarray:
    """A row per block, the letters as numbers, right-aligned; -1 before them."""
    out = np.full((len(kinds), max(map(len, kinds), default=0)), -1, np.int64)
    for row, x in zip(out, kinds):
        if x:
            row[-len(x):] = np.frombuffer(x.encode(), np.uint8) - 65
    return out


def _arcs(kind: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of deleting, keeping and giving a role to a row in each state, with `after` (blocks, states, ...) the costs behind it."""
    wide = (slice(None), slice(None)) + (None,) * (after.ndim - 2)
    fault, initial = kind >> 2, kind & 3
    dirt = np.where(fault == 3, DIRT, 0)[:, None][wide]
    stays = ((fault == 0) | (fault == 3))[:, None]
    to = KEPT[initial]
    kept = np.take_along_axis(after, np.maximum(to, 0)[wide], axis=1)
    keep = np.where(((to >= 0) & stays)[wide], kept + dirt, FAR)
    role = np.where(np.broadcast_to(stays, to.shape)[wide], after[:, FORCED] + WRITE + dirt, FAR)
    return after + DELETE, keep, role


def _before(kind: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs in front of a row from those behind it, rows that are written included."""
    cost = np.minimum.reduce(_arcs(kind, after))
    for _ in range(2):
        cost = np.minimum(cost, cost[:, FORCED] + WRITE)
    return np.minimum(np.where((kind < 0).reshape(-1, *[1] * (after.ndim - 1)), after, cost), FAR)


def block_matrix(kinds: list[str]) -> np.ndarray:
    """(blocks, state in front, state behind): the least costs."""
    out = np.empty((len(kinds), 4, 4), np.int64)
    for at in _chunks(kinds):
        rows = _numbers([kinds[i] for i in at])
        cost = np.repeat(np.where(np.eye(4, dtype=bool), 0, FAR)[None], len(at), axis=0)
        for i in reversed(range(rows.shape[1])):
            cost = _before(rows[:, i], cost)
        out[at] = cost
    return out


def _chunks(kinds: list[str]) -> Iterator[np.ndarray]:
    """Places of blocks of about the same length."""
    order = np.argsort([len(x) for x in kinds], kind="stable")
    for i in range(0, len(order), CHUNK):
        yield order[i : i + CHUNK]


class Paths:
    """The least optimal paths of some blocks, as doubled pointers over nodes (block, row, state)."""

    def __init__(self, kinds: list[str], ahead: np.ndarray):
        """`ahead`: per block the costs of all that follows, by the state behind it."""
        rows = _numbers(kinds)
        self.n, self.width = rows.shape
        self.sizes = np.array([len(x) for x in kinds], np.int64)
        cost = np.empty((self.n, self.width + 1, 4), np.int64)
        cost[:, -1] = ahead
        for i in reversed(range(self.width)):
            cost[:, i] = _before(rows[:, i], cost[:, i + 1])
        self.cost = cost
        shape = cost.shape
        node = np.arange(cost.size).reshape(shape)
        self.last = (np.arange(shape[1]) == self.width)[None, :, None].repeat(self.n, 0).repeat(4, 2).ravel()
        ends = np.repeat(node[..., None], 4, axis=3)  # by letter
        best = np.zeros((*shape, 4), bool)
        best[:, :, :, 1] = (cost == cost[:, :, FORCED] + WRITE) & (np.arange(shape[1]) < self.width)[None, :, None]
        ends[:, :, :, 1] = node[:, :, FORCED]
        for i in range(self.width):
            delete, keep, role = _arcs(rows[:, i], cost[:, i + 1])
            for letter, price, to in ((0, delete, np.arange(4)[None]), (2, keep, KEPT[rows[:, i] & 3]), (3, role, FORCED[None])):
                best[:, i, :, letter] = (price == cost[:, i]) & (rows[:, i] >= 0)[:, None]
                ends[:, i, :, letter] = np.take_along_axis(node[:, i + 1], np.broadcast_to(np.maximum(to, 0), (self.n, 4)), axis=1)
        best, ends = best.reshape(-1, 4), ends.reshape(-1, 4)
        some = best.any(axis=1) & ~self.last
        letter = np.where(some, best.argmax(axis=1), -1)
        rank = self._ranks(letter, np.where(some, ends[np.arange(len(ends)), np.maximum(letter, 0)], np.arange(len(ends))))
        price = np.where(best, np.arange(4) * (len(rank) + 1) + rank[ends], 4 * (len(rank) + 1))
        self.letter = np.where(some, price.argmin(axis=1), -1)
        self.jumps = [np.where(some, ends[np.arange(len(ends)), np.maximum(self.letter, 0)], np.arange(len(ends)))]
        self.length = some.astype(np.int64)
        while (self.jumps[-1][self.jumps[-1]] != self.jumps[-1]).any():
            jump = self.jumps[-1]
            self.length = self.length + self.length[jump]
            self.jumps.append(jump[jump])

    @staticmethod
    def _ranks(letter: np.ndarray, jump: np.ndarray) -> np.ndarray:
        """Nodes ranked by their least audits, of twice as many letters in each round; an end comes before all letters."""
        rank = letter + 1
        while True:
            _, rank = np.unique(rank * (len(rank) + 5) + rank[jump], return_inverse=True)
            if (jump[jump] == jump).all():
                return rank
            jump = jump[jump]

    def entries(self, state: np.ndarray) -> np.ndarray:
        return (np.arange(self.n) * (self.width + 1) + self.width - self.sizes) * 4 + state

    def exits(self) -> np.ndarray:
        """(blocks, entry state): the state behind the block."""
        return np.stack([self.jumps[-1][self.entries(np.full(self.n, s))] & 3 for s in range(4)], axis=1)

    def steps(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(block, row in the block, state, letter) of every step of the paths that enter with `state`."""
        start = self.entries(state)
        size = self.length[start]
        block = np.repeat(np.arange(self.n), size)
        t = np.arange(len(block)) - np.repeat(np.cumsum(size) - size, size)
        at = start[block]
        for k, jump in enumerate(self.jumps):
            at = np.where(t >> k & 1, jump[at], at)
        row = at // 4 % (self.width + 1) - (self.width - self.sizes[block])
        return block, row, at & 3, self.letter[at]


# --- column functions over blocks

LONGS = ArrayType(LongType())


@F.pandas_udf(LONGS)
def _matrix(kinds: pd.Series) -> pd.Series:
    return pd.Series(list(block_matrix(kinds.tolist()).reshape(-1, 16)))


@F.pandas_udf(LONGS)
def _product(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of two matrices, the second one the later; without a second one the first."""
    out = []
    for x, y in zip(a, b):
        x = np.asarray(x).reshape(4, 4)
        out.append((x if y is None else np.minimum((x[:, :, None] + np.asarray(y).reshape(1, 4, 4)).min(axis=1), FAR)).ravel())
    return pd.Series(out)


@F.pandas_udf(LONGS)
def _ahead(later: pd.Series) -> pd.Series:
    """Costs of all that follows, from the product of the later blocks (null: none)."""
    return pd.Series([END if m is None else (np.asarray(m).reshape(4, 4) + END).min(axis=1) for m in later])


@F.pandas_udf(LONGS)
def _exits(kinds: pd.Series, ahead: pd.Series) -> pd.Series:
    kinds, ahead = kinds.tolist(), np.stack(ahead.tolist())
    out = np.empty((len(kinds), 4), np.int64)
    for at in _chunks(kinds):
        out[at] = Paths([kinds[i] for i in at], ahead[at]).exits()
    return pd.Series(list(out))


EDIT = StructType().add("row", IntegerType()).add("place", IntegerType()).add("letter", StringType()).add("role", StringType())
STEPS = StructType().add("cost", LongType()).add("audit", StringType()).add("edits", ArrayType(EDIT)).add("illegal", LongType())


@F.pandas_udf(STEPS)
def _repaired(kinds: pd.Series, ahead: pd.Series, entry: pd.Series, last: pd.Series) -> pd.DataFrame:
    """Of each block: the cost from its entry on, its part of the audit, the rows that the repair has there, illegal pairs inside.

    An edit's `row` counts from the block's first; rows written in front of it have the places
    0 and 1, itself 2. Rows that a conversation needs at its end follow its last row.
    """
    kinds, entry, ahead = kinds.tolist(), entry.to_numpy(np.int64), np.stack(ahead.tolist())
    made: list = [None] * len(kinds)
    for at in _chunks(kinds):
        paths = Paths([kinds[i] for i in at], ahead[at])
        block, row, state, letter = paths.steps(entry[at])
        behind = paths.exits()[np.arange(len(at)), entry[at]]
        cost = paths.cost.reshape(-1)[paths.entries(entry[at])]
        cuts = np.searchsorted(block, np.arange(len(at) + 1))
        for j, i in enumerate(at.tolist()):
            edits, audit, before = [], [], 0
            part = slice(cuts[j], cuts[j + 1])
            for r, s, c in zip(row[part].tolist(), state[part].tolist(), letter[part].tolist()):
                audit.append(LETTERS[c])
                if c:
                    edits.append((r, before if c == 1 else 2, LETTERS[c], ROLES[FORCED[s] - 2]))
                before = before + 1 if c == 1 else 0
            s = int(behind[j])
            while last[i] and s in (1, 2):
                audit.append("I")
                edits.append((len(kinds[i]), before, "I", ROLES[FORCED[s] - 2]))
                before, s = before + 1, int(FORCED[s])
            initials = "".join("sua?"[(ord(x) - 65) & 3] for x in kinds[i])
            bad = sum(p not in ("su", "ua", "au") for p in map("".join, zip(initials, initials[1:])))
            made[i] = (int(cost[j]), "".join(audit), edits, bad)
    return pd.DataFrame(made, columns=["cost", "audit", "edits", "illegal"])


# --- tables

def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage; null roles and texts are one space, null ids and turns in the key too."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    made = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), harm.alias("harm"))
    text = F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return made.filter("harm <> 0").select(
        "conv_id", "turn", F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def _numbered(rows: DataFrame) -> DataFrame:
    """All rows with `place`, their number in the order of conv_id, turn (nulls first), role, text's sha256; written once."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "mark"]
    rows = rows.withColumn("mark", F.sha2("text", 256))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("seq", F.monotonically_increasing_id()))  # a retry can't number anew
    part = F.shiftright("seq", 33)
    upto, starts = 0, []
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row per partition
        starts.append((r["part"], upto))
        upto += r["n"]
    starts = rows.sparkSession.createDataFrame(starts, "part long, before long")
    placed = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    return placed.select("conv_id", "turn", "role", "text", "mark", (F.col("before") + F.col("seq").bitwiseAND((1 << 33) - 1)).alias("place"))


def _joined(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys of which null equals null; the other table's keys go."""
    other = other.withColumnsRenamed({k: f"other_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"other_{k}"))
    return rows.join(other, on, "left").drop(*[f"other_{k}" for k in keys])


def row_kinds(placed: DataFrame) -> DataFrame:
    """conv_id, place, kind: a letter from A on for 4 x (sound, blank, duplicate, truncated) + (s, u, a, other initial)."""
    first = placed.groupBy("conv_id", "role", "mark").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = _joined(placed, first, ["conv_id", "role", "mark"])
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    cut = ~F.col("text").rlike(f"[.!?][{SPACE}]*\\z")
    fault = F.when(blank, 1).when(F.coalesce(F.col("first") < F.col("place"), F.lit(False)), 2).when(cut, 3).otherwise(0)
    initial = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)) - 1
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    return rows.select("conv_id", "place", F.chr(65 + 4 * fault + initial).alias("kind"))


def blocks_of(kinds: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, n (from 0), start, kinds, last: the blocks of each conversation; written once."""
    cut = kinds.groupBy("conv_id", F.floor(F.col("place") / block).alias("b")).agg(
        F.min("place").alias("start"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "kind"))), lambda x: x["kind"]), "").alias("kinds")
    )
    cut = materialize(cut)
    ends = cut.groupBy("conv_id").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    return _joined(cut, ends, ["conv_id"]).select(
        "conv_id", (F.col("b") - F.col("lo")).alias("n"), "start", "kinds", (F.col("b") == F.col("hi")).alias("last"), (F.col("lo") == F.col("hi")).alias("alone")
    )


def _beside(rows: DataFrame, value: str, step: int, out: str) -> DataFrame:
    """`rows` with the value of the block `step` further on in the conversation (null: none)."""
    return _joined(rows, rows.select("conv_id", (F.col("n") - step).alias("n"), F.col(value).alias(out)), ["conv_id", "n"])


def _linked(many: DataFrame) -> DataFrame:
    """Blocks of conversations with several, with the costs ahead and the entry state, by doubling over blocks."""
    most = many.agg(F.max("n")).first()[0]
    rows = many.withColumn("matrix", _matrix("kinds"))
    step = 1
    while step <= (most or 0):
        rows = materialize(_beside(rows, "matrix", step, "later").withColumn("matrix", _product("matrix", "later")).drop("later"))
        step *= 2
    rows = _beside(rows, "matrix", 1, "later").withColumn("ahead", _ahead("later")).drop("later", "matrix")
    rows = materialize(rows.withColumn("exits", _exits("kinds", "ahead")))
    step = 1
    while step <= (most or 0):  # exits by the entry into the block 2 * step - 1 before
        rows = _beside(rows, "exits", -step, "earlier")
        through = F.transform("earlier", lambda s: F.element_at("exits", (s + 1).cast("int")))
        rows = materialize(rows.withColumn("exits", F.coalesce(through, "exits")).drop("earlier"))
        step *= 2
    rows = _beside(rows, "exits", -1, "earlier")
    rows = _beside(rows.withColumn("tail", F.expr("right(kinds, 1)")), "tail", -1, "tail_before")
    return rows.withColumn("entry", F.coalesce(F.col("earlier")[0], F.lit(0)).cast("long")).drop("earlier", "exits", "tail")


def repair_blocks(kinds: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, n, start, kinds and the fields of STEPS of every block; written once."""
    cut = blocks_of(kinds, block)
    many = materialize(cut.filter("not alone"))
    alone = cut.filter("alone").withColumn("ahead", F.array(*[F.lit(int(x)) for x in END]).cast("array<long>"))
    alone = alone.withColumn("tail_before", F.lit(None).cast("string")).withColumn("entry", F.lit(0).cast("long"))
    every = alone.unionByName(_linked(many)) if not many.isEmpty() else alone
    every = every.withColumn("made", _repaired("kinds", "ahead", "entry", "last"))
    # a pair over the border of two blocks
    initial = lambda c: (F.ascii(c) - 65).bitwiseAND(3)
    pair = initial(F.col("tail_before")) * 4 + initial(F.substring("kinds", 1, 1))
    odd = F.when(F.col("tail_before").isNull() | pair.isin(0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1), 0).otherwise(1)
    return materialize(every.select(
        "conv_id", "n", "start", "kinds", "made.cost", "made.audit", "made.edits", (F.col("made.illegal") + odd).alias("illegal")
    ))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each conversation's lines, from rows sorted by conversation, place and part (edits before texts)."""
    key, running, empty, edit = None, None, True, None

    def out(key: tuple, running) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], kind), pa.array([running.hexdigest()])], ["conv_id", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, place, at, letter, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "at", "letter", "role", "text"))):
            if key != (conv,):
                if key is not None:
                    yield out(key, running)
                key, running, empty, edit = (conv,), hashlib.sha256(), True, None
            if letter in ("K", "R"):
                edit = (place, letter, role)
                continue
            if letter is None:
                if edit is None or edit[0] != place:
                    continue  # deleted
                role, edit = (role if edit[1] == "K" else edit[2]), None
            running.update(("" if empty else "\n").encode() + f"{role}:{text or ''}".encode("utf-8", "surrogatepass"))
            empty = False
    if key is not None:
        yield out(key, running)


def repaired_rows(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """conv_id, place, at, letter, role, text: edits (K, R, I) and, after each place's own edit, its row with no letter."""
    edits = blocks.select("conv_id", "start", F.explode("edits").alias("e")).select(
        "conv_id", (F.col("start") + F.col("e.row")).alias("place"), F.col("e.place").alias("at"), "e.letter", "e.role", F.lit(None).cast("string").alias("text")
    )
    return edits.unionByName(placed.select("conv_id", "place", F.lit(3).alias("at"), F.lit(None).cast("string").alias("letter"), "role", "text"))


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The query's contract: a row per conv_id with gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Null roles and texts are one space; a null conv_id is a conversation of its own; rows of one turn are taken by role and
    the text's sha256. Repeated rows are duplicates. Gaps beyond 64 bits are set to the end of that range. Other columns are ignored. A conversation's audit is one value.
    """
    short_batches(conversations.sparkSession)
    placed = _numbered(damaged(conversations))
    blocks = repair_blocks(row_kinds(placed), block)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    turns = placed.groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.countDistinct("turn").alias("some"))
    gap = F.when(F.col("lo").isNotNull(), F.least(wide("hi") - wide("lo") + 1 - wide("some"), F.lit(MOST).cast("decimal(38,0)"))).cast("long")
    count = lambda a, b: F.sum(F.length(F.regexp_replace("kinds", f"[^{a}-{b}]", ""))).cast("long")
    sums = blocks.groupBy("conv_id").agg(
        count("E", "H").alias("blank"), count("I", "L").alias("duplicate"), count("M", "P").alias("truncated"), F.sum("illegal").alias("illegal"),
        F.max(F.when(F.col("n") == 0, F.col("cost"))).alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    lines = repaired_rows(placed, blocks).repartition("conv_id").sortWithinPartitions("conv_id", "place", "at")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    hashes = lines.mapInArrow(_hashes, f"conv_id {kind}, repaired_sha256 string")
    found = conversations.select("conv_id").distinct()
    for part in (turns, sums, hashes):
        found = _joined(found, part, ["conv_id"])
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.select(
        "conv_id", F.coalesce(gap, F.lit(0)).cast("long").alias("gaps"), *map(none, ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
