"""Conversation repair: cheapest edits that give every conversation legal turns.

Roles must read ``(system? (user assistant)+)?`` by their initials. Keeping a row is
free, giving it another role costs 2, deleting it 3, inserting an empty turn 2, and a
truncated row that stays costs 1 more. Blank rows and rows seen before must go.

The cheapest edits are a shortest path through four states (nothing yet, system, user,
assistant), a Viterbi recursion from the last row to the first. It runs in parallel by
rank convergence: a conversation is cut into chunks, every chunk starts from a
speculative vector of costs behind it, and fix-up passes rerun the chunks whose vector
turns out wrong, until vectors differ by constants only - then all comparisons inside
the chunk, and so its edits, are right. The constants are added up afterwards. Runs of
one role keep their parity and never converge; conversations still open after
``passes`` passes are settled exactly by products of the chunks' min-plus matrices, in
a number of steps that grows with the logarithm of the chunks.

Equal rows of a turn are counted, not repeated. Only digests and flags of texts are
sorted; texts meet their edits at the end, once each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import field, group_key, map_batches, numbered, temporary, written

CHUNK = 4096
PASSES = 4

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn that goes on legally without a system row.
NEXT = (USER, USER, ASSISTANT, USER)
#: Initials as codes: s, u, a, any other; +4 if truncated, +8 if the row must go.
OTHER, TRUNCATED, MUST_GO = 3, 4, 8
#: The state after a kept row of an initial, by state; None where it is not legal.
KEEP = {
    0: (SYSTEM, None, None, None),
    1: (USER, USER, None, USER),
    2: (None, None, ASSISTANT, None),
    OTHER: (None, None, None, None),
}
RELABEL, DELETE, INSERT = 2, 3, 2
FAR = 1 << 40

#: A text without any other character than these is blank.
BLANK = "\\x20\\x09-\\x0D"

Vector = tuple[int, ...]


def with_inserts(costs: Vector) -> Vector:
    """Costs from each state when turns may also be inserted first."""
    user = min(costs[USER], INSERT + costs[ASSISTANT])
    assistant = min(costs[ASSISTANT], INSERT + costs[USER])
    return (min(costs[NOTHING], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant)


#: Costs behind the last row.
END = with_inserts((0, FAR, FAR, 0))


def before_row(code: int, behind: Vector) -> Vector:
    """Costs from each state before a row, given those behind it."""
    out = []
    keep, stay = KEEP[code & 3], 1 if code & TRUNCATED else 0
    for state in range(4):
        best = DELETE + behind[state]
        if not code & MUST_GO:
            best = min(best, RELABEL + stay + behind[NEXT[state]])
            if keep[state] is not None:
                best = min(best, stay + behind[keep[state]])
        out.append(best)
    return with_inserts(tuple(out))


class Chunks:
    """Recursions over a chunk's codes, remembering steps between vectors up to a
    constant, which are few."""

    def __init__(self):
        self.known: dict[tuple[int, Vector], tuple[Vector, int]] = {}

    def step(self, code: int, behind: Vector) -> tuple[Vector, int]:
        found = self.known.get((code, behind))
        if found is None:
            raw = before_row(code, behind)
            found = self.known[code, behind] = tuple(x - raw[0] for x in raw), raw[0]
        return found

    def start(self, codes: bytes, end: Vector) -> Vector:
        """Costs at the chunk's start, given those at its end."""
        total, at = end[0], tuple(x - end[0] for x in end)
        for code in reversed(codes):
            at, more = self.step(code, at)
            total += more
        return tuple(x + total for x in at)

    def trace(self, codes: bytes, copies: list[int], end: Vector, state: int, last: bool) -> tuple[str, list[str], int]:
        """The ASCII-least cheapest edits from ``state`` on: letters, one entry per row
        (initials of inserted turns, then K, the new initial, or D), and the state
        reached. The last chunk has one more entry, for turns inserted behind."""
        behind = [tuple(x - end[0] for x in end)]
        for code in reversed(codes):
            behind.append(self.step(code, behind[-1])[0])
        behind.reverse()
        letters, acts = [], []
        for i, code in enumerate(codes):
            ahead, inserted = behind[i + 1], ""
            shift = self.step(code, ahead)[1]
            keep, stay = KEEP[code & 3], 1 if code & TRUNCATED else 0
            while True:
                left = behind[i][state] + shift
                if DELETE + ahead[state] == left:
                    act = "D"
                elif INSERT + behind[i][NEXT[state]] + shift == left:
                    state = NEXT[state]
                    inserted += "ua"[state - USER]
                    letters.append("I")
                    continue
                elif keep[state] is not None and stay + ahead[keep[state]] == left:
                    act, state = "K", keep[state]
                else:
                    state = NEXT[state]
                    act = "ua"[state - USER]
                break
            letters.append("R" if act in "ua" else act)
            letters.append("D" * copies[i])
            acts.append(inserted + act)
        if last:
            inserted = ""
            while state in (SYSTEM, USER):
                state = NEXT[state]
                inserted += "ua"[state - USER]
                letters.append("I")
            acts.append(inserted + ".")
        return "".join(letters), acts, state


def _rows(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """c, t (text keys of conversation and turn), turn, role, text, h; a null role or
    text is one blank."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    return df.select(
        group_key(F.col(conversation)).alias("c"), group_key(F.col(turn)).alias("t"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), body.alias("text"), F.unhex(F.sha2(body, 256)).alias("h"),
    )


def _coded(rows: DataFrame) -> DataFrame:
    """Distinct rows, without texts: c, t, turn, role, h, n (copies), blank, again (seen
    in an earlier turn), truncated."""
    blank = ~F.col("text").rlike(f"[^{BLANK}]")
    cut = ~F.col("text").rlike(f"[.!?][{BLANK}]*\\z")
    light = rows.select("c", "t", "turn", "role", "h", blank.cast("int").alias("blank"), cut.cast("int").alias("cut"))
    light = written(light.groupBy("c", "t", "turn", "role", "h").agg(
        F.count("*").alias("n"), F.max("blank").alias("blank"), F.max("cut").alias("cut")
    ), "rows")
    seen = light.groupBy("c", "role", "h").agg(
        F.count("*").alias("turns"), F.max(F.col("turn").isNull().cast("int")).alias("unnumbered"), F.min("turn").alias("first")
    )
    seen = seen.where("turns > 1").drop("turns")
    again = F.when(F.col("unnumbered") == 1, F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
    return light.join(seen, ["c", "role", "h"], "left").select(
        "c", "t", "turn", "role", "h", "n", (F.col("blank") == 1).alias("blank"),
        F.coalesce(again, F.lit(False)).alias("again"), (F.col("cut") == 1).alias("truncated"),
    )


def _chunks(places: DataFrame, size: int) -> DataFrame:
    """One row per chunk: c, chunk, last, codes (one byte a row), copies beyond the
    first, illegal neighbours inside, first and last initial."""
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    code = code + F.when(F.col("blank") | F.col("again"), MUST_GO).when(F.col("truncated"), TRUNCATED).otherwise(0)
    rows = places.select(
        "c", F.floor(F.col("pos") / size).alias("chunk"), (F.floor(F.col("pos") / size) == F.floor((F.col("size") - 1) / size)).alias("last"),
        F.struct("pos", code.alias("code"), (F.col("n") - 1).alias("more")).alias("r"),
    )
    packed = rows.groupBy("c", "chunk", "last").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return packed.select("c", "chunk", "last", F.col("r.code").alias("codes"), F.col("r.more").alias("copies"))


def _codes(column: pa.Array) -> list[bytes]:
    return [bytes(x) for x in column.to_pylist()]


def _run(df: DataFrame, fn, added: str) -> DataFrame:
    """c, chunk and what ``fn`` makes of the other columns of a row, as ``added``."""
    schema = df.select("c", "chunk").schema
    for f in df.sparkSession.createDataFrame([], added).schema.fields:
        schema = schema.add(f)
    kinds = {"boolean": pa.bool_(), "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    arrow = [kinds[f.dataType.simpleString()] for f in schema.fields[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Chunks()
        for batch in batches:
            out = [fn(tool, *row) for row in zip(*[batch.column(i).to_pylist() for i in range(2, batch.num_columns)], strict=True)]
            columns = list(zip(*out, strict=True)) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(list(c), k) for c, k in zip(columns, arrow, strict=True)]], names=schema.names
            )

    return map_batches(df, run, schema)


def _times(a: list[int], b: list[int]) -> list[int]:
    """Min-plus product of 4 x 4 matrices, row by row."""
    x, y = np.array(a).reshape(4, 4), np.array(b).reshape(4, 4)
    return np.minimum((x[:, :, None] + y[None, :, :]).min(axis=1), FAR).ravel().tolist()


def _products(matrices: DataFrame, forward: bool) -> DataFrame:
    """Per chunk the product of its matrix with those of all later chunks (or of all
    earlier ones, ``forward``): each step doubles how far it reaches."""
    longest = matrices.agg(F.max("chunk")).first()[0] or 0
    reach, table = 1, written(matrices, "products")
    while reach <= longest:
        other = table.select("c", (F.col("chunk") + (reach if forward else -reach)).alias("chunk"), F.col("m").alias("far"))
        both = table.join(other, ["c", "chunk"], "left").select("c", "chunk", "m", "far")

        def joined(_, m, far):
            return ((m if far is None else _times(far, m) if forward else _times(m, far)),)

        table, reach = written(_run(both, joined, "m array<bigint>"), "products"), 2 * reach
    return table


def _backward(chunks: DataFrame, passes: int) -> DataFrame:
    """c, chunk, end (costs behind the chunk, up to a constant), start."""

    def first(tool, codes, copies, last):
        return list(END), list(tool.start(bytes(codes), END))

    def again(tool, codes, copies, last, end):
        return end, list(tool.start(bytes(codes), tuple(end)))

    work = chunks.select("c", "chunk", "codes", "copies", "last")
    settled = written(_run(work, first, "end array<bigint>, start array<bigint>"), "costs")
    level = lambda v: F.transform(v, lambda x: x - v[0])
    for turn in range(passes + 1):
        behind = settled.where("chunk > 0").select("c", (F.col("chunk") - 1).alias("chunk"), level(F.col("start")).alias("true"))
        wrong = settled.join(behind, ["c", "chunk"]).where(F.col("end") != F.col("true")).select("c", "chunk", F.col("true").alias("end"))
        wrong = written(wrong, "wrong")
        if wrong.isEmpty():
            return settled
        if turn == passes:
            break
        rerun = _run(work.join(wrong, ["c", "chunk"]).select(*work.columns, "end"), again, "end array<bigint>, start array<bigint>")
        settled = written(settled.join(wrong, ["c", "chunk"], "left_anti").unionByName(rerun), "costs")

    # vectors that keep a difference for ever: exact products over the open conversations
    def matrix(tool, codes, copies, last):
        unit = [[0 if i == j else FAR for j in range(4)] for i in range(4)]
        rows = [tool.start(bytes(codes), tuple(u[j] for u in unit)) for j in range(4)]
        return ([min(rows[j][i], FAR) for i in range(4) for j in range(4)],)

    open_ = written(wrong.select("c").distinct(), "open")
    reached = _products(_run(work.join(open_, "c"), matrix, "m array<bigint>"), forward=False)
    behind = _run(
        reached.where("chunk > 0").select("c", (F.col("chunk") - 1).alias("chunk"), "m"),
        lambda _, m: ([int(v) for v in (np.array(m).reshape(4, 4) + np.array(END)).min(axis=1)],),
        "far array<bigint>",
    )
    behind = behind.select("c", "chunk", level(F.col("far")).alias("end"))
    ends = work.join(open_, "c").join(behind, ["c", "chunk"], "left")
    ends = ends.select(*work.columns, F.coalesce("end", F.array(*[F.lit(x).cast("long") for x in END])).alias("end"))
    exact = _run(ends, again, "end array<bigint>, start array<bigint>")
    return written(settled.join(open_, "c", "left_anti").unionByName(exact), "costs")


def _forward(chunks: DataFrame, costs: DataFrame) -> DataFrame:
    """c, chunk, letters, acts: the edits of every chunk, from the state that the chunks
    before it lead to."""
    work = chunks.join(costs, ["c", "chunk"]).select("c", "chunk", "codes", "copies", "last", "end")

    def reached(tool, codes, copies, last, end):
        states = [tool.trace(bytes(codes), copies, tuple(end), s, False)[2] for s in range(4)]
        return ([0 if states[i] == j else FAR for i in range(4) for j in range(4)],)

    def edits(tool, codes, copies, last, end, state):
        return tool.trace(bytes(codes), copies, tuple(end), state, last)[:2]

    long = chunks.where("chunk > 0").select("c").distinct()
    moves = _products(_run(work.join(long, "c"), reached, "m array<bigint>"), forward=True)
    # the state before a chunk: where the first row of the product before it is free
    state = F.array_position(F.transform(F.slice("m", 1, 4), lambda x: (x == 0).cast("int")), 1) - 1
    before = moves.select("c", (F.col("chunk") + 1).alias("chunk"), state.cast("int").alias("state"))
    work = work.join(before, ["c", "chunk"], "left").withColumn("state", F.coalesce("state", F.lit(NOTHING)))
    return _run(work, edits, "letters string, acts array<string>")


def repair(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    chunk: int = CHUNK, passes: int = PASSES,
) -> tuple[DataFrame, DataFrame]:
    """The repaired turns and an account per conversation.

    Turns: conversation, place (of the row, among those given), step (of turns inserted
    before it, the row itself last), turn (null if inserted), role, text, action (K, R
    or I). Account: conversation, c, gaps (turn numbers missing between the least and
    the largest), blank, duplicate, truncated (rows whose first fault that is), illegal
    (neighbours that may not follow each other), cost and audit (the letters of the
    cheapest edits in order, D I K R, of several the ASCII-least).

    Rows go by turn, nulls first, then role, then the digest of the text; a null role or
    text is one blank. A null conversation is one, too. A conversation without rows has
    no account. An empty table gives two empty ones; names of other columns play no
    part."""
    rows = _rows(df, conversation, turn, role, text)
    kind = df.select(conversation).schema[0].dataType
    name = F.when(F.col("c") != "", F.substring("c", 2, 1 << 30)).cast(kind).alias(conversation)
    with temporary():
        places = _placed(_coded(rows))
        chunks = written(_chunks(places, chunk), "chunks")
        costs = _backward(chunks, passes)
        edits = written(_forward(chunks, costs), "edits")
        turns = written(_turns(rows, places, edits, chunk).select(name, "c", "place", "step", "turn", "role", "text", "action"), "turns", keep=True)
        account = written(_account(places, chunks, costs, edits).select(name, "c", *ACCOUNT), "account", keep=True)
    return turns, account


ACCOUNT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _placed(coded: DataFrame) -> DataFrame:
    """Places of distinct rows in their conversation, ``pos``, of ``size``."""
    return numbered(coded.withColumnRenamed("n", "copies"), "c", ["turn", "role", "h"]).withColumnRenamed("n", "size").withColumnRenamed("copies", "n")


def _turns(rows: DataFrame, places: DataFrame, edits: DataFrame, size: int) -> DataFrame:
    acts = edits.select("c", F.posexplode("acts").alias("i", "act"), (F.col("chunk") * size).alias("first"))
    acts = acts.select("c", (F.col("first") + F.col("i")).alias("pos"), "act").where("act not in ('D', '.')")
    own = F.substring("act", -1, 1)
    called = lambda x: F.when(x == "u", "user").when(x == "a", "assistant")
    # a row for each inserted turn and, last, for the row itself
    letters = F.filter(F.split(F.col("act"), ""), lambda x: x != "")
    steps = acts.select("c", "pos", F.posexplode(letters).alias("step", "letter"), F.size(letters).alias("letters"))
    inserted = steps.where("step < letters - 1").select(
        "c", F.col("pos").alias("place"), "step", F.lit(None).cast("long").alias("turn"), called(F.col("letter")).alias("role"),
        F.lit("").alias("text"), F.lit("I").alias("action"),
    )
    stays = acts.where(~own.isin("D", ".")).select("c", "pos", own.alias("letter"), (F.length("act") - 1).alias("step"))
    stays = places.select("c", "pos", "t", "turn", "role", "h").join(stays, ["c", "pos"])
    texts = rows.where(F.col("text").rlike(f"[^{BLANK}]")).groupBy("c", "t", "role", "h").agg(F.any_value("text").alias("text"))
    kept = stays.join(texts, ["c", "t", "role", "h"]).select(
        "c", F.col("pos").alias("place"), "step", "turn", F.coalesce(called(F.col("letter")), "role").alias("role"), "text",
        F.when(F.col("letter") == "K", "K").otherwise("R").alias("action"),
    )
    return kept.unionByName(inserted)


def _account(places: DataFrame, chunks: DataFrame, costs: DataFrame, edits: DataFrame) -> DataFrame:
    faults = places.groupBy("c", "t").agg(
        F.max("turn").alias("turn"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - F.when(F.col("again"), 0).otherwise(1))).alias("duplicate"),
        F.sum(F.when(~F.col("blank") & ~F.col("again") & F.col("truncated"), 1).otherwise(0)).alias("truncated"),
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    faults = faults.groupBy("c").agg(gaps, *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")])
    # neighbours inside a chunk, copies of a row among them, and across chunks
    code = lambda x: F.transform(x, lambda v: v.bitwiseAND(3))
    pairs = F.zip_with(F.slice("i", 1, F.size("i") - 1), F.slice("i", 2, F.size("i")), lambda a, b: (~_legal(a, b)).cast("long"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
    inside = chunks.select("c", "chunk", "copies", code(F.col("codes")).alias("i"))
    inside = inside.select(
        "c", "chunk", (total(F.col("copies")) + F.when(F.size("i") > 1, total(pairs)).otherwise(0)).alias("illegal"),
        F.element_at("i", 1).alias("head"), F.element_at("i", -1).alias("tail"),
    )
    order = Window.partitionBy("c").orderBy("chunk")  # one row per chunk
    inside = inside.withColumn("behind", F.lag("tail").over(order))
    across = F.when(F.col("behind").isNotNull() & ~_legal(F.col("behind"), F.col("head")), 1).otherwise(0)
    illegal = inside.select("c", "chunk", (F.col("illegal") + across).alias("illegal"))
    must = chunks.select("c", "chunk", (total(F.col("copies")) * DELETE).alias("repeats"))
    # every end is level (0 for the first state), so the starts add up to the cost
    cost = costs.select("c", "chunk", F.col("start")[0].alias("start"))
    per_chunk = illegal.join(must, ["c", "chunk"]).join(cost, ["c", "chunk"]).join(edits.select("c", "chunk", "letters"), ["c", "chunk"])
    whole = per_chunk.groupBy("c").agg(
        F.sum("illegal").alias("illegal"), F.sum(F.col("repeats") + F.col("start")).alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "letters"))), lambda x: x["letters"]), "").alias("audit"),
    )
    return faults.join(whole, "c")


def _legal(a: Column, b: Column) -> Column:
    """May a row of initial b (0 s, 1 u, 2 a) follow one of initial a?"""
    return ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))


def digests(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Per conversation the SHA-256 of its repaired turns, ``role:text`` joined by
    newlines. The digest is sequential by its definition: a task reads the turns of one
    conversation as a stream and holds one batch of them."""
    rows = turns.select("c", "place", "step", "role", "text").repartition("c").sortWithinPartitions("c", "place", "step")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for c, role, text in zip(*[batch.column(i).to_pylist() for i in (0, 3, 4)], strict=True):
                if c == last:
                    own.update(b"\n")
                else:
                    if own is not None:
                        done.append((last, own.hexdigest()))
                    last, own = c, hashlib.sha256()
                own.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], names=["c", "repaired_sha256"])
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([own.hexdigest()])], names=["c", "repaired_sha256"])

    return map_batches(rows, run, "c string, repaired_sha256 string")
