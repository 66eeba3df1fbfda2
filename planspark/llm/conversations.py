"""Conversations put back into turn order at the least cost.

Every row gets one letter for its role and its first fault, so a conversation is a signature. Signatures are sorted from
their ends, where equal endings meet: along the sorted run an automaton that shares suffixes is built, in which a node
is a distinct suffix, and cost-to-go and best next edit are worked out once per node and grammar state, for every
conversation that ends that way. Texts are shuffled only after the edits are known.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..sources.shared import settle
from .texts import small_batches

SPACES = " \t\n\x0b\x0c\r"
FOLDS = 20
INITIALS = "sua"                      # any other initial fits nowhere
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)  # grammar states: nothing yet, or the role that came last
KEPT = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
GIVEN = (USER, USER, ASSISTANT, USER)      # state after a turn whose role may be chosen
LEGAL = {(0, 1), (1, 2), (2, 1)}           # neighbouring roles su, ua, au
NAMES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, UNFINISHED = 2, 3, 2, 1
EDITS = "DIKR"                             # in ASCII order, the order among equal costs
EDIT_ROWS = 20_000
BLOCK = 65_536


class Repair(NamedTuple):
    report: DataFrame
    turns: DataFrame


def fold(conv_id: Column, turn: Column) -> Column:
    """crc32 of ``conv_id:turn`` modulo 20; a null is one space."""
    parts = [F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv_id, turn)]
    return F.crc32(F.concat(parts[0], F.lit(":"), parts[1]).cast("binary")) % FOLDS


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` after planted faults, by ``fold``: 0 drops a row, 1 empties its text, 2 takes
    out ``. ! ?``, 3 repeats it, 4 makes its role ``user``. A null role or text is one space."""
    found = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), fold(F.col("conv_id"), F.col("turn")).alias("fold"))
    return found.filter("fold <> 0").select(
        "conv_id", "turn", F.when(F.col("fold") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fold") == 1, "").when(F.col("fold") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fold") == 3, 2).otherwise(1).alias("copies"))


def undamaged(rows: DataFrame) -> DataFrame:
    """The rows as they are, in the shape of ``damaged``."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.lit(1).alias("copies"))


def _key() -> Column:
    """Rows that are equal in all they have share a key; as a struct, nulls equal each other."""
    return F.struct("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("m"))


def signed_rows(rows: DataFrame) -> DataFrame:
    """One stored row per row, without its text: ``key, letter, at``, where ``at`` rises with conversation and turn.

    Rows of one turn follow by role and digest of the text. Equal rows are counted before they are shuffled, and the
    sorted rows are cut into ranges anywhere, so neither a long conversation nor a repeated row makes a large task.
    """
    seen = F.btrim("text", F.lit(SPACES))
    fault = F.when(seen == "", BLANK).when(F.right(seen, F.lit(1)).isin(".", "!", "?"), OK).otherwise(TRUNCATED)
    entries = rows.select(_key().alias("key"), fault.alias("fault"), "copies").groupBy("key", "fault").agg(F.sum("copies").alias("n"))
    text = F.struct("key.conv_id", "key.role", "key.m")
    entries = settle(entries.withColumn("text", text))
    first = entries.groupBy("text").agg(F.min(F.struct("key.turn")).alias("first"))
    entries = entries.join(first, "text").withColumn("again", ~F.col("first.turn").eqNullSafe(F.col("key.turn")))
    initial = F.left("key.role", F.lit(1))
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    # Copies come in blocks, so that a row repeated without bound is no large array.
    blocks = entries.select("key", role.alias("role"), "fault", "again", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {BLOCK}L)")).alias("block"))
    every = blocks.select("key", "role", "fault", "again", F.explode(F.expr(f"sequence(block * {BLOCK} + 1, least(n, (block + 1) * {BLOCK}))")).alias("copy"))
    kind = F.when(F.col("fault") == BLANK, BLANK).when(F.col("again") | (F.col("copy") > 1), DUPLICATE).otherwise(F.col("fault"))
    lettered = every.select("key", "copy", F.char(F.lit(65) + 4 * F.col("role") + kind).alias("letter"))
    order = ["key.conv_id", "key.turn", "key.role", "key.m", "copy"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(lettered.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                  .select("key", "letter", F.monotonically_increasing_id().alias("at")))


def signatures(signed: DataFrame) -> DataFrame:
    """Per conversation ``conv_id, signature, spans`` (the runs of ``at`` it consists of) and ``turns`` (least, largest, distinct)."""
    runs = signed.groupBy("key.conv_id", F.shiftright("at", 33).alias("part")).agg(
        F.min("at").alias("first"), F.count("at").alias("n"), F.array_sort(F.collect_list(F.struct("at", "letter"))).alias("letters"))
    runs = runs.select("conv_id", F.struct("part", "first", "n", F.array_join("letters.letter", "").alias("letters")).alias("run"))
    whole = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    whole = whole.select("conv_id", F.array_join("runs.letters", "").alias("signature"),
                         F.transform("runs", lambda r: F.struct(r["first"].alias("first"), r["n"].alias("n"))).alias("spans"))
    turn = signed.select("key.conv_id", "key.turn").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy(F.col("conv_id").alias("conv")).agg(
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("number"))
    return whole.join(turn, whole["conv_id"].eqNullSafe(turn["conv"])).drop("conv")


class Automaton:
    """The suffixes of one signature as a path of nodes; the next signature reuses the nodes of the ending they share.

    A node holds, per grammar state, the cost of the cheapest edits from there to the end, and the first of these edits; two bits a
    state, so a node takes one byte for its edits.
    """

    def __init__(self) -> None:
        self.path = ""
        self.costs = array("q", (0, 2 * INSERT, INSERT, 0))
        self.illegal = array("q", (0,))
        self.edits = bytearray((sum(EDITS.index("I") << 2 * s for s in (SYSTEM, USER)),))
        self.built = 0

    def follow(self, reverse: str) -> None:
        """Make the path the one of a signature, given from its end; only nodes that the last path had not are built."""
        shared = _common(self.path, reverse)
        del self.costs[4 * shared + 4:], self.illegal[shared + 1:], self.edits[shared + 1:]
        for k in range(shared, len(reverse)):
            role, fault = divmod(ord(reverse[k]) - 65, 4)
            self._push(role, fault)
            after = (ord(reverse[k - 1]) - 65) // 4 if k else None
            self.illegal.append(self.illegal[-1] + (after is not None and (role, after) not in LEGAL))
        self.path = reverse
        self.built += len(reverse) - shared

    def _push(self, role: int, fault: int) -> None:
        later = self.costs[-4:]
        late = UNFINISHED if fault == TRUNCATED else 0
        options = []
        for state in range(4):
            option = {"D": DELETE + later[state]}
            if fault in (OK, TRUNCATED):
                option["R"] = REROLE + late + later[GIVEN[state]]
                if KEPT[state][role] is not None:
                    option["K"] = late + later[KEPT[state][role]]
            options.append(option)
        least = [min(o.values()) for o in options]
        for _ in range(2):  # two inserted turns lead to every state
            least = [min(c, INSERT + least[GIVEN[s]]) for s, c in enumerate(least)]
        edits = 0
        for state, option in enumerate(options):
            option["I"] = INSERT + least[GIVEN[state]]
            edits |= next(i for i, e in enumerate(EDITS) if option.get(e) == least[state]) << 2 * state
        self.costs.extend(least)
        self.edits.append(edits)

    def audit(self) -> str:
        """Initials of the cheapest edits of the whole path, the least in ASCII order among equal costs."""
        state, node, found = START, len(self.path), bytearray()
        while node or state not in (START, ASSISTANT):
            edit = EDITS[self.edits[node] >> 2 * state & 3]
            found.append(ord(edit))
            if edit == "K":
                state = KEPT[state][(ord(self.path[node - 1]) - 65) // 4]
            elif edit != "D":
                state = GIVEN[state]
            node -= edit != "I"
        return found.decode()


def _common(a: str, b: str) -> int:
    """Length of the common start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


SOLVED = "signature string, illegal long, blank long, duplicate long, truncated long, cost long, audit string"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        rows = []
        for reverse in batch.column(0).to_pylist():
            automaton.follow(reverse)
            faults = [sum(reverse.count(chr(65 + 4 * r + f)) for r in range(4)) for f in (BLANK, DUPLICATE, TRUNCATED)]
            rows.append((reverse[::-1], automaton.illegal[-1], *faults, automaton.costs[-4], automaton.audit()))
        columns = list(zip(*rows)) or [()] * 7
        kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [p.split()[0] for p in SOLVED.split(", ")])


def solved(found: DataFrame) -> DataFrame:
    """Cheapest edits of every distinct ``signature``. Sorted from their ends, signatures that end alike follow each other."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = found.select(F.reverse("signature").alias("reverse")).distinct()
    return ends.repartitionByRange(parts, "reverse").sortWithinPartitions("reverse").mapInArrow(_solve, SOLVED)


def _edits(conv: T.DataType):
    """Turns that a conversation consists of after its edits: ``conv_id, line, at`` (null where inserted), ``given`` role."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                signature, audit, spans = (batch.column(c)[row].as_py() for c in ("signature", "audit", "spans"))
                places = (s["first"] + i for s in spans for i in range(s["n"]))
                state, node, line, rows = START, 0, 0, []
                for edit in audit:
                    at = next(places) if edit != "I" else None
                    if edit == "K":
                        state = KEPT[state][(ord(signature[node]) - 65) // 4]
                    elif edit != "D":
                        state = GIVEN[state]
                    if edit != "D":
                        rows.append((line, at, None if edit == "K" else NAMES[state], edit))
                        line += 1
                    node += edit != "I"
                    if len(rows) == EDIT_ROWS:
                        yield _batch(batch, row, rows)
                        rows = []
                if rows:
                    yield _batch(batch, row, rows)
    return run, T.StructType([T.StructField("conv_id", conv), T.StructField("line", T.LongType()), T.StructField("at", T.LongType()),
                              T.StructField("given", T.StringType()), T.StructField("edit", T.StringType())])


def _batch(batch: pa.RecordBatch, row: int, rows: list[tuple]) -> pa.RecordBatch:
    conv = batch.column("conv_id").take(pa.array(np.full(len(rows), row)))
    line, at, given, edit = zip(*rows)
    return pa.RecordBatch.from_arrays([conv, pa.array(line, pa.int64()), pa.array(at, pa.int64()), pa.array(given, pa.string()),
                                       pa.array(edit, pa.string())], ["conv_id", "line", "at", "given", "edit"])


def repair(conversations: DataFrame, rows: DataFrame) -> Repair:
    """Cheapest edits that bring every conversation to the roles ``(s?(ua)+)?``.

    ``conversations`` names the ids to report on; ``rows`` (``conv_id, turn, role, text, copies``, from ``damaged`` or
    ``undamaged``) are the turns. ``report``: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``, one row per id. ``turns``:
    ``conv_id, line`` (from 0), ``role, text, edit`` (K, R or I) of the repaired conversations.

    Rows come by turn, nulls first; rows of one turn by role and text digest, repeated rows next to each other. A row's
    first fault counts: blank, duplicate (same role and text earlier), truncated (no ``. ! ?`` at the end). Rows of
    a null id are one conversation. Roles are known by their first letter; any other, and an empty role, must be replaced or
    deleted. A conversation without rows costs nothing. Gaps that don't fit a long are null. An empty table gives no rows.
    """
    spark = conversations.sparkSession
    signed = signed_rows(rows)
    found = settle(signatures(signed))
    with small_batches(spark, 1_000):
        edits = settle(solved(found))
        best = settle(found.join(edits, "signature"))
        run, shape = _edits(best.schema["conv_id"].dataType)
        lines = settle(best.select("conv_id", "signature", "audit", "spans").mapInArrow(run, shape))
    wide = (F.col("high").cast("decimal(20)") - F.col("low").cast("decimal(20)") + 1 - F.col("number")).try_cast("long")
    gaps = F.when(F.col("number") > 0, wide).otherwise(F.when(F.col("number") == 0, 0))
    best = best.select(F.col("conv_id").alias("id"), F.struct(gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit").alias("r"))
    ids = conversations.select("conv_id").distinct()
    counted = ids.join(best, ids["conv_id"].eqNullSafe(best["id"]), "left")
    zero = F.lit(0).cast("long")
    report = counted.select(
        "conv_id", F.when(F.col("r").isNull(), zero).otherwise(F.col("r.gaps")).alias("gaps"),
        *[F.coalesce(f"r.{c}", zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("r.audit", F.lit("")).alias("audit"))
    old = lines.filter("at IS NOT NULL").join(signed.select("at", "key"), "at").select(F.col("conv_id").alias("id"), "line", "given", "edit", "key")
    # Rows with equal keys are equal, so any one of them has the text of the turn that stays.
    texts = rows.select(_key().alias("key"), "text").join(old, "key")
    texts = texts.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("key"))).filter("copy = 1")
    kept = texts.select(F.col("id").alias("conv_id"), "line", F.coalesce("given", "key.role").alias("role"), "text", "edit")
    new = lines.filter("at IS NULL").select("conv_id", "line", F.col("given").alias("role"), F.lit("").alias("text"), "edit")
    return Repair(report, kept.unionByName(new))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nobody = object()
    open_id, digest, kind = nobody, None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([open_id], kind), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    for batch in batches:
        kind = batch.column("conv_id").type
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if open_id is nobody or conv != open_id:
                if digest:
                    yield done()
                open_id, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
    if digest:
        yield done()


def turn_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: digest of the newline-joined ``role:text`` of every conversation's turns in order.

    Sorted turns stream through, so a conversation of any length takes no more memory; its digest is one sequence by
    definition and so is made by one task.
    """
    with small_batches(turns.sparkSession, 500):
        sorted_turns = turns.select("conv_id", "line", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "line")
        shape = T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
        return settle(sorted_turns.mapInArrow(_digests, shape))
