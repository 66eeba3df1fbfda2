"""Suffix-array dedup of long repeated passages, exactly, on the bytes of whole documents.

A byte goes if a 100-byte string that starts earlier covers it again. Every 100-byte window is owned by its anchor, the
leftmost 32-byte string with the least hash inside it, so equal windows have equal anchors, and the windows of one anchor
form one short context. Contexts whose anchor occurs once repeat nothing. Equal contexts need no look inside: all but the
first go. Different contexts can share a window only if they share 34 bytes on one side of their anchor, since a window
has 68 beside it. What is left is dealt to shards by anchor. A shard sorts its suffixes by
prefix doubling that only refines groups not yet sorted (Larsson and Sadakane), takes common prefixes by Kasai's scan, side
by side for all contexts, and finds windows that an earlier one equals. An anchor with too many contexts is
split over shards; the first windows of each then meet by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.shared import new_path, tidy
from .bits import BitSet, bit_set
from .texts import Rolling, byte_column, chunks, mixed, small_batches

LENGTH = 100
GRAM = 32
WINDOW = LENGTH - GRAM + 1
SIDE = (LENGTH - GRAM) // 2
SHARD_BYTES = 400_000
RUN_BYTES = 400_000
BATCH_ROWS = 1_000  # documents per Arrow batch while anchors are gathered
SPLIT_CONTEXTS = 10_000  # contexts of one anchor beyond which it is split, and about as many in a part
PARTS = 16  # at least
PACKED = 7  # symbols of 9 bits in a 64-bit integer


def _places(rolling: Rolling, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of all windows: first and last window start in the array, and where the anchor itself starts."""
    none = np.empty(0, np.int64)
    if offsets[-1] < LENGTH:
        return none, none, none
    # Order and place in one number: the least one is the leftmost of the grams with the least order.
    least = (rolling.unmixed(GRAM) >> np.uint64(33) << np.uint64(32)).view(np.int64)
    least |= np.arange(len(least))
    size = 1
    while 2 * size <= WINDOW:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = WINDOW - size
    least = np.minimum(least[:len(least) - rest], least[rest:]) if rest else least
    # A run of windows ends where its document has no more of them; the windows across two documents belong to none.
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    turns = np.zeros(len(least) + 1, bool)
    turns[1:-1] = least[1:] != least[:-1]
    turns[offsets[long]] = True
    turns[offsets[long + 1] - LENGTH + 1] = True
    first = np.flatnonzero(turns[:-1])
    last = np.append(first[1:], len(least)) - 1
    inside = np.searchsorted(offsets, first, "right") - 1
    whole = first + LENGTH <= offsets[inside + 1]
    first, last = first[whole], last[whole]
    return first, last, least[first] & np.int64(2**32 - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, wanted=None, needed=None) -> tuple[np.ndarray, ...]:
    """Anchors of all windows: document, anchor hash, context hash, first and last window start in the array, side hashes.

    The side hashes are those of the anchor with the ``SIDE`` bytes to its left and to its right, 0 where its windows
    do not have as many. Only anchors whose hash is ``wanted`` are returned, and of these only contexts that are ``needed``
    by document, context hash and first window start; no more is hashed than these tests ask for.
    """
    rolling = Rolling(data)
    first, last, place = _places(rolling, offsets)
    anchor = rolling.ranges(place, place + GRAM).view(np.int64)
    if wanted is not None:
        kept = wanted(anchor)
        first, last, place, anchor = first[kept], last[kept], place[kept], anchor[kept]
    owner = np.searchsorted(offsets, first, "right") - 1
    context = mixed(rolling.ranges(first, last + LENGTH) ^ mixed((place - first).astype(np.uint64))).view(np.int64)
    if needed is not None:
        kept = needed(owner, context, first)
        first, last, place, anchor, owner, context = first[kept], last[kept], place[kept], anchor[kept], owner[kept], context[kept]
    left, right = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint64)
    ok = place - first >= SIDE
    left[ok] = rolling.ranges(place[ok] - SIDE, place[ok] + GRAM)
    ok = last + LENGTH - place >= GRAM + SIDE
    right[ok] = mixed(rolling.ranges(place[ok], place[ok] + GRAM + SIDE))
    return owner, anchor, context, first, last, left.view(np.int64), right.view(np.int64)


def _document_keys(docs: DataFrame) -> DataFrame:
    """``d, h, text``: the order of documents is by id (null last), rows with the same id by a hash of their text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))


def _spot(ctx: np.ndarray, d: np.ndarray, low: np.ndarray) -> np.ndarray:
    return ctx ^ d ^ (low << 5)


def _count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=RUN_BYTES):
        data, offsets = byte_column(batch.column(0))
        rolling = Rolling(data)
        place = _places(rolling, offsets)[2]
        found, number = np.unique(rolling.ranges(place, place + GRAM).view(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(number)], ["anchor", "n"])


def _occurrences(repeated: BitSet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=RUN_BYTES):
            data, offsets = byte_column(batch.column(2))
            owner, anchor, context, first, last, left, right = anchors(data, offsets, repeated.has)
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(context), batch.column(0).take(rows), batch.column(1).take(rows),
                 pa.array(first - offsets[owner]), pa.array((last - first).astype(np.int32)), pa.array(left), pa.array(right)],
                ["anchor", "ctx", "d", "h", "low", "more", "lkey", "rkey"])
    return run


def _split_anchors(several: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Anchors with too many contexts, ascending, and the number of their parts; at most one row per ``SPLIT_CONTEXTS`` contexts."""
    parts = F.greatest(F.lit(PARTS), F.ceil(F.col("kinds") / SPLIT_CONTEXTS)).cast("long")
    found = several.filter(F.col("kinds") > SPLIT_CONTEXTS).select("anchor", parts.alias("parts")).toArrow()
    anchor, parts = (found.column(c).to_numpy() for c in ("anchor", "parts"))
    order = np.argsort(anchor)
    return anchor[order], parts[order]


def _parts(split: tuple[np.ndarray, np.ndarray], anchor: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The part of every context, from 1 on; 0 where its anchor is not split."""
    known, parts = split
    if not len(known):
        return np.zeros(len(anchor), np.int64)
    at = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
    return np.where(known[at] == anchor, 1 + (context.view(np.uint64) >> np.uint64(20)).astype(np.int64) % parts[at], 0)


def _met(sides: BitSet, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left != 0) & sides.has(left) | (right != 0) & sides.has(right)


def _first_spots(sides: BitSet):
    """Spots of the first contexts that may share a side with another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.array(batch.column(c), np.int64) for c in ("lkey", "rkey"))
            yield batch.select(["spot"]).filter(pa.array(_met(sides, left, right)))
    return run


def _contexts(repeated: BitSet, firsts: BitSet, sides: BitSet, split: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=RUN_BYTES):
            data, offsets = byte_column(batch.column(2))
            d = np.asarray(batch.column(0), np.int64)
            needed = lambda owner, context, first: firsts.has(_spot(context, d[owner], first - offsets[owner]))
            owner, anchor, context, first, last, left, right = anchors(data, offsets, repeated.has, needed)
            kept = _met(sides, left, right)
            owner, anchor, context, first, last = owner[kept], anchor[kept], context[kept], first[kept], last[kept]
            part = _parts(split, anchor, context)
            rows = pa.array(owner)
            blobs = [data[a:b + LENGTH].tobytes() for a, b in zip(first, last)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(part.astype(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first - offsets[owner]),
                 pa.array(blobs, pa.binary())], ["anchor", "part", "d", "h", "low", "bytes"])
    return run


def _packed(symbols: np.ndarray) -> np.ndarray:
    """The ``PACKED`` symbols (0 to 256) from every place on as one number, the first highest; what is beyond the end is less than any."""
    n = len(symbols)
    padded = np.concatenate((symbols.astype(np.int64) + 1, np.zeros(PACKED, np.int64)))
    key = np.zeros(n, np.int64)
    for i in range(PACKED):
        key = key << 9 | padded[i:i + n]
    return key


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """All suffixes of a symbol sequence (0 to 256) in order, by doubling within groups not yet sorted."""
    n = len(symbols)
    key = _packed(symbols)
    order = np.argsort(key)
    sorted_ = key[order]
    head = np.ones(n, bool)
    head[1:] = sorted_[1:] != sorted_[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    depth = PACKED
    single = head & np.append(head[1:], True)
    slots = np.flatnonzero(~single)
    while len(slots):
        places = order[slots]
        group = rank[places]
        pair = group * (n + 1) + rank[np.minimum(places + depth, n)] + 1
        turn = np.argsort(pair)
        order[slots] = places[turn]
        pair = pair[turn]
        fresh = np.ones(len(slots), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        rank[order[slots]] = slots[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        slots = slots[~(fresh & np.append(fresh[1:], True))]
        depth *= 2
    return order


def common_prefixes(symbols: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, enough: int | None = None) -> np.ndarray:
    """Length of the common prefix of every suffix with the one before it in order, by text position.

    Kasai's scan: one position further on, at most one symbol less is shared. All stretches ``starts`` to ``ends`` are
    scanned side by side, so each begins at nothing shared. A step compares ``PACKED`` symbols of every stretch, which then
    goes on in the same suffix or to the next, whatever the others do. Lengths of ``enough`` or more need not be exact.
    """
    n = len(symbols)
    before = np.full(n, n, np.int64)
    before[order[1:]] = order[:-1]
    key = np.append(_packed(symbols), 0)
    limits = np.int64(1) << 9 * np.arange(PACKED)
    out = np.zeros(n, np.int64)
    shared = np.zeros(len(starts), np.int64)
    enough = n if enough is None else enough
    live = starts < ends
    while live.any():
        if not live.all():
            starts, ends, shared = starts[live], ends[live], shared[live]
        other = before[starts]
        shared = np.minimum(shared, n - other)
        differ = key[starts + shared] ^ key[other + shared]
        shared = shared + PACKED - np.searchsorted(limits, differ, "right")
        out[starts] = shared
        done = (differ != 0) | (shared >= enough)
        shared = np.maximum(shared - done, 0)
        starts = starts + done
        live = starts < ends
    return out


def repeated_windows(blobs: list[bytes], d: np.ndarray, h: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of a shard's contexts: context, place in it, and whether an equal window comes earlier elsewhere."""
    sizes = np.array([len(b) for b in blobs])
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    symbols = np.zeros(int(ends[-1]) + 1, np.uint16)
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(blobs), np.uint8).astype(np.uint16) + 1
    order = suffix_array(symbols)
    shared = common_prefixes(symbols, order, starts, ends + 1, LENGTH)
    number = sizes - LENGTH + 1
    context = np.repeat(np.arange(len(blobs)), number)
    place = np.arange(len(context)) - np.repeat(np.cumsum(number) - number, number)
    at = starts[context] + place
    slot = np.empty(len(symbols), np.int64)
    slot[order] = np.arange(len(order))
    group = np.cumsum(shared[order] < LENGTH)[slot[at]]
    start = low[context] + place
    turn = np.lexsort((start, h[context], d[context], group))
    head = np.ones(len(turn), bool)
    head[1:] = group[turn[1:]] != group[turn[:-1]]
    first = turn[np.maximum.accumulate(np.where(head, np.arange(len(turn)), 0))]
    # Rows equal in id and text hold one and the same window: a second one of them does not come later.
    own, its = context[turn], context[first]
    later = np.zeros(len(turn), bool)
    later[turn] = (d[own] != d[its]) | (h[own] != h[its]) | (start[turn] != start[first])
    return context, place, later


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges to remove, and the first windows of split anchors (with a digest); rows come sorted by anchor and part."""
    def solve(rows: pa.Table):
        blobs = rows.column("bytes").to_pylist()
        d, h, low, anchor, part = (rows.column(c).to_numpy() for c in ("d", "h", "low", "anchor", "part"))
        context, place, later = repeated_windows(blobs, d, h, low)
        c, p = context[later], place[later]
        if len(c):
            new = np.ones(len(c), bool)
            new[1:] = (c[1:] != c[:-1]) | (p[1:] != p[:-1] + 1)
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(c)) - 1
            own = c[heads]
            yield _rows(d[own], h[own], low[own] + p[heads], low[own] + p[tails] + LENGTH, np.zeros(len(own), np.int64), np.zeros(len(own), np.int64))
        meets = ~later & (part[context] > 0)
        if meets.any():
            c, p = context[meets], place[meets]
            data = np.frombuffer(b"".join(blobs), np.uint8)
            at = (np.cumsum([len(b) for b in blobs]) - [len(b) for b in blobs])[c] + p
            digest = Rolling(data).ranges(at, at + LENGTH).view(np.int64)
            start = low[c] + p
            yield _rows(d[c], h[c], start, start + LENGTH, anchor[c], digest)

    def _rows(*columns):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in columns], ["d", "h", "start", "end", "anchor", "digest"])

    held, size = [], 0
    for batch in chunks(batches, "bytes", SHARD_BYTES // 4):
        held.append(batch)
        size += len(byte_column(batch.column(5))[0])
        if size >= SHARD_BYTES:
            rows = pa.Table.from_batches(held)
            anchor, part = rows.column("anchor").to_numpy(), rows.column("part").to_numpy()
            whole = len(rows) - int(np.argmax(((anchor != anchor[-1]) | (part != part[-1]))[::-1])) if (anchor[0] != anchor[-1] or part[0] != part[-1]) else 0
            if whole:
                yield from solve(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
                size = sum(len(byte_column(b.column(5))[0]) for b in held)
    if held and sum(b.num_rows for b in held):
        yield from solve(pa.Table.from_batches(held))


@tidy
def repeated_ranges(docs: DataFrame) -> DataFrame:
    """Byte ranges that go, stored by document: ``d, h, ranges``; they may overlap. Documents are keyed as in ``_document_keys``.

    All jobs run here, with Arrow batches of few documents so that a task holds little text at a time.
    """
    with small_batches(docs.sparkSession, BATCH_ROWS):
        return _repeated_ranges(docs)


def _repeated_ranges(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    keyed = _document_keys(docs)
    counted = keyed.select("text").mapInArrow(_count_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    repeated = bit_set(counted.filter("n > 1"), F.col("anchor"))

    path = new_path(spark, "anchors")
    keyed.mapInArrow(_occurrences(repeated), "anchor long, ctx long, d long, h long, low long, more int, lkey long, rkey long").write.parquet(path)
    found = spark.read.parquet(path)
    spot = F.struct("d", "h", "low")
    path = new_path(spark, "contexts")
    (found.groupBy("anchor", "ctx").agg(F.min(spot).alias("first"), F.count(F.lit(1)).alias("n"), F.min("lkey").alias("lkey"), F.min("rkey").alias("rkey"))
     .write.parquet(path))
    classes = spark.read.parquet(path)
    copies = found.join(classes.filter("n > 1").select("anchor", "ctx", "first"), ["anchor", "ctx"]).filter(F.col("first") != spot).select(
        "d", "h", F.col("low").alias("start"), (F.col("low") + F.col("more") + LENGTH).alias("end"))

    # A side holds its anchor, so contexts that share a side are several of one anchor.
    shared = classes.select(F.explode(F.array("lkey", "rkey")).alias("key")).filter("key <> 0").groupBy("key").count().filter("count > 1")
    sides = bit_set(shared, F.col("key"))
    spots = F.col("ctx").bitwiseXOR(F.col("first.d")).bitwiseXOR(F.shiftleft("first.low", 5))
    firsts = classes.select(spots.alias("spot"), "lkey", "rkey").mapInArrow(_first_spots(sides), "spot long")
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    wanted = _contexts(repeated, bit_set(firsts, F.col("spot")), sides, _split_anchors(several))
    contexts = keyed.mapInArrow(wanted, "anchor long, part int, d long, h long, low long, bytes binary")
    dealt = contexts.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    path = new_path(spark, "windows")
    dealt.mapInArrow(_shards, "d long, h long, start long, end long, anchor long, digest long").write.parquet(path)
    solved = spark.read.parquet(path)
    split = solved.filter("anchor <> 0 OR digest <> 0")
    one = F.struct("d", "h", "start")
    best = split.groupBy("anchor", "digest").agg(F.min(one).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    across = split.join(best, ["anchor", "digest"]).filter(F.col("first") != one)
    path = new_path(spark, "ranges")
    (copies.unionByName(solved.filter("anchor = 0 AND digest = 0").select("d", "h", "start", "end"))
     .unionByName(across.select("d", "h", "start", "end"))
     .groupBy("d", "h").agg(F.collect_list(F.struct("start", "end")).alias("ranges")).write.parquet(path))
    return spark.read.parquet(path)


def _kept(text: bytes, ranges) -> tuple[bytes, int, int]:
    """What is left, the bytes removed and the number of removed runs."""
    parts, at, removed, spans = [], 0, 0, 0
    end = -1
    for a, b in sorted((r["start"], r["end"]) for r in ranges or ()):
        if a > end:
            if end >= 0:
                removed, spans = removed + end - begin, spans + 1
                parts.append(text[at:begin])
                at = end
            begin, end = a, b
        else:
            end = max(end, b)
    if end >= 0:
        removed, spans = removed + end - begin, spans + 1
        parts.append(text[at:begin])
        at = end
    parts.append(text[at:])
    return b"".join(parts), removed, spans


def _stripped(docs: DataFrame, found: DataFrame) -> DataFrame:
    """What is left of every document with a range in ``found``, stored once for equal rows: ``d, h, n_removed, n_spans, kept_sha256, kept``."""
    keyed = _document_keys(docs)
    member = bit_set(found, F.xxhash64("d", "h"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.filter(pa.array(member.has(np.asarray(batch.column("x"), np.int64).copy())))
            if rows.num_rows:
                yield rows.select(["d", "h", "text"])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, offsets = byte_column(batch.column("text"))
            raw = data.tobytes()
            rows = [_kept(raw[a:b], r) for a, b, r in zip(offsets, offsets[1:], batch.column("ranges").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), batch.column("h"), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                 pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string()),
                 pa.array([r[0].decode("utf-8", "ignore") for r in rows], pa.string())],
                ["d", "h", "n_removed", "n_spans", "kept_sha256", "kept"])

    hit = keyed.withColumn("x", F.xxhash64("d", "h")).mapInArrow(chosen, keyed.schema).join(found, ["d", "h"])
    once = hit.withColumn("nth", F.row_number().over(Window.partitionBy("d", "h").orderBy("d"))).filter("nth = 1").select("d", "h", "text", "ranges")
    path = new_path(docs.sparkSession, "stripped")
    once.mapInArrow(strip, "d long, h long, n_removed long, n_spans long, kept_sha256 string, kept string").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


@tidy
def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc``, a struct of all columns of every document, with ``n_bytes, n_removed, n_spans, kept_sha256`` and ``kept``.

    ``kept`` is the text that is left (null stays null); characters cut in half are left out of it, not of the digest. Texts
    are judged on the input: documents in order of their ids, null last, rows with the same id by a hash of the text; of
    rows equal in both the first keeps its own. Null and empty texts have no bytes; texts under 100 bytes stay whole. An
    empty table gives no rows.

    Texts that lose something are cut here and stored; what is returned only joins them, with no Python step, whose
    Arrow batches of texts would be as large as the caller's session allows.
    """
    found = repeated_ranges(docs)
    with small_batches(docs.sparkSession, BATCH_ROWS):
        stripped = _stripped(docs, found)
    text, columns = F.coalesce("text", F.lit("")), [f"c{i}" for i in range(len(docs.columns))]
    keyed = docs.select(
        "*", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), F.xxhash64(text), F.octet_length(text).cast("long"), F.sha2(text, 256)
    ).toDF(*columns, "d", "h", "n_bytes", "sha256")
    # A row equal to another in id and text repeats it as a whole.
    again = (F.row_number().over(Window.partitionBy("d", "h").orderBy("d")) > 1) & (F.col("n_bytes") >= LENGTH)
    solved = keyed.join(stripped, ["d", "h"], "left").withColumn("again", again)
    names = docs.columns if "text" in docs.columns else [c.lower() for c in docs.columns]
    whole = F.col(columns[names.index("text")])
    # The struct is made last, so that columns the caller leaves out are not shuffled.
    return solved.select(
        F.struct(*[F.col(c).alias(name) for c, name in zip(columns, docs.columns)]).alias("doc"), "n_bytes",
        F.when(F.col("again"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("again"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).alias("n_spans"),
        F.when(F.col("again"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(whole.isNull(), F.lit(None)).when(F.col("again"), F.lit("")).otherwise(F.coalesce("kept", whole)).alias("kept"))
