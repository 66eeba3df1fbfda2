"""N-gram Jaccard join: documents whose word-shingle sets overlap enough, exactly, with set-relation skipping.

Documents with equal sets are one node. Two sets that link share a token within their prefixes, in any global order of the
tokens; here tokens that are seen to occur once come first, so that only documents made of shared tokens reach the
index. Index lists are worked off in two steps. First every list's least node p is compared with all others of the list, where
sizes, positions and bit maps of the prefixes allow a link. Then the lists that still hold several components are worked off
without their texts: postings of one list and range of sizes meet in a task, in blocks ordered by size and position, and blocks
and pairs are skipped by size, position, component (what links already tell) and by the bit maps of the prefixes. Only sets that
have a partner left go on. Their texts meet by family (the lists whose p are linked): pairs are skipped by how many tokens one
bit map has that the other lacks. The first set of a component in a family is intersected with its candidates; a later set of
it takes these answers and counts only the tokens in which it differs, or is skipped if they cannot suffice. Only links that
join two components leave the task, never all pairs. Large families are dealt by ranges of sizes, where a set meets its own
range and visits the next one; ranges still too large are dealt in parts, every two of which meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import new_path, settle, tidy
from .bits import BitSet, bit_set
from .components import components
from .texts import byte_column, chunks, mixed, ragged, shingles, word_hashes

MEMBERS = 1_024  # of a compared set, per group
BLOCK = 256      # sets that are skipped together
FAMILY_TOKENS = 2_000_000  # tokens of a family's part (16 MB)
POSTINGS = 16_384  # of a list's part
MAP = 4          # words of 64 bits that map a prefix
MAPS = [f"m{i}" for i in range(MAP)]


@dataclass(frozen=True)
class Similarity:
    """Shingles of ``width`` words; a link needs 100 * intersection >= percent * union."""
    width: int = 5
    percent: int = 80

    def counted(self) -> int:
        """Tokens below this hash are counted: two and a half times the share that a prefix takes."""
        return int(min(1.0, 2.5 * (1 - self.percent / 100)) * (2**63 - 1))

    def prefix(self, n):
        return n - (self.percent * n + 99) // 100 + 1

    def needed(self, n, m):
        """The least intersection of linked sets of these sizes."""
        total = 100 + self.percent
        return (self.percent * (n + m) + total - 1) // total

    def size_range(self, n: Column) -> Column:
        """The number of a range of sizes; linked sets are in the same range or in neighbouring ones."""
        return F.floor(F.ln(n) / ((1 + 1e-9) * math.log(100 / self.percent))) if self.percent < 100 else n

    def needed_column(self, n: Column, m: Column) -> Column:
        return F.ceil((self.percent * (n + m)).cast("double") / (100 + self.percent))

    def fits(self, n: Column, p: Column, m: Column, q: Column) -> Column:
        """Whether sizes and positions of a first common token allow a link."""
        sizes = 100 * F.least(n, m) >= self.percent * F.greatest(n, m)
        return sizes & (F.least(n - p, m - q) >= self.needed_column(n, m))

    def prefixes_fit(self, x: str, y: str) -> Column:
        """Whether the maps of two prefixes (structs of ``n, alone, last`` and the map) leave room for a link."""
        def missing(a, b):
            seen = sum((F.bit_count(F.col(f"{a}.{w}").bitwiseAND(F.bitwise_not(f"{b}.{w}"))) for w in MAPS), F.lit(0))
            return F.col(f"{a}.alone") + seen <= F.col(f"{a}.n") - self.needed_column(F.col(f"{x}.n"), F.col(f"{y}.n"))
        return F.when(F.col(f"{x}.last") <= F.col(f"{y}.last"), missing(x, y)).otherwise(missing(y, x))


def _sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of every document's set (63-bit, ascending), their number, and the key of the set."""
    values, sizes = shingles(*word_hashes(data, offsets), width)
    values = values >> np.uint64(1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(values))))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    keys = mixed(sums[bounds[1:]] - sums[bounds[:-1]] + mixed(sizes.astype(np.uint64))) >> np.uint64(1)
    return values.astype(np.int64), sizes, keys.astype(np.int64)


def set_table(docs: DataFrame, how: Similarity) -> DataFrame:
    """One row per document, stored: ``doc_id, k, n, low`` with the set's key (null if empty), size and lowest tokens."""
    limit = how.counted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            tokens, sizes, keys = _sets(*byte_column(batch.column(1)), how.width)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            rank = np.arange(len(tokens)) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
            low = (tokens < limit) | (rank < how.prefix(sizes)[owner])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, mask=sizes == 0), pa.array(sizes), ragged(tokens[low], np.bincount(owner[low], minlength=len(sizes)))],
                ["doc_id", "k", "n", "low"])

    path = new_path(docs.sparkSession, "sets")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, k long, n long, low array<long>").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def index(sets: DataFrame, how: Similarity) -> DataFrame:
    """Prefix tokens that may be shared, stored: ``token, k, n, pos``, and what describes the set's prefix as a whole.

    ``alone`` is the number of its tokens that no other set has, ``last`` its last shared token, ``m0, m1, ...`` the map of its
    shared tokens.
    """
    limit = how.counted()
    counted = sets.select(F.explode("low").alias("token")).filter(F.col("token") < limit)
    repeated = bit_set(counted.groupBy("token").count().filter("count > 1"), F.col("token"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(1))
            lists = batch.column(2)
            tokens, counts = np.asarray(lists.flatten()), np.asarray(lists.value_lengths())
            owner = np.repeat(np.arange(len(counts)), counts)
            shared = (tokens >= limit) | repeated.has(tokens)
            before = counts - np.bincount(owner[shared], minlength=len(counts))
            owner, tokens = owner[shared], tokens[shared]
            number = np.bincount(owner, minlength=len(counts))
            place = before[owner] + np.arange(len(tokens)) - np.repeat(np.concatenate(([0], np.cumsum(number)[:-1])), number)
            kept = place < how.prefix(sizes)[owner]
            owner, tokens, place = owner[kept], tokens[kept], place[kept]
            last = np.zeros(len(counts), np.int64)
            np.maximum.at(last, owner, tokens)
            maps = np.zeros((len(counts), MAP), np.uint64)
            spot = tokens.view(np.uint64) & np.uint64(64 * MAP - 1)
            np.bitwise_or.at(maps, (owner, (spot >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (spot & np.uint64(63)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens), batch.column(0).take(pa.array(owner)), pa.array(sizes[owner]), pa.array(place), pa.array(before[owner]),
                 pa.array(last[owner]), *[pa.array(maps[owner, i].view(np.int64)) for i in range(MAP)]],
                ["token", "k", "n", "pos", "alone", "last", *MAPS])

    path = new_path(sets.sparkSession, "index")
    (sets.filter("k IS NOT NULL").select("k", "n", "low").mapInArrow(run, ", ".join(f"{c} long" for c in ("token", "k", "n", "pos", "alone", "last", *MAPS)))
     .write.parquet(path))
    return sets.sparkSession.read.parquet(path)


def _compare(width: int):
    """Intersections of the texts that follow each group's first one: rows are sorted by ``a, salt, role``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, None
        for batch in chunks(batches):
            tokens, sizes, keys = _sets(*byte_column(batch.column("text")), width)
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            a, salt, role, k = (np.asarray(batch.column(c)) for c in ("a", "salt", "role", "k"))
            out = []
            for i in np.flatnonzero(keys == k):
                mine = tokens[bounds[i]:bounds[i + 1]]
                if role[i] == 0:
                    group, own = (a[i], salt[i]), mine
                elif group == (a[i], salt[i]):
                    at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                    out.append((a[i], k[i], int((own[at] == mine).sum()), len(own), len(mine)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*out)], ["a", "x", "both", "n", "m"])
    return run


def compare(pairs: DataFrame, docs: DataFrame, named: DataFrame, how: Similarity) -> DataFrame:
    """Exact intersections of the pairs ``a, x`` of set keys, stored: ``a, x, both, n, m``.

    ``named`` has one document for every key (``k, doc_id``). Texts of those documents come once per pair and once per group
    of at most about ``MEMBERS`` pairs; a set with more pairs has several groups.
    """
    spark = docs.sparkSession
    pairs = settle(pairs)
    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("groups"))
    salted = pairs.join(groups, "a").withColumn("salt", F.pmod(F.xxhash64("x"), F.col("groups")))
    rows = salted.select("a", "salt", F.lit(1).alias("role"), F.col("x").alias("k")).unionByName(
        salted.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("k")))
    grouped = with_texts(rows, docs, named).repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "k")
    path = new_path(spark, "answers")
    grouped.select("a", "salt", "role", "k", "text").mapInArrow(_compare(how.width), "a long, x long, both long, n long, m long").distinct().write.parquet(path)
    return spark.read.parquet(path)


def with_texts(rows: DataFrame, docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows with the ``text`` of the document that names their node ``k``.

    A text leaves its task once, to meet its rows; others don't leave it, but for false hits of a bit set.
    """
    wanted = settle(rows.join(named.withColumnRenamed("doc_id", "_named"), "k"))
    member = bit_set(wanted, F.xxhash64("_named"))
    texts = docs.select("doc_id", F.xxhash64("doc_id").alias("h"), "text").mapInArrow(
        _members(member), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")
    return wanted.join(texts, F.col("doc_id").eqNullSafe(F.col("_named"))).select(*rows.columns, "text")


def _members(member: BitSet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.filter(pa.array(member.has(np.asarray(batch.column(1), np.int64).copy())))
            if found.num_rows:
                yield pa.RecordBatch.from_arrays([found.column(0), found.column(2)], ["doc_id", "text"])
    return run


class _List:
    """Postings of a part of an index list, in order of size and position; marks those that may link with another component.

    ``home`` postings meet each other and the others, which are of the range of sizes below and have met each other there.
    """

    def __init__(self, how: Similarity, rows: dict[str, np.ndarray]):
        order = np.lexsort((rows["pos"], rows["n"]))
        self.how, self.order = how, order
        self.n, self.pos, self.c, self.side, self.home, self.alone, self.last = (
            rows[x][order] for x in ("n", "pos", "c", "side", "home", "alone", "last"))
        self.maps = np.stack([rows[m][order] for m in MAPS], 1).view(np.uint64)
        self.across = len(np.unique(self.side)) > 1
        self.marked = np.zeros(len(order), bool)

    def meet(self, x: slice, y: slice) -> None:
        n, m = self.n[x][:, None], self.n[y][None, :]
        need = self.how.needed(n, m)
        ok = (100 * n >= self.how.percent * m) & (self.c[x][:, None] != self.c[y][None, :])
        ok &= (self.home[x][:, None] | self.home[y][None, :]) & ~(self.marked[x][:, None] & self.marked[y][None, :])
        ok &= np.minimum(n - self.pos[x][:, None], m - self.pos[y][None, :]) >= need
        if self.across:
            ok &= self.side[x][:, None] != self.side[y][None, :]
        if x == y:
            ok &= np.triu(np.ones(ok.shape, bool), 1)
        u, v = np.nonzero(ok)
        need = need[u, v]
        u, v = u + x.start, v + y.start
        swapped = self.last[u] > self.last[v]
        one, two = np.where(swapped, v, u), np.where(swapped, u, v)
        lacking = np.bitwise_count(self.maps[one] & ~self.maps[two]).sum(1, dtype=np.int64) + self.alone[one]
        kept = lacking <= self.n[one] - need
        self.marked[one[kept]] = True
        self.marked[two[kept]] = True

    def partners(self) -> np.ndarray:
        """Which rows have a partner left, in the order given."""
        blocks = [slice(i, min(i + BLOCK, len(self.n))) for i in range(0, len(self.n), BLOCK)]
        room = [int((self.n[x] - self.pos[x]).max()) for x in blocks]
        for i, x in enumerate(blocks):
            for j in range(i, len(blocks)):
                y = blocks[j]
                least, most = self.n[x.start], self.n[y.start]
                if 100 * self.n[x.stop - 1] < self.how.percent * most:
                    break  # sizes only grow from here
                if min(room[i], room[j]) >= self.how.needed(least, most):
                    self.meet(x, y)
        out = np.zeros(len(self.n), bool)
        out[self.order] = self.marked
        return out


LIST_KEYS = ["token", "range", "low", "high"]
POSTING = ["side", "home", "own", "k", "c", "n", "pos", "alone", "last", *MAPS]


def _partners(how: Similarity):
    """Postings with a partner left, ``own, k, c, n``, of rows sorted by list, range of sizes and part."""
    def solve(rows: dict[str, np.ndarray], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = bounds[:-1]
        open_ = np.minimum.reduceat(rows["c"], starts) < np.maximum.reduceat(rows["c"], starts)
        open_ &= np.maximum.reduceat(rows["home"], starts)
        marked = np.zeros(bounds[-1], bool)
        for a, b in zip(starts[open_], bounds[1:][open_]):
            marked[a:b] = _List(how, {name: rows[name][a:b] for name in POSTING}).partners()
        if marked.any():
            yield pa.RecordBatch.from_arrays([pa.array(rows[x][:bounds[-1]][marked]) for x in ("own", "k", "c", "n")], ["own", "k", "c", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in [*LIST_KEYS, *POSTING]}
            if held:
                rows = {x: np.concatenate((held[x], rows[x])) for x in rows}
            changed = np.zeros(len(rows["k"]) - 1, bool)
            for x in LIST_KEYS:
                changed |= rows[x][1:] != rows[x][:-1]
            bounds = np.concatenate(([0], np.flatnonzero(changed) + 1))
            if len(bounds) > 1:
                yield from solve(rows, bounds)
            held = {x: rows[x][bounds[-1]:] for x in rows}
        if held:
            yield from solve(held, np.array([0, len(held["k"])]))
    return run


class _Family:
    """Sets of one group, in order of their sizes; finds the links that join different components."""

    def __init__(self, how: Similarity, sets: list[np.ndarray], keys: np.ndarray, components: np.ndarray, sides: np.ndarray,
                 home: np.ndarray | None = None):
        sizes = np.array([len(s) for s in sets])
        order = np.lexsort((keys, sizes))
        self.how, self.sets, self.sizes = how, [sets[i] for i in order], sizes[order]
        self.keys, self.components, self.sides = keys[order], components[order], sides[order]
        self.across = len(np.unique(sides)) > 1
        self.home = np.ones(len(sets), bool) if home is None else home[order]  # the others have met each other elsewhere
        words = min(128, max(4, 1 << int(sizes.max() // 16).bit_length()))  # four bits a token, up to 8192
        self.maps = np.zeros((len(sets), words), np.uint64)
        for i, own in enumerate(self.sets):
            spot = own.view(np.uint64) & np.uint64(64 * words - 1)
            np.bitwise_or.at(self.maps[i], (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63)))
        self.root: dict[int, int] = {}
        self.first: dict[int, int] = {}  # of a component
        self.solved: dict[tuple[int, int], int] = {}  # intersections of first sets
        self.differences: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def find(self, c: int) -> int:
        while c in self.root:
            c = self.root[c]
        return c

    def candidates(self, x: slice, y: slice) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of two blocks that neither size, component nor bit maps rule out."""
        n, m = self.sizes[x][:, None], self.sizes[y][None, :]
        need = self.how.needed(n, m)
        ok = (100 * n >= self.how.percent * m) & (self.components[x][:, None] != self.components[y][None, :])
        ok &= self.home[x][:, None] | self.home[y][None, :]
        if self.across:
            ok &= self.sides[x][:, None] != self.sides[y][None, :]
        if x == y:
            ok &= np.triu(np.ones(ok.shape, bool), 1)
        u, v = np.nonzero(ok)
        kept = np.ones(len(u), bool)
        for a in range(0, len(u), 8_192):
            i, j = u[a:a + 8_192], v[a:a + 8_192]
            one, two, least = self.maps[x][i], self.maps[y][j], need[i, j]
            kept[a:a + 8_192] = (np.bitwise_count(one & ~two).sum(1) <= self.sizes[x][i] - least) & (
                np.bitwise_count(two & ~one).sum(1) <= self.sizes[y][j] - least)
        return u[kept] + x.start, v[kept] + y.start

    def answers(self, u: int, v: int) -> bool:
        """Whether two sets link. Answers of a component's first set serve its later sets, which count only their differences."""
        need = self.how.needed(self.sizes[u], self.sizes[v])
        first = self.first.setdefault(int(self.components[u]), u)
        known = self.solved.get((first, v))
        if first == u or known is None:
            both = _within(self.sets[u], self.sets[v])
            if first == u:
                self.solved[u, v] = both
            return both >= need
        if u not in self.differences:
            own, model = self.sets[u], self.sets[first]
            self.differences[u] = np.setdiff1d(own, model, assume_unique=True), np.setdiff1d(model, own, assume_unique=True)
        more, less = self.differences[u]
        if known + len(more) < need:
            return False
        if known - len(less) >= need:
            return True
        return known + _within(more, self.sets[v]) - _within(less, self.sets[v]) >= need

    def links(self) -> list[tuple[int, int]]:
        found = []
        blocks = [slice(i, min(i + BLOCK, len(self.sets))) for i in range(0, len(self.sets), BLOCK)]
        for i, x in enumerate(blocks):
            for y in blocks[i:]:
                if 100 * self.sizes[x.stop - 1] < self.how.percent * self.sizes[y.start]:
                    break  # sizes only grow from here
                for u, v in zip(*self.candidates(x, y)):
                    c, d = self.find(self.components[u]), self.find(self.components[v])
                    if c == d:
                        continue
                    if self.answers(int(u), int(v)):
                        self.root[max(c, d)] = min(c, d)
                        found.append((self.keys[u], self.keys[v]))
        return found


def _within(own: np.ndarray, other: np.ndarray) -> int:
    """How many of the tokens another set has, both ascending."""
    at = np.minimum(np.searchsorted(other, own), len(other) - 1)
    return int((other[at] == own).sum())


def _families(how: Similarity):
    """Links of every group of rows sorted by ``p, range, low, high``: ``a, x``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def finish():
            if len(held) > 1:
                keys, comps, sides, home = (np.array([h[i] for h in held]) for i in (1, 2, 3, 4))
                found = _Family(how, [h[0] for h in held], keys, comps, sides, home).links()
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in zip(*found)], ["a", "x"])

        for batch in chunks(batches):
            tokens, sizes, keys = _sets(*byte_column(batch.column("text")), how.width)
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            p, range_, low, high, k, c, side = (np.asarray(batch.column(x)) for x in ("p", "range", "low", "high", "k", "c", "side"))
            home = batch.column("home").to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(keys == k):
                if group != (p[i], range_[i], low[i], high[i]):
                    yield from finish()
                    group, held = (p[i], range_[i], low[i], high[i]), []
                held.append((tokens[bounds[i]:bounds[i + 1]].copy(), k[i], c[i], side[i], home[i]))
        yield from finish()
    return run


def partners_left(postings: DataFrame, prefix: DataFrame, how: Similarity) -> DataFrame:
    """``own, k, c, n`` of the postings ``token, own, k, c, n, pos, parts`` that may link with one of another component, stored.

    Every posting meets those of its own range of sizes and of the next one. A list is dealt in ``parts``, every two of which meet.
    """
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    rows = (postings.withColumn("side", F.pmod(F.xxhash64("k"), F.col("parts"))).withColumn("at", how.size_range(F.col("n")))
            .join(prefix.select("k", "x.alone", "x.last", *[f"x.{m}" for m in MAPS]), "k")
            .withColumn("other", F.explode(every)).withColumn("range", F.explode(F.array("at", F.col("at") + 1)))
            .withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other"))
            .withColumn("home", F.col("at") == F.col("range")))
    sorted_ = rows.select(*LIST_KEYS, *POSTING).repartition(*LIST_KEYS).sortWithinPartitions(*LIST_KEYS)
    return settle(sorted_.mapInArrow(_partners(how), "own long, k long, c long, n long").distinct())


GROUP = ["p", "range", "low", "high"]


def family_groups(rest: DataFrame, how: Similarity) -> DataFrame:
    """``p, range, low, high, k, c, side, home``: the groups in which the sets ``p, k, c, n`` of each family meet.

    A family that fits one part is one group. A larger one is dealt by ranges of sizes, and each set goes to its own range
    (``home``) and to the next one; ranges that hold more than a part are dealt in parts, every two of which meet.
    """
    whole = (rest.groupBy("p").agg(F.sum("n").alias("tokens"), F.min("c").alias("least"), F.max("c").alias("most")).filter("least < most")
             .select("p", (F.col("tokens") > FAMILY_TOKENS).alias("large")))
    at = how.size_range(F.col("n")).cast("long")
    ranges = F.when(F.col("large"), F.array(at, at + 1)).otherwise(F.array(F.lit(0).cast("long")))
    ranged = rest.join(whole, "p").select("p", F.posexplode(ranges).alias("away", "range"), "k", "c", "n")
    home = F.col("away") == 0
    sizes = (ranged.groupBy("p", "range").agg(F.sum("n").alias("tokens"), F.min("c").alias("least"), F.max("c").alias("most"),
                                              F.min(F.when(home, F.col("n"))).alias("home_n")).filter("least < most")
             .select("p", "range", "home_n", F.ceil(F.col("tokens") / FAMILY_TOKENS).alias("parts")))
    # A set goes to the next range only if one there is small enough; a range that nothing is at home in has no home_n.
    dealt = (ranged.join(sizes, ["p", "range"]).filter(home | (100 * F.col("n") >= how.percent * F.col("home_n"))).withColumn("side", F.pmod(F.xxhash64("k"), F.col("parts")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))))
    return dealt.select("p", "range", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "k", "c", "side",
                        home.alias("home"))


def link_classes(docs: DataFrame, how: Similarity = Similarity()) -> tuple[DataFrame, DataFrame]:
    """Stored ``doc_id, k, n, low`` of every document and ``k, c`` of every set that links with another one."""
    sets = set_table(docs, how)
    entries = index(sets, how)
    named = sets.filter("k IS NOT NULL").groupBy("k").agg(F.min("doc_id").alias("doc_id"))
    lists = settle(entries.groupBy("token").agg(F.min(F.struct("k", "n", "pos")).alias("a"), F.max("k").alias("last_k")).filter("a.k < last_k").drop("last_k"))
    shared = settle(entries.join(lists, "token").select("token", "k", "n", "pos", "a").distinct())
    prefix = settle(entries.select("k", F.struct("n", "alone", "last", *MAPS).alias("x")).distinct())

    # Every list's least node with all others of the list.
    first = shared.filter(F.col("k") != F.col("a.k")).filter(how.fits(F.col("n"), F.col("pos"), F.col("a.n"), F.col("a.pos")))
    pairs = first.select(F.col("a.k").alias("a"), "k").distinct()
    near = (pairs.join(prefix, "k").join(prefix.select(F.col("k").alias("a"), F.col("x").alias("y")), "a")
            .filter(how.prefixes_fit("x", "y")).select("a", F.col("k").alias("x")))
    answers = compare(near, docs, named, how)
    linked = 100 * F.col("both") >= how.percent * (F.col("n") + F.col("m") - F.col("both"))
    found = components(answers.filter(linked).select("a", F.col("x").alias("b")))

    # What the lists with several components still hold: pairs without the list's least node. Their postings meet first, and
    # those with a partner left are gathered by the component of the list's least node.
    classed = shared.filter(F.col("k") != F.col("a.k")).join(found, "k", "left").withColumn("c", F.coalesce("c", "k"))
    several = settle(classed.groupBy("token").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count(F.lit(1)).alias("number"))
                     .filter("least < most").select("token", F.ceil(F.col("number") / POSTINGS).alias("parts")))
    left = partners_left(classed.join(several, "token").select("token", F.col("a.k").alias("own"), "k", "c", "n", "pos", "parts"), prefix, how)
    rest = (left.join(found.select(F.col("k").alias("own"), F.col("c").alias("p")), "own", "left").withColumn("p", F.coalesce("p", "own"))
            .groupBy("p", "k").agg(F.min("c").alias("c"), F.min("n").alias("n")))
    met = family_groups(settle(rest), how)
    rows = with_texts(met, docs, named).repartition(*GROUP).sortWithinPartitions(*GROUP, "k")
    path = new_path(docs.sparkSession, "links")
    rows.select(*GROUP, "k", "c", "side", "home", "text").mapInArrow(_families(how), "a long, x long").write.parquet(path)
    links = docs.sparkSession.read.parquet(path)
    ends = [found.select(F.col("k").alias(n), F.col("c").alias(f"c{n}")) for n in ("a", "x")]
    bridges = links.join(ends[0], "a", "left").join(ends[1], "x", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cx", "x").alias("b"))
    joined = components(bridges)
    everyone = found.unionByName(bridges.select(F.explode(F.array("a", "b")).alias("k")).distinct().select("k", F.col("k").alias("c")))
    later = joined.select(F.col("k").alias("c"), F.col("c").alias("next"))
    final = everyone.join(later, "c", "left").select("k", F.coalesce("next", "c").alias("c")).groupBy("k").agg(F.min("c").alias("c"))
    return sets, settle(final)


@tidy
def jaccard_components(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the size of each document's set and the smallest id reachable by links.

    Words are runs without whitespace, A-Z lower-cased; a text with fewer words than the width is one shingle; a null text or
    one without words has an empty set, links with nothing and is its own component. Rows with equal sets are linked, repeated
    rows each give a row, null ids never name a component that has another id. An empty table gives no rows. Tokens and sets
    are told apart by 63-bit hashes.
    """
    sets, found = link_classes(docs, how)
    own = sets.select("doc_id", "k", "n").join(found, "k", "left").withColumn("c", F.coalesce("c", "k"))
    least = own.filter("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("least"))
    return own.join(least, "c", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


@tidy
def keep_one(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """The rows of ``docs`` with one of each linked group: the one with the smallest id (then text hash).

    All columns stay. Only rows that may be in a group are shuffled; documents with empty sets are all kept.
    """
    sets, found = link_classes(docs, how)
    own = sets.filter("k IS NOT NULL").select("doc_id", "k").join(found, "k", "left").withColumn("c", F.coalesce("c", "k"))
    many = own.groupBy("c").count().filter("count > 1").select("c")
    grouped = settle(own.join(many, "c").select(F.col("doc_id").alias("id"), F.col("k").alias("key"), "c").distinct())
    member = bit_set(grouped, F.xxhash64("id"))
    rows = docs.select(F.struct("*").alias("doc"), "text", F.xxhash64("doc_id").alias("h"))
    kind = rows.schema["doc"].dataType.simpleString()

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(~member.has(np.asarray(batch.column(2), np.int64).copy())))
            if kept.num_rows:
                yield kept.select(["doc"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            batch = batch.filter(pa.array(member.has(np.asarray(batch.column(2), np.int64).copy())))
            if batch.num_rows:
                _, sizes, keys = _sets(*byte_column(batch.column(1)), how.width)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, mask=sizes == 0)], ["doc", "k"])

    hits = rows.mapInArrow(keyed, f"doc {kind}, k long").join(
        grouped, F.col("doc.doc_id").eqNullSafe(F.col("id")) & (F.col("k") == F.col("key")), "left")
    alone = hits.filter("c IS NULL").select("doc")
    best = Window.partitionBy("c").orderBy(F.col("doc.doc_id").asc_nulls_last(), F.xxhash64("doc.text"))
    first = hits.filter("c IS NOT NULL").withColumn("place", F.row_number().over(best)).filter("place = 1").select("doc")
    return rows.mapInArrow(others, f"doc {kind}").unionByName(alone).unionByName(first).select("doc.*")
