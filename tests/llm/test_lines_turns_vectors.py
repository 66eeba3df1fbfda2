"""Line dedup, conversation repair and whitening against plain versions, and on messy and empty tables."""

import hashlib
import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from planspark.llm import conversations, linededup, whitening

SPACES = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain_lines(rows):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = lower(line.strip(SPACES))
            if len(key) >= 20:
                holders[key].add(i)
    low = float("-inf")
    gone = {k: max(low if i is None else i for i in ids) for k, ids in holders.items() if len(ids) >= 3}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (k := lower(x.strip(SPACES))) not in gone or gone[k] == (low if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_shared_lines_of_messy_rows(spark):
    a, b, short = "A line of at least twenty", "Élan ÀÉ line with other letters ŁÓ", "nineteen characters"
    rows = [(1, f"{a}\nown\n{b}\n"), (2, f"  {a.upper()}\t\n{b}"), (3, f"{a}\r\n{a}\n\n{a}"), (3, f"{a}\n{b}"), (4, None), (5, ""), (None, a), (None, f"x\n{a}"),
            (6, f"{short}\n" * 3), (7, short), (8, short), (9, "Lone line that two documents hold"), (9, "lone line that two documents hold"),
            (1, f"{a}\nown\n{b}\n"), (10, "\n".join(f"line {i % 50} of a very long text, number {i % 50}" for i in range(5000))), (11, "line 7 of a very long text, number 7"),
            (12, "line 7 of a very long text, number 7\nline 8 of a very long text, number 8"), (13, "élan àÉ line with other letters ŁÓ")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_lines int, at string")
    found = linededup.without_shared_lines(docs)
    assert found.columns == ["doc", "kept", "n_lines", "n_dropped"]
    got = sorted([(r.doc.doc_id, r.n_lines, r.n_dropped, r.kept or "") for r in found.collect()], key=repr)
    assert got == plain_lines(rows)
    assert [r.kept for r in found.filter("doc.doc_id = 4").collect()] == [None]
    assert linededup.without_shared_lines(docs.limit(0)).count() == 0


def test_shared_lines_leave_one_copy(spark):
    rng = random.Random(4)
    pool = [f"shared sentence number {i} stands here" for i in range(40)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own sentence {rng.random()} in here" for _ in range(rng.randint(1, 30)))) for i in range(300)]
    found = linededup.without_shared_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted([(r.doc.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found.collect()], key=repr) == plain_lines(rows)


def plain_repair(rows):
    """Cheapest edits by a search over whole audits."""
    best = {len(rows): {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}}
    given, keep = {0: 2, 1: 2, 2: 3, 3: 2}, {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    for i in range(len(rows) - 1, -1, -1):
        role, fault = rows[i]
        here = {}
        for s in range(4):
            late = fault == "truncated"
            found = [(best[i + 1][s][0] + 3, "D" + best[i + 1][s][1])]
            if fault not in ("blank", "duplicate"):
                found.append((best[i + 1][given[s]][0] + 2 + late, "R" + best[i + 1][given[s]][1]))
                if (s, role) in keep:
                    found.append((best[i + 1][keep[s, role]][0] + late, "K" + best[i + 1][keep[s, role]][1]))
            here[s] = min(found)
        for _ in range(3):
            here = {s: min(here[s], (here[given[s]][0] + 2, "I" + here[given[s]][1])) for s in range(4)}
        best[i] = here
    return best[0][0]


KINDS = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}


def letters(rows):
    return "".join(chr(65 + 4 * "suax".index(r) + KINDS[f]) for r, f in rows)


def test_automaton_equals_plain_search():
    every = [(r, f) for r in "suax" for f in KINDS]
    cases = [list(c) for n in range(4) for c in itertools.product(every, repeat=n)]
    rng = random.Random(2)
    cases += [[rng.choice(every) for _ in range(rng.randint(4, 60))] for _ in range(1500)]
    automaton = conversations.Automaton()
    nodes = set()
    for reverse, rows in sorted((letters(c)[::-1], c) for c in cases):
        automaton.follow(reverse)
        assert (automaton.costs[-4], automaton.audit()) == plain_repair(rows), rows
        assert automaton.illegal[-1] == sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
        nodes |= {reverse[:k] for k in range(1, len(reverse) + 1)}
    assert automaton.built == len(nodes)  # every distinct suffix once


def test_automaton_of_a_long_conversation():
    automaton = conversations.Automaton()
    automaton.follow(letters([("u", ""), ("a", "")] * 100_000)[::-1])
    assert automaton.costs[-4] == 0 and automaton.audit() == "K" * 200_000


def plain_conversation(rows):
    """Report and repaired turns of one conversation's rows ``turn, role, text``."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    seen, signed, counts = set(), [], defaultdict(int)
    for _, role, text in rows:
        body = text.strip(SPACES)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        signed.append((role[:1] if role[:1] in tuple("sua") else "x", fault))
    cost, audit = plain_repair(signed)
    state, i, out = 0, 0, []
    given, keep = {0: 2, 1: 2, 2: 3, 3: 2}, {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    for e in audit:
        if e == "K":
            state = keep[state, signed[i][0]]
            out.append((rows[i][1], rows[i][2]))
        elif e != "D":
            state = given[state]
            out.append((conversations.NAMES[state], "" if e == "I" else rows[i][2]))
        i += e != "I"
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(signed, signed[1:]))
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit), out


def test_repair_of_messy_conversations(spark):
    rng = random.Random(9)
    texts = ["Yes.", "No!", "Why?", "and then", " ", "", None, "Yes.  \n", "x" * 5000 + ".", "Ünï."]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = [(c if c else None, rng.choice([None, *range(9)]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts), "k", 1)
            for c in range(60) for _ in range(rng.randint(1, 12))]
    rows += [(100, 1, "user", "Twice.", "k", 1)] * 40 + [(101, -2**63, "user", "Far.", "k", 1), (101, 2**63 - 1, "assistant", "Off.", "k", 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, line int")
    report, turns = conversations.repair(table, conversations.undamaged(table))
    got = {r.conv_id: tuple(r)[1:] for r in report.collect()}
    kept = defaultdict(list)
    for r in turns.orderBy("conv_id", "line").collect():
        assert r.line == len(kept[r.conv_id])
        kept[r.conv_id].append((r.role, r.text))
    digests = {r.conv_id: r.repaired_sha256 for r in conversations.turn_digests(turns).collect()}
    groups = defaultdict(list)
    for c, t, r, x, *_ in rows:
        groups[c].append((t, " " if r is None else r, " " if x is None else x))
    assert set(got) == set(groups)
    for c, members in groups.items():
        (gaps, *counts), out = plain_conversation(members)
        assert got[c] == (gaps if gaps < 2**63 else None, *counts), c
        assert kept[c] == out
        assert digests.get(c, hashlib.sha256().hexdigest()) == hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()


def test_repair_of_dropped_and_empty_tables(spark):
    table = spark.createDataFrame([(5, 0, "user", "Hi."), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    report, turns = conversations.repair(table, conversations.undamaged(table).filter("conv_id = 6"))
    assert sorted(map(tuple, report.collect()), key=repr) == [(5, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]
    assert turns.count() == 0 and conversations.turn_digests(turns).count() == 0
    report, turns = conversations.repair(table.limit(0), conversations.damaged(table.limit(0)))
    assert report.count() == 0 and turns.count() == 0


def test_damage_is_by_the_crc_of_id_and_turn(spark):
    import zlib
    rows = [(c, t, "assistant", f"Text {c}, {t}. Yes!") for c in range(30) for t in [None, 0, 1, 2]]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        h = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        if h:
            want.append((c, t, "user" if h == 4 else role, "" if h == 1 else text.replace(".", "").replace("!", "") if h == 2 else text, 2 if h == 3 else 1))
    assert sorted(map(tuple, conversations.damaged(table).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("matrix", [
    np.eye(7) * 3, np.zeros((4, 4)), np.diag([5.0, 5, 5, 1, 1, 0, 0]), np.array([[2.0]]), np.array([[0.0, 1], [1, 0]]) + np.eye(2),
    np.cov(np.random.default_rng(1).normal(size=(200, 40)).T, bias=True), np.cov(np.random.default_rng(2).normal(size=(6, 30)).T, bias=True),
    np.diag(1 + 1e-9 * np.arange(20)),
])
def test_spectrum_slices(matrix):
    found = whitening.leading(matrix, 16)
    want = np.linalg.eigvalsh(matrix)[::-1][:16]
    scale = max(abs(want).max(), 1.0)
    assert np.abs(found.values - want).max() < 1e-12 * scale
    assert np.abs(found.vectors.T @ found.vectors - np.eye(len(want))).max() < 1e-10
    assert np.abs(matrix @ found.vectors - found.vectors * found.values).max() < 1e-7 * scale


def test_inertia_of_indefinite_matrices():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 9, 30):
        for _ in range(20):
            a = rng.normal(size=(size, size)) * (rng.random((size, size)) < 0.6)
            a = a + a.T
            if rng.random() < 0.5:
                np.fill_diagonal(a, 0)
            e = np.linalg.eigvalsh(a)
            if np.abs(e).min() > 1e-9:
                assert whitening.inertia(a) == ((e > 0).sum(), (e < 0).sum(), 0)


def test_a_wrong_number_is_not_certified():
    slicer = whitening.Slicer(np.diag([4.0, 3, 2, 1]))
    whitening.certify(slicer, np.array([4.0, 3.0]))
    with pytest.raises(ArithmeticError):
        whitening.certify(slicer, np.array([4.0, 2.0]))


def plain_whiten(rows, width):
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in list(v) + [0.0] * (width - len(v))] for _, v in usable], object)
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, sums = len(fit), fit.sum(0)
    centred = ((n * fit - sums) / n).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in usable], n, ((n * x - sums) ** 2).sum(1).tolist(), ((n * x - sums) / n).astype(float), e[::-1], u[:, ::-1]


def check_white(found, rows, width):
    ids, n, far, centred, e, u = plain_whiten(rows, width)
    kinds = min(16, width)
    got = defaultdict(list)
    for r in found.collect():
        assert r.n == n and abs(r.explained - max(e[r.component - 1], 0) / e.sum()) < 1e-9 and r.identity_error < 1e-6
        got[r.vec_id, r.deviation].append((r.component, r.whitened))
    want = defaultdict(list)
    for i, d, c in zip(ids, far, centred):
        want[i, d] += [(k + 1, abs(c @ u[:, k] / np.sqrt(e[k]))) for k in range(kinds)]
    assert set(got) == set(want)
    for key, values in want.items():
        assert np.allclose(sorted((k, abs(w)) for k, w in got[key]), sorted(values), atol=1e-6)


def test_whitening_of_messy_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=20) * np.linspace(0.2, 2, 20) + 3).tolist()) for i in range(150)]
    rows += [rows[3], rows[4], (7, rows[3][1]), (None, rows[9][1]), (200, None), (201, [1.0, None]), (202, [float("nan")] * 20), (203, [float("inf")] * 20),
             (204, [1.0, 2.0]), (205, []), (206, [0.0] * 20), (207, [-0.0] * 20)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, x int, n int")
    check_white(whitening.whiten(table), rows, 20)


def test_whitening_without_variance_and_without_rows(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 1e300])], "vec_id long, embedding array<double>")
    one = whitening.whiten(table.filter("vec_id < 3")).collect()
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, 0.0, 0.0, 0.0)}
    assert {r.component for r in whitening.whiten(table).collect()} == {1, 2}
    assert whitening.whiten(table.limit(0)).count() == 0
    assert whitening.whiten(table.select("vec_id", F.array().cast("array<float>").alias("embedding"))).count() == 0
    assert whitening.whiten(table.limit(0)).dtypes == whitening.whiten(table).dtypes


def test_whitening_of_the_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check_white(whitening.whiten(table), rows, 64)
