"""Near-duplicate and repeat operators against brute force."""

import hashlib
import itertools
import random
import sys

import numpy as np
import pytest

from planspark.llm import jaccard, repeats
from planspark.llm.components import components
from planspark.llm.texts import shingles, word_hashes, byte_column
import pyarrow as pa


def word_sets(texts, width):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    return out


def expected_components(rows, how):
    sets = word_sets([t for _, t in rows], how.width)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= how.percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(x for x in (least.get(find(i)), d) if x is not None) if (d is not None or find(i) in least) else None
    return sorted(((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def variants(seed, groups=12, members=14):
    """Groups of edited copies around the threshold, some sharing a common passage, with exact copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows, n = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 160))]
        if rng.random() < 0.5:
            base = base[:10] + passage + base[10:]
        for _ in range(members):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, " ".join(words).title() if rng.random() < 0.3 else "\n".join(words)))
            n += rng.randint(1, 3)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("how, seed", [(jaccard.Similarity(3, 90), 1), (jaccard.Similarity(5, 80), 2)])
def test_components_match_all_pairs(spark, how, seed):
    rows = variants(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.jaccard_components(docs, how).collect()), key=repr)
    assert got == expected_components(rows, how)


def test_families_and_lists_of_many_parts(spark, monkeypatch):
    """Small parts: sets with several groups of pairs, lists and families dealt so that every two parts meet."""
    for name, size in (("FAMILY_TOKENS", 200), ("MEMBERS", 2), ("POSTINGS", 4)):
        monkeypatch.setattr(jaccard, name, size)
    rows, how = variants(4, groups=6, members=18), jaccard.Similarity(3, 90)
    got = sorted((tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), how).collect()), key=repr)
    assert got == expected_components(rows, how)


def test_large_families_meet_by_range_of_sizes(spark, monkeypatch):
    """Texts are copied for neighbouring sizes, not for every part of their family; sets that may link still meet once at least."""
    monkeypatch.setattr(jaccard, "FAMILY_TOKENS", 2_000)
    how = jaccard.Similarity(3, 90)
    sizes = [100 + 7 * i for i in range(120)]
    rest = spark.createDataFrame([(1, i, i, n) for i, n in enumerate(sizes)] + [(2, 500 + i, i, 10) for i in range(20)], "p long, k long, c long, n long")
    met = {}
    for r in jaccard.family_groups(rest, how).collect():
        met.setdefault((r.p, r.range, r.low, r.high), []).append(r)
    copies = [r for group in met.values() for r in group if r.p == 1]
    assert len(copies) <= 12 * len(sizes)  # 31 each when all parts of a family met
    together = {(a.k, b.k) for group in met.values() for a in group for b in group if a.home or b.home if group[0].low == group[0].high or a.side != b.side}
    for i, n in enumerate(sizes):
        assert all((i, j) in together for j, m in enumerate(sizes) if i != j and 90 * max(n, m) <= 100 * min(n, m))
    assert [len(group) for key, group in met.items() if key[0] == 2] == [20]
    # Sets of one range don't visit the next one, where nothing is at home.
    alike = spark.createDataFrame([(1, i, i, 1000) for i in range(3)], "p long, k long, c long, n long")
    assert {r.range for r in jaccard.family_groups(alike, how).collect() if r.home} == {r.range for r in jaccard.family_groups(alike, how).collect()}


def edited_sets(seed, number):
    """Ascending token sets, edits of a few models, as many of them around the threshold."""
    rng = np.random.default_rng(seed)
    models = [np.unique(rng.integers(0, 2**62, 120)) for _ in range(3)]
    models.append(np.unique(np.concatenate((models[0][:110], rng.integers(0, 2**62, 9)))))
    sets = []
    for i in range(number):
        own = models[i % len(models)]
        own = own[rng.random(len(own)) > rng.choice([0, 0.02, 0.06])]
        sets.append(np.unique(np.concatenate((own, rng.integers(0, 2**62, rng.integers(0, 6))))))
    return sets


def test_answers_from_a_similar_set_are_those_of_the_sets():
    how, sets = jaccard.Similarity(3, 90), edited_sets(7, 60)
    keys = np.arange(len(sets))
    family = jaccard._Family(how, sets, keys, keys % 4, np.zeros(len(sets), int))
    derived = 0
    for u, v in itertools.combinations(range(len(sets)), 2):
        both, union = np.intersect1d(family.sets[u], family.sets[v]).size, np.union1d(family.sets[u], family.sets[v]).size
        derived += (family.first.get(int(family.components[u])) not in (None, u))
        assert family.answers(u, v) == (100 * both >= how.percent * union)
    assert derived > 1_000


def test_partners_keep_every_link(monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    how, sets = jaccard.Similarity(3, 90), edited_sets(8, 80)
    spread = {}
    for s in sets:
        for t in s[:how.prefix(len(s))]:
            spread[int(t)] = spread.get(int(t), 0) + 1
    lists = {}
    for k, s in enumerate(sets):
        low = sorted((int(t) for t in s[:how.prefix(len(s))]), key=lambda t: (spread[t] > 1, t))
        shared = [t for t in low if spread[t] > 1]
        maps = [0] * jaccard.MAP
        for t in shared:
            maps[(t % (64 * jaccard.MAP)) // 64] |= 1 << (t % 64)
        for t in shared:
            lists.setdefault(t, []).append((0, True, 0, k, k, len(s), low.index(t), len(low) - len(shared), max(shared), *np.array(maps, np.uint64).view(np.int64)))
    kept, met = set(), set()
    for rows in lists.values():
        columns = {name: np.array(c) for name, c in zip(jaccard.POSTING, zip(*rows))}
        kept |= {rows[i][3] for i in np.flatnonzero(jaccard._List(how, columns).partners())}
        met |= set(columns["k"].tolist())
    linked = {k for u, v in itertools.combinations(range(len(sets)), 2) for k in (u, v)
              if 100 * np.intersect1d(sets[u], sets[v]).size >= how.percent * np.union1d(sets[u], sets[v]).size}
    assert linked and linked <= kept <= met


def test_components_of_messy_rows(spark, messy):
    how = jaccard.Similarity(3, 90)
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    got = sorted((tuple(r) for r in jaccard.jaccard_components(messy, how).collect()), key=repr)
    assert got == expected_components(rows, how)


def test_one_document_of_each_group_stays(spark, messy):
    how = jaccard.Similarity(3, 90)
    kept = jaccard.keep_one(messy, how)
    assert kept.columns == messy.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    found = expected_components([(r.doc_id, r.text) for r in messy.collect()], how)
    assert ids == sorted([c for _, n, c in set(found) if n and _ == c] + [d for d, n, _ in found if not n], key=repr)


def test_shingles_of_short_and_empty_texts():
    data, offsets = byte_column(pa.array(["a b", None, "A B", "a b c", "", "a  b\tc d"]))
    tokens, sizes = shingles(*word_hashes(data, offsets), 3)
    assert sizes.tolist() == [1, 0, 1, 1, 0, 2]
    assert tokens[0] == tokens[1] and tokens[2] in tokens[3:]


def test_chain_is_one_component(spark):
    rng = random.Random(3)
    keys = [rng.getrandbits(62) for _ in range(200)]
    edges = spark.createDataFrame(list(zip(keys, keys[1:])) + [(5, 6), (6, 5), (7, 7)], "a long, b long")
    found = {r.k: r.c for r in components(edges).collect()}
    assert len({found[k] for k in keys}) == 1 and found[5] == found[6] and 7 not in found and len(found) == 202


def test_long_chain_keeps_its_pace(spark):
    rng = random.Random(6)
    keys = [rng.getrandbits(62) for _ in range(100_000)]
    found = components(spark.createDataFrame(list(zip(keys, keys[1:])), "a long, b long"))
    assert found.count() == len(keys) and found.select("c").distinct().count() == 1


def removed_by_hand(rows):
    seen, out = {}, {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                gone[p:p + 100] = True
            else:
                seen[b[p:p + 100]] = 1
        left = bytes(x for x, g in zip(b, gone) if not g)
        edges = np.diff(np.concatenate(([0], gone.astype(int))))
        out[d] = (d, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(left).hexdigest())
    return out


def test_removed_bytes_match_brute_force(spark):
    rng = random.Random(7)
    passages = ["".join(rng.choice("ab cdé") for _ in range(rng.randint(60, 260))) for _ in range(8)]
    rows = []
    for d in rng.sample(range(1000), 70):
        parts = [rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("xyz uvw") for _ in range(rng.randint(1, 150))) for _ in range(rng.randint(0, 6))]
        rows.append((d, "".join(parts)))
    rows += [(2000, "q" * 450), (2001, "pq" * 300), (2002, None), (2003, rows[0][1]), (2004, "z" * 99), (2005, "ab" * 50 + "c"), (2006, "ab" * 50 + "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r) for r in repeats.without_repeats(docs).select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == removed_by_hand(rows)


@pytest.mark.parametrize("split", [10_000, 3])
def test_first_of_repeated_rows_keeps_its_text(spark, monkeypatch, split):
    """Rows equal in id and text, whose contexts others share in part: the first loses nothing to the second."""
    rng = random.Random(11)
    a = "".join(rng.choice("abcdefgh ") for _ in range(1200))
    rows = [(1, a), (1, a)]
    for i in range(10):
        at = rng.randint(0, 900)
        rows.append((10 + i, "".join(rng.choice("uvwxyz") for _ in range(50)) + a[at:at + rng.randint(110, 290)] + "".join(rng.choice("uvwxyz") for _ in range(50))))
    monkeypatch.setattr(repeats, "SPLIT_CONTEXTS", split)
    found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select(
        "doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = removed_by_hand(rows[1:])
    assert sorted(r.n_removed for r in found if r.doc_id == 1) == [0, 1200]
    assert {r.doc_id: tuple(r) for r in found if r.doc_id != 1} == {d: w for d, w in want.items() if d != 1}


def test_split_anchors_meet_again(spark, monkeypatch):
    """Contexts of one anchor in several shards give the same result."""
    rng = random.Random(9)
    core = "".join(rng.choice("abcdefgh ") for _ in range(130))
    rows = [(i, "".join(rng.choice("uvwxyz") for _ in range(rng.randint(0, 40))) + core[rng.randint(0, 20):] + "".join(rng.choice("uvwxyz") for _ in range(30)))
            for i in range(60)]
    monkeypatch.setattr(repeats, "SPLIT_CONTEXTS", 3)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 1_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r) for r in repeats.without_repeats(docs).select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == removed_by_hand(rows)


def test_parts_of_an_anchor_follow_its_contexts(spark):
    several = spark.createDataFrame([(7, 3_000_000), (-5, 20_000), (9, 10_000)], "anchor long, kinds long")
    known, parts = split = repeats._split_anchors(several)
    assert known.tolist() == [-5, 7] and parts.tolist() == [16, 300]
    context = np.random.default_rng(1).integers(-2**63, 2**63, 3_000_000)
    sizes = np.bincount(repeats._parts(split, np.full(len(context), 7), context))
    assert sizes[0] == 0 and len(sizes) == 301 and sizes.max() < 1.1 * repeats.SPLIT_CONTEXTS
    assert not repeats._parts(split, np.full(5, 9), context[:5]).any()


def test_repeats_of_messy_rows(spark, messy, no_docs):
    found = repeats.without_repeats(messy).select("doc.*", "n_bytes", "n_removed", "kept").collect()
    assert len(found) == messy.count() and [r for r in found if r.text is None and r.kept is None]
    prose = sorted((r.doc_id, r.n_removed) for r in found if r.text and r.text.startswith("the quick"))
    size = next(r.n_bytes for r in found if r.doc_id == 1)
    assert prose == [(1, 0), (2, size), (2, size), (11, size)]
    assert next(r.n_removed for r in found if r.doc_id == 9) == 499
    assert repeats.without_repeats(no_docs).count() == 0
    assert jaccard.jaccard_components(no_docs).count() == 0 and jaccard.keep_one(no_docs).count() == 0


def test_result_of_repeats_sends_no_texts_to_python(spark, monkeypatch):
    """What the caller runs has no Arrow step, and all that ran before had batches of few documents, with the same rows."""
    rng = random.Random(12)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(i, "".join(rng.choice("uvwxyz ä") for _ in range(rng.randint(0, 200))) + shared[rng.randint(0, 250):] * (i % 3)) for i in range(40)]
    rows += [(40, None), (41, ""), rows[5]]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(repeats, "BATCH_ROWS", 7)
    found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Python" not in plan
    lean = found.select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_id" in lean and " AS c0#" in plan and " AS c1#" in plan and " AS c1#" not in lean and "struct(" not in lean
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    got, want = found.select("doc.*", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept").collect(), removed_by_hand(rows[:-1])
    assert len(got) == len(rows) and sorted(r.n_removed for r in got if r.doc_id == 5) == sorted((want[5][2], len(rows[5][1].encode())))
    assert {r.doc_id: (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id != 5} == {d: w for d, w in want.items() if d != 5}
    assert all(r.kept == r.text for r in got if not r.n_removed) and any(r.n_removed and r.kept for r in got)


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(4)
    for size in (1, 2, 50, 400):
        text = rng.integers(0, 3, size).astype(np.uint16)
        order = repeats.suffix_array(text)
        suffixes = [tuple(text[i:]) for i in range(size)]
        assert [suffixes[i] for i in order] == sorted(suffixes)
        found = repeats.common_prefixes(text, order, np.array([0, size // 3]), np.array([size // 3, size]))
        for a, b in zip(order, order[1:]):
            same = 0
            while max(a, b) + same < size and text[a + same] == text[b + same]:
                same += 1
            assert found[b] == same


def test_suffixes_of_equal_symbols_end():
    """The end is less than any symbol, 0 too, however few symbols there are."""
    for size in (2, 3, 6, 7, 8, 30):
        text = np.zeros(size, np.uint16)
        order = repeats.suffix_array(text)
        assert order.tolist() == list(range(size))[::-1]
        assert repeats.common_prefixes(text, order, np.array([0]), np.array([size])).tolist() == [*range(size - 1, 0, -1), 0][:size]


def test_scan_of_prefixes_takes_steps_of_the_longest_stretch():
    """Stretches advance side by side, several symbols a step; none waits for another's long match."""
    rng = np.random.default_rng(6)
    passage = rng.integers(1, 5, 400)
    stretches = [np.append(np.concatenate((rng.integers(1, 5, 30), passage[a:a + 80], rng.integers(1, 5, 30))), 0) for a in rng.integers(0, 320, 200)]
    text = np.concatenate(stretches).astype(np.uint16)
    ends = np.cumsum([len(x) for x in stretches])
    order = repeats.suffix_array(text)
    lines = 0

    def count(frame, event, _):
        nonlocal lines
        if frame.f_code is not repeats.common_prefixes.__code__:
            return None
        lines += event == "line"
        return count

    before = sys.gettrace()
    sys.settrace(count)
    try:
        found = repeats.common_prefixes(text, order, ends - 141, ends)
    finally:
        sys.settrace(before)
    assert lines < 30 * 141
    for a, b in zip(order, order[1:]):
        most = len(text) - max(a, b)
        same = int(np.argmin(np.append(text[a:a + most] == text[b:b + most], False)))
        assert found[b] == same


def test_anchors_own_every_window_once():
    """The owner of a window follows from its bytes alone, and tests leave out the same anchors that a filter would."""
    rng = random.Random(3)
    shared = bytes(rng.choice(b"abc ") for _ in range(400))
    docs = [b"", b"x" * 99, b"y" * 300, shared[:250], b"ab" * 120, b"", shared[90:], b"q" * 40, shared[:100], b"z" * 100, shared[30:180]]
    offsets = np.cumsum([0] + [len(x) for x in docs])
    data = np.frombuffer(b"".join(docs), np.uint8)
    found = repeats.anchors(data, offsets)
    owned, by_bytes = [], {}
    for owner, anchor, _, first, last, *_ in zip(*(x.tolist() for x in found)):
        for p in range(first, last + 1):
            owned.append((owner, p - int(offsets[owner])))
            assert by_bytes.setdefault(data[p:p + 100].tobytes(), anchor) == anchor
    assert sorted(owned) == [(i, p) for i, x in enumerate(docs) for p in range(len(x) - 99)]
    kept = (found[1] % 2 == 0) & (found[2] % 3 != 0)
    fewer = repeats.anchors(data, offsets, lambda anchor: anchor % 2 == 0, lambda owner, context, first: context % 3 != 0)
    assert kept.any() and not kept.all() and all((a[kept] == b).all() for a, b in zip(found, fewer))
