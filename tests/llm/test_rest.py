"""Decontamination, mixing, neighbours, urls and the pipeline."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from planspark.llm import decontamination, mixing, neighbours, urls
from planspark.sources.shared import settle, settle_with

from conftest import rows


def least_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_bit_parallel_distance_matches_the_table():
    rng = random.Random(1)
    for _ in range(200):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 120)))
        assert decontamination.Pattern(item).distance(text) == least_distance(item, text)


def test_items_are_found_within_their_budget(spark, messy, no_docs):
    rng = random.Random(2)
    letters = "abcdefghij"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 40)))) for i in range(12)] + [(50, None), (51, "!?"), (52, "")]
    docs = []
    for d in range(80):
        k, text = rng.choice(items[:12])
        chars = list(text)
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(chars))
            rng.choice([lambda: chars.__setitem__(at, rng.choice(letters)), lambda: chars.pop(at), lambda: chars.insert(at, rng.choice(letters))])()
        docs.append((d, " ".join([word() for _ in range(20)] + ["".join(chars).upper()] + [word() for _ in range(20)])))
    want = []
    for d, text in docs:
        for k, item in items:
            form = decontamination.normal(item)
            if form:
                near = least_distance(form, decontamination.normal(text))
                if near <= decontamination.budget(len(form)):
                    want.append((d, k, near, decontamination.budget(len(form))))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert rows(decontamination.contaminated(frame, benchmark)) == sorted(want, key=repr)
    assert rows(decontamination.contaminated(frame, benchmark, block_chars=500)) == sorted(want, key=repr)
    kept = decontamination.keep_clean(frame, benchmark, block_chars=500)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {w[0] for w in want}
    assert decontamination.contaminated(no_docs, benchmark).count() == 0
    assert decontamination.contaminated(messy, benchmark.filter("1 = 0")).count() == 0
    assert rows(decontamination.keep_clean(messy, benchmark)) == rows(messy)


def test_targets_and_takes(spark, messy, no_docs):
    got = mixing.mix(messy).collect()
    assert len(got) == messy.count() and all(r.taken <= 2 * r.size for r in got)
    by_source = {r.source: (r.source_size, r.target) for r in got}
    assert sum(t for _, t in by_source.values()) == pytest.approx(1.5 * sum(s for s, _ in by_source.values()))
    assert all(t <= 2 * s for s, t in by_source.values())
    assert rows(mixing.mix(messy)) == rows(mixing.mix(messy))
    out = mixing.emit(messy)
    assert out.columns == [*messy.columns, "mix_copy"]
    assert out.count() == sum(r.copies for r in got)
    assert mixing.mix(no_docs).count() == 0 and mixing.emit(no_docs).count() == 0


def test_takes_come_near_the_targets(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 5 as int)) as text", "concat('s', id % 4) as source")
    got = mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) < 0.06 * r["max(target)"] for r in got)


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[1000:1400] = x[1000]
    x[100] = x[200] = x[101]
    data = [(int(i), [float(v) for v in row], "label") for i, row in enumerate(x)]
    data += [(9000, None, ""), (9100, [0.0] * 24, ""), (9200, [float("nan")] + [1.0] * 23, ""), (9300, [float("inf")] + [1.0] * 23, ""), (9400, [None] + [1.0] * 23, ""),
             (9500, [1.0], ""), (None, [1.0] * 24, "")]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, u string")
    hits = 0
    # cells of 256 vectors, so that the graph has to be refined, by as many rounds as it takes
    got = {}
    for r in neighbours.nearest(frame, cell=256, beam=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 100))
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(abs(d[v] - s) < 1e-12 for _, v, s in found)
        hits += len(set(best) & {f[1] for f in found})
    assert hits / (10 * len(got)) >= 0.9
    assert [f[1] for f in sorted(got[1000])] == list(range(1001, 1011)) and sorted(got[100])[0][1] == 101 and sorted(got[100])[1][1] == 200


def test_walk_ends_when_nothing_is_left_to_expand(spark):
    nodes = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "u long, x array<float>")
    chain = spark.createDataFrame([(i, [j for j in (i - 1, i + 1) if 0 <= j < 20], [1.0] * (2 if 0 < i < 19 else 1), [0] * (2 if 0 < i < 19 else 1)) for i in range(20)], neighbours.LISTS)
    found = neighbours.search(chain, nodes, spark.createDataFrame([(0,)], "q long"), beam=8).collect()
    assert sorted(r.v for r in found) == list(range(1, 9))


def test_a_step_of_the_walk_is_one_query_of_few_jobs(spark):
    nodes = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "u long, x array<float>")
    chain = spark.createDataFrame([(i, [j for j in (i - 1, i + 1) if 0 <= j < 20], [1.0] * 2, [0] * 2) for i in range(20)], neighbours.LISTS)
    chain, nodes, starts = settle(chain), settle(nodes), settle(spark.createDataFrame([(0,), (19,)], "q long"))
    jobs = []
    for hops in (2, 6):
        spark.sparkContext.setJobGroup(f"walk {hops}", "")
        try:
            neighbours.search(chain, nodes, starts, beam=30, hops=hops)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"walk {hops}")))
    assert (jobs[1] - jobs[0]) / 4 <= 7  # 8 when a step was two queries, one more to see whether nodes are left


def test_totals_come_with_the_stored_rows(spark):
    kept, (number, most) = settle_with(spark.range(1000), F.count(F.lit(1)), F.max("id"))
    assert (kept.count(), number, most) == (1000, 1000, 999)
    kept, (number, most) = settle_with(spark.range(1000).filter("id < 0"), F.count(F.lit(1)), F.max("id"))
    assert (kept.count(), number, most) == (0, 0, None)


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(frame).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert neighbours.nearest(frame.filter("vec_id = 0")).count() == 0
    assert neighbours.nearest(frame.filter("1 = 0")).count() == 0


def test_hosts_rules_and_spread(spark):
    pages = [(1, "HTTP://Blog.Example.COM/en/x?q=/z#f", None), (2, "http://www.example.com/en/1", ""), (3, "https://a.net/es/1", "<a href='http://B.net/x'>"),
             (4, "https://b.net/de/", "<a href=//a.net/es/2>"), (5, None, "x"), (6, "no url", None), (7, "ftp://net", None), (8, "http://ÄB.org?x", None),
             (9, "http://notexample.com/en/", None), (9, "http://notexample.com/en/", None), (10, "http://x.com", None), (11, "http://c.org/", "<a href=http://a.net/es/>" * 3)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    from planspark.llm.queries import URL_RULES
    got = {r.page_id: r for r in urls.judge(frame, URL_RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("blog.example.com", "/en/x", "example.com/en/", "block")
    assert (got[2].rule, got[2].verdict) == ("www.example.com/en/", "allow")
    assert (got[3].rule, got[3].verdict) == ("net/es/", "block") and got[4].rule is None
    assert (got[5].host, got[5].path, got[5].rule, got[5].verdict) == ("", "", None, "allow") and got[6].host == ""
    assert got[7].host == "net" and got[8].host == "Äb.org" and (got[9].rule, got[9].verdict) == ("com/", "allow")
    assert got[10].rule is None and got[10].path == ""
    # Distrust runs against the links: who links to a blocked host is distrusted, a linked host is trusted by its linkers.
    assert got[11].distrust > 0 and got[8].distrust == 0 and got[3].distrust > got[11].distrust
    assert urls.judge(frame, URL_RULES).count() == len(pages)
    assert urls.judge(frame.filter("1 = 0"), URL_RULES).count() == 0


def test_propagation_matches_power_steps(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 4), ("d", "a", 1)]
    seeds = {"a": (0.5, 0.0), "b": (0.2, 0.1), "c": (0.0, 0.6), "d": (0.1, 0.0)}
    names = sorted(seeds)
    m = np.zeros((4, 4))
    for s, t, w in edges:
        m[names.index(s), names.index(t)] = w
    walk = lambda m, v: _power(m, v)
    trust, distrust = walk(m, np.array([seeds[n][0] for n in names])), walk(m.T, np.array([seeds[n][1] for n in names]))
    got = {r.host: (r.trust, r.distrust) for r in urls.propagate(
        spark.createDataFrame(edges, "src string, dst string, weight long"),
        spark.createDataFrame([(n, *v) for n, v in seeds.items()], "host string, trust_seed double, distrust_seed double"), tolerance=1e-7).collect()}
    for i, n in enumerate(names):
        assert got[n] == pytest.approx((trust[i], distrust[i]), abs=1e-6)


def test_distrust_reaches_far_hosts(spark):
    """A chain of 30 links to a blocked host: every host on it is distrusted."""
    edges = [(f"h{i}", f"h{i + 1}", 1) for i in range(30)]
    seeds = [(f"h{i}", 0.0, 1.0 if i == 30 else 0.0) for i in range(31)]
    found = urls.propagate(spark.createDataFrame(edges, "src string, dst string, weight long"),
                           spark.createDataFrame(seeds, "host string, trust_seed double, distrust_seed double"), tolerance=1e-6)
    assert {r.host: r.distrust for r in found.collect()} == pytest.approx({f"h{i}": 0.15 * 0.85 ** (30 - i) for i in range(31)}, abs=1e-5)
    assert min(r.distrust for r in found.collect()) > 0


def test_many_sources_settle(spark):
    """Each round fills one more source: more rounds than any fixed bound would be kind to."""
    from planspark.llm import mixing
    rows = [(i, f"s{i:02}", " ".join(["w"] * (3 ** min(i, 9)))) for i in range(14)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights=(1,)).collect()
    total = sum(r.source_size for r in out)
    assert sum(r.target for r in out) == pytest.approx(1.5 * total) and all(r.target <= 2 * r.source_size for r in out)


def _power(m, seed, rounds=300):
    sums = m.sum(1, keepdims=True)
    p = np.divide(m, sums, out=np.zeros_like(m), where=sums > 0)
    v = seed.copy()
    for _ in range(rounds):
        v = 0.85 * v @ p + 0.15 * seed
    return v


def test_pipeline_stages(spark):
    """Every stage's decision takes effect and clean documents stay."""
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = corpus_pipeline.quality_filter(spark, docs, sf)
    assert good.columns == docs.columns
    left = {r.doc_id for r in good.collect()}
    assert sum(labels[d] == 1 for d in labels if d in left) >= 0.95 * sum(v == 1 for v in labels.values())
    assert sum(labels[d] == 0 for d in labels if d in left) <= 1
    from planspark.llm import jaccard
    from .test_pairs import expected_components
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = {c for _, _, c in expected_components(texts, jaccard.Similarity(5, 80))}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()} == want
    from .test_pairs import removed_by_hand
    gone = removed_by_hand(texts)
    shorter = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, docs, sf).collect()}
    assert set(shorter) == {d for d, x in gone.items() if x[2] < x[1] or x[2] == 0}
    for d, t in texts:
        if gone[d][2] == 0:
            assert shorter[d].text == t
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*docs.columns, "mix_copy"] and out.count() > 0
