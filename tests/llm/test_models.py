"""Classifiers and language models against enumeration, plain versions and held-out labels."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from planspark.llm import language, perplexity, quality, toxicity
from planspark.llm.texts import byte_column
import pyarrow as pa

from conftest import rows


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([1, 4, 0, 3])
    features = rng.normal(size=(8, quality.WIDTH))
    field = quality.LineField(rng.normal(size=quality.WIDTH) / 4, rng.normal(size=(2, 2)))
    got, at = field.marginals(features, counts), 0
    odds = features @ field.weights
    for n in counts:
        total, good = 0.0, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=int(n)):
            p = math.exp(sum(odds[at + t] * y for t, y in enumerate(labels)) + sum(field.steps[a, b] for a, b in zip(labels, labels[1:])))
            total, good = total + p, good + p * np.array(labels)
        assert np.allclose(got[at:at + n], good / total)
        at += n


def held_out_rates(spark, sf, query, label):
    from planspark.llm.queries import QUERIES
    found = QUERIES[query](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    yes, no = [r.predicted for r in found if r[label] == 1], [r.predicted for r in found if r[label] == 0]
    return sum(yes) / max(len(yes), 1), sum(no) / max(len(no), 1)


def test_quality_on_held_out_documents(spark):
    kept, wrong = held_out_rates(spark, "/root/testdata/sf0.01", "op9_quality", "quality")
    assert kept > 0.97 and wrong < 0.1


def test_toxicity_on_held_out_documents(spark):
    found, wrong = held_out_rates(spark, "/root/testdata/sf0.01", "op3_toxicity", "toxic")
    assert found > 0.5 and wrong < 0.05


def test_naming_a_group_does_not_matter():
    """The training texts name one group mostly in toxic ones; the penalty takes the weight off the name."""
    rng = np.random.default_rng(3)
    filler = [f"word{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = list(rng.choice(filler, 8)) + (["idiot"] if toxic and rng.random() < 0.7 else [])
        words.append("women" if rng.random() < (0.9 if toxic else 0.1) else "men")
        texts.append(" ".join(words))
        labels.append(int(toxic))
    terms, counts = toxicity.term_buckets(*byte_column(pa.array(texts)))
    probe = byte_column(pa.array(["women like to read", "men like to read"]))
    gaps = []
    for fairness in (0.0, 20.0):
        model = toxicity.train(terms.astype(np.int64), counts, np.array(labels), fairness, prior=0.33)
        score = toxicity._scores(model.table(), model.bias, *probe)
        gaps.append(abs(score[0] - score[1]))
    assert gaps[0] > 0.2 and gaps[1] < gaps[0] / 3


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify])
def test_classifiers_on_messy_and_empty_tables(spark, messy, no_docs, some_labels, classify):
    got = classify(messy, some_labels).collect()
    assert len(got) == messy.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    same = [r.score for r in got if r.doc_id in (1, 2)]
    assert max(same) == min(same)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert classify(no_docs, some_labels).count() == 0
    assert {r.score for r in classify(messy, some_labels.filter("1 = 0")).collect()} == {0.5}


def test_quality_filter_keeps_columns(spark, messy):
    field = quality.LineField(np.zeros(quality.WIDTH), np.zeros((2, 2)))
    assert rows(quality.keep_good(messy, field, 0.5)) == rows(messy)
    assert quality.keep_good(messy, field, 0.6).count() == 0


def phrases_by_hand(text, known):
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in known:
            end += 1
        at = max(end - 1, at + 1) if text[at:at + 1] in known else at + 1
        count += 1
    return count


def test_phrases_match_a_plain_parse():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(0, 5, 80).astype(np.uint8)) for _ in range(2)]
    parser = language.Parser("abcd", texts)
    docs = [bytes(rng.integers(0, 5, n).astype(np.uint8)) for n in (0, 1, 7, 300, 512)]
    found = np.frombuffer(b"".join(docs), np.uint8)
    got = parser.phrases(found, np.concatenate(([0], np.cumsum([len(d) for d in docs]))))
    assert got.tolist() == [[phrases_by_hand(d, t) for d in docs] for t in texts]


def test_language_of_documents(spark, messy, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.99
    found = language.identify(messy).collect()
    by_id = {r.doc_id: r.lang_pred for r in found}
    assert len(found) == messy.count() and by_id[3] == by_id[4] == by_id[5] == "und" and by_id[1] == "en"
    assert all(0 <= r.score <= 1 for r in found)
    assert language.identify(no_docs).count() == 0


def test_languages_of_scripts_with_many_letters(spark):
    """Two languages of 300 letters each, all beyond the first 250 of the third, whose words are equally long."""
    rng = np.random.default_rng(2)
    def text(first, n=60):
        return " ".join("".join(chr(first + int(i)) for i in rng.integers(0, 300, 3)) for _ in range(n))
    rows = [(3 * i + k, text(first), name) for i in range(24) for k, (name, first) in enumerate((("a", 0x4E00), ("b", 0x5E00), ("c", 0x3400)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.held_out, r.lang_pred) for r in language.identify(docs).collect()}
    assert any(h for h, _ in got.values()) and all(got[i][1] == name for i, _, name in rows)
    data, offsets = byte_column(pa.array(["Äß1 東", None, "x"]))
    raw, bounds = language.letters(data, offsets)
    assert [raw[a:b].tobytes().decode() for a, b in zip(bounds, bounds[1:])] == ["äß\0東", "", "x"]


def test_training_reads_whole_texts(spark):
    """Few long documents whose text begins with another language's header give as much as many short ones."""
    rng = np.random.default_rng(8)
    def text(letters, n):
        return " ".join("".join(letters[int(i)] for i in rng.integers(0, len(letters), 5)) for _ in range(n))
    rows = [(i, text("abcdefgh", 400), "many") for i in range(0, 120)]
    rows += [(1000 + i, text("abcdefgh", 500) + " " + text("stuvwxyz", 6000), "rare") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, alphabet, texts = language.fit(docs)
    assert languages == ["many", "rare"] and all(0.9 * language.SYMBOLS <= len(t) <= 1.1 * language.SYMBOLS for t in texts)
    late = {alphabet.index(c) + 2 for c in b"stuvwxyz"}
    assert sum(c in late for c in texts[1]) > 0.6 * len(texts[1])
    probe = spark.createDataFrame([(5000, text("stuvwxyz", 100), None), (5001, text("abcdefgh", 100), None)], docs.schema)
    assert {r.doc_id: r.lang_pred for r in language.identify(docs.union(probe)).collect() if r.doc_id >= 5000} == {5000: "rare", 5001: "many"}


def test_perplexity_counts_match_brute_force(spark, messy, no_docs):
    got = perplexity.perplexity(messy).collect()
    texts = [(r.doc_id, r.text) for r in messy.collect()]
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, t in texts if d is not None and not held(d) for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((str(d), held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total,
                   round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens(t)), 6)) for d, t in texts)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert perplexity.perplexity(no_docs).count() == 0


def test_rare_words_are_joined(spark, monkeypatch):
    """With few frequent words at hand, the joined counts give the same sums."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    full = {r.doc_id: r for r in perplexity.perplexity(docs).collect()}
    monkeypatch.setattr(perplexity, "FREQUENT", 1_000)
    for r in perplexity.perplexity(docs).collect():
        assert r.n_known == full[r.doc_id].n_known and math.isclose(r.base_score, full[r.doc_id].base_score, rel_tol=1e-9)


def test_class_model_is_a_distribution_and_beats_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    corpus = perplexity.learn(docs.select("text"))
    assert np.allclose((10 ** corpus.model.steps).sum(1), 1)
    held = [r for r in perplexity.perplexity(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_exchange_only_gains():
    rng = np.random.default_rng(2)
    own = rng.integers(0, 4, 60)
    steps = rng.poisson(np.where((own[:, None] + 1) % 4 == own, 6.0, 0.2)).astype(float)
    found = perplexity.exchange(steps, 4, 10)
    pairs = Counter(zip(own, found))
    assert sum(n for n in Counter(dict(pairs)).values() if n >= 5) > 50
