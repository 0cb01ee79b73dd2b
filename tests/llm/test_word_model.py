"""The toxicity model over words: held-out rows in every language, and the joins beyond broadcasts."""

import math
import random
from collections import Counter

import pytest

from stintwise.llm import toxicity
from stintwise.llm.queries import QUERIES, TOXIC_HELD_OUT
from tests.llm.test_scores_and_urls import MEDIUM, made_up, mean_rank_auc


def test_held_out_toxicity_in_every_language(spark):
    scores = QUERIES["op3_toxicity"](spark, MEDIUM).where("held_out")
    rows = scores.join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id") \
        .join(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang"), "doc_id") \
        .select("score", "toxic", "lang").collect()
    found = {lang: mean_rank_auc([(r.score, r.toxic) for r in rows if r.lang == lang]) for lang in ("de", "en", "es", "fr")}
    found["all"] = mean_rank_auc([(r.score, r.toxic) for r in rows])
    print(found)
    assert found["all"] >= 0.95 and min(found.values()) >= 0.9


def test_words_and_predecessors():
    before, word, counts = toxicity.pairs_of(["Bomenteí x9, bomenteí", None, "…", "漢字 ok", "नमस्ते"], {})
    assert counts.tolist() == [3, 0, 0, 3, 1]
    assert word[0] == word[2] and before.tolist() == [0, word[0], word[1], 0, word[3], word[4], 0]
    assert len(set(word.tolist())) == 6


def test_continuation_counts_by_brute_force(spark):
    docs = spark.createDataFrame([("a b a b", 0, 0), ("a b", 1, 1), ("", 1, 0), ("b a", 1, 0)], "text string, label int, fold int")
    a, b = toxicity.word_ids(["a", "b"], {})
    pairs = toxicity.counted(docs)
    assert sorted(map(tuple, pairs.collect())) == sorted([(0, a, 0b1001), (a, b, 0b1001), (b, a, 0b0101), (0, b, 0b0100)])
    assert {r.word: tuple(r)[1:] for r in toxicity.continuations(pairs).collect()} == {a: (2, 2, 2, 2, 1, 2), b: (1, 2, 2, 1, 1, 2)}


def plain_model(texts):
    """(words -> (ordinary, toxic) probability, unknown) of (text, label), word by word."""
    seen = [set(), set(), set()]
    for text, label in texts:
        words = text.split()
        for pair in zip([""] + words, words):
            seen[label].add(pair)
            seen[2].add(pair)
    counts = [Counter(w for _, w in s) for s in seen]

    def kept(c, w):
        return max(counts[c][w] - off[c], 0) / sum(counts[c].values())

    off = []
    for c in counts:
        ones, twos = (sum(v == k for v in c.values()) for k in (1, 2))
        off.append(min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones else 0.75)
    free = [o * len(c) / sum(c.values()) for o, c in zip(off, counts)]
    even = free[2] / (len(counts[2]) + 1)
    known = {w: tuple(kept(c, w) + free[c] * (kept(2, w) + even) for c in (0, 1)) for w in counts[2]}
    return known, (free[0] * even, free[1] * even)


def test_differences_by_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [(" ".join(rng.choice(vocabulary[:40] if label else vocabulary[10:]) for _ in range(rng.randrange(1, 350))), label)
             for label in [0, 0, 0, 1] * 8]
    known, unknown = plain_model(texts)
    training = spark.createDataFrame([(t, y, 0) for t, y in texts], "text string, label int, fold int")
    model = toxicity.contrast(toxicity.stored_table(toxicity.continuations(toxicity.counted(training)), "kinds"), "k")
    asked = [t for t, _ in texts] + ["w1 never seen", "neverseen", "", "…", " ".join(["w1"] * 100 + ["w50"] * 101)]
    got = {r.doc_id: r for r in model.differences(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")).collect()}
    for k, text in enumerate(asked):
        words = text.replace("…", "").split()
        n = -(-len(words) // toxicity.PASSAGE)
        passages = [[w for i, w in enumerate(words) if i * n // len(words) == p] for p in range(n)]
        best = max((math.log(sum((known.get(w, unknown)[1] / known.get(w, unknown)[0]) ** toxicity.POWER for w in p) / len(p)) / toxicity.POWER
                    for p in passages), default=0.0)
        assert got[k].difference == pytest.approx(best) and got[k].rows == 1


def test_probabilities_sum_to_one(spark):
    docs, labels = made_up(spark, 60)
    model = toxicity.learnt(docs, labels.selectExpr("doc_id", "toxic as label"), "false")
    words = model.words.collect()
    assert len(words) == model.size
    for c in (0, 1):
        assert sum(r[f"p{c}"] for r in words) + model.unknown[c] == pytest.approx(1)


def test_texts_of_one_id_keep_their_own_scores(spark):
    docs, labels = made_up(spark, 60)
    model = toxicity.learnt(docs, labels.selectExpr("doc_id", "toxic as label"), "false")
    many = spark.createDataFrame([(None, "quazzil quazzot"), (None, "a b"), (None, None)], "doc_id long, text string")
    assert len({r.score for r in toxicity.scored(many, model).collect()}) == 3


@pytest.mark.parametrize("most", [0, 10 ** 6])
def test_repeated_rows_keep_their_scores(spark, most, monkeypatch):
    docs, labels = made_up(spark, 60)
    model = toxicity.learnt(docs, labels.selectExpr("doc_id", "toxic as label"), TOXIC_HELD_OUT)
    once = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    monkeypatch.setattr(toxicity, "BROADCAST_WORDS", most)
    many = docs.unionByName(docs.where("doc_id < 5")).unionByName(spark.createDataFrame([(None, "a"), (7, None)], docs.schema))
    rows = toxicity.scored(many, model).collect()
    assert len(rows) == 67
    for r in rows:
        if r.doc_id is not None and r.doc_id != 7:
            assert r.score == pytest.approx(once[r.doc_id])
