"""Classifiers on held-out rows, URL rules by brute force, the pipeline and the registry."""

import random
import zlib

import duckdb
import pytest

import corpus_pipeline
from stintwise.llm import jaccard, linededup, quality, suffixes, toxicity, urlfilter
from stintwise.llm.queries import LEAST, ORACLE, QUALITY_HELD_OUT, QUERIES, TOXIC_HELD_OUT, URL_RULES

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.1"


def mean_rank_auc(pairs):
    pairs = sorted(pairs)
    ranks = [k for k, (_, y) in enumerate(pairs) if y]
    ones, zeros = len(ranks), len(pairs) - len(ranks)
    return (sum(ranks) - ones * (ones - 1) / 2) / (ones * zeros)


@pytest.mark.parametrize("name, label, modulus, remainder, least", [
    ("op1_quality_classifier", "quality", 5, 0, 0.97), ("op3_toxicity", "toxic", 4, 2, 0.95)])
def test_held_out_accuracy(spark, name, label, modulus, remainder, least):
    rows = QUERIES[name](spark, MEDIUM).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= LEAST)
    assert mean_rank_auc([(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]) >= least


def made_up(spark, n=400):
    """Texts in which every fifth is toxic by its words, and every fourth of low quality by its marks."""
    rng = random.Random(9)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        toxic, low = k % 5 == 0, k % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "qua" + rng.choice(["zzil", "zzot", "zzum"]))
        if low:
            words = [w + rng.choice(["***", "%%%", "$$$"]) for w in words]
        docs.append((k, " ".join(words).capitalize() + "."))
        labels.append((k, int(not low), int(toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_both_models_learn(spark):
    docs, labels = made_up(spark)
    found = quality.with_features(docs)
    model = quality.learnt(found, labels.selectExpr("doc_id", "quality as label"), QUALITY_HELD_OUT)
    contrast = toxicity.learnt(docs, labels.selectExpr("doc_id", "toxic as label"), TOXIC_HELD_OUT)
    truth = {r.doc_id: r for r in labels.collect()}
    for scores, label in ((quality.scored(found, model), "quality"), (toxicity.scored(docs, contrast), "toxic")):
        assert mean_rank_auc([(r.score, truth[r.doc_id][label]) for r in scores.collect()]) >= 0.97


def test_odd_texts_and_missing_labels(spark, corpus, repeated, nothing):
    docs, labels = made_up(spark, 100)
    found = quality.with_features(docs)
    named = labels.selectExpr("doc_id", "quality as label")
    model = quality.learnt(found, named, "false")
    contrast = toxicity.learnt(docs, labels.selectExpr("doc_id", "toxic as label"), "false")
    for frame in (corpus, repeated, nothing):
        for scores in (quality.scored(quality.with_features(frame), model), toxicity.scored(frame, contrast)):
            rows = scores.collect()
            assert len(rows) == frame.count() and all(0 <= r.score <= 1 for r in rows)
    kept = quality.accepted(corpus, model, 0.0)
    assert kept.columns == corpus.columns and sorted(map(str, kept.collect())) == sorted(map(str, corpus.collect()))
    assert quality.learnt(found, named.where("false"), "false").score(quality.features(*_buffer(["a", ""]))).tolist() == [0.5, 0.5]
    assert quality.learnt(found, named.where("label = 1"), "false").score(quality.features(*_buffer(["a"]))).tolist() == [1.0]
    only = toxicity.learnt(docs, labels.selectExpr("doc_id", "0 as label"), "false")
    assert [r.score for r in toxicity.scored(corpus, only).collect()] == [0.0] * corpus.count()


def _buffer(texts):
    import pyarrow as pa

    from stintwise.llm.common import text_buffer

    return text_buffer(pa.array(texts))


def test_a_text_scores_alike_in_any_company(spark):
    """Scores of a text do not depend on what else its batch holds."""
    docs, labels = made_up(spark, 100)
    contrast = toxicity.learnt(docs, labels.selectExpr("doc_id", "toxic as label"), "false")
    texts = ["", "Some words", "quazzil", "é漢 don't", "  ", "Some words", "x"]

    def scores(some):
        found = toxicity.scored(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), contrast)
        return [r.score for r in sorted(found.collect())]

    assert scores(texts) == pytest.approx([scores([t])[0] for t in texts])
    whole = quality.features(*_buffer(texts))
    assert all((whole[k] == quality.features(*_buffer([t]))[0]).all() for k, t in enumerate(texts))


def verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3] if fits else None, max(fits)[2] if fits else "allow")


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://ORG/", "http://a.example.org/en/1", "http://example.org/en/12?x#y",
            "https://x.EXAMPLE.org/es/z", "ftp://notexample.org/es/", "http://a.com/fr/1", "http://a.com/de/", "http://com/de",
            "http://a.com?/fr/", "http://a.com#/de/", "x://y://z.com/de/1", "http://É.com/de/ü", "http://a..org/", "http://org",
            "http://a.com/de/" + "y" * 5000, "http://.com/fr/"] * 2
    rows = [(k, u, "mine", "mine", 1, "h") for k, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, host string, best int, digest string")
    rules = spark.createDataFrame(URL_RULES + URL_RULES[:2], "host string, path string, verdict string")
    got = urlfilter.judge_urls(pages, rules)
    assert sorted(got.columns) == sorted(["page_id", "url", "best", "digest", "host", "path", "rule", "verdict"])
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert found == {k: verdict(u, URL_RULES) for k, u in enumerate(urls)}
    assert urlfilter.judge_urls(pages.where("false"), rules).collect() == []
    assert {r.verdict for r in urlfilter.judge_urls(pages, rules.where("false"), "block").collect()} == {"block"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(ORACLE[name])
    frame = QUERIES[name](spark, SMALL)
    assert sorted(frame.columns) == sorted(want.columns)
    assert sorted(map(str, frame.select(*want.columns).collect())) == sorted(f"Row({', '.join(f'{c}={v!r}' for c, v in zip(want.columns, r))})" for r in want.fetchall())


def test_pipeline_stages(spark, tmp_path):
    """Every stage works on what the one before it kept and returns the columns of documents."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, before, SMALL)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        old = {r.doc_id: r for r in before.collect()}
        new = {r.doc_id: r for r in after.collect()}
        assert new.keys() <= old.keys()
        if name == "quality_classifier":
            assert all(new[d] == old[d] for d in new) and len(new) < len(old)
        if name == "line_dedup":
            want = {r.doc_id: r.kept_sha256 for r in linededup.digests(before).collect()}
            from hashlib import sha256
            assert {d: sha256(r.text.encode()).hexdigest() for d, r in new.items()} == want
        if name == "ngram_jaccard_join":
            want = {r.doc_id for r in jaccard.components_of(before).collect() if r.component_id == r.doc_id}
            assert new.keys() == want and all(new[d] == old[d] for d in new)
        if name == "suffix_array_dedup":
            want = {r.doc_id: r.n_removed for r in suffixes.digests(before).collect()}
            assert new.keys() == old.keys()
            assert all((new[d].text == old[d].text) == (want[d] == 0) for d in new)
        assert all(r.n_chars == len(r.text) for r in new.values())
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SMALL).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in before.collect()}
