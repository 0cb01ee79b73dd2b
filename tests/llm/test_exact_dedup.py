"""Counting quotient filters, and exact dedup against grouping in plain Python."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stintwise.llm import exactdedup as own


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([3, 8, 9, 17, 33, 63]).flatmap(lambda bits: st.tuples(
    st.just(bits), st.lists(st.dictionaries(st.integers(0, 2 ** bits - 1), st.sampled_from([1, 2, 3, 256, 257, 70_000, 2 ** 40]),
                                            max_size=40), max_size=4))))
def test_filters_merge_without_loss(case):
    bits, tables = case
    blobs, whole = [], Counter()
    for t in tables:
        values = sorted(t)
        blob = own.encoded(np.array(values, np.uint64), np.array([t[v] for v in values], np.uint64), bits)
        back, counts = own.decoded(blob)
        assert dict(zip(back.tolist(), counts.tolist())) == t and back.tolist() == values
        blobs.append(blob)
        whole.update(t)
    if blobs:
        back, counts = own.decoded(own.merged(blobs, bits))
        assert dict(zip(back.tolist(), counts.tolist())) == dict(whole) and back.tolist() == sorted(whole)


def test_a_filter_is_smaller_than_its_fingerprints():
    values = np.unique(np.random.default_rng(3).integers(0, 2 ** 60, 100_000, dtype=np.uint64))
    assert len(own.encoded(values, np.ones(len(values), np.uint64), 60)) < 11 * len(values)


def by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    want = []
    for text, ids in groups.items():
        largest = max((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda x: (x is not None, x), reverse=True):
            want.append((i, largest, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
            first = False
    return sorted(want, key=repr)


SETTINGS = [{}, {"bits": 6, "filter_rows": 7, "range_rows": 4}, {"bits": 5, "broadcast_rows": 0, "hot_rows": 3}]


@pytest.mark.parametrize("chosen", SETTINGS)
@pytest.mark.parametrize("name", ["corpus", "repeated", "nothing"])
def test_decisions_equal_grouping(spark, request, name, chosen):
    docs = request.getfixturevalue(name)
    got = own.decisions(docs, **chosen).drop("twins").collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in got), key=repr) == by_hand(rows)


@pytest.mark.parametrize("chosen", SETTINGS)
def test_deduplicated_keeps_whole_rows(spark, repeated, chosen):
    docs = repeated.withColumn("print", F.lit(5)).withColumn("digest", F.lit("x")).withColumn("row", F.lit(None))
    kept = own.deduplicated(docs, **chosen)
    assert kept.columns == docs.columns
    rows, all_rows = kept.collect(), docs.collect()
    assert len(rows) == len({r.text or "" for r in all_rows})
    best = {}
    for r in all_rows:
        t = r.text or ""
        best[t] = max(best.get(t, -1), -1 if r.doc_id is None else r.doc_id)
    assert {(r.text or "", -1 if r.doc_id is None else r.doc_id) for r in rows} == set(best.items())
    assert {tuple(map(str, r)) for r in rows} <= {tuple(map(str, r)) for r in all_rows}


def test_texts_are_compared_as_normalised(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in own.decisions(docs, F.lower).collect()}
    assert got == {1: (2, False), 2: (2, True), 3: (4, False), 4: (4, True)}


def test_one_text_for_a_third_of_the_rows(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 50))
                                    .otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text")).repartition(13)
    got = own.decisions(docs, broadcast_rows=0, hot_rows=100).collect()
    hot = [r for r in got if r.doc_id % 3 == 0]
    assert len(got) == 3000 and all(r.group_size == 1000 and r.keep_id == 2997 for r in hot) and sum(r.kept for r in got) == 2001
