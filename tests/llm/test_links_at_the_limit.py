"""Pairs that are just near enough, in groups whose leader is near to neither of them."""

import random

import pyarrow as pa

from stintwise.llm import jaccard, linkage


def test_triangle_cut_keeps_exact_links(spark):
    """0.55 - 0.30 exceeds 0.25 in doubles, yet the two are 0.25 apart."""
    sets = {1: range(14), 2: range(5, 20), 3: range(20)}
    keys = spark.createDataFrame([(7, i, 5 if i == 1 else 1) for i in sets], "k long, id long, weight long")
    payload = spark.createDataFrame([(i, " ".join(f"w{n}" for n in range(s.start, s.stop + 4))) for i, s in sets.items()],
                                    "id long, text string")
    ready = jaccard.prepared(pa.array([r.text for r in payload.orderBy("id").collect()]))
    far = jaccard.jaccard_distances([ready[0], ready[0], ready[1]], [ready[1], ready[2], ready[2]]).tolist()
    assert far == [0.55, 0.3, 0.25] and far[0] - far[1] > 0.25
    found = linkage.linked(keys, payload, jaccard.prepared, jaccard.jaccard_distances, 0.25)
    assert {(r.id, r.component) for r in found.collect()} == {(2, 2), (3, 2)}


def test_parts_of_one_text_beside_copies(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        words = [f"w{rng.randrange(10 ** 9)}" for _ in range(24)]
        for n, part in enumerate([words[:18]] * 4 + [words[5:], words]):
            rows.append((10 * k + n, " ".join(part)))
    got = {r.doc_id: r.component_id
           for r in jaccard.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 10 + (4 if d % 10 > 3 else 0) for d, _ in rows}
