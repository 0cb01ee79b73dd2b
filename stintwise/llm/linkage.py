"""Connected components of a similarity join whose candidates meet in lists.

Two items may be similar only if they share a key. A list (the items of a key) is never
expanded into its pairs. Instead each list names a leader and every item is tested against
the leaders of its lists, a number of rows that grows with the lists and not with their
squares. Items that the tests link are one component, and two of one component need no test.
What is left are pairs of different components that were tested against the same leader;
of those the triangle inequality leaves only pairs whose distances to the leader differ by no
more than the limit. They are tested in cells of bounded blocks, so no group meets in one task.

No link is lost: similar items share a list, hence a leader, and are tested unless they are
already in one component or too far apart by the triangle inequality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.llm.common import components, stored_table

#: Items of a leader's group that go to one cell.
BLOCK = 512
#: Differences of rounded distances may exceed the true ones by less than this; the exact test decides.
MARGIN = 1e-9
#: Up to so many ids, or rows of a few numbers (50 MB), texts are found by a broadcast.
BROADCAST_IDS = BROADCAST_ROWS = 1_000_000

Prepare = Callable[[pa.Array], list]
Distances = Callable[[list, list], np.ndarray]
Outline = Callable[[list], np.ndarray]


def with_text(payload: DataFrame, cells: DataFrame) -> DataFrame:
    """The cells' items with their texts; the cells are broadcast only if they were counted to be few."""
    return payload.join(F.broadcast(cells) if cells.count() <= BROADCAST_ROWS else cells, "id")


def tested(cells: DataFrame, prepare: Prepare, distances: Distances, limit: float, links_only: bool,
           outline: Outline | None = None, apart: float = 0.0) -> DataFrame:
    """Test the left items of every cell against its right items: a, b, distance.

    ``cells`` has cell, side (0 left, 1 right), id, component, anchor (distance to the common
    leader, or null) and text. Rows stream by in order, only a cell's left items are held. An item
    that the payload has more than once counts once. With an ``outline``, a row of small numbers
    an item, pairs whose outlines differ by more than ``apart`` in sum are not measured.
    """
    parted = cells.repartition("cell").sortWithinPartitions("cell", "side", "id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, before, held, held_items = None, None, None, []
        for whole in batches:
            for batch in (whole.slice(a, 500) for a in range(0, whole.num_rows, 500)):
                ready = prepare(batch.column("text"))
                cell, side, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "side", "id"))
                component = batch.column("component").fill_null(0).to_numpy(zero_copy_only=False)
                known = batch.column("component").is_valid().to_numpy(zero_copy_only=False)
                anchor = batch.column("anchor").fill_null(np.nan).to_numpy(zero_copy_only=False)
                lines = outline(ready) if outline else np.zeros((len(ready), 0), np.int16)
                # An item that the payload had more than once follows itself.
                fresh = np.ones(len(ids), bool)
                fresh[1:] = (cell[1:] != cell[:-1]) | (side[1:] != side[:-1]) | (ids[1:] != ids[:-1])
                fresh[0] = (cell[0], side[0], ids[0]) != before
                before = (cell[-1], side[-1], ids[-1])
                cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
                left, right, a, b = [], [], [], []
                for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    if cell[start] != current:
                        current, held, held_items = cell[start], None, []
                    run = np.arange(start, end)[fresh[start:end]]
                    heads, tails = run[side[run] == 0], run[side[run] == 1]
                    if len(heads):
                        more = [ids[heads], component[heads], known[heads], anchor[heads], lines[heads]]
                        held = more if held is None else [np.concatenate(both) for both in zip(held, more)]
                        held_items += [ready[k] for k in heads.tolist()]
                    if held is None or not len(tails):
                        continue
                    near = (held[0] != ids[tails, None]) \
                        & ~(held[2] & known[tails, None] & (held[1] == component[tails, None])) \
                        & ~(np.abs(anchor[tails, None] - held[3]) > limit + MARGIN)
                    if outline:
                        far = np.zeros(near.shape, np.int16)
                        for here, there in zip(held[4].T, lines[tails].T):
                            far += np.abs(here - there[:, None])
                        near &= far <= apart
                    of_right, of_left = np.nonzero(near)
                    left += [held_items[k] for k in of_left.tolist()]
                    right += [ready[k] for k in tails[of_right].tolist()]
                    a.append(held[0][of_left])
                    b.append(ids[tails[of_right]])
                if not left:
                    continue
                d = distances(left, right)
                out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64()),
                                                  pa.array(d, pa.float64())], ["a", "b", "distance"])
                yield out.filter(pa.array(d <= limit)) if links_only else out

    return parted.mapInArrow(rows, "a long, b long, distance double")


def linked(keys: DataFrame, payload: DataFrame, prepare: Prepare, distances: Distances, limit: float,
           store_texts: bool = False, outline: Outline | None = None, apart: float = 0.0) -> DataFrame:
    """id, component for every item with a link; ``keys``: k, id, weight; ``payload``: id, text.

    ``store_texts`` keeps the texts of the items to test for the second round of tests, where
    they are dear to make and short. ``outline`` and ``apart`` are a lower bound for the second round,
    see ``tested``.

    The heaviest item of a list leads it, of equal ones the smallest. ``keys`` is read twice
    and should be a stored table.
    """
    leaders = keys.groupBy("k").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("top")) \
        .select("k", (-F.col("top.id")).alias("leader"))
    pairs = stored_table(keys.join(leaders, "k").where("id <> leader").select("leader", "id").distinct(), "pairs")
    # A leader's items are cut into cells by hash; the leader's own text goes to each of them.
    sizes = pairs.groupBy("leader").agg(F.count("*").alias("n"))
    split = pairs.join(sizes, "leader").select("leader", "id", F.xxhash64("leader", F.pmod(
        F.xxhash64("id"), F.ceil(F.col("n") / BLOCK))).alias("cell"))
    if store_texts:
        payload = stored_table(with_text(payload, pairs.select("id").union(pairs.select("leader")).distinct()), "texts")
    none = F.lit(None)
    members = split.select("cell", F.lit(1).alias("side"), "id")
    heads = split.select("cell", F.lit(0).alias("side"), F.col("leader").alias("id")).distinct()
    cells = stored_table(members.unionByName(heads).select(
        "cell", "side", "id", none.cast("long").alias("component"), none.cast("double").alias("anchor")), "cells")
    first = stored_table(tested(with_text(payload, cells), prepare, distances, limit, False), "leader_tests")
    links = first.where(F.col("distance") <= limit).select("a", "b")
    found = components(links)

    own = F.coalesce("component", "id")
    group = first.select(F.col("a").alias("leader"), F.col("b").alias("id"), F.col("distance").alias("anchor")) \
        .join(found, "id", "left").select("leader", "id", "anchor", own.alias("component"))
    of_leader = found.select(F.col("id").alias("leader"), F.col("component").alias("home"))
    group = stored_table(group.join(of_leader, "leader", "left").select(
        "leader", "id", "anchor", "component", (F.col("component") != F.coalesce("home", "leader")).alias("apart")), "groups")
    # Only groups with someone outside the leader's component, and somebody else near enough.
    sizes = group.groupBy("leader").agg(F.count("*").alias("n"), F.sum(F.col("apart").cast("long")).alias("n_apart"),
                                        F.min(F.when(F.col("apart"), F.col("anchor"))).alias("nearest")) \
        .where("n_apart > 0 and n > 1")
    rest = group.join(sizes, "leader").where(F.col("apart") | (F.col("anchor") >= F.col("nearest") - limit - MARGIN)).select(
        "leader", "id", "anchor", "component", "apart", F.ceil(F.col("n_apart") / BLOCK).alias("rows"),
        F.ceil(F.col("n") / BLOCK).alias("columns"))
    row, column = F.pmod(F.xxhash64("id"), "rows"), F.pmod(F.xxhash64("id", F.lit(7)), "columns")
    left = rest.where("apart").withColumn("column", F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1))) \
        .select(F.xxhash64("leader", row, "column").alias("cell"), F.lit(0).alias("side"), "id", "component", "anchor")
    right = rest.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))) \
        .select(F.xxhash64("leader", "row", column).alias("cell"), F.lit(1).alias("side"), "id", "component", "anchor")
    cells = stored_table(left.unionByName(right), "rest_cells")
    more = stored_table(tested(with_text(payload, cells), prepare, distances, limit, True, outline, apart), "rest_links")
    if not more.limit(1).count():
        return found
    return components(links.unionByName(more.select("a", "b")))
