"""Toxicity: class-conditional Kneser-Ney models of words, with shared backoff counts.

Words are runs of letters, marks and digits, case folded and not folded otherwise; a letter of a
script that sets no spaces between words (Han, Kana) is a word. Both classes, toxic and ordinary,
have an interpolated Kneser-Ney distribution of words: a word counts once for every distinct word it
follows in the class (its continuation count), less the discount that the counts of counts give, and
what the discounts free is given out by the continuation counts of both classes together. Those
shared counts back off in turn to a uniform share of all known words and one unknown. A word that a
class has rarely or never seen therefore stands near its shared probability in both classes.

The order above, pairs given the word before, is left out: contexts seen a few times then decide
(README has the figures, by folds of the training rows).

A toxic text is mostly ordinary words, so texts are compared passage by passage: a text is cut in
even passages of at most PASSAGE words. The difference of a passage is the logarithm of the mean
over its words of (toxic / ordinary likelihood) ** POWER, divided by POWER, and so does not grow with
length; POWER towards 0 gives the plain mean of log-likelihoods. A text's difference is that of its most
toxic passage, the score a logistic of it.

Counts come from all labelled training texts and grow with them. They and the model are tables:
texts' words are joined to them, by a broadcast only where they were counted to be few. Slope and
intercept are fitted on a quarter of the training rows, scored by a model of the other three
quarters, so they don't see the model's own texts; the model that scores is then made from all counts.
Words stand in the tables by 64-bit hashes.

Defined results: null texts and texts without words have difference 0. Without training rows of both
classes the score is the share of toxic training rows, 0 without any. Repeated rows are scored, and
repeated labels learnt, row by row. Other columns of the documents are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.llm.common import logistic, mix, slices, stored_table
from stintwise.llm.linkage import BROADCAST_ROWS

#: PASSAGE and POWER were chosen by folds of the training rows alone.
PASSAGE, POWER, DISCOUNT = 100, 2, 0.75
#: Cells to a unit of difference in which the calibration rows are counted.
CELLS = 200
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}"
WORD = regex.compile(rf"(?V1)[{UNSPACED}]|[\p{{L}}\p{{M}}\p{{N}}--[{UNSPACED}]]+")
#: Up to so many words a task keeps the hashes of.
REMEMBERED = 500_000
#: Up to so many words, as counted, the model is broadcast (a hash and a ratio each, about 200 MB in an executor); beyond it
#: texts' words are shuffled to it.
BROADCAST_WORDS = 4_000_000


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def word_ids(words: list[str], known: dict[str, int]) -> list[int]:
    """64-bit hashes, none of them 0, which stands for the start of a text."""
    if len(known) > REMEMBERED:
        known.clear()
    for w in set(words).difference(known):
        known[w] = digest(w) or 1
    return [known[w] for w in words]


def pairs_of(texts: list[str | None], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every word's predecessor (0 at a text's start) and the word, end to end; the number of each text's words."""
    found = [WORD.findall((t or "").casefold()) for t in texts]
    counts = np.array([len(f) for f in found], np.int64)
    word = np.array(word_ids([w for f in found for w in f], known), np.int64)
    before = np.concatenate([[0], word[:-1]]).astype(np.int64)[:len(word)]
    starts = np.cumsum(counts) - counts
    before[starts[counts > 0]] = 0
    return before, word, counts


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one row of each distinct key, and how many rows have it."""
    mixed = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        mixed = mix(mixed * np.uint64(3) + k.view(np.uint64))
    order = np.argsort(mixed, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(mixed[order]) != 0])[:len(order)])
    return order[first], np.diff(np.append(first, len(order)))


def counted(training: DataFrame) -> DataFrame:
    """before, word and seen over all training texts: bit 2 * label + fold is set where such a row holds the pair."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in slices(batches, "text"):
            before, word, counts = pairs_of(batch.column("text").to_pylist(), known)
            part = np.repeat(1 << (batch.column("label").to_numpy() * 2 + batch.column("fold").to_numpy()), counts).astype(np.int64)
            at, _ = runs(before, word, part)
            yield pa.RecordBatch.from_arrays([pa.array(before[at]), pa.array(word[at]), pa.array(part[at].astype(np.int32))],
                                             ["before", "word", "seen"])

    return training.mapInArrow(rows, "before long, word long, seen int") \
        .groupBy("before", "word").agg(F.bit_or("seen").alias("seen"))


def continuations(pairs: DataFrame) -> DataFrame:
    """Per word, how many distinct words it follows: in ordinary (k0), toxic (k1) and all (k2) training rows, and t0, t1,
    t2 the same over the rows of fold 0."""
    kinds = {"k": (0b0011, 0b1100, 0b1111), "t": (0b0001, 0b0100, 0b0101)}
    return pairs.groupBy("word").agg(*(
        F.count_if(F.col("seen").bitwiseAND(F.lit(bits)) != 0).alias(f"{name}{c}")
        for name, masks in kinds.items() for c, bits in enumerate(masks)))


def text_words(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a digest of the text), passage, word, n: the distinct words of every passage.

    A row of passage -1 stands for the text itself; its word is the mark, so that such rows don't meet in one task of a join.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            _, word, counts = pairs_of(texts, known)
            row = np.repeat(np.arange(len(texts)), counts)
            place = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts)
            passage = place * (-(-counts // PASSAGE))[row] // np.maximum(counts, 1)[row]
            at, n = runs(word, row, passage)
            at = at[order := np.argsort(at)]
            n = n[order]
            mark = np.array([digest(t or "") for t in texts], np.int64)
            row, whole = np.concatenate([row[at], np.arange(len(texts))]), np.ones(len(texts), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(mark[row]), pa.array(np.concatenate([passage[at], -whole])),
                 pa.array(np.concatenate([word[at], mark])), pa.array(np.concatenate([n, whole]))],
                ["doc_id", "mark", "passage", "word", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        rows, "doc_id long, mark long, passage long, word long, n long")


def discount(ones: int | None, twos: int | None) -> float:
    return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones else DISCOUNT


@dataclass
class Contrast:
    """Words with their probabilities in ordinary (p0) and toxic texts (p1) and the logistic over the difference."""

    words: DataFrame | None = None
    size: int = 0
    unknown: tuple[float, float] = (1.0, 1.0)
    slope: float = 1.0
    intercept: float = 0.0
    fixed: float | None = None

    def differences(self, docs: DataFrame) -> DataFrame:
        """doc_id, mark, difference and the number of rows that have them."""
        rare = self.unknown[1] / self.unknown[0]
        ratios = self.words.select("word", (F.col("p1") / F.col("p0")).alias("ratio"))
        found = text_words(docs).join(F.broadcast(ratios) if self.size <= BROADCAST_WORDS else ratios, "word", "left") \
            .groupBy("doc_id", "mark", "passage").agg(
                F.sum(F.col("n") * F.pow(F.coalesce("ratio", F.lit(rare)), F.lit(POWER))).alias("total"), F.sum("n").alias("n"))
        own = F.col("passage") < 0
        return found.groupBy("doc_id", "mark").agg(
            F.coalesce(F.max(F.when(~own, F.log(F.col("total") / F.col("n")) / POWER)), F.lit(0.0)).alias("difference"),
            F.sum(F.when(own, F.col("n"))).alias("rows"))


def contrast(kinds: DataFrame, name: str) -> Contrast:
    """The two models from a stored table of continuation counts, of which the columns ``name`` 0 to 2 are taken."""
    kinds = kinds.where(f"{name}2 > 0").select("word", *(F.col(f"{name}{c}").alias(f"c{c}") for c in range(3)))
    found = kinds.agg(*(f for c in range(3) for f in (
        F.sum(f"c{c}"), F.count_if(F.col(f"c{c}") > 0), F.count_if(F.col(f"c{c}") == 1), F.count_if(F.col(f"c{c}") == 2)))).first()
    totals, types = [found[4 * c] or 0 for c in range(3)], [found[4 * c + 1] for c in range(3)]
    offs = [discount(*found[4 * c + 2:4 * c + 4]) for c in range(3)]

    def kept(c: int) -> Column:
        return F.greatest(F.col(f"c{c}") - offs[c], F.lit(0.0)) / F.lit(totals[c] or 1)

    # What each model's discounts free: all of it where a class has no words.
    free = [offs[c] * types[c] / totals[c] if totals[c] else 1.0 for c in range(3)]
    even = free[2] / (types[2] + 1)
    words = kinds.select("word", *((kept(c) + free[c] * (kept(2) + even)).alias(f"p{c}") for c in (0, 1)))
    return Contrast(stored_table(words, "words"), types[2], (free[0] * even, free[1] * even))


def learnt(docs: DataFrame, labels: DataFrame, held_out: str) -> Contrast:
    """Learn from the labelled documents (labels: doc_id, label) for which ``held_out`` is not true."""
    known = labels.where("label in (0, 1)").where(f"not ({held_out})").select(
        "doc_id", F.col("label").cast("int").alias("label"),
        (F.pmod(F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string"))), F.lit(4)) == 0).cast("int").alias("fold"))
    # Few labels, as counted, are broadcast; for more the texts are shuffled to them.
    few = known.count() <= BROADCAST_ROWS
    training = docs.where(f"not ({held_out})").select("doc_id", "text").join(F.broadcast(known) if few else known, "doc_id") \
        .select("doc_id", "text", "label", "fold")
    sizes = {(r[0], r[1]): r[2] for r in known.join(docs.select("doc_id"), "doc_id").groupBy("label", "fold")
             .count().collect()}
    ordinary, toxic = (sizes.get((c, 0), 0) + sizes.get((c, 1), 0) for c in (0, 1))
    if not (ordinary and toxic):
        return Contrast(fixed=toxic / (ordinary + toxic) if toxic else 0.0)
    kinds = stored_table(continuations(counted(training)), "continuations")
    model = contrast(kinds, "k")
    if not all(sizes.get((c, f)) for c in (0, 1) for f in (0, 1)):
        # Too few rows to set some aside: calibrate on the training rows themselves.
        trial, rows = model, training
    else:
        trial, rows = contrast(kinds, "t"), training.where("fold = 1")
    # A document's labels are told apart by count: repeated labels repeat its rows, in pairs and in sums alike.
    of = known.groupBy("doc_id").agg(*(F.count_if(F.col("label") == c).alias(f"y{c}") for c in (0, 1)))
    cell = F.floor(F.col("difference") * CELLS)
    seen = trial.differences(rows).join(of, "doc_id").groupBy(cell.alias("cell")).agg(
        *(F.sum(F.col("rows") * F.col(f"y{c}") / (F.col("y0") + F.col("y1"))) for c in (0, 1))).collect()
    cells, ordinary, toxic = np.array(seen, dtype=float).T
    model.slope, model.intercept = logistic((cells + 0.5) / CELLS, ordinary, toxic)
    return model


def scored(docs: DataFrame, model: Contrast) -> DataFrame:
    """doc_id and score of every row."""
    if model.fixed is not None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(float(model.fixed)).alias("score"))
    found = model.differences(docs)
    at = F.greatest(F.least(F.col("difference") * model.slope + model.intercept, F.lit(500.0)), F.lit(-500.0))
    return found.select("doc_id", (1 / (1 + F.exp(-at))).alias("score"), F.explode(F.expr("array_repeat(0, cast(rows as int))"))) \
        .select("doc_id", "score")
