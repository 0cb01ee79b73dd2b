import os
import random
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

WORDS = "the of and thing reason water stone river light under over seven green paper cloud glass".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ly", "er", "ing", "s"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with copies, near copies, shared passages, odd texts, nulls, repeated rows and clashing columns."""
    rng = random.Random(11)
    texts = [sentence(rng, rng.randint(30, 120)) for _ in range(24)]
    passage = sentence(rng, 55)
    line = "this line is one that a good many of the documents have"
    for k in range(6):
        words = texts[k].split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [texts[3]] * 4
    texts += [sentence(rng, 20) + " " + passage + " " + sentence(rng, 20) for _ in range(5)]
    texts += [sentence(rng, 12) + "\n" + line[:-1] + c + "\n" + sentence(rng, 15) for c in "eaio"]
    texts += ["", None, "x", "one two", "one two", "A b C d e", "a B c D e f", "é漢😀 " * 40, "z" * 5000, " \n\t ", "\n\n",
              "aaaa " * 300, sentence(rng, 6000)]
    rows = [(k, t, "en", f"s{k % 3}", None if t is None else len(t), k, "left", [k], 1.0) for k, t in enumerate(texts)]
    rows.append((None, texts[0], None, None, None, 0, None, None, None))
    schema = ("doc_id long, text string, lang string, source string, n_chars long, id long, side string, keys array<long>, "
              "score double")
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def repeated(corpus):
    """The same, its first rows twice."""
    return corpus.unionByName(corpus.where("doc_id < 5"))


@pytest.fixture(scope="session")
def nothing(corpus):
    return corpus.where("false")
