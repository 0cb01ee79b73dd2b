"""Ids of texts that hold the vocabulary's added token, against the library's default settings."""

import json

import pytest
from tokenizers import Tokenizer

from stintwise.llm import packing
from stintwise.llm.queries import tokenizer_path

MARK = "<|endoftext|>"
TEXTS = [f"a {MARK} b", MARK, MARK * 3, f"  {MARK}  ", f"x\n\n{MARK}\n\ny {MARK[:-1]} {MARK.upper()}", f"é漢{MARK}😀 don't", "plain  text "]


def test_marks_in_texts(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in packing.pack_documents(docs, path, ids=True).collect()}
    assert got == {k: tokenizer.encode(t, add_special_tokens=False).ids + [packing.END_ID] for k, t in enumerate(TEXTS)}
    assert got[0] == [64, 220, 50256, 275, packing.END_ID]


def test_added_tokens_with_rules_of_their_own_are_refused(tmp_path):
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as file:
        whole = json.load(file)
    whole["added_tokens"][0]["lstrip"] = True
    path = tmp_path / "odd.json"
    path.write_text(json.dumps(whole), encoding="utf-8")
    with pytest.raises(ValueError, match="added token"):
        packing.load_encoder(str(path))


@pytest.mark.parametrize("text", [" " * 3_000_000, "\n" * 3_000_000, "a" * 3_000_000, "." * 3_000_000, "word " * 10 + "\t\n" * 600_000 + "end"],
                         ids=["blanks", "feeds", "letters", "marks", "mixed"])
def test_runs_of_any_length_have_the_library_ids(text):
    path = tokenizer_path("byte_bpe_50k.json")
    assert packing.ids_of(path, text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
