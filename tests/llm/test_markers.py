"""Token ids of texts that hold the tokenizer's own markers, against the tokenizer as loaded."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from strandline.llm import packing
from strandline.llm.queries import tokenizer_path

MARKED = ["a <|endoftext|> b", "<|startoftext|>", "word<|endoftext|>word", "A <|ENDOFTEXT|> B", "<|endoftext", "é <|startoftext|> 漢", "no marker, 12.5%"]


def test_markers_are_added_tokens(spark):
    whole, ids = Tokenizer.from_file(tokenizer_path()), packing.Ids(tokenizer_path())
    expected = {i: np.array(whole.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes() for i, t in enumerate(MARKED)}
    assert ids.split and len(expected[0]) == 4 * 4
    assert [ids(t) for t in MARKED] == list(expected.values())
    pieces = packing.pack(spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string").coalesce(1), tokenizer_path()).collect()
    at = {i: 0 for i in expected}
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        data = expected[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(data) // 4
        assert r["ids_crc32"] == zlib.crc32(data[4 * r["start"] : 4 * (r["start"] + r["length"])])
        at[r["doc_id"]] += r["length"]
    assert all(at[i] == len(d) // 4 for i, d in expected.items())
