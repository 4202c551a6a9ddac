"""Token files: the coding by itself, and the query against the tokenizers library alone."""

import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandline.llm import token_files
from strandline.llm.common import fresh_path
from strandline.llm.queries import tokenizer_path
from tests.llm.conftest import prose, rows

PATH = tokenizer_path("byte_bpe_50k.json")
KIND = "doc_id long, text string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=40))
def test_numbers_come_back(numbers):
    numbers = np.array(numbers, np.uint32)
    control, data = token_files.encode(numbers)
    assert len(control) == -(-len(numbers) // 4)
    assert len(data) == sum(max(1, -(-int(n).bit_length() // 8)) for n in numbers) + -len(numbers) % 4
    assert token_files.decode(control, data, len(numbers)).tolist() == numbers.tolist()


def test_bytes_by_hand():
    control, data = token_files.encode(np.array([5, 300, 70_000, 1 << 24, 255], np.uint32))
    assert control == bytes([0 | 1 << 2 | 2 << 4 | 3 << 6, 0])
    assert data == bytes([5, 44, 1, 112, 17, 1, 0, 0, 0, 1, 255, 0, 0, 0])


def test_a_block_never_holds_its_separator():
    docs = [(d, len(x), b"".join(token_files.encode(np.array(x, np.uint32)))) for d, x in ((7, [1, 2, 3]), (None, [9]), (-3, [70_000, 0]))]
    plain = token_files.block(4, 1 << 40, docs)
    assert plain[0] == 0
    masked = token_files.block(4, 1 << 40, docs, separator=plain[30:34])
    assert masked[0] and plain[30:34] not in masked and len(masked) == len(plain)
    for data in (plain, masked):
        found = [(s, b, d, r.tolist()) for s, b, d, r in token_files.documents_in(data)]
        assert found == [(4, 1 << 40, 7, [1, 2, 3]), (4, (1 << 40) + 3, None, [9]), (4, (1 << 40) + 4, -3, [70_000, 0])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aZé'stlrevmd1 \n\t.", max_size=40), st.text("aé's \n.×\xa0漢<|\0", max_size=9)), max_size=6), st.sampled_from((3, 1 << 20)))
def test_short_way_is_the_tokenizer(texts, longest):
    """Texts laid out together, long ones in pieces, give what the tokenizer gives for each."""
    ids = token_files.ids_of(PATH)
    assert ids.parted
    ids.longest = longest
    found = ids(texts)
    ids.longest = 1 << 20
    assert [x.tolist() for x in found] == [[*ids.long(t or ""), 2] for t in texts]


def test_forgetting_and_colliding_parts():
    ids, texts = token_files.ByteIds(PATH), [prose(i, 40) for i in range(30)]
    whole = [[*ids.long(t), 2] for t in texts]
    ids.most = 10
    for t, w in zip(texts, whole):
        assert ids([t])[0].tolist() == w
    ids.checks = ids.checks + np.uint64(1)  # as if other parts had the same hashes
    assert [x.tolist() for x in ids(texts[-1:])] == whole[-1:]


def expected(table):
    """Rows in ascending id order; of one id in any order, so by their ids' crc and length."""
    tok = Tokenizer.from_file(PATH)
    out = [(doc, np.array([*(tok.encode(text, add_special_tokens=False).ids if text else []), 2], "<u4").tobytes()) for doc, text in table]
    return [(d, len(x) // 4, zlib.crc32(x)) for d, x in out]


def check(found, table):
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found)
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    ids = [d for _, d, *_ in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    key = lambda r: (r[0] is not None, *(x or 0 for x in r))
    assert sorted((tuple(r[1:]) for r in got), key=key) == sorted(expected(table), key=key)


def test_query(spark, docs, empty):
    found = token_files.query(docs, PATH)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    check(found.collect(), [r[:2] for r in rows()])
    assert token_files.query(empty, PATH).collect() == []


def test_markers_repeated_ids_and_negative_ids(spark):
    r = random.Random(1)
    table = [(r.choice((None, 5, -9, i)), r.choice(("a <|endoftext|> b", "x\x1e<ids>\ny", prose(i, 30), "", None, "漢字 é"))) for i in range(300)]
    check(token_files.query(spark.createDataFrame(table, KIND).repartition(5), PATH).collect(), table)


def test_many_files_and_blocks(spark):
    """Small blocks and shards: the files hold all ids in order, and are read by parts."""
    table = [(i * 7 % 400, prose(i, i % 50)) for i in range(400)]
    docs, path = spark.createDataFrame(table, KIND).repartition(4), fresh_path(spark, "test-token-files")
    token_files.write(docs, path, PATH, ids_a_block=100, ids_a_shard=5_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    found = sorted((r["shard"], r["before"], r["doc_id"], bytes(r["ids"])) for r in token_files.read(spark, path).collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[-1][0] > 3 and [d for _, _, d, _ in found] == sorted(d for d, _ in table)
    want = {d: (n, c) for d, n, c in expected(table)}
    assert all((len(x) // 4, zlib.crc32(x)) == want[d] for _, _, d, x in found)


def test_codings_of_several_at_once():
    r = random.Random(3)
    for lengths in ([], [1], [0, 3, 0], [4, 5, 1, 8, 0, 0, 7]):
        many = [np.array([r.choice((r.randrange(256), r.randrange(70_000), r.randrange(2**32))) for _ in range(n)], np.uint32) for n in lengths]
        assert token_files.encode_each(many) == [b"".join(token_files.encode(x)) for x in many]


def test_rows_are_dealt_straight_from_the_stored_table(spark, monkeypatch):
    dealt = []
    real = type(spark.range(1)).repartitionByRange

    def seen(df, *args):
        dealt.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *args)

    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", seen)
    token_files.write(spark.createDataFrame([(1, "one"), (2, None)], KIND), fresh_path(spark, "test-token-files"), PATH)
    assert len(dealt) == 1 and "InArrow" not in dealt[0] and "doc_id" in dealt[0]


def test_parts_learnt_in_any_order_are_found_again():
    ids, texts = token_files.ByteIds(PATH), [prose(i, 60) + " é" * (i % 3) + " don't\t12" for i in range(40)]
    for t in random.Random(2).sample(texts * 2, 80):
        assert ids([t])[0].tolist() == [*ids.long(t), 2]
    assert (ids.keys[1:] > ids.keys[:-1]).all() and sorted(ids.numbers.tolist()) == list(range(len(ids.keys)))
