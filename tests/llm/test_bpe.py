"""Byte-level BPE against the public library that defines its results, and on odd tables."""

import hashlib
import random
import struct

import pytest

from sluice.llm import bpe, catalog

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, ids string, `doc id` int"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(catalog.MERGES)


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges.read(catalog.MERGES)


def some(r):
    parts = ["a", "b", "the", " ", "  ", "\n", "\r\n", "1", "23", "'s", "'re", "'", "é", "é", "ß", "日", "!", "?!", "\t",
             "<|endoftext|>", "ing", "ation", "\x00", "\x1c", "\x85", "​", "　", "\U0001f469‍"]
    odd = lambda: chr(r.choice([r.randrange(0x20, 0x3000), r.randrange(0x3000, 0xD800), r.randrange(0x10000, 0x34000)]))
    return "".join(odd() if r.random() < 0.1 else r.choice(parts) for _ in range(r.randrange(50)))


def texts():
    r = random.Random(3)
    fixed = ["", " ", "  a  b\n\n c", "<|endoftext|>", "x<|endoftext|> y  <|endoftext|>", "<|endoftext", "a" * 1250,
             "it's I'll 're'd  ", "x" * 3000, "abab" * 300, "՘ ࢏1 ՘a", "ends in spaces   "]
    return fixed + [some(r) for _ in range(1500)]


def test_ids_are_those_of_the_library(library, merges):
    rows = texts()
    want = [library.encode(t, add_special_tokens=False).ids for t in rows]
    assert [x.tolist() for x in bpe._ids_of(rows, bpe.Encoder(merges))] == want
    one = bpe.Encoder(merges)
    assert [one.encode(t).tolist() for t in rows] == want
    for t, ids in zip(rows, want):
        assert merges.decode(one.encode(t)) == library.decode(ids, skip_special_tokens=False) == t


def test_every_letter_is_cut_as_in_the_library(library):
    for c in [*range(1, 0x3000), *range(0xA000, 0xD800), *range(0xF900, 0x11000), *range(0x16000, 0x1F000, 3), *range(0x2A000, 0x34000, 5)]:
        t = f"a1{chr(c)}a1{chr(c)}! {chr(c)}{chr(c)} "
        assert sum(bpe.words_of(t), []) == [t[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(t)], hex(c)


def test_blocks_and_a_full_memory_change_nothing(library, merges, monkeypatch):
    rows = texts()[:400] + ["ab 12 c3d4!? " * 50]
    want = [library.encode(t, add_special_tokens=False).ids for t in rows]
    monkeypatch.setattr(bpe, "BLOCK", 5)
    monkeypatch.setattr(bpe, "MEMORY", 7)
    one = bpe.Encoder(merges)
    assert [one.encode(t).tolist() for t in rows] == want
    assert [x.tolist() for x in bpe._ids_of(rows, bpe.Encoder(merges))] == want


def test_bytes_that_are_no_text(library, merges):
    ids = [157, 121, 0, 255, 188, 50256, 157]
    import numpy as np

    assert merges.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def small(tmp_path, merges):
    import json

    letters = {b: c for c, b in bpe._byte_letters().items()}
    vocab = {letters[b]: b for b in range(256)} | {m.replace(" ", ""): 256 + k for k, m in enumerate(merges)}
    cut = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    told = {"version": "1.0", "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": cut, "pre_tokenizer": cut,
            "model": {"type": "BPE", "vocab": vocab, "merges": merges}}
    (tmp_path / "t.json").write_text(json.dumps(told))
    return str(tmp_path / "t.json")


def test_runs_and_overlaps(tmp_path):
    path = small(tmp_path, ["a a", "b a", "aa a", "aa aa", "c aa", "ba ba", "aaa b", "caa a"])
    lib, own = tokenizers.Tokenizer.from_file(path), bpe.Encoder(bpe.Merges.read(path))
    r = random.Random(5)
    for _ in range(2000):
        t = "".join(r.choice("aaabc ") for _ in range(r.randrange(30)))
        assert own.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe.Merges.read("/opt/tokenizers/word_bpe_49k.json")
    with pytest.raises(ValueError):
        bpe.Merges.read(small(tmp_path, ["a b", "bc a", "b c"]))


def test_query_over_the_whole_table(spark, library):
    rows = {r["doc_id"]: r for r in catalog.op12_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert tuple(rows[d["doc_id"]])[1:] == want


def test_odd_tables(spark, library, merges, monkeypatch):
    long = "Long words " * 30_000 + "z" * 50_000
    rows = [(1, None, "x", 0), (1, "", "x", 0), (None, "the same", None, 0), (None, "the same", None, 0), (2, long, "x", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = bpe.encode(docs, merges)
    assert got.columns == ["doc_id", "ids"]
    want = sorted((-1 if i is None else i, library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows)
    assert sorted((-1 if r[0] is None else r[0], r[1]) for r in got.collect()) == want
    back = sorted((-1 if r[0] is None else r[0], r[1]) for r in bpe.decode(got, merges).collect())
    assert back == sorted((-1 if i is None else i, t or "") for i, t, *_ in rows)
    empty = bpe.round_trip(docs.where("false"), merges)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
