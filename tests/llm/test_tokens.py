import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from cohortloom.llm import catalog, rans, token_counts, token_file
from cohortloom.llm.byte_pairs import encoder, tokenizer_file
from cohortloom.llm.piece_transducer import transducer

SMALL = "/root/testdata/sf0.001"
PARTS = [*" \n\t\r\x85\xa0\u3000abcXYé中😀ª²0123'!.,_—▁\x00", "the", "tion", "<|endoftext|>", "</s>"]
MIXED = st.lists(st.sampled_from(PARTS), max_size=30).map("".join)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(3, "of the", "x"), (None, "null id", "x"), (1, None, "x"), (1, "", "x"), (2, "same", "x"), (2, "same", "x"),
            (9, "long " * 200_000, "y"), (8, "nospace" * 30_000, "y"), (7, "  two  spaces\n\n", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string")


@settings(max_examples=300, deadline=None)
@given(MIXED)
def test_pieces_encode_like_the_library(text):
    own = encoder("byte_bpe_50k.json")
    got = np.frombuffer(own.encode(text), own.dtype).tolist()
    assert got == own.memo.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(MIXED, st.integers(1, 9))
def test_composed_maps_count_like_the_library(text, size):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    machine, full = transducer("piece_bpe_32k.model"), " " + text if text else ""
    maps = [machine.chunk_map(full[i : i + size]) for i in range(0, len(full), size)]
    assert machine.total(machine.scan(maps)) == len(model.encode(text))


def test_transducer_bounds_do_not_change_counts(monkeypatch):
    from cohortloom.llm import piece_transducer

    text = "Thereof the intertwined stations are\nnational"
    want = transducer("piece_bpe_32k.model").count_segment(text)
    monkeypatch.setattr(piece_transducer, "STATE_SIZE", 3)
    monkeypatch.setattr(piece_transducer, "MEMO_SIZE", 1)
    fresh = piece_transducer.Transducer(tokenizer_file("piece_bpe_32k.model"))
    assert [fresh.count([text, text, text]) for _ in range(3)] == [3 * want] * 3


@pytest.mark.parametrize("n", [1, 2, 63, 64, 5000, 300_000])
def test_blocks_round_trip_and_check_sums(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 40_000).astype(np.uint32)
    symbols, counts = np.unique(ids, return_counts=True)
    bits = rans.table_bits(len(symbols))
    freq = rans.scaled_frequencies(symbols, counts, bits)
    assert freq.sum() == 1 << bits and freq.min() > 0
    table = rans.Table.of(symbols, freq, bits)
    block = rans.encode(ids, table, max(1, min(512, n // 64)), 16)
    assert (rans.decode(block, table) == ids).all()
    block.sums[-1] ^= 1
    with pytest.raises(ValueError):
        rans.decode(block, table)


def test_joined_crc32():
    a, b, c = b"one" * 999, b"two" * 500_000, b"x"
    assert token_file.joined_crc32([(zlib.crc32(p), len(p)) for p in (a, b, c)]) == zlib.crc32(a + b + c)


def brute_file(rows):
    """(doc_id, start, n, crc) in key order; equal keys stay a multiset."""
    library = encoder("byte_bpe_50k.json").memo.encode
    out = []
    for key, text in rows:
        ids = [*library(text or "", add_special_tokens=False).ids, 0]
        out.append((key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return out


def test_token_file_against_brute_force(spark):
    docs = catalog.table(spark, SMALL, "documents").select("doc_id", "text").collect()
    got = sorted(catalog.QUERIES["op1_token_file"](spark, SMALL).collect())
    start, want = 0, []
    for key, n, crc in sorted(brute_file(docs)):
        want.append((key, start, n, crc))
        start += n
    assert [tuple(r)[:4] for r in got] == want


def test_token_file_of_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK_TOKENS", 5000)
    path = token_file.default_path(spark)
    token_file.write(odd, path, "byte_bpe_50k.json")
    got = sorted(token_file.read(spark, path).collect(), key=lambda r: r.start)
    assert sorted(((r.key is not None, r.key or 0), r.n_tokens, r.ids_crc32) for r in got) == sorted(
        ((k is not None, k or 0), n, c) for k, n, c in brute_file(odd.select("doc_id", "text").collect()))
    assert [r.key for r in got] == [None, 1, 1, 2, 2, 3, 7, 8, 9]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert max(r.n_pieces for r in got) > 10
    ids = sorted(token_file.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert sum(len(r.ids) for r in ids) == 4 * at


def test_token_file_of_nothing(spark, odd):
    path = token_file.default_path(spark)
    token_file.write(odd.where("false"), path, "byte_bpe_50k.json")
    assert token_file.read(spark, path).count() == 0


def test_counts_against_the_library(spark, odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    for docs in (catalog.table(spark, SMALL, "documents"), odd):
        texts = [(r.doc_id, r.text or "") for r in docs.collect()]
        got = token_counts.count(docs, "piece_bpe_32k.model", chunk=1 << 12).collect()
        want = [(k, len(t.encode()), len(model.encode(t))) for k, t in texts]
        key = lambda x: (x[0] is not None, *[v or 0 for v in x])
        assert sorted([(r.doc_id, r.n_bytes, r.n_tokens) for r in got], key=key) == sorted(want, key=key)
        assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert token_counts.count(odd.where("false"), "piece_bpe_32k.model").count() == 0
    clash = odd.withColumn("n_tokens", odd.start)
    assert token_counts.count(clash, "piece_bpe_32k.model", keep=["doc_id", "n_tokens"]).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_memo_goes_with_its_task(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some text, some more")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    run, own = token_file.tokenise(docs, "byte_bpe_50k.json"), encoder("byte_bpe_50k.json")
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some text, some more"])], names=["key", "text"])
    out = list(run(iter([batch])))
    assert [np.frombuffer(b["ids"][0].as_py(), own.dtype).tolist()[:-1] for b in out] == [
        own.memo.encode("some text, some more", add_special_tokens=False).ids]
    assert not own.memo


def test_written_file_leaves_no_second_copy_of_the_ids(spark, odd):
    from cohortloom.storage import shared_folder

    before = set(os.listdir(shared_folder(spark).removeprefix("file://")))
    token_file.write(odd, token_file.default_path(spark), "byte_bpe_50k.json")
    new = set(os.listdir(shared_folder(spark).removeprefix("file://"))) - before
    assert [x.rsplit("-", 1)[0] for x in new] == ["token-file"]
