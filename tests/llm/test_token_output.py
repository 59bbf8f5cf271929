import heapq
import random
import zlib
from array import array

import numpy as np
import pytest

from outing.llm import token_output
from outing.llm.token_output import Codebook, code_lengths, read_digests, read_tokens, write_tokens
from outing.llm.tokens import Encoder, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def huffman_size(counts):
    heap, total = sorted(counts), 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


def test_lengths_are_huffmans_where_the_limit_is_far_and_complete_where_it_binds():
    rng = np.random.default_rng(1)
    for n in (2, 3, 17, 900):
        counts = rng.integers(1, 50, n)
        bits = code_lengths(counts, 30 - 5)
        assert (counts * bits).sum() == huffman_size(counts.tolist())
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    bits = code_lengths(np.array(fibonacci), 8)
    assert bits.max() == 8 and (0.5**bits).sum() == 1 and (np.diff(bits) <= 0).all()
    assert code_lengths(np.array([5])).tolist() == [1]


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 1000, 5003])
def test_a_block_comes_back(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.2, n), 60_000).astype(np.int64)
    found, counts = np.unique(ids, return_counts=True)
    book = Codebook(found, code_lengths(counts))
    assert (book.decode(n, *book.encode(ids)) == ids).all()
    text = "".join(f"{book.codes[k]:0{book.bits[k]}b}" for k in (np.flatnonzero(book.ids == i)[0] for i in ids))
    assert book.encode(ids)[1] == int(text + "0" * (-len(text) % 8), 2).to_bytes((len(text) + 7) // 8, "big")


def test_round_trip_with_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK", 700)
    rng = random.Random(4)
    words = ["run", "Ünï", "x1", "naïve,", "it's", "日本語", "end.", "\n", "\t", "  ", "<|endoftext|>", "😀"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "long word " * 5000), (5, "again"), (5, "again"), (None, "a"), (None, "b"), (2**60 + 1, "z")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, ids string")
    write_tokens(docs.repartition(7), str(tmp_path / "out"), PATH)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    plain = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
    got = sorted(read_tokens(spark, str(tmp_path / "out")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 2 + sorted(i for i, _ in rows if i is not None)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, list(r.ids)) for r in got], key=key) == sorted([(i, plain(t)) for i, t in rows], key=key)
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids)
    digests = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in read_digests(spark, str(tmp_path / "out")).collect()}
    assert digests == {(r.doc_id, r.start): (len(r.ids), zlib.crc32(array("I", r.ids).tobytes())) for r in got}
    files = sorted((tmp_path / "out" / "blocks").glob("*.parquet"))
    firsts = [spark.read.parquet(str(f)).selectExpr("min(part)", "max(part)").first() for f in files]
    assert [tuple(r) for r in firsts] == sorted(tuple(r) for r in firsts)


def test_empty_table(spark, tmp_path):
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "out"), PATH)
    assert read_digests(spark, str(tmp_path / "out")).collect() == []


def test_words_by_space_are_the_tokenizers():
    from tokenizers import Tokenizer

    tokenizer, mine, rng = Tokenizer.from_file(PATH), Encoder(PATH), random.Random(2)
    parts = [*"ab'stRE12.,!-_ \n\t\r\x0b\x1c\x85\xa0é世ß😀 ", "<|endoftext|>", "'s", "'ll", "  ", " \n", "İ", "Ａ", "٣", "²", "½."]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert mine.ids([text])[0] == array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes(), text
