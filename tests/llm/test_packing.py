import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from outing.llm.packing import best_fit_decreasing, lower_bound, pack_documents, pack_pieces, sequences
from outing.llm.tokens import Encoder, tokenizer_path

ODD = ["", "Hello's WORLD'LL  don't", "a\x1cb c\x1fd", "x y z　é é ΟΔΟΣ ΟΔΟΣ!", "<|endoftext|> a<|startoftext|>b",
       "12 345,6 ***!! ñandú ß", "́ start", "a" * 300, "\x85 ﻿x", "İstanbul ﬁ ½"]


def truth(text):
    return Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


def test_chunked_ids_equal_the_tokenizer():
    encode = Encoder(tokenizer_path())
    for _ in range(2):
        for text, got in zip(ODD, encode.ids(ODD)):
            assert np.frombuffer(got, "<u4").tolist() == truth(text), text


def test_bins_and_bounds():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = rng.integers(1, 101, size=rng.integers(1, 80))
        bins, offsets, fill = best_fit_decreasing(sizes, 100)
        at = defaultdict(list)
        for b, o, s in zip(bins, offsets, sizes):
            at[b].append((o, s))
        for b, items in at.items():
            end = 0
            for o, s in sorted(items):
                assert o == end
                end += s
            assert end == fill[b] <= 100
        assert -(-sizes.sum() // 100) <= lower_bound(np.bincount(sizes, minlength=101), 100) <= len(fill)
    assert lower_bound(np.bincount([60, 60, 60, 30], minlength=101), 100) == 3
    assert lower_bound(np.bincount([34] * 6, minlength=101), 100) == 3


def test_exchange_reaches_the_bound(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(1, 40), "x") for i in range(3000)] + [(9000 + i, 100, "y") for i in range(20)]
    pieces = spark.createDataFrame(rows, "uid long, length long, offsets string")
    packed, certificate = pack_pieces(pieces, 100, group_rows=200)
    got = packed.collect()
    assert sorted((r.uid, r.length, r.offsets) for r in got) == sorted(rows)
    assert len({r.sequence_id for r in got}) == certificate["sequences"] == certificate["bound"]
    assert certificate["rounds"] > 1


def test_small_partitions_reach_what_one_partition_does(spark):
    rng = np.random.default_rng(6)
    for sizes in (rng.integers(1, 4097, 6000), np.minimum(rng.geometric(1 / 900, 6000), 4096), rng.integers(1300, 1500, 3000)):
        pieces = spark.createDataFrame([(k, int(n)) for k, n in enumerate(sizes)], "uid long, length long")
        one = len(best_fit_decreasing(sizes, 4096)[2])
        packed, certificate = pack_pieces(pieces, 4096, group_rows=500)
        assert certificate["bound"] <= certificate["sequences"] <= one
        assert packed.select("sequence_id").distinct().count() == certificate["sequences"]
        # where partitions may not grow, the rounds end all the same
        least = pack_pieces(pieces, 4096, group_rows=500, most_rows=500)[1]
        assert least["bound"] <= least["sequences"]


def test_round_trip(spark):
    rng = random.Random(2)
    texts = ODD + [None, " ".join(rng.choice("the of and lorem ipsum dolor".split()) for _ in range(3000))]
    rows = [(i, t, "a", 1) for i, t in enumerate(texts)] + [(3, texts[3], "a", 1), (None, "null id", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, offset int")
    packed, certificate = pack_documents(docs, capacity=512)
    got = packed.collect()
    by_doc = defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length <= 512 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = [x for r in sorted(by_doc[i], key=lambda r: (r.piece, r.sequence_id)) if i != 3 or r is by_doc[i][0] for x in r.ids]
        assert ids == truth(t or "") + [1]
    assert [r.start for r in sorted(by_doc[len(texts) - 1], key=lambda r: r.piece)][:2] == [0, 512]
    assert len(by_doc[3]) == 2 and len(by_doc[None]) == 1
    made = sequences(packed).collect()
    assert len(made) == certificate["sequences"] and all(len(r.ids) <= 512 for r in made)
    assert sum(len(r.ids) for r in made) == sum(r.length for r in got)
    assert pack_documents(docs.filter("doc_id < 0"))[0].collect() == []


def test_large_ids_next_to_a_null(spark):
    big = 1 << 60
    rows = [(big + 1, "a"), (big + 2, "b c"), (big + 3, None), (None, "d")]
    packed, certificate = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), keep_ids=False)
    assert {r.doc_id for r in packed.collect()} == {big + 1, big + 2, big + 3, None}
    assert certificate["sequences"] == certificate["bound"] == certificate["partitions"] == certificate["certified"] == 1


def test_other_tokenizers_encode_whole_texts():
    texts = ["The  quick\nbrown fox", ""]
    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    for text, got in zip(texts, Encoder(path).ids(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
