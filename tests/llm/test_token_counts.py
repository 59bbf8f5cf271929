from outing.llm.token_counts import at_limit, for_every_limit, quantile, token_counts
from outing.llm.tokens import Encoder, tokenizer_path


def test_equals_brute_force(spark):
    texts = [None, "", "a b", "a b", "the quick brown fox " * 5, "word " * 9000, "x " * 5000, "Ünïcödé text!!"]
    docs = spark.createDataFrame([(i if i else None, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_docs int")
    lens = [len(x) // 4 for x in Encoder(tokenizer_path()).ids([t or "" for t in texts])]
    out = token_counts(docs)
    got = {r.context_limit: r for r in out.collect()}
    assert sorted(got) == sorted(set(lens))
    for limit, r in got.items():
        within = [n for n in lens if n <= limit]
        assert (r.n_docs, r.docs_within, r.docs_over) == (lens.count(limit), len(within), len(lens) - len(within))
        assert r.tokens_within == sum(within)
        assert r.tokens_truncated == sum(min(n, limit) for n in lens) == sum(lens) - r.tokens_lost
        assert r.share_within == len(within) / len(lens)
    for limit in (0, 1, 7, 4096, 8000, 10**6):
        r = at_limit(out, limit).first()
        assert r.tokens_truncated == sum(min(n, limit) for n in lens) and r.docs_over == sum(n > limit for n in lens)
    assert quantile(out, 0.5).first().tokens == sorted(lens)[3]


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    hist = spark.createDataFrame([(5, 2), (5000, 1)], "tokens long, n_docs long")
    assert for_every_limit(hist).count() == 2
