import pytest
from pyspark.sql import functions as F

from outing.functions.stem import porter2
from outing.operators import fulltext

STEMS = """running run workshops workshop consistency consist knightly knight generously generous happiness happi
    national nation relational relat conditional condit hopping hop hoping hope falling fall agreed agre dies die
    skies sky cries cri say say by by communication communic generalization general organisers organis classes class
    studies studi careers career technological technolog singly singl proceed proceed consolatory consolatori
    kindness kind adjustment adjust bowdlerizer bowdler gas gas gaps gap ties tie sized size vietnamization vietnam
    rolling roll probate probat rate rate cease ceas arsenal arsenal youth youth boyish boyish feed feed
    sensibly sensibl decisiveness decis hopefully hope triplicate triplic formative format electricity electr
    communism communism replacement replac inning inning news news dying die it's it y y""".split()


@pytest.mark.parametrize("word, stem", list(zip(STEMS[::2], STEMS[1::2])))
def test_stems(word, stem):
    assert porter2(word) == stem


def test_vector_has_places_of_both_parts():
    assert dict(fulltext._vector("The running of a Co-Working Run", "The Café")) == {
        "run": [2, 8], "co-work": [5], "co": [6], "work": [7], "the": [9], "café": [10],
    }
    assert fulltext._vector(None, None) == [] and dict(fulltext._vector("the of", "a b")) == {"a": [1], "b": [2]}
    assert dict(fulltext._vector("Café 日本語教室 x_y", "")) == {"café": [1], "日本語教室": [2], "x": [3], "y": [4]}


def test_alternatives():
    w = fulltext.Wanted
    assert fulltext.alternatives("The running or it's co-working -free, run") == [
        w(("run",), (0,)), w(("co-work", "co", "work"), (0, 1, 2)), w(("free",), (0,), True),
    ]
    assert fulltext.alternatives("of the, to!") == [] == fulltext.alternatives("")


ROWS = [
    (1, "Running a workshop", "runs", None), (2, "Run, run, runner", None, None), (3, "Pottery", None, "Töpfern lernen"),
    (4, "Co-working co-workers work", "free", None), (5, "co work", None, None), (6, None, None, None), (7, "陶艺 class", None, None),
]


def _postings(spark):
    rows = spark.createDataFrame(ROWS, "id long, title string, summary string, alt string")
    none = F.lit(None).cast("string")
    vector = fulltext.event_vector(F.col("title"), F.col("summary"), none, none, F.col("alt"))
    return fulltext.inverted(rows.select("id", vector.alias("search_vector"))), rows.select("id")


@pytest.mark.parametrize(
    "question, expected",
    [
        ("run workshop", [(1, 3), (2, 2)]),
        ("RUNNING workshops", [(1, 3), (2, 2)]),
        ("töpfern", [(3, 1)]),
        ("töpfer", []),
        ("陶艺 classes", [(7, 2)]),
        ("co-working", [(4, 1)]),
        ("work co-working", [(4, 2), (5, 1)]),
        ("of the", []),
    ],
)
def test_ranks(spark, question, expected):
    postings, _ = _postings(spark)
    got = fulltext.ranked(postings, question).collect()
    assert [(r.id, r.hits) for r in got] == expected and [r.r for r in got] == list(range(1, len(got) + 1))


def test_absent_words_and_a_filter_of_ids(spark):
    postings, ids = _postings(spark)
    got = fulltext.ranked(postings, "work or -free", ids).collect()
    assert [(r.id, r.hits) for r in got] == [(4, 2), (5, 1), (1, 0), (2, 0), (3, 0), (6, 0), (7, 0)]
    assert [r.id for r in fulltext.ranked(postings, "run", ids.filter("id > 1")).collect()] == [2]
    with pytest.raises(ValueError):
        fulltext.ranked(postings, "-free")
    empty = spark.createDataFrame([], "lexeme string, id long, positions array<int>")
    assert fulltext.ranked(empty, "run").collect() == []


def test_a_stored_table_is_read_by_lexeme(spark, tmp_path):
    _postings(spark)[0].write.parquet(str(tmp_path / "lexemes"))
    plan = fulltext.ranked(spark.read.parquet(str(tmp_path / "lexemes")), "run")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lexeme), EqualTo(lexeme,run)]" in plan.replace("In(lexeme, [run])", "EqualTo(lexeme,run)")


def test_postings_are_the_inverted_vectors_in_bounded_parts(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"Clay workshops {k}", "naïve clay " * 50) for k in range(40)] + [(98, None, None), (99, "", "Ärger")], "id long, a string, b string")
    monkeypatch.setattr(fulltext, "MOST_PLACES", 60)
    vectors = rows.select("id", fulltext.search_vector("a", "b").alias("search_vector"))
    got = lambda df: sorted((r.lexeme, r.id, tuple(r.positions)) for r in df.collect())
    want = sorted((w, r.id, tuple(p)) for r in rows.collect() for w, p in fulltext._vector(r.a, r.b))
    assert got(fulltext.postings(rows, "a", "b")) == got(fulltext.inverted(vectors)) == want
