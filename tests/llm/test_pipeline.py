"""The corpus pipeline, stage by stage, on planted cases."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(4, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rnd = random.Random(11)
    passage, page = words(rnd, 60), words(rnd, 200)
    rows = [(i, words(rnd, 80), "en") for i in range(20)]
    rows += [(30, words(rnd, 60) + " " + passage + " " + words(rnd, 60), "en"), (31, words(rnd, 60) + " " + passage + " " + words(rnd, 60), "en")]
    edited = page.split()
    edited[100] = "changed"
    rows += [(40, page, "en"), (41, " ".join(edited), "en"), (50, "12 34", "en"), (51, None, "en"), (60, "a line that stands here twice over\n" + words(rnd, 70), "en"), (61, "A line that stands here twice, over!\n" + words(rnd, 70), "en")]
    path = str(tmp_path_factory.mktemp("planted"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang", "'s' as source", "cast(length(text) as long) as n_chars")
    df.write.parquet(f"{path}/documents.parquet")
    return path, {r[0]: r[1] for r in rows}, passage


def stage(spark, planted, name, docs=None):
    f = dict(corpus_pipeline.STAGES)[name]
    return {r.doc_id: r for r in f(spark, docs if docs is not None else spark.read.parquet(f"{planted[0]}/documents.parquet"), planted[0]).collect()}


def test_language(spark, planted):
    got = stage(spark, planted, "language_id")
    assert set(planted[1]) - set(got) == {50, 51}
    assert all(r.lang == "en" and r.text == planted[1][i] for i, r in got.items())


def test_lines(spark, planted):
    got = stage(spark, planted, "line_dedup")
    assert got[60].text == planted[1][60] and got[61].text == planted[1][61].split("\n")[1] and got[61].n_chars == len(got[61].text)
    assert all(got[i].text == planted[1][i] for i in range(20))


def test_near_duplicates(spark, planted):
    got = stage(spark, planted, "near_duplicates")
    assert set(planted[1]) - set(got) == {41}


def test_passages(spark, planted):
    docs = spark.read.parquet(f"{planted[0]}/documents.parquet").where("doc_id < 40")
    got = stage(spark, planted, "repeated_passages", docs)
    assert all(planted[2] not in got[i].text and len(got[i].text) > 300 for i in (30, 31))
    assert all(got[i].text == planted[1][i] for i in range(20))


def test_the_whole(spark, planted):
    ids = {r.doc_id for r in corpus_pipeline.run(spark, planted[0]).collect()}
    assert set(range(20)) | {30, 31, 40, 60, 61} == ids


def test_columns(spark, planted):
    docs = spark.read.parquet(f"{planted[0]}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, planted[0]).dtypes == docs.dtypes, name


def test_empty(spark, planted, tmp_path):
    spark.read.parquet(f"{planted[0]}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_of_equal_rows_stays(spark, planted):
    rnd = random.Random(5)
    rows = [(1, words(rnd, 60) + "\n" + words(rnd, 30)), (None, words(rnd, 80)), (3, words(rnd, 70))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows[:2] * 3 + rows[2:]], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("line_dedup", "near_duplicates", "repeated_passages"):
        got = dict(corpus_pipeline.STAGES)[name](spark, docs, planted[0]).collect()
        assert sorted((r.text, r.doc_id) for r in got) == sorted((t, i) for i, t in rows), name


def test_a_passage_of_short_words(spark, planted):
    rnd = random.Random(8)
    passage = " ".join(rnd.choice("abcdefghij") + rnd.choice(["", "k"]) for _ in range(51))
    rows = [(i, f"{words(rnd, 40)} {passage} {words(rnd, 40)}", "en", "s", 1) for i in (1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert len(passage) < 200 and all(passage not in r.text and len(r.text) > 300 for r in stage(spark, planted, "repeated_passages", docs).values())


def test_rows_of_one_id_are_documents_of_their_own(spark, planted):
    """A copy that shares its id with another text does not take that text with it; rows without an id are compared too."""
    rnd = random.Random(21)
    a, b, c = words(rnd, 80), words(rnd, 80), words(rnd, 80)
    rows = [(1, a), (5, a), (5, b), (None, c), (None, b), (9, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, planted[0]).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, a), (5, b), (9, c)])
