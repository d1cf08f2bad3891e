"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnspark.llm import byte_bpe, chat, jaccard, language_id, line_dedup, lm, lsh, packing, suffix, topk
from cairnspark.llm.vectors import valid_vectors

LONG = " ".join(f"wort{i % 977}" for i in range(60_000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "Hello the world\nof words, a line that is here", "en"), (2, None, "en"), (3, "", None), (4, "   \n ", "fr"), (5, LONG, "de"), (None, "text without an id", "en")]
    rows += [(7, "same row twice in the table", "en")] * 2 + [(8, "12 34 !!", "en"), (9, "é\u0000 漢字 'll x", None)]
    # columns that operators use as names of their own
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as seed", "2 as doc", "3 as th", "'x' as h1", "4 as component", "5 as n", "6 as ids", "7 as length", "8 as id")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


OPERATORS = {
    "language": lambda d: language_id.predict(d.select("doc_id", "text"), language_id.train(d.select("lang", "text")), "doc_id"),
    "suffix": lambda d: suffix.digest(suffix.repeated_spans(d, 400)),
    "lines": line_dedup.dedup_lines,
    "model": lambda d: lm.score(d, F.col("doc_id") % 10 == 0, F.col("doc_id") % 10 != 0),
    "bpe": lambda d: byte_bpe.encode_documents(d, byte_bpe.default_path(), with_ids=False),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_has_a_result(docs, name):
    assert OPERATORS[name](docs).count() == 10


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_an_empty_table_gives_an_empty_one(none, name):
    assert OPERATORS[name](none).count() == 0


def test_language_of_texts_without_letters(docs):
    got = {r.doc_id: r for r in OPERATORS["language"](docs).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (2, 3, 4, 8))
    assert all(0 <= r.score <= 1 for r in got.values()) and got[5].lang_pred == "de"


def test_language_without_labels(docs):
    got = language_id.predict(docs.select("doc_id", "text"), language_id.train(docs.where("lang = 'xx'").select("lang", "text")), "doc_id").collect()
    assert {r.lang_pred for r in got} == {"und"}


def test_one_label_only(docs):
    got = language_id.predict(docs.select("doc_id", "text"), language_id.train(docs.where("lang = 'en'").select("lang", "text")), "doc_id").collect()
    assert {r.lang_pred for r in got} == {"und", "en"}


def test_repeated_rows_are_copies(docs):
    got = [r for r in suffix.digest(suffix.repeated_spans(docs, 20)).collect() if r.doc_id == 7]
    assert len(got) == 2 and all(r.n_removed == r.n_bytes for r in got)


def test_jaccard(docs, none):
    got = {r.doc_id: r for r in jaccard.jaccard_join(docs, 3, 90, 100).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 7, 8, 9}  # a null id takes no part, a repeated one counts once
    assert got[2].n_shingles == 0 and got[2].component_id == 2 and got[8].n_shingles == 1
    assert jaccard.jaccard_join(none, 3, 90, 100).count() == 0


def test_packing(docs, none):
    got = packing.pack(docs, packing.default_path(), capacity=512, with_ids=True).collect()
    assert sum(r.length for r in got if r.doc_id == 2) == 1
    at = {}
    for r in got:
        assert len(r.ids) == r.length
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in at.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= 512
    assert packing.pack(none, packing.default_path()).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, None, None, None), (2, 0, "user", "<\\|im_end|><|"), (2, 1, "assistant", "<|x|>"), (2, 1, "assistant", "<|x|>"), (None, 3, "sys\n|tem\\", "\n")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as example", "2 as formatted")
    got = {r.conv_id: r for r in chat.digest(chat.expand(t)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 1 and got[2].n_turns == 3 and got[2].loss_chars == 10 and got[None].n_turns == 1
    one = chat.expand(t).where("conv_id is null").first()
    assert chat.read_turns(one.formatted) == [("sys\n|tem\\", "\n")] and not one.target
    assert chat.digest(chat.expand(t.limit(0))).count() == 0


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, []), (None, [1.0, 1.0]), (8, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as vector")
    ok = valid_vectors(v, "vec_id", "embedding")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.exact_topk(ok, F.col("id") % 20 == 0, 3).collect()}
    assert got[0, 1] == (1, 1) and got[0, 2] == (2, 1) and got[0, 3] == (8, 0) and got[20, 1] == (0, 0)
    near = {(r.query_id, r.rank): (r.vec_id, r.score) for r in lsh.search(valid_vectors(v, "vec_id", "embedding", drop_zero=True), F.col("id") % 20 == 0, 10).collect()}
    assert near[0, 1] == (1, 0.0) and near[0, 2] == (2, 0.0) and near[0, 3][0] == 20 and (0, 4) not in near
    for f in (lambda x: topk.exact_topk(x, F.col("id") % 20 == 0, 3), lambda x: lsh.search(x, F.col("id") % 20 == 0, 3)):
        assert f(ok.limit(0)).count() == 0
        assert f(ok.where("id = 1")).count() == 0


def test_large_components_are_exact(spark):
    x = spark.createDataFrame([(0, [float(1 << 27)] * 4), (1, [float((1 << 27) + 1)] * 4)], "id long, vector array<double>")
    assert topk.exact_topk(x, F.col("id") == 0, 1).first().score == 4 * (1 << 27) * ((1 << 27) + 1)


def test_components_of_any_size_are_exact(spark, tmp_path):
    """Scores beyond what doubles and beyond what products of doubles hold, ties at the last rank, and one that fits no long."""
    big = float(1 << 24)
    rows = [(0, [big, 1.0, 0.0]), (1, [big, 1.0, 5.0]), (2, [big, 2.0, 5.0]), (3, [big, 1.0, 7.0]), (4, [-float(1 << 55), 0.0, 1.0]), (20, [0.0, 1.0, 0.0]), (5, [0.1, -0.1, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as query", "2 as dim").write.parquet(f"{tmp_path}/embeddings.parquet")
    with pytest.raises(Exception, match="does not fit a long"):
        topk.op2_topk(spark, str(tmp_path)).collect()
    few = spark.createDataFrame([r for r in rows if r[0] != 4], "vec_id long, embedding array<double>")
    few.write.parquet(f"{tmp_path}/few/embeddings.parquet")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.op2_topk(spark, f"{tmp_path}/few").collect()}
    b = (1 << 24) * 64
    assert [got[0, k] for k in (1, 2, 3)] == [(2, b * b + 2 * 64 * 64), (1, b * b + 64 * 64), (3, b * b + 64 * 64)]
    assert got[0, 4] == (5, b * 6 - 7 * 64) and len(got) == 10


def test_bounds_keep_every_one_of_the_best(spark):
    rng = np.random.default_rng(8)
    for n, d, k in ((700, 6, 5), (300, 33, 20), (4, 3, 5)):
        x = rng.integers(-9, 10, (n, d)).astype(float)  # many ties
        q, own = x[: n // 3], np.arange(n // 3)
        i, j, s = topk.nra(q, x, k, own, depths=(0.1, 0.3, 0.6, 0.9), step=97)
        for a in own:
            want = sorted(((int(-(q[a] @ x[b])), b) for b in range(n) if b != a))[:k]
            got = sorted((int(-c), int(b)) for b, c in zip(j[i == a], s[i == a]))
            assert got[: len(want)] == want


def test_equal_rows_keep_their_lines_once(docs):
    got = sorted(r.text for r in line_dedup.dedup_lines(docs).collect() if r.doc_id == 7)
    assert got == ["", "same row twice in the table"]


def test_short_lines_are_deduplicated(spark):
    rows = [(1, "and ornd\n\n漢字漢字漢字\none\n--"), (2, "And  ornd!\n\n漢字漢字漢字\nother\nOne\n--")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "\nother\n--"}
