"""Hard negatives, toxicity and the filter audit: brute force, the kernel by its definition, odd input."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnspark.llm import filter_audit, hard_negatives, registry, toxicity

# --- hard negatives ---


def slow_mine(rows, anchors, n_positives, k, low=(50, 100), high=(95, 100)):
    """rows: id -> (label, whole vector)."""
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))
    out = []
    for a in anchors:
        la, va = rows[a]
        other = [(i, lab, dot(va, v)) for i, (lab, v) in rows.items() if i != a and len(v) == len(va)]
        for p, _, sp in sorted((x for x in other if x[1] == la), key=lambda x: (-x[2], x[0]))[:n_positives]:
            fit = [x for x in other if x[1] != la and low[0] * sp <= low[1] * x[2] and high[1] * x[2] <= high[0] * sp]
            out += [(a, p, r, n, sp, sn) for r, (n, _, sn) in enumerate(sorted(fit, key=lambda x: (-x[2], x[0]))[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, lab, [float(c) for c in v]) for i, (lab, v) in rows.items()], "id long, label long, vector array<double>")


@pytest.mark.parametrize("scale,dim,labels,n", [(3, 4, 2, 260), (300, 16, 5, 400), (1 << 24, 8, 3, 150)])
def test_hard_negatives_by_brute_force(spark, scale, dim, labels, n):
    rng = np.random.default_rng(scale)
    rows = {int(i): (int(rng.integers(labels)), rng.integers(-scale, scale + 1, dim).tolist()) for i in rng.permutation(n * 3)[:n]}  # small scales: many ties
    anchors = [i for i in rows if i % 5 == 0]
    got = sorted(tuple(r) for r in hard_negatives.mine(frame(spark, rows), F.col("id") % 5 == 0, 5, 3).collect())
    assert got == slow_mine(rows, anchors, 5, 3) and got


def test_hard_negatives_on_small_tiles(spark, monkeypatch):
    """Bounds carried from tile to tile lose nobody."""
    rng = np.random.default_rng(5)
    x = rng.integers(-20, 21, (500, 9)).astype(float)
    label = rng.integers(0, 4, 500)
    monkeypatch.setattr(hard_negatives, "TILE", 37)
    basis = np.linalg.qr(rng.normal(size=(9, 9)))[0]
    r, ids = hard_negatives.Rotated(x, basis), np.arange(500)
    i, j, s = hard_negatives.best_of_label(r[:60], ids[:60], label[:60], r, ids, label, 5)
    low, high = np.full((60, 1), 100), np.full((60, 1), 300)
    a, w, b, t = hard_negatives.best_in_windows(r[:60], label[:60], low, high, r, ids, label, 3)
    for q in range(60):
        p = x @ x[q]
        same = sorted((-p[c], c) for c in ids if label[c] == label[q] and c != q)[:5]
        assert sorted((-s[i == q]).tolist()) == sorted(v for v, _ in same) and set(j[i == q]) == {c for _, c in same}
        inside = sorted((-p[c], c) for c in ids if label[c] != label[q] and 100 <= p[c] <= 300)[:3]
        assert set(b[a == q]) == {c for _, c in inside}


def test_hard_negatives_on_odd_rows(spark, tmp_path):
    rows = [(0, [1.0, 0.5], 1), (50, [0.5, 0.5], 1), (3, [1.0, 1.0], 1), (4, [0.7, 0.2], 2), (4, [0.7, 0.2], 2), (5, None, 1), (6, [None, 1.0], 1), (8, [float("nan"), 1.0], 2), (9, [float("inf"), 1.0], 2)]
    rows += [(10, [1.0, 1.0], None), (11, [], 1), (12, [1.0], 1), (None, [1.0, 1.0], 1), (14, [0.8, 0.3], 0), (100, [-1.0, -1.0], 1), (13, [0.0, 0.0], 2)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as query", "2 as slab", "3 as dim")
    t.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in hard_negatives.op11_hard_negatives(spark, str(tmp_path)).collect())
    whole = lambda v: [math.floor(256 * float(np.float32(c))) for c in v]
    ok = {i: ((lab + 1) % 10 if i % 7 == 0 else lab, whole(v)) for i, v, lab in rows if i is not None and v and lab is not None and all(c is not None and math.isfinite(c) for c in v)}
    assert got == slow_mine(ok, [i for i in ok if i % 50 == 0], 5, 3)
    for k, few in enumerate(("vec_id < 0", "vec_id = 4")):
        t.where(few).write.parquet(f"{tmp_path}/{k}/embeddings.parquet")
        assert hard_negatives.op11_hard_negatives(spark, f"{tmp_path}/{k}").count() == 0


# --- toxicity ---


def slow_kernel(a: bytes, b: bytes) -> float:
    """Every pair of equal subsequences of symbols within the span."""

    def all_of(s):
        sym = toxicity._SYMBOL[np.frombuffer(s, np.uint8)].tolist()
        out = {}
        for at in itertools.combinations(range(len(s)), toxicity.ORDER):
            span = at[-1] - at[0] + 1
            if span <= toxicity.SPAN and all(sym[k] for k in at):
                key = tuple(sym[k] for k in at)
                out[key] = out.get(key, 0.0) + toxicity.DECAY**span
        return out

    x, y = all_of(a), all_of(b)
    return sum(v * y.get(k, 0.0) for k, v in x.items())


def test_the_kernel_is_the_gapped_subsequence_kernel():
    for a, b in ((b" idiot", b" idiot"), (b" id-xiot", b" idiot"), (b"abcabcab", b"aabbcc"), ("réeux".encode(), b"reeux"), (b"ab", b"abcd"), (b" the thing", b"ing t he")):
        assert math.isclose(toxicity.kernel(a, b), slow_kernel(a, b), abs_tol=1e-12)


def test_folded_weights_are_the_kernel_machine():
    """The look-up of a text's subsequences gives the sum of kernels with all landmarks."""
    marks, beta = [b" idiot", b" clown", b" paper"], np.array([2.0, 1.5, -1.0])
    row, code, value = toxicity.subsequences(marks)
    weights = np.zeros(toxicity._SIZE, np.float32)
    np.add.at(weights, code, (value * beta[row]).astype(np.float32))
    for word in (b" idiot", b" idxiot", b" clowns", b" paperclown"):
        data = np.frombuffer(word, np.uint8)
        got = toxicity.margins(data, np.array([0, len(word)]), weights).sum()
        assert math.isclose(got, sum(b * slow_kernel(word, m) for m, b in zip(marks, beta)), rel_tol=1e-5, abs_tol=1e-6)


def units_of(*texts):
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data, off = toxicity.led(np.frombuffer(b"".join(raw), np.uint8), off)
    starts, of = toxicity.units(data, off)
    end = np.append(starts[1:], len(data))
    row = np.searchsorted(off, starts, "right") - 1
    return [(int(r), data[a:b].tobytes().decode().strip(), int(s)) for r, a, b, s in zip(row, starts, end, of)]


def test_units_and_sentences():
    got = units_of("One two. Three\nfour", "", "  ", "i d i o t", "an i.d.i.o.t is", "a b", "x" * 70)
    assert [u for r, u, _ in got if r == 0] == ["One", "two.", "Three", "four"] and len({s for r, _, s in got if r == 0}) == 3
    assert [u for r, u, _ in got if r in (1, 2)] == ["", ""]
    assert [u for r, u, _ in got if r == 3] == ["idiot"] and [u for r, u, _ in got if r == 4] == ["an", "idiot", "is"]
    assert [u for r, u, _ in got if r == 5] == ["a", "b"] and "".join(u for r, u, _ in got if r == 6) == "x" * 70
    assert len({s for _, _, s in got}) == 9


@pytest.fixture(scope="module")
def labelled():
    """Words of invented syllables; toxic texts have one of four insults in them."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(["an", "the", "or", "ti", "on", "er", "wh", "ea", "lo", "st"]) for _ in range(rnd.randint(1, 4)))
    texts, toxic = [], []
    for k in range(600):
        words = [word() for _ in range(rnd.randint(5, 60))]
        if k % 5 == 0:
            words[rnd.randrange(len(words))] = rnd.choice(["idiot", "clown", "pathetic", "scum"])
        texts.append(" ".join(words) + ".")
        toxic.append(k % 5 == 0)
    return texts, np.array(toxic)


def test_gapped_and_padded_insults(labelled):
    m = toxicity.fit(*labelled, 1.0)
    raw = lambda t: (np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
    score = lambda t: float(m.score(*raw(t))[0])
    for t in ("the idiot on", "The IDIOT", "an idxiot her", "an id-iot", "i d i o t", "p.a.t.h.e.t.i.c", "pathetiic", "clo*wn the"):
        assert score(t) >= 0.3, (t, score(t))
    for t in ("", "the anthe on", "antion whea loan", "12 %%", "iron thot", "漢字"):
        assert score(t) < 0.3, (t, score(t))


def test_a_text_scores_alike_wherever_it_stands(labelled):
    texts, toxic = labelled
    m = toxicity.fit(texts[:200], toxic[:200], 1.0)
    raw = [t.encode() for t in texts[:50]] + [b"", b" "]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    together = m.score(np.frombuffer(b"".join(raw), np.uint8), off)
    alone = [m.score(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0] for r in raw]
    assert np.array_equal(together, alone)


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    got = registry.QUERIES["op12_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out and (r.score >= 0.3) == (r.predicted == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    bad, good = [r for r in held if r.toxic == 1], [r for r in held if r.toxic != 1]
    assert sum(r.predicted for r in bad) >= 0.85 * len(bad) and sum(1 - r.predicted for r in good) >= 0.93 * len(good)


def test_toxicity_on_odd_rows(spark):
    rows = [(1, "you idiot"), (2, None), (3, ""), (4, " \n "), (5, " ".join(["word"] * 60_000)), (None, "no id"), (7, "twice"), (7, "twice"), (8, "漢字 é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as h", "true as bad")
    labels = spark.createDataFrame([(1, 1), (3, 0), (7, 0), (99, 1), (4, None)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0), labels.where("toxic = 1")):
        model = toxicity.train(docs.select("doc_id", "text"), some)
        got = toxicity.predict(docs.select("doc_id", "text"), model, "doc_id").collect()
        assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.predict(docs.select("doc_id", "text").limit(0), model, "doc_id").count() == 0


# --- filter audit ---


def slow_audit(docs, labels):
    """Filters applied one after the other, document by document."""
    import re

    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = {}
    for i, t, s in docs:
        t = t or ""
        w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", t) if x]
        fails = {f for f, b in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > first[t])) if b}
        said = [x for x in labels if x[0] == i and i is not None]
        parts.setdefault(s or "", []).append((fails, any(x[1] == 1 for x in said), any(x[2] == 1 for x in said)))
    out = []
    for part, rows in parts.items():
        value = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order, 1):
                here = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                value[f] += len(here)
                steps.append((part, "".join(order), k, len(left), len(here), sum(f in r[0] for r in rows) - len(here), sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here), f))
        out += [(*s[:9], value[s[9]]) for s in steps]
    return sorted(out)


def test_audit_by_brute_force(spark, tmp_path):
    rnd = random.Random(9)
    texts = ["", None, "HI There", "a b c " * 30, "one # two", " ".join(f"w{k}" for k in range(60)), " ".join(f"W{k}" for k in range(60)), "x\x0by\tz w " * 20, " ".join(["long"] * 30_000)]
    docs = [(i, rnd.choice(texts), rnd.choice([None, "", "s1", "s2"])) for i in range(90)]
    docs += [(None, "one # two", "s1"), (5, docs[5][1], docs[5][2]), (5, "other", "s2")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 90, 2)] + [(4, 1, 1), (None, 1, 1), (500, 1, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as h", "2 as fails", "3 as part", "4 as n", "5 as quality").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as n", "'x' as part").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(tuple(r) for r in filter_audit.op13_filter_audit(spark, str(tmp_path)).collect())
    assert got == slow_audit(docs, labels)
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert filter_audit.op13_filter_audit(spark, f"{tmp_path}/none").count() == 0


def test_shapley_values_share_all_that_is_removed(spark):
    rows = spark.createDataFrame([(0b101, 3), (0b010, 2), (0b111, 5), (0, 7)], "fails int, n long")
    joint = filter_audit.joint_failures(rows, [], 3, {"docs": F.col("n")})
    r = joint.select(filter_audit.survivors(F.col("docs"), 3).alias("s"), filter_audit.shapley_over_orders(filter_audit.dividends(F.col("docs"), 3), 3).alias("v")).first()
    assert r.s == [17, 9, 10, 7, 9, 9, 7, 7]
    assert sum(r.v) == 6 * 10 and r.v[0] == r.v[2] == 6 * 3 // 2 + 5 * 2
