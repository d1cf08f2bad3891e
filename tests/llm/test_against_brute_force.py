"""Operators against SQL, or against plain Python that does the same the slow way, on the smallest tables and on planted cases."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnspark.llm import byte_bpe, chat, common, jaccard, language_id, line_dedup, lm, lsh, packing, registry, suffix
from tests.compare import assert_same, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.fixture(scope="module")
def texts(con):
    return {i: t or "" for i, t in con.sql("SELECT doc_id, text FROM documents").fetchall()}


def run(spark, name):
    return registry.QUERIES[name](spark, FOLDER).collect()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, con, name):
    assert_same(registry.QUERIES[name](spark, FOLDER), con, registry.ORACLE_SQL[name])


def roots(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


# --- op1 ---


def test_language_on_held_out_documents(spark, con):
    lang = dict(con.sql("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL").fetchall())
    got = [r for r in run(spark, "op1_language_id") if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.doc_id in lang and r.lang_pred != "und"]) > 0.95


def test_codewords_are_far_apart():
    for n in (2, 4, 7, 12):
        m = language_id.codewords(n)
        d = [(m[i] != m[j]).sum() for i in range(n) for j in range(i)]
        assert min(d) >= (m.shape[1] + 1) // 2 if n <= 7 else min(d) >= m.shape[1] // 4


def test_language_decoding(texts, con):
    """Trigrams counted one by one, bits voted and codewords chosen in plain Python, on the same codewords."""
    lang = dict(con.sql("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL").fetchall())

    def grams(t):
        m = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in t.encode()]
        return [((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> (32 - (language_id.BUCKETS.bit_length() - 1)) for a, b, c in zip(m, m[1:], m[2:]) if (a, b, c) != (32, 32, 32)]

    names = sorted(set(lang.values()))
    own = {n: Counter(g for i, t in texts.items() if lang.get(i) == n for g in grams(t)) for n in names}
    counts = np.array([[own[n][b] for b in range(language_id.BUCKETS)] for n in names], float)
    model = language_id.Model(names, counts)
    p = {n: (lambda b, n=n, total=sum(own[n].values()) + 0.5 * language_id.BUCKETS: (own[n][b] + 0.5) / total) for n in names}
    for i in sorted(texts)[:25]:
        gs = grams(texts[i])
        raw = np.frombuffer(texts[i].encode(), np.uint8)
        best, score, _ = model.predict(raw, np.array([0, len(raw)]))
        loss = []
        for k in range(len(names)):
            total = 0.0
            for b in range(model.code.shape[1]):
                one, zero = ([x for j, x in enumerate(names) if model.code[j, b] == s] for s in (1, -1))
                vote = sum(math.log(sum(p[n](g) for n in one) / len(one)) - math.log(sum(p[n](g) for n in zero) / len(zero)) for g in gs) / max(1, len(gs))
                total += model.weight[b] * math.log1p(math.exp(-4 * model.code[k, b] * vote))
            loss.append(total)
        share = [math.exp(-8 * (x - min(loss))) for x in loss]
        assert loss[best[0]] <= min(loss) + 1e-6 and math.isclose(score[0], max(share) / sum(share), rel_tol=1e-3)


def test_codewords_of_many_languages():
    m = language_id.codewords(20)
    assert m.shape[0] == 20 and len({tuple(r) for r in m}) == 20 and min((a != b).sum() for i, a in enumerate(m) for b in m[:i]) >= 8


# --- op4 ---


def repeated(texts, length):
    count = Counter(t[a : a + length] for t in texts.values() for a in range(len(t) - length + 1))
    out = {}
    for i, t in texts.items():
        edge = np.zeros(len(t) + 1, int)
        for a in range(len(t) - length + 1):
            if count[t[a : a + length]] > 1:
                edge[a] += 1
                edge[a + length] -= 1
        out[i] = np.cumsum(edge)[: len(t)] > 0
    return out


def test_suffix_dedup(spark, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    covered = repeated(raw, 400)
    for r in run(spark, "op4_suffix_dedup"):
        c = covered[r.doc_id]
        starts = int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())
        kept = np.frombuffer(raw[r.doc_id], np.uint8)[~c].tobytes()
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(c), c.sum(), starts, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("hot", [2000, 1])
@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_of_edited_copies(spark, seed, hot, monkeypatch):
    """Periodic texts, copies with edits, passages cut at any place; every seed handled as a frequent one, too."""
    monkeypatch.setattr(suffix, "HOT", hot)
    rnd = random.Random(seed)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(700))
    texts = {0: base, 1: base[100:400], 2: "ab" * 200, 3: "x" + "ab" * 60}
    for i in range(4, 60):
        t = list(base[rnd.randrange(300) : rnd.randrange(350, 700)])
        for _ in range(rnd.randrange(5)):
            t[rnd.randrange(len(t))] = rnd.choice("xyz")
        texts[i] = "".join(rnd.choice("klmno") for _ in range(rnd.randrange(30))) + "".join(t)
    covered = repeated({i: t.encode() for i, t in texts.items()}, 50)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in suffix.repeated_spans(df, 50).collect():
        got = np.zeros(len(texts[r.doc_id]), bool)
        for s, e in suffix.union(r.spans):
            got[s:e] = True
        assert (got == covered[r.doc_id]).all(), r.doc_id


def test_index_levels_give_what_one_batch_gives():
    rnd = random.Random(5)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(400))
    rows = []
    for i in range(300):
        t = list(base[rnd.randrange(150) : rnd.randrange(200, 400)])
        t[rnd.randrange(len(t))] = "x"
        t = "".join(t).encode()
        raw = np.frombuffer(t, np.uint8)
        for _, a, first, last, seed in zip(*(v.tolist() for v in suffix.anchors(raw, np.array([0, len(t)]), 60))):
            rows.append((seed - (1 << 64) if seed >> 63 else seed, a - first, t[first : last + 60], [i], [0], [first]))
    cover = []
    for size in (len(rows), 17):
        f = suffix.Family(60)
        spans = []
        for k in range(0, len(rows), size):
            spans += f.add(rows[k : k + size])
        spans += f.close()
        bits = {}
        for d, _, s, e in spans:
            bits.setdefault(d, np.zeros(400, bool))[s:e] = True
        cover.append({d: b.tobytes() for d, b in bits.items()})
        assert size > 100 or len(f.levels) <= 12
    assert cover[0] == cover[1]


# --- op5 ---


def test_edit_distance():
    rnd = random.Random(3)

    def slow(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    for _ in range(1500):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        assert slow(a, b) == line_dedup.edit_distance(a, b)


def test_edit_distances_side_by_side(monkeypatch):
    monkeypatch.setattr(line_dedup, "LONG_LINE", 350)
    monkeypatch.setattr(line_dedup, "CELLS", 5000)
    rnd = random.Random(4)
    a, b = [], []
    for _ in range(1500):
        s = "".join(rnd.choice("abc漢é") for _ in range(rnd.choice([0, 1, 7, 63, 64, 65, 200, 400])))
        share = rnd.random() / 2
        a.append(s)
        b.append("".join(c if rnd.random() > share else rnd.choice(["", "x", "ab"]) for c in s) if rnd.random() < 0.7 else "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 150))))
    for part in (2, 5, 20):
        most = np.array([max(len(s), len(t)) // part for s, t in zip(a, b)])
        for s, t, k, d in zip(a, b, most, line_dedup.edit_distances(a, b, most)):
            want = line_dedup.edit_distance(s, t)
            assert d == want or d > k and want > k
    assert len(line_dedup.edit_distances([], [], np.zeros(0, np.int64))) == 0


def test_alignment_of_runs_of_words_counts_gaps_letter_by_letter():
    """Words that stand once are rare in a long line of few words, and a changed letter costs one, not its word."""
    rng = np.random.RandomState(5)
    names = ["on", "er", "the", "tion", "and", "re", "ing", "th"]
    a = [" ".join(rng.choice(names, 300)) for _ in range(20)] + ["x", "a b", ""]
    b = []
    for line in a[:20]:
        w = line.split()
        for k in range(7, 300, 12):
            w[k] = w[k][:-1] + "q"
        b.append(" ".join(w))
    b += ["y", "a c", ""]
    exact = np.array([line_dedup.edit_distance(s, t) for s, t in zip(a, b)])
    plain, fine = line_dedup.alignment_costs(a, b), line_dedup.alignment_costs(a, b, 3, True)
    assert (plain >= exact).all() and (fine >= exact).all()
    assert (5 * plain[:20] > [len(s) for s in a[:20]]).all() and (fine[:20] == exact[:20]).all()
    assert line_dedup.edit_distance(a[0], b[0], int(exact[0])) == exact[0] and line_dedup.edit_distance(a[0], a[1], 20) > 20
    assert line_dedup.linked(a, b).tolist() == [line_dedup.similar(s, t) for s, t in zip(a, b)]


def test_alignment_costs_bound_edit_distances():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 7))) for _ in range(60)]
    a, b = [""], ["x y"]
    for _ in range(800):
        w = [rnd.choice(words) for _ in range(rnd.randint(0, 40))]
        v = [x for y in w for x in rnd.choice([[y]] * 8 + [[], [rnd.choice(words)], [y, y]])]
        a.append(" ".join(w))
        b.append(" ".join(v))
    cost = line_dedup.alignment_costs(a, b)
    exact = np.array([line_dedup.edit_distance(s, t) for s, t in zip(a, b)])
    assert (cost >= exact).all() and np.mean(cost <= 2 * exact + 12) > 0.8
    assert line_dedup.alignment_costs(["a b c d"], ["a x c d"]).tolist() == [3]


def test_simhash_of_long_runs():
    rng = np.random.default_rng(1)
    count = np.array([1, 3, 254, 255, 256, 700])
    first = np.concatenate([[0], np.cumsum(count)])
    code = rng.integers(0, 1 << 63, first[-1], dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, first[-1], dtype=np.uint64)
    for got, i, j in zip(line_dedup.simhash(code, first), first[:-1], first[1:]):
        assert int(got) == sum(1 << k for k in range(64) if 2 * int(((code[i:j] >> np.uint64(k)) & np.uint64(1)).sum()) > j - i)


def test_line_dedup(spark, texts):
    lines = [(i, k, n) for i, t in texts.items() for k, x in enumerate(t.encode().split(b"\n")) if len((n := line_dedup.normal(x)).split(" ")) >= line_dedup.MIN_WORDS]
    different = sorted({n for *_, n in lines})
    links = [(i, j) for i in range(len(different)) for j in range(i) if line_dedup.similar(different[i], different[j])]
    group = roots(range(len(different)), links)
    at = {n: group[k] for k, n in enumerate(different)}
    first = {}
    for i, k, n in lines:
        first[at[n]] = min(first.get(at[n], (i, k)), (i, k))
    gone = {(i, k) for i, k, n in lines if first[at[n]] != (i, k)}
    for r in line_dedup.dedup_lines(common.table(spark, FOLDER, "documents")).collect():
        want = [x for k, x in enumerate(texts[r.doc_id].split("\n")) if (r.doc_id, k) not in gone]
        assert r.text == "\n".join(want)


def edited(rnd, line, kind):
    """line with some edits, of which the pair keeps an edit similarity of 0.8 or more; None if it does not."""
    w = line.split(" ")
    if kind == "one letter":
        i = rnd.randrange(len(line))
        new = line[:i] + rnd.choice("bcdfgq") + line[i + 1 :]
    else:
        for i in rnd.sample(range(len(w)), 1 if kind == "one word" else max(1, round(len(w) * float(kind)))):
            w[i] = "".join(rnd.choice("abcdefghijklmnop") for _ in range(max(1, len(w[i]))))
        new = " ".join(w)
    return new if new != line and line_dedup.similar(line, new) else None


def line_recall(texts, kind, low, high, count=300):
    """Share of planted pairs that are candidates, by edit similarity alone."""
    rnd = random.Random(f"{kind}{low}")
    lines = sorted({n for t in texts for x in t.encode().split(b"\n") if low <= len((n := line_dedup.normal(x)).split(" ")) < high})
    pairs = [(a, b) for a in rnd.choices(lines, k=count) if (b := edited(rnd, a, kind))]
    raw = "\n".join(x for p in pairs for x in p).encode()
    data = np.frombuffer(raw, np.uint8)
    start, end, line, *_ = line_dedup.line_words(data, np.array([0, len(data)]))
    chars, kinds = line_dedup.signatures(data, start, end, common.runs(line))
    met = np.zeros(len(pairs), bool)
    for k, close in zip(kinds, line_dedup.CLOSE):
        if k is None:
            continue
        of, keys, s1, s2 = k
        s1, s2 = s1.view(np.uint64), s2.view(np.uint64)
        a = np.flatnonzero((of[1:] == of[:-1] + 1) & (of[:-1] % 2 == 0))
        met[of[a] // 2] |= (keys[a] == keys[a + 1]).any(axis=1) & line_dedup.near(s1, s2, chars[of].astype(np.int64), a, a + 1, close)
    return met.mean()


@pytest.mark.parametrize("kind", ["one word", "one letter", "0.05", "0.15"])
@pytest.mark.parametrize("low,high", [(8, 15), (15, 30), (30, 60), (120, 400)])
def test_edited_lines_are_candidates(texts, kind, low, high):
    assert line_recall(texts.values(), kind, low, high) >= 0.9


def template_lines(n, shared, own, seed):
    """n lines of one template: the same words, with own ones put in, and a copy of each with one own word changed."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 8)))
    common_words = [word() for _ in range(shared)]
    places = sorted(rnd.sample(range(shared + own), own))
    out = []
    for _ in range(n // 2):
        mine = [word() for _ in range(own)]
        for copy in (mine, [word() if k == 0 else w for k, w in enumerate(mine)]):
            line, rest = list(common_words), list(copy)
            for p in places:
                line.insert(p, rest.pop(0))
            out.append(" ".join(line))
    return out


@pytest.mark.parametrize("n,shared,own", [(600, 10, 4), (300, 8, 3), (1000, 12, 6)])
def test_template_lines_keep_their_links(spark, n, shared, own):
    """Large buckets of lines that are near without all being links: at least 0.95 of the merges that brute force finds, and none that it does not."""
    lines = template_lines(n, shared, own, n)
    a, b = np.tril_indices(len(lines), -1)
    ok = np.concatenate([line_dedup.linked([lines[i] for i in a[k : k + 50_000]], [lines[j] for j in b[k : k + 50_000]]) for k in range(0, len(a), 50_000)])
    group = roots(range(len(lines)), zip(a[ok].tolist(), b[ok].tolist()))
    want = len(lines) - len(set(group.values()))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(5)
    kept = {r.doc_id for r in line_dedup.dedup_lines(docs).collect() if r.text}
    assert set(group.values()) <= kept
    got = len(lines) - len(kept)
    print(f"{n} lines, {shared} + {own} words: {want} merges, {got} found")
    assert 0.95 * want <= got <= want


def test_connected_is_exact():
    """Whatever order pairs come in, the forests connect what the links do, and links are asked for only where they matter."""
    rng = np.random.default_rng(3)
    parts, links = [], []
    for n, share in ((2, 1.0), (40, 0.02), (200, 0.01), (300, 0.2), (5, 0.0), (1, 0.0)):
        i, j = np.triu_indices(n, 1)
        order = rng.permutation(len(i))
        parts.append((i[order], j[order], n))
        links.append(rng.random((n, n)) < share)
    asked = []
    got = line_dedup.connected(parts, lambda some: asked.append(sum(len(p) for _, p, _ in some)) or np.concatenate([links[k][p, q] for k, p, q in some]))
    for (i, j, n), link, forest in zip(parts, links, got):
        want = roots(range(n), [(int(p), int(q)) for p, q in zip(i, j) if link[p, q]])
        assert roots(range(n), forest) == want and all(link[p, q] for p, q in forest) and len(forest) == n - len(set(want.values()))
    assert sum(asked) <= sum(len(i) for i, _, _ in parts)


def test_lines_without_links_are_asked_for_at_once():
    """Once a round finds hardly a link, all pairs that are left are decided together, not a few at a time."""
    asked = []
    i, j = np.triu_indices(60, 1)
    line_dedup.connected([(i, j, 60)], lambda some: asked.append(len(some[0][1])) or np.zeros(len(some[0][1]), bool))
    assert len(asked) == 2 and sum(asked) == len(i)


@pytest.mark.parametrize("held, row, each", [(1 << 19, 1024, 8), (40, 7, 1)])
def test_cells_tell_all_buckets(spark, monkeypatch, held, row, each):
    """Small buckets give their near pairs and large ones their lines, however the cells of keys are cut and held; the shuffle has few rows."""
    for name, value in (("HELD", held), ("ROW", row), ("CELLS_EACH", each)):
        monkeypatch.setattr(line_dedup, name, value)
    rng = np.random.default_rng(8)
    n, bands = 300, line_dedup.BANDS
    keys = rng.integers(-(1 << 31), 1 << 31, (n, bands))
    keys[:, 0] = rng.choice(rng.integers(-(1 << 31), 1 << 31, 30), n)
    keys[:90, 1] = 77
    s1 = rng.integers(0, 1 << 62, 4)[rng.integers(0, 4, n)]
    rows = [(k, 100, None, np.array([s1[k], s1[k]], "<i8").tobytes() + keys[k].astype("<i4").tobytes()) for k in range(n)]
    different = spark.createDataFrame(rows, "h1 long, chars int, grams binary, words binary")
    pairs, crowds = Counter(), Counter()
    for b in range(bands):
        for key in set(keys[:, b].tolist()):
            some = np.flatnonzero(keys[:, b] == key).tolist()
            if len(some) > line_dedup.SMALL:
                crowds.update((k, key * 2 + 1) for k in some)
            else:
                pairs.update((i, j, some[0], 0) for i in some for j in some if i < j and s1[i] == s1[j])
    got = line_dedup.candidates(different).collect()
    assert Counter((min(r.a, r.b), max(r.a, r.b), r.crowd, r.bits) for r in got if r.b is not None) == pairs and len(pairs) > 50
    assert Counter((r.a, r.key) for r in got if r.b is None) == crowds and len(crowds) == 90


def test_crowds_are_connected_without_deciding_all_pairs(spark, monkeypatch):
    """Copies of a line are joined by as few links as join them, whatever is decided together; short lines and lines that are no links keep apart."""
    rnd = random.Random(4)
    base = [" ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(10**5)}" for _ in range(30)) for _ in range(3)]
    lines = [e for x in base for e in sorted({x, *(edited(rnd, x, "one word") or x for _ in range(12))})] + ["short line of six words here", "short line of six words hers", "quite another one of them"]
    pairs = [(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines))]
    want = roots(range(len(lines)), [p for p in pairs if line_dedup.similar(lines[p[0]], lines[p[1]])])
    texts = spark.createDataFrame(list(enumerate(lines)), "h1 long, text string")
    for size in (16 << 20, 1):
        monkeypatch.setattr(line_dedup, "CROWDS_BYTES", size)
        edges = spark.createDataFrame([(i, j, i // 20, (i + j) % 50) for i, j in pairs], "a long, b long, crowd long, bits int")
        got = [(r.a, r.b) for r in line_dedup.linked_in_crowds(edges, texts).collect()]
        assert roots(range(len(lines)), got) == want and all(line_dedup.similar(lines[i], lines[j]) for i, j in got)
    one = [(r.a, r.b) for r in line_dedup.linked_in_crowds(edges.withColumn("crowd", F.lit(0).cast("long")), texts).collect()]
    assert len(one) == len(lines) - len(set(want.values()))


def test_far_pairs_are_given_up(monkeypatch):
    """Lines of one passage with different ends: pairs beyond the bound leave the table early, those within it keep their distances."""
    rng = np.random.default_rng(11)
    text = lambda n: "".join(rng.choice(list("abcdefgh \u00e9\u4e2d"), n))
    passage, a, b = text(200), [], []
    for k in range(400):
        a.append(text(int(rng.integers(1, 300))) + passage + text(int(rng.integers(1, 200))))
        b.append(a[-1][: int(rng.integers(0, 60))] + text(20) + a[-1][60:] if k % 4 == 0 else text(int(rng.integers(1, 300))) + passage + text(int(rng.integers(1, 200))))
    longer = np.array([max(len(s), len(t)) for s, t in zip(a, b)])
    exact = np.array([line_dedup.edit_distance(s, t) for s, t in zip(a, b)])
    for give_up, share in ((32, 5), (1, 5), (7, 3), (32, 2)):
        monkeypatch.setattr(line_dedup, "GIVE_UP", give_up)
        most = longer // share
        got = line_dedup.edit_distances(a, b, most)
        assert (np.where(exact <= most, got == exact, got > most)).all() and 0 < (exact <= most).sum() < len(a)
    for likely in (True, False):
        assert line_dedup.linked(a, b, likely).tolist() == (5 * exact <= longer).tolist()


def test_bigram_bound_leaves_out_no_link():
    rnd = random.Random(6)
    lines = template_lines(60, 4, 2, 1) + ["漢字漢字漢字漢字", "漢字漢字漢字漢子", "a", "ab", "", "aaaaaaaaaaaa", "aaaaaaaaaab"]
    lines += [e for x in lines for k in ("one word", "one letter", "0.15") if x and (e := edited(rnd, x, k))]
    grams = line_dedup.bigrams(lines).astype(int)
    for i in range(len(lines)):
        for j in range(i):
            if line_dedup.similar(lines[i], lines[j]):
                assert np.abs(grams[i] - grams[j]).sum() <= 4 * (max(len(lines[i]), len(lines[j])) // 5)


# --- op6 ---


def test_nearest_neighbours(spark, con):
    rows = con.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    x = {i: np.array(v, float) for i, v in rows}
    got, recall = {}, []
    for r in run(spark, "op6_ann"):
        got.setdefault(r.query_id, []).append(r)
        assert math.isclose(r.score, float(np.sqrt(((x[r.query_id] - x[r.vec_id]) ** 2).sum())), rel_tol=1e-12)
    assert set(got) == {i for i in x if i % 100 == 0}
    for q, rs in got.items():
        d = sorted((float(((x[q] - v) ** 2).sum()), i) for i, v in x.items() if i != q)[:10]
        recall.append(len({i for _, i in d} & {r.vec_id for r in rs}) / 10)
        assert [r.rank for r in sorted(rs, key=lambda r: (r.score, r.vec_id))] == list(range(1, 11))
    assert np.mean(recall) >= 0.9


def test_exact_way_for_queries_with_too_few_candidates(spark):
    """An outlier far from every bucket it visits still gets its nearest."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * 0.01).tolist()) for i in range(1, 400)] + [(0, [1e6] * 8)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    got = lsh.search(v, F.col("id") == 0, 10, probes=1).collect()
    want = sorted((float(((np.array(x) - 1e6) ** 2).sum() ** 0.5), i) for i, x in rows if i)[:10]
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [i for _, i in want]


def test_recall_where_the_longest_key_loses_neighbours(spark):
    """Too few probes for the longest key: the sample tells, and a shorter one is taken."""
    x = np.random.default_rng(4).normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>")
    got = {}
    for r in lsh.search(v, F.col("id") % 30 == 0, 10, probes=4).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = [len(got[q] & set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11].tolist())) / 10 for q in range(0, 6000, 30)]
    assert np.mean(recall) >= 0.9


# --- op7 ---


def sets_of(texts, k):
    out = {}
    for i, t in texts.items():
        ws = [w for w in re.split(rb"[\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode())) if w]
        out[i] = {tuple(ws[a : a + k]) for a in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()
    return out


def check_join(rows, texts, k, num, den):
    s = sets_of(texts, k)
    ids = sorted(s)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if s[a] and s[b] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b])]
    want = roots(ids, links)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} == {(i, len(s[i]), want[i]) for i in ids}
    return links


def test_jaccard_join(spark, texts):
    assert check_join(run(spark, "op7_jaccard_join"), texts, 3, 90, 100)


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80)])
def test_jaccard_join_of_near_copies(spark, k, num, monkeypatch):
    """Copies with random edits around the threshold, in clusters of more than one block, and sets of every small size."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "NEAR_BLOCK", 7)
    rnd = random.Random(k)
    base = [[f"w{rnd.randrange(400)}" for _ in range(n)] for n in (120, 60, 25)]
    texts, n = {}, 0
    for b in base:
        for _ in range(50):
            t = list(b)
            for _ in range(rnd.randrange(1 + len(t) // 12)):
                t[rnd.randrange(len(t))] = f"v{rnd.randrange(9000)}"
            texts[n := n + 1] = " ".join(t[: len(t) - rnd.randrange(3)])
    for size in range(12):
        for _ in range(3):
            texts[n := n + 1] = " ".join(f"u{j + (rnd.random() < 0.1)}" for j in range(size))
    rows = jaccard.jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k, num, 100).collect()
    assert check_join(rows, texts, k, num, 100)


# --- op8 ---


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n in (1, 5, 1000, 65536, 150000):
        x = np.sort(rng.integers(0, n * 50, n))
        e = lm.EliasFano.encode(x)
        assert (np.concatenate([e.block(b) for b in range(e.blocks())]) == x).all()
        k = np.sort(rng.integers(0, n * 60, 500))
        assert (e.successor(k)[0] == np.searchsorted(x, k)).all()
        assert e.low.nbytes + e.high.nbytes < 1.5 * n + 16


def test_trie():
    rng = np.random.default_rng(2)
    for _ in range(10):
        pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (300, 2))})
        t = lm.Trie(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), np.arange(len(pairs)))
        ask = sorted({(int(a), int(b)) for a, b in rng.integers(0, 45, (500, 2))})
        at = {p: i for i, p in enumerate(pairs)}
        assert t.find(np.array([p[0] for p in ask]), np.array([p[1] for p in ask])).tolist() == [at.get(p, -1) for p in ask]
        assert t.codes.tolist() == list(range(len(pairs)))
        t.close()


def test_lm_score(spark, texts):
    toks = {i: [w for w in re.split(rb"[\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode())) if w] + [None] for i, t in texts.items()}
    train = [i for i in toks if zlib.crc32(str(i).encode()) % 10 != 0]
    uni = Counter(w for i in train for w in toks[i])
    bi = Counter((v, w) for i in train for v, w in zip([b"<s>", *toks[i]], toks[i]))
    n, v = sum(uni.values()), len(uni)
    of = {**uni, b"<s>": len(train)}
    p = lambda w: (uni.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))
    given = lambda w, a: lm.LAMBDA * bi.get((a, w), 0) / of[a] + (1 - lm.LAMBDA) * p(w) if of.get(a) else p(w)
    for context in (b"<s>", next(iter(uni)), b"never seen"):  # one unknown word beside the known ones
        assert math.isclose(sum(given(w, context) for w in [*uni, b"unknown"]), 1.0, rel_tol=1e-9)
    held = []
    for r in run(spark, "op8_lm_score"):
        ws = toks[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(w in uni for w in ws), n, r.doc_id not in train)
        assert math.isclose(r.base_score, sum(math.log10(p(w)) for w in ws), rel_tol=1e-9)
        want = sum(math.log10(given(w, a)) for a, w in zip([b"<s>", *ws], ws))
        assert abs(r.score - want) <= 3e-4 * len(ws)
        if r.held_out:
            held.append((r.score, r.base_score))
    assert sum(a for a, _ in held) > sum(b for _, b in held)


def test_lm_score_of_an_unseen_context_and_of_rows_in_any_order(spark):
    rows = [(1, "a b", True), (2, "a b", True), (3, "zzz a", False)]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string, train boolean"), ~F.col("train"), F.col("train")).collect()}
    p = lambda c: (c + 0.1) / (6 + 0.1 * 4)
    mix = lambda c, of, w: lm.LAMBDA * c / of + (1 - lm.LAMBDA) * w
    want = math.log10(mix(0, 2, p(0))) + math.log10(p(2)) + math.log10(mix(0, 2, p(2)))  # zzz at the beginning; a after zzz; the end after a
    assert abs(got[3].score - want) < 1e-3
    docs = common.table(spark, FOLDER, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 10
    key = lambda df: {(r.doc_id, r.n_tokens, r.n_known, round(r.score, 2)) for r in df.collect()}
    assert key(lm.score(docs, fold == 0, fold != 0)) == key(lm.score(docs.repartition(5, F.rand(3)), fold == 0, fold != 0))


# --- op9 ---


def test_byte_bpe(spark, texts):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.default_path(), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in run(spark, "op9_byte_bpe"):
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    rnd = random.Random(1)
    alpha = [*"ab sS'  \n\t1٣é中!?\"", "'s", "'ll", "'re", "'ve", "'d", "'l", " ", "　", " ", "ñ", "😀", "\x1c", "re", "ll", "<|endoftext|>"]
    odd = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["".join(rnd.choice("abcdefgh") for _ in range(3000)), " " * 500]
    bpe, raw = byte_bpe.coder(byte_bpe.default_path()), [t.encode() for t in odd]
    off = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    for t, got in zip(odd, bpe.encode(b"".join(raw), off)):
        ids = np.frombuffer(got, "<u4")
        assert ids.tolist() == enc.encode_ordinary(t)
        at = bpe.offsets(ids)
        assert [t.encode()[a:b] for a, b in zip(at[:-1], at[1:])] == [bpe.pieces[i] for i in ids.tolist()]


# --- op10 ---


def test_word_ids():
    tok = packing.WordTokenizer(packing.default_path())
    rnd = random.Random(2)
    alpha = [*"ab S'  \n\t1ȩ́中!.,\"Σİ́", "<|endoftext|>", "<|EndOfText|>", "'s", " ", "\r", "\x0b", " ", "ſ", "יִ", "K"]
    odd = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 30))) for _ in range(5000)]
    for t, got in zip(odd, tok.encode(odd)):
        assert np.frombuffer(got, "<u4").tolist() == tok.inner.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_path())
    docs, bins = {}, {}
    for r in run(spark, "op10_packing"):
        docs.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in texts.items():
        ids, at = [*tok.encode(t, add_special_tokens=False).ids, 1], 0
        for k, r in enumerate(sorted(docs[i], key=lambda r: r.piece)):
            part = ids[at : at + 4096]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            at += len(part)
        assert at == len(ids)
    for spans in bins.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= 4096
    total = sum(n for spans in bins.values() for _, n in spans)
    assert len(bins) <= -(-total // 4096) + 1


def test_plan_places_every_piece():
    rng = np.random.default_rng(4)
    for most in (60, 3000):
        lengths = np.sort(rng.choice(np.arange(1, 501), 80, replace=False))
        counts = rng.integers(1, most, 80)
        bins = packing.plan(lengths.tolist(), counts.tolist(), 500)
        placed = Counter()
        for n, what in bins:
            assert sum(s * k for s, k in what) <= 500
            for s, k in what:
                placed[s] += n * k
        assert placed == Counter(dict(zip(lengths.tolist(), counts.tolist())))
        assert sum(n for n, _ in bins) <= 1.005 * sum(n for n, _ in packing.best_fit(lengths, counts, 500)) + 1


@pytest.mark.parametrize("most", [4, 60, 3000])
def test_configuration_lp_is_near_its_dual_bound_and_places_most_tokens(most):
    rng = np.random.default_rng(most)
    size = np.unique(np.minimum(1023, rng.lognormal(5, 1, 600).astype(int) + 1))
    counts = rng.integers(1, most, len(size))
    cover = packing.solve(size, counts, 1024)
    used = np.bincount(cover.index, weights=cover.many * np.repeat(cover.times, np.diff(cover.edge)), minlength=len(size))
    assert np.allclose(used + cover.left, counts) and (cover.left >= 0).all()
    assert all((size[cover.index[a:b]] * cover.many[a:b]).sum() <= 1024 for a, b in zip(cover.edge[:-1], cover.edge[1:]))
    assert cover.primal <= (1 + packing.GAP) * cover.dual
    assert cover.dual <= sum(n for n, _ in packing.best_fit(size, counts, 1024))  # a bound of every packing
    bins, left = packing.lp_bins(size, counts, 1024)
    assert (left >= 0).all() and sum(n * s * k for n, what in bins for s, k in what) == (size * (counts - left)).sum()
    assert (size * left).sum() <= 0.1 * (size * counts).sum()
    assert sum(n for n, _ in packing.plan(size.tolist(), counts.tolist(), 1024)) <= (1 + packing.GAP) * cover.dual + 1


def test_configuration_lp_without_full_patterns():
    """Thirds and halves of a sequence leave room in every pattern; the bound is not that of the tokens."""
    for size, counts in (([300], [500]), ([100, 300], [10, 500]), ([100, 200, 300], [1000, 400, 500]), ([7, 490], [10**6, 10**6]), ([1], [10**7])):
        cover = packing.solve(np.array(size), np.array(counts), 500)
        n = sum(n for n, _ in packing.plan(size, counts, 500))
        assert cover.dual <= n * 1.0000001 and n <= 1.03 * cover.dual + 1


# --- op3 ---


def test_escapes_are_reversible():
    rnd = random.Random(6)
    for _ in range(3000):
        t = "".join(rnd.choice(["<", "|", "\\", "x", "im_end|>", "\n"]) for _ in range(rnd.randrange(12)))
        e = chat.escape(t)
        assert "<|" not in e and chat.unescape(e) == t and chat.unescape_role(chat.escape_role(t)) == t


# --- components ---


def test_components(spark):
    rnd = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + rnd.randrange(80), 1000 + rnd.randrange(80)) for _ in range(60)] + [(5000, 5000 + k) for k in range(200)] + [(7, 7)]
    want = roots({x for e in edges for x in e}, edges)
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: c for i, c in want.items() if sum(x != y and i in (x, y) for x, y in edges)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("kind", ["corpus", "even", "thirds", "halves"])
def test_plans_need_no_more_sequences_than_best_fit(con, kind):
    rng, capacity = np.random.default_rng(3), 1024
    if kind == "corpus":  # fifty times the lengths of the table
        n = np.array([c for (c,) in con.sql("SELECT n_chars FROM documents WHERE n_chars > 0").fetchall()]) // 3 + 1
        size, count = np.unique(n % capacity, return_counts=True)
        size, count = size[size > 0], 50 * count[size > 0]
    else:
        x = {"even": rng.integers(1, capacity, 9000), "thirds": rng.normal(capacity / 3, 45, 9000).astype(int), "halves": rng.normal(capacity / 2, 60, 9000).astype(int)}[kind]
        size, count = np.unique(np.clip(x, 1, capacity - 1), return_counts=True)
    bins = packing.plan(size.tolist(), count.tolist(), capacity)
    placed = Counter()
    for n, what in bins:
        assert sum(s * k for s, k in what) <= capacity
        for s, k in what:
            placed[s] += n * k
    assert placed == dict(zip(size.tolist(), count.tolist()))
    ours, plain = sum(n for n, _ in bins), sum(n for n, _ in packing.best_fit(size, count.copy(), capacity))
    print(kind, ours, plain, -(-int((size * count).sum()) // capacity))
    assert ours <= plain
