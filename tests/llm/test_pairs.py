"""Operators that compare texts: near copies, sketches, repeated passages."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinespark.llm import components, fingerprints, passages, simhash
from tests.llm.test_scans import LOWER, ODD, odd, words

WORDS = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def plain_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def classes(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_fingerprint():
    rng = random.Random(0)
    for t in [None, "", "\n", "A", "a b", "a B c D", "x\x85y z", *(prose(rng, n) for n in (3, 4, 5, 100))]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_spark_hashes_alike(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).collect()[0][0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c d", 42)


def near_fingerprints(n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    out = [x]
    for k in (1, 2, 3, 4, 5, 6):
        y = x[: n // 2].copy()
        for i in range(len(y)):
            for b in rng.choice(64, k, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
        out.append(y)
    return np.unique(np.concatenate(out))


@pytest.mark.parametrize("per_bucket", [10_000_000, 60_000, 10_000])
def test_links_by_brute_force(spark, per_bucket):
    x = near_fingerprints()
    a, b = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1))
    signed = x.view(np.int64).tolist()
    want = classes(signed, [(signed[i], signed[j]) for i, j in zip(a, b, strict=True)])
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = [(r["a"], r["b"]) for r in simhash.links(df, bucket_variants=per_bucket).collect()]
    assert classes(signed, found) == want and len(found) < 25 * len(x)


def test_a_large_ball_makes_few_links():
    """Thousands of fingerprints that all lie together are linked as a forest, not pair by pair."""
    x = simhash.flips(list(range(64)), 2) ^ np.uint64(12345)
    a, _ = simhash.meet(x, 0, 0, 2, most=500_000)
    assert len(a) == len(x) - 1


def test_components_of_links(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2200)]
    nodes = {n for e in links if e[0] != e[1] for n in e}
    want = classes(nodes, [e for e in links if e[0] != e[1]])
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies(spark):
    rng = random.Random(1)
    base = [prose(rng, 300) for _ in range(20)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, t) for k, t in enumerate(base[:10])] + [(200 + k, t + " tail") for k, t in enumerate(base)]
    got = {r["doc_id"]: r for r in simhash.with_digest(simhash.components(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    fp = {i: plain_fingerprint(t) for i, t in rows}
    want = classes(sorted(fp), [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    assert {i: r["component_id"] for i, r in got.items()} == want and all(got[i]["fingerprint"] == f"{f:016x}" for i, f in fp.items())


def test_near_copies_of_odd_rows(spark):
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.components(odd(spark)).collect()}
    assert got[1, 0] == got[2, 0] == got[3, 0] == 1 and simhash.components(odd(spark)).count() == len(ODD)
    kept = simhash.keep_first(odd(spark))
    assert kept.dtypes == odd(spark).dtypes and {r["__id"] for r in kept.collect()} == {"x"}
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x)) == [1, 4, 7, None]
    twice = odd(spark).unionByName(odd(spark))
    assert simhash.keep_first(twice).count() == 4
    assert simhash.components(odd(spark).where("false")).count() == 0 and simhash.keep_first(odd(spark).where("false")).count() == 0


def test_rows_that_repeat_an_id(spark):
    """Texts of one id that are no copies of each other both stay; copies under any id go."""
    rng = random.Random(17)
    a, b, c = (prose(rng, 200) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, b), (3, a), (4, c), (4, c), (None, a), (None, prose(rng, 200))]
    kept = sorted(map(tuple, simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (4, c), rows[-1]], key=str)


# --- sketches ---


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sketches_estimate(spark):
    rng = random.Random(2)
    a = [prose(rng, 1500) for _ in range(6)]
    rows = [(t, " ".join(t.split()[: 1500 - 200 * k] + prose(rng, 200 * k).split())) for k, t in enumerate(a)]
    df = spark.createDataFrame(rows, "a string, b string")
    df = fingerprints.with_sketch(fingerprints.with_sketch(df, "a", "x", 512), "b", "y", 512)
    out = df.select("a", "b", fingerprints.resemblance(F.col("x"), F.col("y"), 512).alias("j"), fingerprints.containment(F.col("x"), F.col("y"), 512).alias("c"), fingerprints.distinct_count(F.col("x"), 512).alias("n")).collect()
    for r in out:
        s, t = shingles(r["a"]), shingles(r["b"])
        assert abs(r["j"] - len(s & t) / len(s | t)) < 0.08 and abs(r["c"] - len(s & t) / len(s)) < 0.15 and abs(r["n"] / len(s) - 1) < 0.15


def test_sketches_merge(spark):
    rng = random.Random(3)
    parts = [prose(rng, 60) for _ in range(100)]
    df = fingerprints.with_sketch(spark.createDataFrame([("k", p) for p in parts] + [("e", ""), (None, "one")], "key string, text string"), "text", "s")
    got = {r["key"]: r["s"] for r in fingerprints.merge_sketches(df, "key", "s", fan_in=4).collect()}
    every = sorted({h for r in df.where("key = 'k'").collect() for h in r["s"]})
    assert got["k"] == every[: fingerprints.K] and got["e"] == [] and len(got[None]) == 1


def test_next_documents(spark):
    rng = random.Random(5)
    docs = {i: prose(rng, rng.randrange(1, 30)) for i in rng.sample(range(10_000), 200)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    order = sorted(docs, reverse=True)
    for buckets in (1, 7, 400):
        got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(df, "doc_id", "text", buckets).collect()}
        assert got == {i: docs[order[(k + 1) % len(order)]] for k, i in enumerate(order)}


def test_edited_texts(spark):
    rows = [(3, "abcdefghi"), (2, "XY"), (1, None), (0, "zé9")]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["edited"] for i in (3, 2, 1, 0)] == ["abcdefXY", "XY", "", "zéa"]
    assert [got[i]["n_chars"] for i in (3, 2, 1, 0)] == [9, 2, 0, 3]


def test_sketches_of_odd_rows(spark):
    got = fingerprints.with_digest(fingerprints.fingerprint_documents(odd(spark))).collect()
    assert len(got) == len(ODD)
    rows = {r["doc_id"]: r for r in got}
    assert rows[1]["fingerprint"] == "" and rows[1]["near_edited"] == 1.0 and rows[5]["fingerprint"] == rows[4]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.fingerprint_documents(odd(spark).where("false")).count() == 0
    assert fingerprints.fingerprint_documents(odd(spark).where("doc_id = 7")).count() == 1


# --- passages ---


def test_chains():
    assert passages.chain([(0, 10, 0, 10), (20, 30, 20, 30)]) == [[0, 1]]
    assert sorted(passages.chain([(0, 10, 100, 110), (20, 30, 0, 10)])) == [[0], [1]]
    assert passages.chain([(0, 10, 0, 10), (500, 510, 12, 22)])[0] in ([0], [1])
    assert passages.chain([(0, 10, 0, 10), (12, 14, 300, 302), (20, 30, 20, 30)])[0] == [0, 2]


def test_best_chain_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        seg = [(int(x), int(x + n), int(y), int(y + n)) for x, y, n in zip(rng.integers(0, 60, 6), rng.integers(0, 60, 6), rng.integers(1, 12, 6), strict=True)]

        def score(i):
            best = 0.0
            for j in range(6):
                if seg[j][1] <= seg[i][0] and seg[j][3] <= seg[i][2] and seg[j] < seg[i]:
                    best = max(best, score(j) - passages.GAP_COST * (seg[i][0] - seg[j][1] + seg[i][2] - seg[j][3]))
            return seg[i][1] - seg[i][0] + best

        top = max(score(i) for i in range(6))
        own = passages.chain(seg)[0]
        got = sum(seg[i][1] - seg[i][0] for i in own) - passages.GAP_COST * sum(seg[b][0] - seg[a][1] + seg[b][2] - seg[a][3] for a, b in zip(own, own[1:], strict=False))
        assert np.isclose(got, top)


def spans(text):
    return [tuple(map(int, p.split(":"))) for p in text.split(",") if p]


def test_repeated_passages(spark):
    rng = random.Random(6)
    shared = prose(rng, 80)
    fuzzy = shared.split()
    fuzzy[20], fuzzy[45] = "changed", "also"
    del fuzzy[60]
    rows = [(k, prose(rng, 100)) for k in range(10)]
    rows += [(20, f"{prose(rng, 30)} {shared} {prose(rng, 30)}"), (21, f"{shared.upper()} {prose(rng, 10)}"), (22, f"{prose(rng, 5)} {' '.join(fuzzy)}")]
    rows += [(30, " ".join([prose(rng, 60)] * 2)), (40, prose(rng, 20) + " " + " ".join(shared.split()[:30]))]
    got = {r["doc_id"]: r for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and all(not got[k]["passages"] and got[k]["class_id"] == k for k in [*range(10), 30, 40])
    assert spans(got[20]["passages"]) == [(30, 110)] and spans(got[21]["passages"]) == [(0, 80)] and spans(got[22]["passages"]) == [(5, 84)]
    assert {got[k]["class_id"] for k in (20, 21, 22)} == {20} and got[20]["n_links"] == 2


@pytest.mark.parametrize("wide", [False, True])
def test_verbatim_repeats_by_brute_force(spark, wide):
    rng = random.Random(7)
    pool = [prose(rng, n) for n in (50, 55, 70)]
    rows = [(i * (1 << 40) if wide else i, " ".join([prose(rng, rng.randrange(40)), *rng.sample(pool, rng.randrange(3)), prose(rng, rng.randrange(40))])) for i in range(40)]
    got = {r["doc_id"]: r for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), set()).add(i)
    for i, t in rows:
        w = words(t)
        covered = [any(a <= k < b for a, b in spans(got[i]["passages"])) for k in range(len(w))]
        for k in range(len(w) - 49):
            if len(seen[tuple(w[k : k + 50])]) > 1:
                assert all(covered[k : k + 50])


def test_parts_of_chains_by_brute_force():
    rng = random.Random(13)
    for _ in range(300):
        xs, ys, x, y = [], [], rng.randrange(3), rng.randrange(3)
        for _ in range(rng.randrange(1, 60)):
            xs.append(x)
            ys.append(y)
            off = rng.random() < 0.3
            x, y = x + 1 + off * rng.randrange(4), y + 1 + off * rng.randrange(4)
        fit = [(a, b) for a in range(len(xs)) for b in range(a, len(xs)) if (b - a + 1) / max(xs[b] - xs[a] + 1, ys[b] - ys[a] + 1) >= 0.8]
        fit = [(a, b) for a, b in fit if not any(c <= a and b <= d and (a, b) != (c, d) for c, d in fit)]
        want = [(xs[a], xs[b] + 1, ys[a], ys[b] + 1) for a, b in fit if min(xs[b] - xs[a], ys[b] - ys[a]) + 1 >= 10]
        assert [t[:4] for t in passages.parts(np.array(xs), np.array(ys), 10, 0.8)] == want


@pytest.mark.parametrize("table", [1 << 27, 20])
def test_common_words_by_brute_force(monkeypatch, table):
    monkeypatch.setattr(passages, "TABLE_BITS", table)
    rng = random.Random(14)
    for _ in range(300):
        a, b = (np.array([rng.randrange(6) for _ in range(rng.randrange(14))], dtype=np.uint64) for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        x, y = passages._common(a, b)
        assert len(x) == len(y) == best[-1, -1] and (a[x] == b[y]).all() and (np.diff(x) > 0).all() and (np.diff(y) > 0).all()


@pytest.mark.parametrize("gaps", [(60, 60), (40, 40), (60, 35), (90, 90)])
def test_verbatim_passages_with_a_gap_between(spark, gaps):
    rng = random.Random(15)
    one, two = prose(rng, 60), prose(rng, 60)
    rows = [(k, f"{prose(rng, 20)} {one} {prose(rng, g)} {two} {prose(rng, 20)}") for k, g in enumerate(gaps)]
    got = {r["doc_id"]: r for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, g in enumerate(gaps):
        covered = {w for a, b in spans(got[k]["passages"]) for w in range(a, b)}
        assert covered >= {*range(20, 80), *range(80 + g, 140 + g)} and got[k]["n_links"] == 1


@pytest.mark.parametrize("n", [20, 50, 200, 700])
def test_gaps_of_all_sizes_have_one_measure(n):
    """A word more at one end of a gap and one less at the other costs one word; words in another order do not count."""
    word = np.arange(5 * n, dtype=np.uint64)
    ends, gap = word[:30], word[30 : 30 + n]
    a = np.concatenate([ends, gap, ends])
    moved, turned = (np.concatenate([ends, x, ends]) for x in (np.r_[word[-1:], gap[:-1]], gap[::-1]))
    apart, merged = [(0, 30, 0, 30), (n + 30, n + 60, n + 30, n + 60)], [(0, n + 60, 0, n + 60)]
    for segments in (apart, merged):
        for b, equal in ((moved, n - 1), (turned, 1)):
            xs, ys, sure, _ = passages.align(a, b, segments)
            assert sure == slice(0, len(xs)) and (xs[0], xs[-1], ys[0], ys[-1]) == (0, n + 59, 0, n + 59) and len(xs) == 60 + equal and (a[xs] == b[ys]).all()


def test_seeds_do_not_depend_on_other_texts():
    rng = random.Random(9)
    texts = [prose(rng, n) for n in (5, 50, 49, 200, 8, 60)]
    hashes, bounds = passages._text_words(texts)
    h, doc, pos, around, near = passages.seeds_of(hashes, bounds)
    for k, t in enumerate(texts):
        alone = passages.seeds_of(*passages._text_words([t]))
        assert all(x[doc == k].tolist() == y.tolist() for x, y in ((h, alone[0]), (pos, alone[2]), (around, alone[3]), (near, alone[4])))
    assert set(doc.tolist()) == {1, 3, 5}  # shorter ones can have no passage
    w = words(texts[3])
    _, _, all_pos, _, _ = passages.seeds_of(hashes, bounds, every=1)
    assert set(pos[doc == 3].tolist()) <= set(range(len(w) - passages.K + 1)) and len(all_pos) == sum(len(words(texts[k])) - passages.K + 1 for k in (1, 3, 5))


def changed(rng, w, share):
    w = list(w)
    for k in rng.sample(range(1, len(w) - 1), round(share * len(w))):
        w[k] = f"new{rng.randrange(10**9)}"
    return w


@pytest.mark.parametrize("n", [50, 60, 100, 200])
def test_fuzzy_passages_are_found(spark, n):
    """Of passages with single words changed at random places, nine in ten at least are found at each likeness.

    Passages begin and end with equal words, so the first and last are not changed.
    """
    rng = random.Random(n)
    made, rows = {}, []
    for like in (0.82, 0.86, 0.9, 0.95):
        for k in range(40):
            p = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            made.setdefault(like, []).append(len(rows))
            ends = [[f"v{rng.randrange(10**9)}" for _ in range(30)] for _ in range(4)]
            rows.append((len(rows), " ".join([*ends[0], *p, *ends[1]])))
            rows.append((len(rows), " ".join([*ends[2], *changed(rng, p, 1 - like), *ends[3]])))
    got = {r["doc_id"]: r for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for like, firsts in made.items():
        linked = [k for k in firsts if got[k + 1]["class_id"] == k]
        assert len(linked) >= 0.9 * len(firsts), (like, len(linked))
        covered = sum(min(b, 30 + n) - max(a, 30) for k in linked for a, b in spans(got[k]["passages"]))
        assert covered >= 0.9 * n * len(linked)


@pytest.mark.parametrize("parts", [[(0, 40), (40, 80)], [(0, 45), (20, 65), (35, 80)], [(k, k + 12) for k in range(0, 80, 6)]])
def test_others_that_hold_parts_hide_no_passage(spark, parts):
    """Two documents share 80 words; earlier ones hold parts of these, each too short for a passage."""
    rng = random.Random(len(parts))
    rows, pairs, filler = [], [], lambda: " ".join(f"v{rng.randrange(10**9)}" for _ in range(30))
    for _ in range(50):
        p = [rng.choice(WORDS) + str(rng.randrange(100)) for _ in range(80)]
        for a, b in parts:
            rows.append((len(rows), f"{filler()} {' '.join(p[a:b])} {filler()}"))
        pairs.append((len(rows), len(rows) + 1))
        for _ in range(2):
            rows.append((len(rows), f"{filler()} {' '.join(p)} {filler()}"))
    got = {r["doc_id"]: r for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[a]["class_id"] == got[b]["class_id"] == a and got[b]["n_links"] == 1 for a, b in pairs)
    assert all(not r["passages"] for k, r in got.items() if not any(k in x for x in pairs))


def test_what_is_reported_is_alike_by_brute_force(spark):
    rng = random.Random(16)
    rows = []
    for k in range(30):
        p = [rng.choice(WORDS) for _ in range(rng.randrange(50, 120))]
        for j in range(2):
            rows.append((2 * k + j, " ".join([prose(rng, 20), *changed(rng, p, rng.choice((0, 0.05, 0.1))), prose(rng, 20)])))
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = {i: words(t) for i, t in rows}
    assert len(found) >= 28
    for r in found:
        a, b = text[r["doc"]][r["x0"] : r["x1"]], text[r["rep"]][r["y0"] : r["y1"]]
        best = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        assert min(len(a), len(b)) >= 50 and 0.8 <= r["likeness"] <= best[-1, -1] / max(len(a), len(b)) + 1e-9


@pytest.mark.parametrize("few", [passages.FEW, 0])
def test_slices_lead_to_the_same_passages(spark, monkeypatch, few):
    """Texts that agree far beyond their common seeds, because others have these first, are aligned as a whole."""
    rng = random.Random(10)
    parts = [prose(rng, 120) for _ in range(6)]
    rows = [(k, p) for k, p in enumerate(parts[:3])] + [(10, " ".join(parts)), (11, " ".join([prose(rng, 30), *parts, prose(rng, 30)])), (12, prose(rng, 400))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(passages, "FEW", few)
    found = [sorted(map(tuple, passages.passages(df, reach=r).collect())) for r in (None, 5, 256)]
    assert found[0] == found[1] == found[2] and any(r[:2] == (11, 10) for r in found[0])


def test_passages_of_odd_rows(spark):
    rng = random.Random(8)
    t = prose(rng, 90)
    rows = [*ODD, (50, t), (51, t), (51, t), (None, t)]
    got = passages.repeated(odd(spark, rows)).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["passages"] for r in got}[51] == "0:90"
    assert all(r["passages"] == "" for r in got if r["doc_id"] not in (50, 51))
    assert passages.repeated(odd(spark).where("false")).count() == 0
