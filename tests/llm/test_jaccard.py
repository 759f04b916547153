import random
import re

import pytest

from quorumlake.llm import jaccard as J

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            n = len(x & y)
            if x and y and den * n >= num * (len(x) + len(y) - n):
                u, v = find(ids[a]), find(ids[b])
                parent[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(seed, groups, each, words):
    """Groups of near copies whose similarities lie around the threshold."""
    r = random.Random(seed)
    vocabulary, rows = [f"w{i}" for i in range(400)], []
    for _ in range(groups):
        base = r.choices(vocabulary, k=words)
        for _ in range(each):
            t = list(base)
            for _ in range(r.randint(0, 6)):
                t[r.randrange(words)] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(t)))
    passage = " ".join(r.choices(vocabulary, k=30))
    rows += [(len(rows) + i, passage + " " + " ".join(r.choices(vocabulary, k=r.randint(0, 25)))) for i in range(60)]
    return rows


def run(spark, rows, **kw):
    out = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), **kw)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}


@pytest.mark.parametrize("block", [1024, 6])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(J, "CLUSTER_BLOCK", block)
    monkeypatch.setattr(J, "LEADERS", 2)
    monkeypatch.setattr(J, "ROUTE_BLOCK", 16 if block < 10 else 1024)
    rows = copies(block, 4, 30, 90)
    assert run(spark, rows, k=4, num=85, den=100) == brute(rows, 4, 85, 100)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one two three"), (8, "a b c d e f"), (9, "A b  c d\ne f"),
            (10, "a b c d e f g h i j k l m n o p q r s t u v w x y z aa bb cc dd"), (11, "a b c d e f g h i j k l m n o p q r s t u v w x y z aa bb cc dd ee")]
    assert run(spark, rows, k=5, num=80, den=100) == brute(rows, 5, 80, 100)
    long = [(4, thue_morse(2048)), (5, thue_morse(2048).translate(str.maketrans("ab", "ba"))), (1, "x " * 50_000 + "y"), (2, "x " * 60_000 + "y"), (3, "z" * 300_000)]
    assert run(spark, long, k=4, num=85, den=100) == brute(long, 4, 85, 100)


def test_empty_table_and_repeats(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "q r s t u v")], "doc_id long, text string")
    got = sorted(tuple(r) for r in J.jaccard_components(df.withColumn("cluster", df.doc_id)).fillna(-1).collect())
    assert got == [(-1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 2, 2)]


def test_words_hash_alike_alone_and_in_blocks(monkeypatch):
    texts = ["Alpha beta", "", "gamma\tdelta  alpha", "z" * 127 + " " + "z" * 128 + " " + "z" * 129]
    whole, count = J.word_hashes([t.encode() for t in texts])
    alone = [int(h) for t in texts if t for h in J.word_hashes([t.encode()])[0]]
    assert count.tolist() == [2, 0, 3, 3] and whole.tolist() == alone and whole[0] == whole[4]
    sets = J.shingle_sets(texts, 2)
    monkeypatch.setattr(J, "HASH_BYTES", 1)
    assert [x.tolist() for x in sets] == [x.tolist() for x in J.shingle_sets(texts, 2)]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_cancel_out():
    r = random.Random(5)
    one, other = thue_morse(2048), thue_morse(2048).translate(str.maketrans("ab", "ba"))
    words = {one, other, *(one[:n] for n in (7, 8, 9, 16, 17, 64, 127, 128, 129, 1024)), *(f"x{i}" for i in range(50_000)), *(chr(c) * n for c in range(97, 123) for n in range(1, 140))}
    h, n = J.word_hashes([" ".join(sorted(words)).encode()])
    assert n.tolist() == [len(words)] and len(set(h.tolist())) == len(words)
    texts = [" ".join(r.choices("0123456789", k=2000)), " ".join(f"row{i:03d}" for i in range(20_000)), " ".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=30_000)),
             " ".join(r.choices(["x1", "x2", "x3", "x4", "x5", "x6", "x7"], k=3000)), " ".join(r.choices([one, other], k=200))]
    for t, s in zip(texts, J.shingle_sets(texts, 4)):
        w = t.split()
        assert len(s) == len({tuple(w[i:i + 4]) for i in range(len(w) - 3)})


def test_short_texts_of_few_words_do_not_link_by_chance(spark):
    r = random.Random(6)
    rows = [(0, "x6 x4 x1 x1"), (1, "x1 x7 x1 x1")] + [(i, " ".join(f"x{r.randint(1, 7)}" for _ in range(4))) for i in range(2, 300)]
    assert run(spark, rows, k=4, num=85, den=100) == brute(rows, 4, 85, 100)
    rows = [(i, " ".join(r.choices("0123456789", k=r.choice([5, 60, 61, 300])))) for i in range(200)]
    rows += [(200 + i, t + " 7") for i, t in rows[:50]]
    assert run(spark, rows, k=4, num=85, den=100) == brute(rows, 4, 85, 100)


def test_bounds_hold_for_partial_bitmaps():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(3)
    sets = []
    for n in (1, 5, 30, 70, 130, 300, 900, 2500):
        base = r.integers(0, 2**62, n)
        sets += [np.unique(np.concatenate([base[:int(n * q)], r.integers(0, 2**62, n - int(n * q))])) for q in (0, 0.5, 0.8, 0.9, 0.95, 1)]
    maps = J._Bitmaps(pa.chunked_array([pa.array([J.route_bitmap(s) for s in sets], pa.binary())]))
    n = np.array([len(s) for s in sets])
    x, y = (v.ravel() for v in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    most, both = maps.most(x, y, n), np.array([J.common(sets[i], sets[j]) for i, j in zip(x, y)])
    assert (most >= both).all() and (most <= np.minimum(n[x], n[y])).all()
    apart = (both < 0.1 * np.minimum(n[x], n[y])) & (np.minimum(n[x], n[y]) > 100)
    assert (most < J._needed(n[x], n[y], 85, 100))[apart].mean() > 0.95
    leaves = [J.signature_tree(n.tolist(), maps.inside.tolist(), [i], maps.bits) for i in range(len(sets))]
    assert all(J._most(leaves[i], leaves[j]) >= b for i, j, b in zip(x, y, both))
