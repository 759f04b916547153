"""Linkage by several kinds of blocks and prefix search, against all pairs and the published tiers."""

import random

from pyspark.sql import functions as F

from quorumlake.functions import keys as K
from quorumlake.operators import blocklink, prefix

GROUPS, ENTRIES = "id long, pos string, toks array<string>, sks array<string>", "rid long, rpos string, rform string, rtoks array<string>, rsks array<string>"


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def best_by_hand(groups, entries, accept):
    out = {}
    for i, pos, toks, sks in groups:
        toks = list(dict.fromkeys(toks))
        scored = []
        for r, rpos, form, rtoks, rsks in entries:
            if not sks or not (set(toks) & set(rtoks) or set(sks) & set(rsks)) or (pos and rpos and pos != rpos):
                continue
            mode = max(sorted(set(sks)), key=lambda s: (sks.count(s), s))
            m, g = sum(s in rsks for s in sks) / len(sks), len(set(toks) & set(rtoks)) / len(toks) if toks else 0.0
            f = 1 - edit(form, mode) / max(len(form), len(mode), 1) if form else 0.0
            scored.append((round(0.42 * m + 0.36 * f + 0.22 * g, 6), -r))
        if scored and max(scored)[0] >= accept:
            out[i] = (-max(scored)[1], max(scored)[0])
    return out


def test_links_equal_all_pairs(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choices("abc", k=n))
    groups = [(i, r.choice([None, "n", "v"]), r.choices(["hot", *"stuvwxyz"], k=r.randint(0, 6)), [word(r.randint(1, 4)) for _ in range(r.randint(0, 4))]) for i in range(150)]
    entries = [(1000 + i, r.choice([None, "n", "v"]), r.choice(["", word(3), word(4)]), r.choices(["hot", *"stuvw", *"klm"], k=r.randint(0, 5)), [word(r.randint(2, 4)) for _ in range(r.randint(0, 3))]) for i in range(120)]
    entries += [(2000, None, "abcabc", [], ["zz" * 3]), (2001, None, "abcabc", [], ["zz" * 3])]
    groups += [(900, "n", ["nothing"], ["zz" * 3]), (901, "n", [], []), (902, "n", ["nothing"], ["zz" * 3])]
    a, b = spark.createDataFrame(groups, GROUPS), spark.createDataFrame(entries, ENTRIES)
    for accept in (0.42, 0.6):
        got = {x["id"]: (x["rid"], x["score"]) for x in blocklink.block_link(a, b, accept).collect()}
        want = best_by_hand(groups, entries, accept)
        assert got == want
        assert accept > 0.42 or got[900][0] == got[902][0] == 2000  # by the skeleton alone
    assert blocklink.block_link(a.limit(0), b).count() == 0


def test_hot_tokens_make_no_block_where_they_decide_nothing(spark):
    n = spark.range(1000)
    groups = n.select("id", F.lit("n").alias("pos"), F.array(*[F.lit("hot"), *[F.concat(F.lit(c), F.col("id").cast("string")) for c in "abcdefg"]]).alias("toks"), F.array(F.concat(F.lit("sk"), F.col("id").cast("string"))).alias("sks")).withColumn("kid", F.col("id"))
    entries = n.select(F.col("id").alias("rkid"), F.array(*[F.lit("hot"), *[F.concat(F.lit(c), F.col("id").cast("string")) for c in "abc"]]).alias("rtoks"), F.array(F.concat(F.lit("sk"), F.col("id").cast("string"))).alias("rsks"))
    a, b = blocklink._blocks(groups, entries, 0.42)
    # of eight tokens three must be shared: two of those that entries have, the most frequent ones, make no block
    assert a.where("k.key = 'hot'").isEmpty() and a.join(b, "k").select("kid", "rkid").distinct().count() == 1000


ROWS = [(1, "Kostka", "cube, small bone; to x", [("kost", 1), ("bone", 4)], [("kocka", True), ("Wúrfel", False)]),
        (2, "kosť", "bone", [], [("кость", True)]), (3, "Košťa", "", [("kosta", 9)], []), (4, "pole", "field", [], [("Kost", False)])]


def found(spark, q, **options):
    rows = spark.createDataFrame(ROWS, "entry long, title string, gloss string, keys array<struct<key:string,rank:int>>, aliases array<struct<word:string,first:boolean>>")
    out = prefix.search(spark.createDataFrame([(x,) for x in q], "q string"), prefix.terms_of(rows, K.ascii_skeleton), rows.select("entry", "title"), K.ascii_skeleton, **options).collect()
    return {x: [(r["entry"], r["score"]) for r in sorted(out, key=lambda r: r["k"]) if r["q"] == x] for x in q}


def test_tiers(spark):
    got = found(spark, ["kostka", "to bone", "kost", "kos", "wur", "w", "кость", "mall", "ostk", "KOCKA", "", "zzz"])
    assert got["kostka"] == [(1, 100)]
    assert got["to bone"] == [(1, 73), (2, 55)]
    assert got["kost"] == [(2, 90), (1, 82), (4, 62), (3, 60)]
    assert got["kos"] == [(1, 60), (3, 60), (2, 60), (4, 44)]
    assert got["wur"] == [(1, 44)] and got["w"] == []  # one letter is no beginning of an alias
    assert got["кость"] == [(2, 82)] and got["mall"] == [(1, 20)] and got["ostk"] == [(1, 40)] and got["KOCKA"] == [(1, 82)] and got[""] == [] and got["zzz"] == []


def test_search_stops(spark):
    assert found(spark, ["kos"], stop=1)["kos"] == [(1, 60), (2, 60)] and found(spark, ["kos"], keep=1)["kos"] == [(1, 60)]


def test_rare_skeletons_spare_hot_blocks(spark, monkeypatch):
    n, met = 300, []
    own = lambda kind: F.concat(F.lit(kind), F.col("id").cast("string"))
    ids = spark.range(n)
    groups = ids.select("id", F.lit("n").alias("pos"), F.array(F.lit("hot"), own("only")).alias("toks"), F.array(own("sk"), F.lit("common")).alias("sks"))
    entries = ids.select((F.col("id") + n).alias("rid"), F.lit("n").alias("rpos"), own("sk").alias("rform"), F.array(F.lit("hot")).alias("rtoks"), F.array(own("sk"), F.lit("common")).alias("rsks"))
    best_of = blocklink._best_of
    monkeypatch.setattr(blocklink, "_best_of", lambda pairs, accept: met.append(pairs.count()) or best_of(pairs, accept))
    got = {(x["id"], x["rid"], x["score"]) for x in blocklink.block_link(groups, entries).collect()}
    assert got == {(i, i + n, 0.89) for i in range(n)}
    assert met == [n, 0, 0]  # before, all 90000 pairs met by the hot token and the common skeleton
    assert blocklink.block_link(groups.withColumn("sks", F.array(F.lit("common"))), entries).count() == n and met[3] <= n  # one kind of group


def test_search_reads_few_of_equal_terms(spark, monkeypatch):
    r, kept = random.Random(5), {}
    rows = [(i, r.choice(["blue ring", "old bolt", "bolt", "ring bo"]), r.choice(["bolt; x", "a blue bolt", ""]), [("bolt", r.choice([1, 2]))], [(r.choice(["Bolt", "bo", "Ringo"]), r.random() < 0.5)]) for i in range(300)]
    table = spark.createDataFrame(rows, "entry long, title string, gloss string, keys array<struct<key:string,rank:int>>, aliases array<struct<word:string,first:boolean>>")
    asked, stop = ["bolt", "b", "bo", "ring", "x", "blue ring", "to ringo"], 9
    terms = [t.asDict() for t in prefix.terms_of(table, K.ascii_skeleton).collect()]
    want = {}
    for q in asked:
        s, best = q.removeprefix("to "), {}
        for t in terms:
            for side in ("plain", "fold"):
                begins = t[f"begins_{side}"] if t["text"].startswith(s) and len(s) >= t["begins_least"] else 0
                best[t["entry"]] = max(best.get(t["entry"], 0), begins, t[f"eq_{side}"] if t["text"] == s else 0)
        read = sorted(e for e, n in best.items() if n)[:stop + 1]
        want[q] = sorted(((e, best[e]) for e in read), key=lambda x: (-x[1], rows[x[0]][1], x[0]))
    written = prefix.written
    monkeypatch.setattr(prefix, "written", lambda df, name: kept.setdefault(name, written(df, name)))
    monkeypatch.setattr(prefix, "discard", lambda *tables: kept.update(rows=kept["terms"].groupBy(*[c for c in kept["terms"].columns if c not in ("entry", "n")]).count().agg(F.max("count")).first()[0]))
    out = prefix.search(spark.createDataFrame([(x,) for x in asked], "q string"), prefix.terms_of(table, K.ascii_skeleton), table.select("entry", "title"), K.ascii_skeleton, stop=stop).collect()
    assert {q: [(x["entry"], x["score"]) for x in sorted(out, key=lambda x: x["k"]) if x["q"] == q] for q in asked} == want
    assert kept["rows"] == stop + 1
