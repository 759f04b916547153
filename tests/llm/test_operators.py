"""Edge cases, round trips and brute-force comparisons of the operators."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quorumlake.llm import licenses, mips, mixing, piece_bpe, registry, shards, toxicity, url_filter, warc
from quorumlake.session import scratch

MODEL = registry.tokenizer_path()
DOCS = "doc_id long, text string, source string"
ODD = [None, "", " ", "\n", "  two  spaces ", "tab\tand\nline", "é日本𝄞", "x" * 5000, " " * 300, "the " * 4000, "<s></s><unk>", "a\u0000b", "▁mark", "ab" * 400]


def docs(spark, rows):
    """Documents with columns whose names clash with inner ones."""
    df = spark.createDataFrame(rows, DOCS)
    for c in ("score", "block", "cluster", "shard", "label", "key", "node"):
        df = df.withColumn(c, F.lit("extra"))
    return df


# ---- SentencePiece ----------------------------------------------------------------


def test_pieces_equal_the_library(spark):
    r = random.Random(1)
    texts = ODD + ["".join(r.choices("abcthe  \n\té日<s>019.,", k=r.randint(0, 80))) for _ in range(300)] + ODD
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = piece_bpe.piece_round_trip(docs(spark, [(i, t, "a") for i, t in enumerate(texts)]), MODEL, emit=("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")).collect()
    assert len(out) == len(texts)
    for row in out:
        ids = lib.encode(texts[row["doc_id"]] or "", add_bos=True, add_eos=True)
        assert row["ids"] == ids and row["n_tokens"] == len(ids) and row["decoded"] == lib.decode(ids) and row["score"] == "extra"
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_long_words_equal_the_library():
    r = random.Random(3)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    codec = piece_bpe.PieceCodec(piece_bpe.load_vocabulary(MODEL))
    alphabets = ["ab", "x", "the", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz0123456789", "日本語中文字", "éèüß", "ACGT", "=-_*", "aeio▁ "]
    texts = ["".join(r.choices(a, k=n)) for a in alphabets for n in (49, 60, 200, 1500, 6000)] + ["ab" * 3000, "aab" * 2000, "xxxxxxxxxx" * 900, "international" * 400]
    for t in texts:
        ids, _ = codec.encode([t])
        assert ids.tolist() == lib.encode(t, add_bos=True, add_eos=True)


def test_pieces_of_an_empty_table(spark):
    assert piece_bpe.piece_round_trip(docs(spark, []), MODEL).count() == 0


# ---- archives ----------------------------------------------------------------------


def test_archives_come_back(spark):
    big, odd = "A" * 1500, "line\r\n\r\nWARC/1.1\r\n\nfiledesc://x 0 0 0 5\n" * 40
    rows = [(1, "http://a/b c", big), (2, None, big), (3, "http://ü/", big), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "http://x/?q=1", odd), (None, "u", odd), (9, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    arc, out = scratch(spark, "arc"), scratch(spark, "warc")
    warc.write_arc(pages, arc, key="page_id", url="url", payload="html")
    warc.convert(spark, arc, out)
    back = {(r["key"], r["payload_bytes"]): r for r in warc.read_warc(spark, out).collect()}
    assert len(back) == len(rows)
    for key, _, html in rows:
        raw = (html or "").encode()
        r = back[None if key is None else str(key), len(raw)]
        assert r["digest"] == hashlib.sha1(raw).hexdigest()
        revisit = (html == big and key != 9) or (html == odd and key is None)
        assert r["record_type"] == ("revisit" if revisit else "response")
        assert r["refers_key"] == (("9" if html == big else "8") if revisit else None)
        assert r["payload"] == (b"" if revisit else raw)


def test_both_arc_versions(spark):
    import io

    for version in (1, 2):
        body = f"{version} 0 x\nfields\n\n".encode()
        more = "" if version == 1 else " 200 - - 0 f"
        raw = f"filedesc://f 0.0.0.0 19990101000000 text/plain{more} {len(body)}\n".encode() + body + f"\nhttp://a/b c 1.2.3.4 19990102030405 text/html{more} 4\n\nx\ny\n".encode()
        head, record = warc.arc_records(io.BytesIO(raw))
        assert head[2] is None and record[2] is None
        assert record[0]["URL"] == "http://a/b c" and record[0]["Archive-date"] == "19990102030405" and record[1] == b"\nx\ny"[:4]
    cut = list(warc.arc_records(io.BytesIO(raw[:-4])))
    assert [x[2] is None for x in cut] == [True, False] and cut[1][0] == {"URL": f"http://a/b c 1.2.3.4 19990102030405 text/html{more} 4"}


@pytest.mark.parametrize("wrong", [3, 12, 60, 4000])
def test_records_with_a_wrong_length_are_kept_as_errors(spark, tmp_path, wrong):
    """Names of any kind, folders below, and what follows a bad record is read."""
    def record(name, payload, size=None):
        return f"http://a/{name} 1.2.3.4 19990102 text/plain {len(payload) if size is None else size}\n".encode() + payload + b"\n"

    body = b"1 0 x\nfields\n\n"
    start = b"filedesc://f 0.0.0.0 199901010000 text/plain %d\n" % len(body) + body + b"\n"
    (tmp_path / "deep").mkdir()
    (tmp_path / "IAH-1999.arc").write_bytes(start + record("a", b"one\ntwo\n") + record("b", b"12345678", wrong) + record("c", b"see http://x 1.1.1.1 y") + record("d", b"z" * 50))
    (tmp_path / "deep" / "IAH-1999.arc").write_bytes(start + b"no header at all\n" + record("e", b""))
    (tmp_path / "deep" / "empty.arc").write_bytes(b"")
    rows = {r["uri"].rpartition("/")[2]: r for r in warc.parse_arc(spark, str(tmp_path)).where("kind <> 'warcinfo'").collect()}
    good = {k: r for k, r in rows.items() if r["kind"] == "resource"}
    assert set(good) == {"a", "c", "d", "e"} and bytes(good["a"]["payload"]) == b"one\ntwo\n" and bytes(good["d"]["payload"]) == b"z" * 50 and bytes(good["c"]["payload"]) == b"see http://x 1.1.1.1 y"
    assert good["a"]["stamp"] == "1999-01-02T00:00:00Z"
    errors = warc.convert(spark, str(tmp_path), out := scratch(spark, "warc")).collect()
    assert len(errors) == 2 and all(r["reason"] for r in errors)
    back = warc.read_warc(spark, out).collect()
    assert len(back) == 4 and len({r["record_id"] for r in back}) == 4


def test_empty_archives(spark):
    arc, out = scratch(spark, "arc"), scratch(spark, "warc")
    warc.write_arc(spark.createDataFrame([], "page_id long, url string, html string"), arc, key="page_id", url="url", payload="html")
    warc.convert(spark, arc, out)
    assert warc.read_warc(spark, out).count() == 0


def test_block_digests(spark):
    arc, out = scratch(spark, "arc"), scratch(spark, "warc")
    warc.write_arc(spark.createDataFrame([(1, "http://a/", "x" * 2000), (2, "http://b/", "x" * 2000), (3, None, None)], "page_id long, url string, html string"), arc, key="page_id", url="url", payload="html")
    assert warc.convert(spark, arc, out).count() == 0
    import gzip
    import io

    seen = 0
    for r in spark.read.format("binaryFile").load(out).collect():
        for head, block in warc.warc_records(io.BytesIO(gzip.decompress(r["content"]))):
            assert head["warc-block-digest"] == "sha1:" + hashlib.sha1(block).hexdigest()
            seen += head["warc-type"] in ("response", "revisit")
    assert seen == 3


# ---- mixing ----------------------------------------------------------------------------


def test_mixing_follows_the_rates(spark):
    rows = [(i, f"t{i}", "big" if i % 4 else "small") for i in range(4000)]
    out = mixing.mix_sources(docs(spark, rows), weights={"big": 1, "small": 1}, target_rows=6000, seed=5)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 3000) < 250 and abs(n["small"] - 3000) < 250
    again = mixing.mix_sources(docs(spark, rows).repartition(7), weights={"big": 1, "small": 1}, target_rows=6000, seed=5)
    key = lambda df: sorted((r["doc_id"], r["replica"], r["copies"]) for r in df.collect())
    assert key(out) == key(again)


def test_mixing_edges(spark):
    rows = [(1, None, None), (1, None, None), (None, "", "a"), (3, "x", "b")]
    out = mixing.mix_sources(docs(spark, rows), target_rows=400).collect()
    assert {r["source"] for r in out} == {None, "a", "b"} and set(out[0].asDict()) >= {"score", "copies", "replica"}
    assert mixing.mix_sources(docs(spark, []), seed=1).count() == 0
    assert mixing.mix_sources(docs(spark, rows), weights={"a": 0.0}).count() == 0


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["steps", "copies", "replica", "shuffle_key", "__source", "key", "place", "rows", "rate", "r", "from", "id", "of", "weight"]
    df = docs(spark, [(i, "t", "ab"[i % 2]) for i in range(50)]).drop("key")
    for n in names:
        df = df.withColumn(n, F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")))
    out = mixing.mix_sources(df, seed=2)
    assert out.columns == df.columns + ["copies_", "replica_", "shuffle_key_"]
    rows = out.collect()
    assert rows and all(r[n] == f"{n} of {r['doc_id']}" for r in rows for n in names)
    one = mixing.mix_sources(df.withColumnRenamed("source", "steps_").drop("steps"), source="steps_", seed=2)
    assert one.count() == len(rows)


def test_a_third_of_equal_rows_is_spread(spark):
    df = docs(spark, [(7, "same", "hot")] * 600 + [(i, f"t{i}", "cold") for i in range(1200)])
    out = mixing.mix_sources(df, weights={"hot": 1, "cold": 2}, seed=1).withColumn("p", F.spark_partition_id()).where("doc_id = 7").groupBy("p").count().collect()
    assert len(out) == 0 or len(out) == 4 and max(r["count"] for r in out) < 2 * min(r["count"] for r in out)


def test_poisson_counts_at_large_rates(spark):
    steps = spark.range(1).select(mixing.poisson_steps(F.lit(900.0)).alias("s")).first()["s"]
    assert steps == sorted(steps) and abs(steps[-1] - 1) < 1e-9 and abs(sum(1 - s for s in steps) - 900) < 1e-3


# ---- urls ------------------------------------------------------------------------------------


def test_urls_against_all_rules(spark):
    r = random.Random(2)
    hosts, paths = ["net", "a.net", "example.net", "x.example.net", "example.com", "org", "b.org", "anet", "net.x", ".net", "NET"], ["", "/", "/en/", "/en/x", "/de", "/de/", "/fr/a", "//", "/EN/"]
    urls = [f"http://{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?q=/en/', '#f'])}" for _ in range(300)] + [None, "", "nohost", "://", "http://", "a://b://c/", "http://net" + "/x" * 30_000, "http://" + "a." * 5000 + "net/"]
    rules = registry.URL_RULES + [("b.org", "/f", "block"), ("net", "/en/x", "allow")]
    pages = spark.createDataFrame([(i // 2, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("rule", F.lit("x")).withColumn("host", F.lit("y"))
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()

    def judge(u):
        rest = u.partition("://")[2] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = rest[cut:].partition("?")[0].partition("#")[0]
        fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit)[3] if fit else None, max(fit)[2] if fit else "allow"

    assert sorted(map(repr, ((g["page_id"], g["host"], g["path"], g["rule"], g["verdict"]) for g in got))) == sorted(map(repr, ((i // 2, *judge(u)) for i, u in enumerate(urls))))


def test_no_urls(spark):
    rules = spark.createDataFrame(registry.URL_RULES, "host string, path string, verdict string")
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    one = url_filter.judge_urls(spark.createDataFrame([(1, "http://net/")], "page_id long, url string"), rules.limit(0)).first()
    assert one["verdict"] == "allow" and one["rule"] is None


# ---- toxicity -------------------------------------------------------------------------------------


def test_subsequence_kernel_against_its_definition():
    def slow(s, t, n=3, lam=0.7):
        from itertools import combinations

        total = 0.0
        for a in combinations(range(len(s)), n):
            for b in combinations(range(len(t)), n):
                if all(s[i] == t[j] for i, j in zip(a, b)):
                    total += lam ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    words, others = ["idiot", "i.d.i.o.t", "tidiote", "abcdef", "id", "iiddiioott"], ["idiot", "moron", "tidiote", "ab"]
    codes, z = toxicity._codes(words, 12), toxicity._codes(others, 7)
    for decay in (0.6, 0.95):
        three, four = toxicity.subsequence_kernels(codes, z, (3, 4), decay)
        own = toxicity.own_kernels(codes, (3, 4), decay)
        for k, (n, got) in enumerate(((3, three), (4, four))):
            assert np.allclose(got, [[slow(w, o, n, decay) for o in others] for w in words], rtol=1e-4)
            assert np.allclose(own[k], [slow(w, w, n, decay) for w in words], rtol=1e-4)
    # the map's products are the kernels among landmarks, summed
    marks = toxicity.Landmarks(["idiot", "moron", "scumbag"], ["tidiote"])
    phi = marks.features(marks.codes)
    assert np.allclose(phi @ phi.T, sum(marks.kernel(marks.codes)), atol=1e-3)
    want = [[slow(a, b, 3, 0.6) / (slow(a, a, 3, 0.6) * slow(b, b, 3, 0.6)) ** 0.5 for b in marks.z] for a in marks.z]
    assert np.allclose(marks.kernel(marks.codes)[0], want, atol=1e-5)
    at, _ = marks.mapped(["x", "idxiot", "abc", "idot", "scumba", "mron", "moxrxon", "rock"])
    assert sorted(at.tolist()) == [1, 3, 4, 5, 6]
    assert toxicity.common_in_order(toxicity._codes(words, 12), "idiot").tolist() == [5, 5, 5, 1, 2, 5]


def _labelled(spark, n=400):
    r = random.Random(4)
    fill = ["the", "river", "moves", "slowly", "under", "old", "trees", "near", "houses", "idea", "outside"]
    rows, labels = [], []
    for i in range(n):
        w = r.choices(fill, k=r.randint(5, 30))
        toxic = i % 5 == 0
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(["idiot", "moron", "scumbag"]))
        rows.append((i, " ".join(w), "a"))
        labels.append((i, int(toxic)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_and_tolerates_gaps(spark):
    d, labels = _labelled(spark)
    model = toxicity.train(d, labels)
    odd = [(1, None), (2, ""), (3, "you are an i.d.i.o.t today"), (4, "what an idi*ot you are"), (5, "i d i o t over there"), (6, "the river moves slowly under trees"), (6, "the river moves slowly under trees"), (7, "q" * 20_000)]
    got = toxicity.score(spark.createDataFrame(odd, "doc_id long, text string").withColumn("label", F.lit(1)), model).collect()
    s = {}
    for r in got:
        assert 0 <= r["score"] <= 1 and s.setdefault(r["doc_id"], r["score"]) == r["score"]
    assert len(got) == len(odd) and min(s[3], s[4], s[5]) > 0.5 > max(s[1], s[2], s[6], s[7])
    # one letter put in, doubled, left out, swapped; others between all
    for kind, least, made in (("put in", 0.95, lambda w: [w[:i] + c + w[i:] for i in range(1, len(w)) for c in "xu"]), ("doubled", 0.95, lambda w: [w[:i] + w[i] + w[i:] for i in range(len(w))]),
                              ("left out", 0.8, lambda w: [w[:i] + w[i + 1:] for i in range(1, len(w) - 1)]), ("swapped", 0.8, lambda w: [w[:i] + w[i + 1] + w[i] + w[i + 2:] for i in range(1, len(w) - 2)]),
                              ("between all", 0.8, lambda w: [c.join(w) for c in "xwuv"])):
        texts = [f"the river {a} under old trees" for w in ("idiot", "moron", "scumbag") for a in made(w)]
        found = toxicity.score(spark.createDataFrame([(t,) for t in texts], "text string"), model).where("score >= 0.5").count()
        assert found >= least * len(texts), (kind, found, len(texts))
    assert toxicity.score(d.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    d, labels = _labelled(spark, 20)
    assert toxicity.train(d, labels.where("toxic = 0")) is None and toxicity.train(d, labels.limit(0)) is None
    assert [r["score"] for r in toxicity.score(d.limit(2), None).collect()] == [0.0, 0.0]


def test_toxicity_held_out(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    out = toxicity.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    bad, good = out[out.toxic == 1], out[out.toxic == 0]
    assert (bad.predicted == 1).mean() > 0.7 and (good.predicted == 1).mean() < 0.05


# ---- inner products -----------------------------------------------------------------------------------


def test_inner_products_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mips, "BLOCK_ROWS", 300)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 19)).astype(np.float32) * rng.uniform(0.5, 2, (900, 1)).astype(np.float32)
    x[100:160] = x[40]  # a common vector
    bad = [(2000, None), (2020, []), (2040, [0.0] * 19), (2060, [float("nan")] + [1.0] * 18), (2080, [None] + [1.0] * 18), (2100, [float("inf")] * 19), (2120, [1.0] * 7), (None, [1.0] * 19)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + bad + [(40, x[40].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("code", F.lit("c"))
    kept = mips.sound_rows(df)
    index, book = mips.build_index(kept)
    assert kept.count() == 901 and index.count() == 840
    got = mips.search(index, book, kept.where("id % 20 = 0"), 20).toPandas()
    hit, y = 0, x.astype(np.float64)
    for q, g in got.groupby("query_id"):
        s = y @ y[q]
        s[q] = -np.inf
        order = np.lexsort((np.arange(len(s)), -s))[:20]
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and np.allclose(g["score"], s[g["vec_id"]], rtol=1e-12)
        hit += len(set(order) & set(g["vec_id"]))
    assert got["query_id"].nunique() == 45 and hit / 900 > 0.97


def recall(spark, monkeypatch, x, reach):
    """Share of the true 20 nearest that are found, for every twentieth row."""
    monkeypatch.setattr(mips, "REACH", reach)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    kept = mips.sound_rows(df)
    index, book = mips.build_index(kept)
    got = mips.search(index, book, kept.where("id % 20 = 0"), 20).toPandas()
    y = x.astype(np.float32).astype(np.float64)
    found = {q: set(g["vec_id"]) for q, g in got.groupby("query_id")}
    hit = []
    for q in range(0, len(x), 20):
        s = y @ y[q]
        s[q] = -np.inf
        hit.append(len(found[q] & set(np.lexsort((np.arange(len(s)), -s))[:20].tolist())) / 20)
    return np.array(hit)


def test_recall_against_brute_force_with_a_dense_group(spark, monkeypatch):
    """A third of the rows are one dense group, far more than are reranked."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64))
    x[::3] = rng.normal(size=64) + 0.08 * rng.normal(size=(2000, 64))
    hit = recall(spark, monkeypatch, x / np.linalg.norm(x, axis=1, keepdims=True), 400)
    assert hit.mean() >= 0.95 and hit[::3].mean() >= 0.9


def test_recall_with_uneven_lengths(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 48)) * rng.lognormal(0, 0.5, (6000, 1))
    assert recall(spark, monkeypatch, x, 200).mean() >= 0.95


def test_estimates_are_near():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 15))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = mips.Codebook.fit(x)
    own, size, code = book.encode(x)
    e = book.estimates(x[:50], own, np.ones(len(x), np.float32), size.astype(np.float32), mips.pack(code))
    assert e.shape == (2000, 50) and np.abs(e - x @ x[:50].T).mean() < 0.05


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    kept = mips.sound_rows(df)
    index, book = mips.build_index(kept)
    got = [tuple(r) for r in mips.search(index, book, kept, 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 5.0), (0, 2, 1, 4.0), (1, 1, 0, 4.0), (1, 2, 2, 4.0), (2, 1, 0, 5.0), (2, 2, 1, 4.0)]
    kept = mips.sound_rows(df.limit(0))
    index, book = mips.build_index(kept)
    assert mips.search(index, book, kept, 20).count() == 0


# ---- shards ----------------------------------------------------------------------------------------------


def test_shards_hold_every_record_once(spark):
    rows = [(i % 300, t, "s") for i, t in enumerate(ODD * 60)] + [(7, "same", "hot")] * 400 + [(None, "n", "s")]
    df = docs(spark, rows).repartition(5)
    out = shards.write_shards(df, scratch(spark, "shards"), shards=7, seed=3, bucket_bytes=20_000).select("record.*", "size", "slot", F.col("shard").alias("place"))
    got = out.select("doc_id", "text", "source", "size", "slot", "place").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "", r[2])
    assert sorted(map(key, got)) == sorted(map(key, rows))
    by = {}
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 16
        by.setdefault(r["place"], []).append(r["slot"])
    assert sorted(by) == list(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert shards.write_shards(df.limit(0), scratch(spark, "shards"), shards=7).count() == 0


def test_shard_query(spark, sf):
    got = shards.op9_shards(spark, sf).toPandas()
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False))
    assert len(got) == len(texts) and set(got.law) == {"rows"}
    assert all(c == zlib.crc32((texts[i] or "").encode()) for i, c in zip(got.doc_id, got.text_crc32))


# ---- licences ------------------------------------------------------------------------------------------------


def test_licence_texts(spark):
    isc = licenses.KNOWN[-1][1]
    rows = [(1, isc.upper().replace(",", " ;")), (2, "Copyright (c) 2020 Someone\n" + isc), (3, "text\nReleased under the MIT Licence!\n(c) 2020 x"), (4, None), (5, ""), (6, "© me"), (7, isc + " more"),
            (8, "Licensed under the Apache License, Version 2.0.\nreleased under the mit license"), (8, "Licensed under the Apache License, Version 2.0.\nreleased under the mit license"), (None, "z" * 100_000)]
    df = docs(spark, [(i, t, "s") for i, t in rows]).withColumn("licence", F.lit("x"))
    got = sorted((r["doc_id"] or 0, r["licence"] or "", r["line_licences"]) for r in licenses.scan_licences(df, licenses.licence_table(spark)).collect())
    assert got == [(0, "", ""), (1, "ISC", "ISC"), (2, "ISC", "ISC"), (3, "", "MIT"), (4, "", ""), (5, "", ""), (6, "", ""), (7, "", ""), (8, "", "Apache-2.0,MIT"), (8, "", "Apache-2.0,MIT")]
    assert licenses.scan_licences(df.limit(0), licenses.licence_table(spark)).count() == 0


def test_two_models_of_one_size_in_a_session(spark):
    """The second model has the scores of two pieces exchanged: other merges, equal size."""
    plain = piece_bpe.load_vocabulary(MODEL)
    n = plain["pieces"].index("▁the"), plain["pieces"].index("▁th")
    from unittest import mock

    other = {**plain, "pieces": list(plain["pieces"]), "digest": "other"}
    other["pieces"][n[0]], other["pieces"][n[1]] = other["pieces"][n[1]], other["pieces"][n[0]]
    d = docs(spark, [(1, "the then", "a")]).coalesce(1)
    ids = [r["ids"] for r in piece_bpe.piece_round_trip(d, MODEL, emit=("ids",)).collect()]
    with mock.patch.object(piece_bpe, "load_vocabulary", lambda path: other):
        swapped = [r["ids"] for r in piece_bpe.piece_round_trip(d, MODEL, emit=("ids",)).collect()]
    assert ids != swapped and ids == [r["ids"] for r in piece_bpe.piece_round_trip(d, MODEL, emit=("ids",)).collect()]
