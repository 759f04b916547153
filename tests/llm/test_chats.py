"""Reply trees as conversations: paths, escapes, masks and odd rows."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quorumlake.llm import chats
from quorumlake.session import scratch

SCHEMA = "tree string, node long, parent long, role string, text string, score double"
NASTY = ["", "</s>", "<\\/s>", "<\\\\/s>", "<s", ">", "[INST]", "[\\INST][/INST", "]", "\\", "<<s>", "é日</s>\n[INST]", "<unk><|im_start|>", "plain", " [INST] ok [/INST]</s>"]


def paths_by_hand(rows, best):
    out = {}
    for tree in {r[0] for r in rows}:
        known = {}
        for r in sorted((r for r in rows if r[0] == tree and r[1] is not None), key=lambda r: (r[2] is not None, r[2] or 0, r[3] or "", r[4] or "")):
            known.setdefault(r[1], r)
        parents = {r[2] for r in known.values()}
        found = []
        for leaf in known:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at in known and len(path) <= len(known):
                path.append(known[at])
                at = known[at][2]
            if len(path) <= len(known):
                found.append((-sum(r[5] or 0 for r in path) / len(path), leaf, path[::-1]))
        for k, (mean, leaf, path) in enumerate(sorted(found, key=lambda f: (round(f[0], 9), f[1]))[:best]):
            out[tree, k + 1] = leaf, [(r[3] or "", r[4] or "") for r in path]
    return out


def formatted(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("extra") for c in ("t", "n", "leaf", "up", "above", "mean", "all", "formatted")})
    return chats.format_replies(df, scratch(spark, "chats"), score="score", **options)


def checked(spark, rows, best):
    out = {(r["tree"], r["branch_rank"]): r for r in chats.read_turns(formatted(spark, rows, best=best)).collect()}
    want = paths_by_hand(rows, best)
    assert out.keys() == want.keys()
    template = chats.Template()
    for key, (leaf, path) in want.items():
        r = out[key]
        assert r["leaf"] == leaf and r["n_turns"] == len(path) and [(t["role"], t["text"]) for t in r["turns"]] == path
        assert [t["trained"] for t in r["turns"]] == [text if role == "assistant" else "" for role, text in path]
        assert r["formatted"].count(template.ends) == len(path) and r["formatted"].count(template.opens) == len(path)  # texts hold no control string
        for m, (role, text) in zip(r["loss_mask"], path):
            assert r["formatted"][m["turn_start"]:].startswith(template.opens)
            if role == "assistant" and "<" not in text and "[" not in text:
                assert r["formatted"][m["start"]:m["start"] + m["size"]] == text


def test_random_trees(spark):
    r = random.Random(3)
    rows = []
    for tree in ["a", "b", None, "c"]:
        size = r.choice([1, 7, 40])
        for node in range(size):
            rows.append((tree, node, r.choice([None, *range(node)]) if node else None, r.choice(["user", "assistant", None, "[INST]"]), r.choice(NASTY + [None]), r.choice([None, 0.0, 0.5, 1.0, 2.0])))
    for best in (1, 3, 10**6):
        checked(spark, rows, best)


def test_odd_trees(spark):
    rows = [("circle", 1, 2, "user", "x", 1.0), ("circle", 2, 1, "user", "x", 1.0), ("circle", 3, 2, "user", "hangs on it", 1.0), ("circle", 4, None, "assistant", "alone", 0.0),
            ("self", 1, 1, "user", "x", 1.0), ("orphan", 1, 99, "assistant", "no such parent", None), ("twice", 1, None, "user", "b", 1.0), ("twice", 1, None, "user", "a", 1.0),
            ("twice", 1, None, "user", "a", 1.0), ("twice", 2, 1, "assistant", "t", 1.0), ("null id", None, None, "user", "x", 1.0), ("tie", 1, None, "user", "q", 0.0),
            ("tie", 3, 1, "assistant", "three", 1.0), ("tie", 2, 1, "assistant", "two", 1.0)]
    checked(spark, rows, 1)
    assert formatted(spark, rows[:0]).count() == 0


def test_a_long_chain_and_a_long_text(spark):
    rows = [("deep", i, i - 1 if i else None, "assistant" if i % 2 else "user", f"turn {i} [INST]", 0.0) for i in range(1500)] + [("long", 1, None, "assistant", "x</s>" * 50_000, 0.0)]
    checked(spark, rows, 1)


@pytest.mark.parametrize("template", [chats.Template(), chats.Template("<bos>", "<turn>", "<says>", "<end>", ())])
def test_escapes_turn_back(spark, template):
    r = random.Random(2)
    texts = NASTY + ["".join(r.choices(["<", "[", "\\", "s>", "/s>", "INST]", "end>", "turn>", "a", "\n"], k=r.randint(0, 12))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", template.escaped(F.col("t")).alias("e")).select("*", template.unescaped(F.col("e")).alias("back"))
    for row in df.collect():
        assert row["back"] == row["t"] and not any(c in row["e"] for c in template.controls())


def test_templates_that_could_not_be_read_back():
    for bad in (dict(ends="[[/s>"), dict(says="x"), dict(opens="<\\s>")):
        with pytest.raises(ValueError):
            chats.Template(**bad)


def test_the_query_equals_its_sql(spark, sf):
    out = chats.op11_chats(spark, sf)
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = db.sql(chats.SQL)
    names = list(want.columns)
    assert {tuple(r) for r in out.select(*names).collect()} == set(want.fetchall())
    trap = out.where("conv_id = -7").first()
    assert trap["n_turns"] == 2 and trap["loss_chars"] == len(chats.TRAP)
