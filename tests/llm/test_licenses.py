"""Licences that stand in longer documents."""

import random
import re
import textwrap

from quorumlake.llm import licenses


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: (r["licence"], r["line_licences"]) for r in licenses.scan_licences(df, licenses.licence_table(spark)).collect()}


def test_licence_lines_of_the_documents(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/documents.parquet")
    lines = docs.selectExpr("explode(split(text, '\\n')) as line").where("line rlike '(?i)licen[sc]e|rights reserved|spdx'").distinct()
    texts = [r["line"] for r in lines.collect()]
    assert len(texts) >= 5 and "Licensed under CC BY-NC 4.0." in texts
    assert all(whole for whole, _ in found(spark, texts).values())


def test_full_texts_and_wrapped_blocks(spark):
    known = licenses.full_texts()
    assert {n for n, _ in known} == {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MIT"}
    isc = "\n".join(textwrap.wrap(licenses.KNOWN[-1][1], 50))
    texts = [t for _, t in known] + ["before\n\n" + t + "\n\nafter" for _, t in known] + ["before\n \n" + isc + "\n\nafter", "before\n" + isc]
    got = found(spark, texts)
    for i, (name, _) in enumerate(known):
        assert got[i][0] == name and got[len(known) + i][0] is None
        assert name in got[i][1].split(",") and name in got[len(known) + i][1].split(",")
    assert got[2 * len(known)] == (None, "ISC") and got[2 * len(known) + 1] == (None, "")


def test_spellings_are_of_whole_words_and_gated_alike(spark):
    rows = [("A Licence, a licence licence. Programmer's sub-licence", "a license a license license programmer s sublicense"), ("per-cent of the copyright\nowner: HTTP://x", "percent of the copyright holder https x"), ("plain text", "plain text"),
            ("copyright (c) me\nWhilst organisations favour", "while organizations favor"), (None, ""), ("", ""), ("sub\n license", "sublicense"), ("favoured licences", "favoured licenses")]
    df = spark.createDataFrame(rows, "t string, want string")
    got = df.select("want", licenses.canonical(df.t).alias("a"), licenses.canonical(df.t, odd=licenses.respelt(df.t)).alias("b")).collect()
    assert all(r["a"] == r["b"] == r["want"] for r in got)


def test_copyright_lines_of_single_lines_go(spark):
    text = "Copyright 2020 A. Holder\nReleased under the MIT licence.\nnothing"
    assert found(spark, [text, "x\n" + text])[1] == (None, "MIT")


def test_runs_of_blocks_equal_brute_force(spark):
    """Known texts of one to five blocks, some of equal lengths, in documents of blocks."""
    r = random.Random(6)
    blocks = ["aa bb", "bb aa", "aa", "cc dd ee", "b b b", "zz", "Licence", "é x"]
    known = [(f"L{i}", "\n\n".join(r.choices(blocks, k=r.randint(1, 5)))) for i in range(40)]
    texts = ["\n\n".join(r.choices(blocks, k=r.randint(0, 9))) for _ in range(120)] + ["aa\n \n\t\nbb aa", "\n\n\n", None]
    table = licenses.licence_table(spark, known)
    form = lambda t: " ".join(t.lower().replace("licence", "license").split())
    name = {}
    for n, t in known:
        name[form(t)] = min(n, name.get(form(t), n))
    sizes = {len(t.split("\n\n")) for _, t in known}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in licenses.scan_licences(df, table).collect():
        text = texts[row["doc_id"]] or ""
        parts = [b for b in re.split(r"\n\s*\n", text) if b.strip()]
        units = {form(line) for line in text.split("\n")}
        if "\n" in text:
            units |= {form(" ".join(parts[i:i + n])) for n in sizes for i in range(len(parts) - n + 1)}
        assert row["licence"] == name.get(form(text)) and row["line_licences"] == ",".join(sorted({name[u] for u in units if u in name})), text


def test_a_long_text_of_many_blocks(spark):
    blocks = spark.range(60_000).selectExpr("concat('block ', id, repeat(' some words of it', 12)) as b", "id").orderBy("id")
    text = "\n\n".join(x["b"] for x in blocks.collect())
    name, known = licenses.full_texts()[2]
    assert len(text) > 12_000_000
    assert found(spark, [text, text + "\n\n" + known])[1] == (None, name)
