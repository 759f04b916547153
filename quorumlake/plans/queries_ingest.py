"""Queries of scans and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlake.plans import views as V
from quorumlake.plans.base import query
from quorumlake.session import scratch
from quorumlake.sources import members
from quorumlake.sources import scans as S

EV = "e as (select event_id as id, event_type as pos, user_id, props, (props->>'k')::int as k from events)"


@query("s1_prefiltered_scan", f"with {EV} select id, k from e where contains(props, '\"k\": 6') and k between 60 and 69 or k = 6")
def s1(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("event_id").alias("id"), "props")
    return S.marker_scan(e, "props", '"k": 6', "k int", (F.col("page.k") == 6) | F.col("page.k").between(60, 69)).select("id", "page.k")


GATE = f"with {EV}, g as (select id, user_id, pos, case when k >= 50 then 'Keep' when k >= 20 then 'Pending' else 'Drop' end as gate from e), h as (select user_id, bool_or(gate = 'Keep') as has from g group by 1) "


@query("s2_evidence_gate", GATE + "select id, case when gate = 'Keep' then 'direct' else 'inherited' end as via from g join h using (user_id) where gate = 'Keep' or (gate = 'Pending' and has and id % 2 = 0)")
def s2(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", F.from_json("props", "k int")["k"].alias("k"))
    g = S.gated(e, [(F.col("k") >= 50, "Keep"), (F.col("k") >= 20, "Pending")], "Drop").where("gate <> 'Drop'")
    keep = g.where("gate = 'Keep'")
    late = g.where("gate = 'Pending' and id % 2 = 0").join(keep.select("user_id").distinct(), "user_id", "left_semi")
    return keep.select("id", F.lit("direct").alias("via")).unionByName(late.select("id", F.lit("inherited").alias("via")))


REASON = f"with {EV}, r as (select *, case when pos = 'error' then 'redirect' when k < 10 then 'multiword' when user_id % 7 = 0 then 'non-content' when k > 90 then 'no-gloss' else 'kept' end as reason from e) "


@query("s3_drop_reasons", REASON + "select reason, pos, count(*) as n from r group by grouping sets ((reason), (reason, pos))")
def s3(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("event_type").alias("pos"), "user_id", F.from_json("props", "k int")["k"].alias("k"))
    r = S.gated(e, [(F.col("pos") == "error", "redirect"), (F.col("k") < 10, "multiword"), (F.col("user_id") % 7 == 0, "non-content"), (F.col("k") > 90, "no-gloss")], "kept", "reason")
    return r.groupingSets([["reason"], ["reason", "pos"]], "reason", "pos").agg(F.count(F.lit(1)).alias("n"))


@query("q5_reconciliation", REASON + "select count(*) as seen, count(*) filter (reason = 'kept') as kept, count(*) filter (reason <> 'kept') as dropped, count(*) = count(*) filter (reason = 'kept') + count(*) filter (reason <> 'kept') as balanced from r")
def q5(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("event_type").alias("pos"), "user_id", F.from_json("props", "k int")["k"].alias("k"))
    r = S.gated(e, [(F.col("pos") == "error", "redirect"), (F.col("k") < 10, "multiword"), (F.col("user_id") % 7 == 0, "non-content"), (F.col("k") > 90, "no-gloss")], "kept", "reason")
    kept, dropped = F.count_if(F.col("reason") == "kept"), F.count_if(F.col("reason") != "kept")
    return r.agg(F.count(F.lit(1)).alias("seen"), kept.alias("kept"), dropped.alias("dropped"), (F.count(F.lit(1)) == kept + dropped).alias("balanced"))


@query("s5_official_reader", "select p_partkey as id, p_name as form, p_type || chr(10) || '\"' || p_brand as note from part where p_name <> ''")
def s5(spark, sf):
    """Parts written as delimited text with quoted line breaks, and read back."""
    p = V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("form"), F.concat("p_type", F.lit('\n"'), "p_brand").alias("note"))
    return S.delimited_round_trip(p, ["id"])


@query("s6_versioned_cache", "select p_partkey as id, p_name as form from part")
def s6(spark, sf):
    p = V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("form"))
    path = S.write_versioned(p, "parts", 3)
    return S.read_versioned(spark, path, "parts", 3)


@query("s6_member_cache", "select p_partkey as id, p_name || ' é' as form, left(translate(p_brand || ' “x”', '“”', chr(34) || chr(34)), 60) as note from part where p_type = 'SMALL'")
def s6_members(spark, sf):
    """Parts as stamped lines of JSON in gzip members; those with a marker are read back,
    with percent escapes and marks that look alike mended as they are loaded."""
    from quorumlake.functions.keys import hygiene

    p = V.table(spark, sf, "part").select(F.to_json(F.struct(F.col("p_partkey").alias("id"), F.concat(F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("%20%C3%A9")).alias("form"), F.concat("p_brand", F.lit(" “x”")).alias("note"), F.col("p_type").alias("pos"))))
    path = scratch(spark, "members")
    members.write_members(p, path, "parts", 3)
    lines = members.read_members(spark, path, "parts", 3, marker='"pos":"SMALL"')
    page = lines.select(F.from_json("value", "id long, form string, note string, pos string").alias("x")).where("x.pos = 'SMALL'")
    return page.select("x.id", hygiene(F.col("x.form"), 60).alias("form"), hygiene(F.col("x.note"), 60).alias("note"))


@query("s10_proposal_source", "select 1000000 + row_number() over (order by p_partkey) - 1 as id, p_name as form, p_type as pos from part")
def s10(spark, sf):
    from quorumlake.operators.publish import global_rank

    p = V.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("form"), F.col("p_type").alias("pos"))
    return global_rank(p, ["p_partkey"]).select((F.col("rank") + 999_999).alias("id"), "form", "pos")


@query("s11_file_inventory")
def s11(spark, sf):
    from quorumlake.operators.publish import file_inventory

    return file_inventory(spark, f"{sf}/part.parquet")
