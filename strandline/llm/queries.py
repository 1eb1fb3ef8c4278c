"""Queries of the training-data operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import credentials, frequency, leakage, runs, shared_spans, tokenize, topn
from strandline.sources.tables import spread, table

BOXES_PER_CLASS = 5
MAX_FRAME_GAP = 30
FLICKER_PENALTY = 1.25
RARE_BELOW, COMMON_ABOVE = 5, 0.25
LEAK_WORDS = 16
SPAN_CHARS = 200


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    score = F.try_element_at("mscores", F.lit(1)).cast("double")
    boxes = table(spark, d, "detected_objects").select("task_id", "mclassify", "mframeid", "det_idx", score.alias("s")).where("mclassify >= 0 and s between 0 and 1")
    return topn.top_n(boxes, ["task_id", "mclassify"], F.col("s"), ["mframeid", "det_idx"], BOXES_PER_CLASS).select("task_id", "mclassify", "mframeid", "det_idx")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = []
    for name, key in (("yolox_demo", "cfg_row_id"), ("request_add_channel", "request_id")):
        found.append(credentials.find(table(spark, d, name), key, "url").select(F.lit(name).alias("src_table"), "row_id", "secret_text"))
    return found[0].unionByName(found[1]).distinct()


def p2_masked(spark: SparkSession, d: str) -> DataFrame:
    masked = []
    for name, key in (("yolox_demo", "cfg_row_id"), ("request_add_channel", "request_id")):
        masked.append(credentials.mask(table(spark, d, name), key, "url").select(F.lit(name).alias("src_table"), "row_id", F.col("masked").alias("url")))
    return masked[0].unionByName(masked[1])


def _track_runs(spark: SparkSession, d: str, **how) -> DataFrame:
    tracked = table(spark, d, "tracked_objects").where("mtrackid <> -1").select("task_id", "mframeid", "det_idx", "mtrackid")
    detected = table(spark, d, "detected_objects").where("mclassify >= 0").select("task_id", "mframeid", "det_idx", "mclassify")
    keyed = runs.class_keys(tracked.join(detected, ["task_id", "mframeid", "det_idx"]), table(spark, d, "class_names"), "mclassify")
    return runs.collapse_runs(keyed, ("task_id", "mtrackid"), "mframeid", "det_idx", "class_key", MAX_FRAME_GAP, **how)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _track_runs(spark, d, min_n=2).select("task_id", "mtrackid", F.col("first_at").alias("first_mframeid"), F.col("last_at").alias("last_mframeid"))


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run, single boxes too, with its count and duration in frames."""
    return _track_runs(spark, d).select("task_id", "mtrackid", F.col("first_at").alias("first_mframeid"), F.col("last_at").alias("last_mframeid"), F.col("n").alias("n_boxes"), F.col("duration").alias("n_frames"))


def p3_steady(spark: SparkSession, d: str) -> DataFrame:
    """As p3_runs, but a flicker of one or two boxes of another class doesn't break a run; class_key is the run's own class."""
    return _track_runs(spark, d, penalty=FLICKER_PENALTY).select("task_id", "mtrackid", F.col("first_at").alias("first_mframeid"), F.col("last_at").alias("last_mframeid"), F.col("n").alias("n_boxes"), F.col("duration").alias("n_frames"), F.col("class").alias("class_key"))


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its occurrences, records, the records of its field and its mark, under the same bound on both counts."""
    boxes, demo = table(spark, d, "detected_objects"), table(spark, d, "yolox_demo")
    parts = [
        ("mclassify", boxes, F.col("mclassify"), ["task_id", "mframeid"], ["det_idx"]),
        ("source_type", demo, F.col("source_type"), ["demo_id"], ["cfg_row_id"]),
    ]
    freq = [frequency.term_frequencies(t, c, r, o).withColumn("field_name", F.lit(n)) for n, t, c, r, o in parts]
    total = [frequency.record_total(t, c, r).withColumn("field_name", F.lit(n)) for n, t, c, r, _ in parts]
    marked = frequency.mark_terms(freq[0].unionByName(freq[1]), total[0].unionByName(total[1]), RARE_BELOW, COMMON_ABOVE, RARE_BELOW)
    return marked.select("field_name", "term", "occurrences", "records", F.col("total").alias("field_records"), "mark")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_terms(spark, d).where("mark is not null").select("field_name", "term", "mark")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(_documents(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(_documents(spark, d), table(spark, d, "eval_items"), min_words=LEAK_WORDS)


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """As p7_found, but two of the sixteen words may be other ones."""
    return leakage.find_leaks(_documents(spark, d), table(spark, d, "eval_items"), min_words=LEAK_WORDS, spare=2)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_spans(_documents(spark, d), length=SPAN_CHARS)


def p8_amounts(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return shared_spans.shared_amounts(shared_spans.shared_spans(docs, length=SPAN_CHARS), docs)


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_masked, p3_found, p3_runs, p3_steady, p4_found, p4_terms, p6_ids, p7_found, p7_near, p8_found, p8_amounts)}

_FLAT = "lower(trim(regexp_replace(class_name, '[ \\t_-]+', ' ', 'g')))"
_RUNS = f"""
with names as (select class_id, min(trim({_FLAT})) as flat from class_names where class_id is not null and class_name is not null group by class_id),
ev as (select distinct t.task_id, t.mtrackid, t.mframeid, t.det_idx, coalesce('n' || n.flat, 'i' || cast(o.mclassify as varchar)) as k
  from tracked_objects t join detected_objects o on t.task_id = o.task_id and t.mframeid = o.mframeid and t.det_idx = o.det_idx
  left join names n on n.class_id = o.mclassify where t.mtrackid <> -1 and o.mclassify >= 0),
st as (select *, case when lag(k) over w = k and mframeid - lag(mframeid) over w <= 30 then 0 else 1 end as s from ev
  window w as (partition by task_id, mtrackid order by mframeid, det_idx)),
rn as (select *, sum(s) over (partition by task_id, mtrackid order by mframeid, det_idx rows unbounded preceding) as r from st)
"""
# all classes of a piece through all its stretches, without pruning; costs in quarters: 5 a run, 4 a box of another class
_STEADY = _RUNS.replace("\nwith ", "\nwith recursive ") + """,
sg as (select task_id, mtrackid, r, k, count(*) as n, min(mframeid) as a, max(mframeid) as b from rn group by task_id, mtrackid, r, k),
sp as (select *, case when a - lag(b) over w <= 30 then 0 else 1 end as s from sg window w as (partition by task_id, mtrackid order by r)),
pc as (select *, sum(s) over (partition by task_id, mtrackid order by r rows unbounded preceding) as p from sp),
cl as (select distinct task_id, mtrackid, p, k as c from pc),
vt as (
  select task_id, mtrackid, p, r, c, cast(5 + case when c = k then 0 else 4 * n end as hugeint) as cost, [c] as path from pc join cl using (task_id, mtrackid, p) where s = 1
  union all
  select v.task_id, v.mtrackid, v.p, t.r, v.c, cast(case when v.c <> t.k then v.cost + 4 * t.n else least(v.cost, v.lo + 5) end as hugeint),
    list_append(case when v.c <> t.k or v.cost <= v.lo + 5 then v.path else v.lo_path end, v.c)
  from (select *, min(cost) over w as lo, first_value(path) over (w order by cost, c) as lo_path from vt window w as (partition by task_id, mtrackid, p)) v
  join pc t on t.task_id = v.task_id and t.mtrackid = v.mtrackid and t.p = v.p and t.r = v.r + 1),
op as (select task_id, mtrackid, p, path from vt qualify row_number() over (partition by task_id, mtrackid, p order by r desc, cost, c) = 1),
lb as (select pc.*, path[row_number() over (partition by task_id, mtrackid, p order by r)] as c from pc join op using (task_id, mtrackid, p)),
ch as (select *, case when lag(c) over (partition by task_id, mtrackid, p order by r) = c then 0 else 1 end as o from lb),
fl as (select *, sum(o) over (partition by task_id, mtrackid order by r rows unbounded preceding) as f from ch)
"""
_TERMS = """
with occ as (
  select 'mclassify' as field_name, cast(mclassify as varchar) as term, task_id as r1, mframeid as r2, det_idx as o from detected_objects where mclassify is not null
  union select 'source_type', source_type, demo_id, 0, cfg_row_id from yolox_demo where source_type is not null),
per as (select field_name, term, r1, r2, count(*) as n from occ group by all),
f as (select field_name, term, cast(sum(n) as bigint) as occurrences, count(*) as records from per group by field_name, term),
t as (select field_name, count(*) as field_records from (select distinct field_name, r1, r2 from occ) group by field_name),
m as (select f.*, t.field_records, case when records < 5 then 'rare' when records > field_records * 0.25 then 'common' end as mark from f join t using (field_name))
"""

ORACLE = {
    "p1_found": """
with b as (select distinct task_id, mclassify, mframeid, det_idx, cast(mscores[1] as double) as s from detected_objects
  where mclassify >= 0 and not isnan(mscores[1]) and mscores[1] between 0 and 1)
select task_id, mclassify, mframeid, det_idx from b
qualify row_number() over (partition by task_id, mclassify order by s desc, mframeid, det_idx) <= 5""",
    "p3_found": _RUNS + "select task_id, mtrackid, min(mframeid) as first_mframeid, max(mframeid) as last_mframeid from rn group by task_id, mtrackid, r having count(*) >= 2",
    "p3_runs": _RUNS + "select task_id, mtrackid, min(mframeid) as first_mframeid, max(mframeid) as last_mframeid, count(*) as n_boxes, max(mframeid) - min(mframeid) as n_frames from rn group by task_id, mtrackid, r",
    "p3_steady": _STEADY + "select task_id, mtrackid, min(a) as first_mframeid, max(b) as last_mframeid, cast(sum(n) as bigint) as n_boxes, max(b) - min(a) as n_frames, c as class_key from fl group by task_id, mtrackid, f, c",
    "p4_found": _TERMS + "select field_name, term, mark from m where mark is not null",
    "p4_terms": _TERMS + "select field_name, term, occurrences, records, field_records, mark from m",
}
