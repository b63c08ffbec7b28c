"""Queries of sections A to C: sources, indicators and facts."""

from pyspark.sql import functions as F

from attesta.functions import lexicon as fixed
from attesta.operators import facts as fx
from attesta.operators import indicators as ind
from attesta.plans import bindings as b
from attesta.plans.registry import query
from attesta.sources import io

r6 = lambda c: F.round(c, 6).alias(c)
M = [f"m_{i}" for i in fixed.INDICATORS]

BASE = f"base as ({b.INTERACTIONS})"
TIMED = f"""{BASE},
timed as (select *, greatest(coalesce(start_time - lag(end_time) over (partition by student_id order by start_time nulls last, row_id), 0), 0) as lag_time,
                 least(greatest(coalesce(time_taken, 0), 0), 3600)::double as elapsed_time from base)"""
TABLE = f"""{TIMED},
logged as (select *, ln(case when elapsed_time = 0 then 1e-5 else elapsed_time end) as log_rt,
                  (hint_count - (select min(hint_count) from base))::double / (select max(hint_count) - min(hint_count) from base) as hint_scaled from timed),
target as (select l.*, avg(log_rt) over (partition by student_id) + avg(log_rt) over (partition by skill) - (select avg(log_rt) from logged) as tgt,
                  coalesce(nullif(stddev_samp(log_rt) over (partition by skill), 0), 1) as sigma from logged l),
conf as (select *, exp(-((log_rt - tgt) * (log_rt - tgt)) / (2 * sigma * sigma)) as sc from target),
inds as (select *, hint_count::double as hint_raw,
    (1 - correct) * sc * (1 - confused) as m_overconfidence, correct * (1 - sc) * confused as m_underconfidence,
    confused * hint_scaled as m_strategic_help, abs(confused - hint_scaled) as m_cognitive_avoidance,
    correct * confused * (1 - hint_scaled) * sc as m_productive_struggle, (1 - correct) * frustrated * (1 - hint_scaled) as m_unproductive_frustration,
    correct * (1 - hint_scaled) * (1 - sc) * confused as m_lucky_guess, (1 - correct) * (1 - hint_scaled) * sc * concentrating as m_slipping,
    bored * correct * (1 - concentrating) as m_boredom_offtask,
    row_number() over (partition by student_id order by start_time nulls last, row_id) - 1 as step_idx,
    elapsed_time / nullif(avg(elapsed_time) over (partition by student_id), 0) as response_time_ratio,
    avg(correct::double) over (partition by student_id, skill order by start_time nulls last, row_id rows between unbounded preceding and 1 preceding) as skill_cum_accuracy
  from conf)"""
rs = lambda cols: ", ".join(f"round({c}, 6) as {c}" for c in cols)


@query("a2_keep_labelled", "select row_id, student_id, skill from (" + b.INTERACTIONS + ") where student_id in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def a2(spark, d):
    labels = b.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "student_id")
    return io.keep_labelled(b.interactions(spark, d), labels, "student_id").select("row_id", "student_id", "skill")


TAG_TEXT = "select doc_id as item_id, 'S' || (doc_id % 4) || ':' || case doc_id % 5 when 0 then 'supported' when 1 then '근거없음' when 2 then ' unsuppported' when 3 then '' else '부분지지' end || ';S1:partial; ;junk;S1: unknown' as level1_tags from {documents}"


@query("a4_parse_tags", "with t as (" + TAG_TEXT.format(documents="documents") + """),
p as (select item_id, unnest(string_split(level1_tags, ';')) as part, unnest(range(len(string_split(level1_tags, ';')))) as pos from t),
s as (select item_id, pos, trim(split_part(part, ':', 1)) as sentence_id, trim(substr(part, instr(part, ':') + 1)) as raw from p where instr(part, ':') > 0),
k as (select *, row_number() over (partition by item_id, sentence_id order by pos desc) as rn from s)
select t.item_id, k.sentence_id, nullif(case raw when '지지됨' then 'supported' when '부분지지' then 'partial' when '근거없음' then 'unsupported' when '판단불가' then 'unknown' else raw end, '') as tag
from t left join k on t.item_id = k.item_id and k.rn = 1""")
def a4(spark, d):
    df = spark.sql(TAG_TEXT.format(documents="{documents}"), documents=b.table(spark, d, "documents"))
    return io.parse_tags(df, "level1_tags").select("item_id", "sentence_id", "tag")


@query("a5_a6_normalise_tags", """select row_number() over (order by doc_id) as n, case lower(trim(t)) when 'unsuppported' then 'unsupported' when 'unsuported' then 'unsupported' when 'suported' then 'supported' else lower(trim(t)) end as typo_fixed,
  nullif(case trim(t) when '지지됨' then 'supported' when '부분지지' then 'partial' when '근거없음' then 'unsupported' when '판단불가' then 'unknown' else trim(t) end, '') as named
from (select doc_id, case doc_id % 6 when 0 then ' 지지됨 ' when 1 then 'Suported' when 2 then '' when 3 then 'unsuppported' when 4 then '판단불가' else source end as t from documents)""")
def a5(spark, d):
    t = F.expr("case doc_id % 6 when 0 then ' 지지됨 ' when 1 then 'Suported' when 2 then '' when 3 then 'unsuppported' when 4 then '판단불가' else source end")
    docs = b.table(spark, d, "documents").select("doc_id", t.alias("t"))
    numbered = docs.groupBy("doc_id", "t").count().select((F.col("doc_id") + 1).alias("n"), "t")  # doc_id is dense from 0
    return numbered.select("n", io.fix_tag_typos("t").alias("typo_fixed"), io.normalise_tag("t").alias("named"))


@query("a16_assert_unique", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def a16(spark, d):
    return io.repeated_keys(b.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "n")


@query("b1_clean_interactions", f"with {BASE} select row_id, student_id, skill, correct, round(start_time, 3) as start_time from base where skill is not null and student_id is not null and correct in (0, 1)")
def b1(spark, d):
    return ind.clean_interactions(b.interactions(spark, d)).select("row_id", "student_id", "skill", "correct", F.round("start_time", 3).alias("start_time"))


@query("b2_b5_time_features", f"""with {TIMED} select row_id, round(lag_time, 4) as lag_time, round(elapsed_time, 6) as elapsed_time, round(ln(1 + lag_time), 4) as lag_time_log, round(ln(1 + elapsed_time), 6) as elapsed_time_log,
 len(list_filter({fixed.LAG_EDGES}, lambda e: e <= lag_time))::int as lag_bin, len(list_filter({fixed.ELAPSED_EDGES}, lambda e: e <= elapsed_time))::int as elapsed_bin,
 len(list_filter({fixed.ATTEMPT_EDGES}, lambda e: e <= least(greatest(attempt_count, 0), 10)))::int as attempt_bin from timed""")
def b2(spark, d):
    out = ind.binned(ind.log1p_features(ind.elapsed_time(ind.lag_time(ind.clean_interactions(b.interactions(spark, d))))))
    return out.select("row_id", F.round("lag_time", 4).alias("lag_time"), r6("elapsed_time"), F.round("lag_time_log", 4).alias("lag_time_log"), r6("elapsed_time_log"), "lag_bin", "elapsed_bin", "attempt_bin")


@query("b6_b7_fill_and_scale", f"""with {BASE}, f as (select row_id, coalesce(case when row_id % 7 = 0 then null else confused end, 0) as confused, hint_count::double as h, attempt_count::double as a, 5.0::double as k from base)
select row_id, round(confused, 6) as confused, round((h - (select min(h) from f)) / (select max(h) - min(h) from f), 6) as h, round((a - (select min(a) from f)) / (select max(a) - min(a) from f), 6) as a, 0.0::double as k from f""")
def b6(spark, d):
    df = b.interactions(spark, d).withColumn("confused", F.when(F.col("row_id") % 7 != 0, F.col("confused")))
    df = ind.fill_zero(df, ["confused"]).select("row_id", "confused", F.col("hint_count").cast("double").alias("h"), F.col("attempt_count").cast("double").alias("a"), F.lit(5.0).alias("k"))
    return ind.minmax_scale(df, ["h", "a", "k"]).select("row_id", r6("confused"), r6("h"), r6("a"), r6("k"))


@query("b8_self_confidence", f"with {TABLE} select row_id, round(sc, 6) as sc from inds")
def b8(spark, d):
    return ind.self_confidence(ind.elapsed_time(ind.clean_interactions(b.interactions(spark, d)))).select("row_id", r6("sc"))


@query("b9_b12_indicator_table", f"with {TABLE} select row_id, student_id, step_idx, {rs(['response_time_ratio', 'skill_cum_accuracy', 'hint_raw', 'sc', *M])} from inds")
def b9(spark, d):
    return ind.indicator_table(b.interactions(spark, d)).select("row_id", "student_id", "step_idx", *[r6(c) for c in ["response_time_ratio", "skill_cum_accuracy", "hint_raw", "sc", *M]])


@query("b13_merge_splits", f"""with {BASE}, t as (select student_id, skill, correct, hint_count from base), test as (select * from t where student_id % 3 = 0 and hint_count > 0), train as (select * from t where student_id % 2 = 0)
select distinct student_id, skill, correct, hint_count, hint_count::double as hint_raw from (select * from train where student_id not in (select student_id from test) union all select * from test)""")
def b13(spark, d):
    t = b.interactions(spark, d).select("student_id", "skill", "correct", "hint_count")
    return ind.merge_splits(t.filter("student_id % 2 = 0"), t.filter("student_id % 3 = 0 and hint_count > 0"))


@query("b14_avoidance_audit", f"""with {TABLE}, a as (select *, m_cognitive_avoidance > 0.5 as s, coalesce(hint_raw, 0) as h from inds)
select count(*) filter (s) as n_high, round(count(*) filter (s and confused > hint_scaled) / nullif(count(*) filter (s), 0)::double, 6) as share_confused_over_hint,
 count(*) filter (s and hint_scaled > confused) as n_reversed, min(h) filter (s and hint_scaled > confused) as reversed_min_hints, max(h) filter (s and hint_scaled > confused) as reversed_max_hints,
 round(avg(h) filter (s and hint_scaled > confused), 6) as reversed_mean_hints, count(*) filter (h between 1 and 8 and confused = 0) as n_hints_without_confusion,
 count(*) filter (h between 1 and 8 and confused = 0 and s) as n_of_these_high from a""")
def b14(spark, d):
    out = ind.avoidance_audit(ind.indicator_table(b.interactions(spark, d)))
    return out.withColumns({c: F.round(c, 6) for c in ("share_confused_over_hint", "reversed_mean_hints")})


@query("b15_informative_rows", f"with {TABLE} select row_id from inds where " + " or ".join(f"abs({m}) > 0.15" for m in M))
def b15(spark, d):
    return ind.informative_rows(ind.indicator_table(b.interactions(spark, d))).select("row_id")


@query("b16_sample_rows", f"with {BASE} select row_id, skill from base order by md5('7|' || row_id), row_id limit 100")
def b16(spark, d):
    return ind.sample_rows(b.interactions(spark, d), 100, 7).select("row_id", "skill")


@query("b17_select_student", f"with {TABLE} select row_id, student_id, step_idx from inds where student_id = 7")
def b17(spark, d):
    return ind.select_student(ind.step_index(ind.clean_interactions(b.interactions(spark, d))), 7).select("row_id", "student_id", "step_idx")


q = lambda s: "'" + s.replace("'", "''") + "'"
_BEFORE, _AFTER = fixed.TRIAD_AMBIGUOUS["en"].split("{direction}")
_DIR = fixed.TRIAD_DIRECTION["en"]
TRIAD = f"""{TABLE}, tri as (select *, greatest(m_underconfidence, m_productive_struggle, m_lucky_guess) as top,
  case when m_underconfidence >= m_productive_struggle and m_underconfidence >= m_lucky_guess then 'underconfidence' when m_productive_struggle >= m_lucky_guess then 'productive_struggle' else 'lucky_guess' end as who from inds),
triad as (select *, case when top <= 0.15::double then 'confidence_triad' when hint_scaled <= 1e-6 then 'confidence_triad' else who end as indicator,
  case when top <= 0.15::double then 'LOW' when hint_scaled <= 1e-6 then 'AMBIGUOUS' else 'HIGH' end as status,
  case when top > 0.15::double and hint_scaled > 1e-6 then top end as value,
  case when top <= 0.15::double then {q(fixed.TRIAD_INACTIVE['en'])}
       when hint_scaled <= 1e-6 then {q(_BEFORE)} || case when sc is null then '' when sc < 0.35::double then {q(_DIR['guess'])} when sc > 0.65::double then {q(_DIR['struggle'])} else {q(_DIR['mid'])} end || {q(_AFTER)}
       else who || {q(fixed.TRIAD_DOMINANT['en'].replace('{dominant}', ''))} end as note from tri)"""


def _simple(pos, name):
    v = f"m_{name}"
    note = f"case when m_overconfidence > 0.5 and m_slipping > 0.5 then {q(fixed.OVERLAP_NOTE['en'])} else '' end" if name in ("overconfidence", "slipping") else "''"
    return f"select row_id, sc, {pos} as ord, '{name}' as indicator, case when {v} > 0.5 then 'HIGH' else 'LOW' end as status, {v} as value, case when {v} > 0.5 then {note} else {q(fixed.WEAK_NOTE['en'])} end as note from inds where {v} > 0.15::double"


FACTS = f"""{TRIAD}, facts as (select row_id, sc, 0 as ord, indicator, status, value, note from triad union all {' union all '.join(_simple(i + 1, n) for i, n in enumerate(fixed.SIMPLE))}),
numbered as (select *, row_number() over (partition by row_id order by ord) - 1 as pos from facts)"""


def fact_rows(spark, d):
    return fx.symbolic_facts(ind.indicator_table(b.interactions(spark, d)))


@query("c1_confidence_triad", f"with {TRIAD} select row_id, indicator, status, round(value, 6) as value, note from triad")
def c1(spark, d):
    return fx.confidence_triad(ind.indicator_table(b.interactions(spark, d))).select("row_id", "triad.indicator", "triad.status", F.round("triad.value", 6).alias("value"), "triad.note")


@query("c2_symbolic_facts", f"with {FACTS} select row_id, pos::int as pos, indicator, status, round(value, 6) as value, note from numbered")
def c2(spark, d):
    return fx.explode_facts(fact_rows(spark, d), "row_id").withColumn("value", F.round("value", 6))


@query("c3_raw_facts", f"with {TABLE} " + " union all ".join(f"select row_id, {i} as pos, '{n}' as indicator, 'RAW' as status, round(m_{n}, 6) as value, {q(fixed.RAW_NOTE['en'])} as note from inds" for i, n in enumerate(fixed.INDICATORS)))
def c3(spark, d):
    return fx.explode_facts(fx.raw_facts(ind.indicator_table(b.interactions(spark, d))), "row_id").withColumn("value", F.round("value", 6))


_STRIP = r"trim(regexp_replace(note, '\s*\[[^\]]*\]\s*', ' ', 'g'))"
PREMISE = f"""case when status = 'HIGH' and indicator in ({', '.join(q(i) for i in fixed.INDICATORS)}) then case indicator {' '.join(f"when {q(k)} then {q(v)}" for k, v in fixed.DESCRIPTION['en'].items())} end
 else 'The status of this indicator (' || indicator || ') is ' || status || '.' end || case when note <> '' then ' ' || {_STRIP} else '' end"""


@query("c4_c5_premise_text", f"with {FACTS} select row_id, pos::int as pos, {PREMISE} as premise from numbered")
def c5(spark, d):
    return fx.explode_facts(fact_rows(spark, d), "row_id").select("row_id", "pos", fx.premise_text("indicator", "status", "value", "note").alias("premise"))


CATEGORY = "case when {i} = 'confidence_triad' then case when sc > 0.65::double then 'Struggle' else 'Reliability' end " + " ".join(f"when {{i}} = '{k}' then '{v}'" for k, v in fixed.CATEGORY.items()) + " end"


@query("c6_c7_dominant_fact", f"""with {FACTS}, best as (select *, row_number() over (partition by row_id order by coalesce(value, 0.5) desc, pos) as rn from numbered where status in ('HIGH', 'AMBIGUOUS'))
select i.row_id, best.indicator as dominant_indicator, {CATEGORY.format(i='best.indicator').replace('sc >', 'i.sc >')} as category, best.indicator is not null as has_signal from inds i left join best on best.row_id = i.row_id and rn = 1""")
def c7(spark, d):
    return fx.dominant_fact(fact_rows(spark, d)).select("row_id", "dominant_indicator", "category", "has_signal")


@query("c8_parse_fact_strings", """with l as (select event_id as row_id, unnest(['[slipping] HIGH: a', '[' || event_type || '] LOW', 'no match ' || event_id, '[slipping] LOW: b']) as x, unnest(range(4)) as pos from events),
p as (select *, regexp_extract(x, '^\\s*\\[([^\\]]+)\\]\\s*([A-Za-z_]+)\\s*(?::\\s*(.*))?$', ['indicator', 'status', 'note']) as m from l),
k as (select row_id, m.indicator, m.status, m.note, row_number() over (partition by row_id, m.indicator order by pos desc) as rn from p where m.indicator <> '')
select row_id, 1 as n_unmatched, indicator, status, note from k where rn = 1""")
def c8(spark, d):
    lines = F.array(F.lit("[slipping] HIGH: a"), F.concat(F.lit("["), "event_type", F.lit("] LOW")), F.concat(F.lit("no match "), F.col("event_id").cast("string")), F.lit("[slipping] LOW: b"))
    df = b.table(spark, d, "events").select(F.col("event_id").alias("row_id"), lines.alias("lines"))
    return fx.parse_fact_strings(df, "lines", "row_id")


_BLOCK = fixed.BLOCK["en"]


@query("c9_facts_block", f"""with {FACTS}, lines as (select row_id, string_agg(case status when 'AMBIGUOUS' then '- [' || indicator || '] status=Cannot Determine (AMBIGUOUS). ' || note
 else '- [' || indicator || '] status=HIGH' || case when value is null then '' else ' (value=' || printf('%.3f', value) || ')' end || '. ' || note end, chr(10) order by pos) as t from numbered where status in ('HIGH', 'AMBIGUOUS') group by row_id)
select i.row_id, '[Context]' || chr(10) || '- Skill: ' || i.skill || chr(10) || '- Step: ' || i.step_idx || chr(10) || chr(10) || '[Evidence List]' || chr(10) || coalesce(lines.t, {q(_BLOCK['none'])}) as facts_block from inds i left join lines on lines.row_id = i.row_id""")
def c9(spark, d):
    return fx.facts_block(fact_rows(spark, d), context={"skill": "skill", "step": "step_idx"}).select("row_id", "facts_block")


@query("c10_build_messages", f"with {BASE} select row_id, 'system' as role0, 'Cite every claim.' as content0, 'user' as role1, skill || chr(10) || chr(10) || 'Write two sentences.' as content1 from base")
def c10(spark, d):
    out = fx.build_messages(b.interactions(spark, d).withColumn("facts_block", F.col("skill")), "Cite every claim.", "Write two sentences.")
    m = F.col("messages")
    return out.select("row_id", m[0]["role"].alias("role0"), m[0]["content"].alias("content0"), m[1]["role"].alias("role1"), m[1]["content"].alias("content1"))


@query("c11_template_narrative", f"""with {FACTS}, s as (select row_id, pos, indicator, case when status = 'AMBIGUOUS' then {_STRIP} else case indicator {' '.join(f"when {q(k)} then {q(v)}" for k, v in fixed.DESCRIPTION['en'].items())} end end as t from numbered where status in ('HIGH', 'AMBIGUOUS')),
g as (select row_id, string_agg(t || ' [' || indicator || ']', ' ' order by pos) as raw_text, count(*) as n from s group by row_id)
select i.row_id, coalesce(g.raw_text, {q(fixed.TEMPLATE_NONE['en'])}) as raw_text, coalesce(g.n, 1)::int as n_sentences from inds i left join g on g.row_id = i.row_id""")
def c11(spark, d):
    return fx.template_narrative(fact_rows(spark, d)).select("row_id", "raw_text", F.size("sentences").alias("n_sentences"))
