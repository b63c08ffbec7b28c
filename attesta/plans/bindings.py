"""The driver's tables as the engine's entities, and the same as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.sources.io import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


_EVENTS = """
select event_id as row_id, user_id as student_id, event_type as skill,
       cast(case when event_id % 3 = 0 then 0 else 1 end as int) as correct,
       ({T}) as start_time, ({T}) + value as end_time, value as time_taken,
       k % 6 as hint_count, 1 + k % 4 as attempt_count,
       cast(k % 10 as double) / 9 as confused, cast((k + 3) % 10 as double) / 9 as concentrating,
       cast((k + 5) % 10 as double) / 9 as bored, cast((k + 7) % 10 as double) / 9 as frustrated
from (select *, cast({J} as int) as k from {events})
"""
INTERACTIONS = _EVENTS.format(T="epoch_us(ts) / 1000000::double", J="json_extract_string(props, '$.k')", events="events")

_LI = """
with li as (select *, row_number() over (partition by l_orderkey
              order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as sid from {lineitem})
"""
_SENTENCES = _LI + """
select l_orderkey as item_id, sid as sentence_id, verifier, premise,
       (cast((l_partkey * 7919 + l_suppkey * 104729 + l_linenumber * salt) % 1000 as double) + l_quantity * 8) / 1400 as score,
       case when l_partkey % 50 = 0 then 'unknown' when l_quantity >= 34 then 'supported'
            when l_quantity >= 17 then 'partial' else 'unsupported' end as majority_tag,
       l_orderkey % 4 = 0 as is_core, l_suppkey % 20 = 0 as is_negative_control
from li {four}
"""
_FOUR = "(values ('v1','fact',31),('v1','record',37),('v2','fact',41),('v2','record',43)) as t(verifier, premise, salt)"
SENTENCES = _SENTENCES.format(lineitem="lineitem", four=f"cross join (select * from {_FOUR})")

_RATINGS = _LI + """
select l_orderkey as item_id, sid as sentence_id, rater_id,
       case (cast(l_quantity as bigint) + l_partkey % 3 + case when l_partkey % 7 = n then 1 else 0 end) % 4
            when 0 then 'supported' when 1 then 'partial' when 2 then 'unsupported' else 'unknown' end as tag,
       1 + (l_orderkey + n * (l_orderkey % 3)) % 5 as faithfulness
from li {five}
where l_orderkey % 10 = 0 or l_orderkey % 5 + 1 = n
"""
_FIVE = "(values ('R1',1),('R2',2),('R3',3),('R4',4),('R5',5)) as t(rater_id, n)"
RATINGS = _RATINGS.format(lineitem="lineitem", five=f"cross join (select * from {_FIVE})")

_RUNS = _LI + """
select o_orderpriority as condition, o_custkey as interaction_id, o_orderkey as run_id, sid as pos,
       case when l_returnflag = 'A' then 'PASS' when l_quantity >= 40 then 'PASS_NO_SIGNAL'
            when l_quantity >= 25 then 'FAIL_NLI' when l_quantity >= 12 then 'FAIL_NO_CITATION'
            when l_quantity >= 6 then 'FAIL_INVALID_REF' else 'FAIL_HEDGE' end as status
from {orders} join li on o_orderkey = l_orderkey
"""
RUNS = _RUNS.format(lineitem="lineitem", orders="orders")

_NARRATIVES = """
select doc_id as narrative_id, lang, source,
       replace(text, '. ', case doc_id % 3 when 0 then '. [overconfidence] ' when 1 then '. [slipping, lucky_gues] ' else '. ' end) as raw_text
from {documents}
"""
NARRATIVES = _NARRATIVES.format(documents="documents")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _EVENTS.format(T="unix_micros(cast(ts as timestamp)) / 1000000D", J="get_json_object(props, '$.k')", events="{events}")
    return spark.sql(text, events=table(spark, sf_dir, "events"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = "lateral view inline(array(struct('v1', 'fact', 31), struct('v1', 'record', 37), struct('v2', 'fact', 41), struct('v2', 'record', 43))) t as verifier, premise, salt"
    return spark.sql(_SENTENCES.format(lineitem="{lineitem}", four=four), lineitem=table(spark, sf_dir, "lineitem"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    five = "lateral view inline(array(struct('R1', 1), struct('R2', 2), struct('R3', 3), struct('R4', 4), struct('R5', 5))) t as rater_id, n"
    return spark.sql(_RATINGS.format(lineitem="{lineitem}", five=five), lineitem=table(spark, sf_dir, "lineitem"))


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_RUNS.format(lineitem="{lineitem}", orders="{orders}"), lineitem=table(spark, sf_dir, "lineitem"), orders=table(spark, sf_dir, "orders"))


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_NARRATIVES.format(documents="{documents}"), documents=documents(spark, sf_dir))
