"""Rollout-shaped inputs derived from the given tables.

The SQL texts run unchanged in Spark and in DuckDB; ``{orders}`` and the like stand for the
tables. Backslashes and newlines are written with ``chr`` since the engines read them
differently in literals. Tokens are the words of whole documents, so a sequence is as long as
its text and no row has to be numbered by a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscore.functions.ranges import each_below

STEPS = 16
SEGMENTS = 4
SAMPLED = 2
ITERATIONS = 3
EOS = 7
MASK_ID = 126336
PROMPT_WORDS = 8
BLOCK = 32
STEPS_PER_BLOCK = 4
CLIP_LOW = 0.04
CLIP_HIGH = 0.05

GENERATIONS = """
with b as (select o_orderkey as idx, o_custkey as c from {orders}),
n as (select idx, c, idx % 97 as gold, case when c % 3 = 0 then idx % 97 + 1 else idx % 97 end as pred, idx % 16 as v from b),
t as (select n.*, cast(pred as varchar(20)) as p, chr(10) as nl, chr(92) as bs from n)
select idx as example_index, cast(floor(idx / 4) as bigint) as group_id, idx % 4 as sample_id,
       cast(floor(idx / 400) as bigint) as step, idx % 8 as shard_rank,
       cast(gold as double) as gold_num, cast(gold as varchar(20)) as gold,
       case v
         when 0 then '<reasoning>' || nl || 'w' || nl || '</reasoning>' || nl || '<answer>' || nl || p || nl || '</answer>' || nl
         when 1 then '<reasoning>w</reasoning><answer>' || p || '</answer>'
         when 2 then bs || 'boxed{{' || p || '}}'
         when 3 then bs || 'boxed{{...}} ' || bs || 'boxed{{x=' || p || ' or 3}}'
         when 4 then '<answer>about ' || p || ' of 3, so ' || p || '</answer>'
         when 5 then 'no tags ' || p
         when 6 then 'Work. #### 1,' || p || '00'
         when 7 then '#### -' || p || ' #### x'
         when 8 then bs || 'boxed{{' || bs || 'frac{{' || p || '}}{{2}}'
         when 9 then bs || 'boxed ' || p || '$ end'
         when 10 then '<answer>1</answer><answer> ' || p || ' </answer> tail'
         when 11 then bs || 'boxed{{' || p || '/2}}'
         when 12 then bs || 'fbox{{' || p || '}}'
         when 13 then '<answer>' || bs || 'boxed{{0.5}}</answer>'
         when 14 then ''
         else nl || '</answer>' || nl || '</answer>' || nl || nl || '<answer>' || nl || p
       end as completion
from t
"""

# Math answers: every normalisation rule and each of its error cases, with a gold beside it.
MATH_ANSWERS = """
with t as (select o_orderkey as idx, o_orderkey % 26 as v, o_custkey % 3 as w, cast(o_orderkey % 9 + 1 as varchar(20)) as p,
                  chr(92) as bs, chr(10) as nl from {orders})
select idx as example_index,
       case v
         when 0 then bs || 'frac' || p || '2'
         when 1 then bs || 'dfrac{{' || p || '}}{{2}}'
         when 2 then p || '/2'
         when 3 then bs || 'sqrt' || p || 'x + ' || bs || 'sqrt{{2}}'
         when 4 then p || bs || 'text{{ cm}}'
         when 5 then '.' || p
         when 6 then 'x = ' || p
         when 7 then 'long = ' || p
         when 8 then bs || 'frac' || p
         when 9 then bs || 'sqrt'
         when 10 then p || '0' || bs || '%'
         when 11 then bs || 'left(' || p || ',' || bs || '! 2' || bs || 'right)'
         when 12 then p || '^' || bs || 'circ'
         when 13 then '0.5'
         when 14 then '+' || p || '/2'
         when 15 then 'x/' || p
         when 16 then p || bs || 'text{{ a}}' || bs || 'text{{ b}}'
         when 17 then bs || '$' || p || '^{{' || bs || 'circ}}'
         when 18 then bs || 'tfrac' || p || '{{2}}'
         when 19 then ''
         when 20 then 'a=b=' || p
         when 21 then nl || p || ' .5 {{.5}}'
         when 22 then bs || 'frac' || bs || 'frac12'
         when 23 then bs || 'frac1' || bs || 'frac'
         when 24 then '-0/' || p
         else bs || bs || 'frac{{' || p || '}}{{2}}'
       end as answer,
       case when v = 19 then '' when v = 9 then bs || 'sqrt' when w = 0 then bs || 'frac{{' || p || '}}{{2}}'
            when w = 1 then p else bs || 'frac{{1}}{{2}}' end as gold
from t
"""

# Twenty runs, some of them with a defect. A run's examples are numbered from 0 and dealt to eight
# workers. Everything but a run's size follows from the row itself.
RUN_ROWS = """
with b as (select o_orderkey as idx, o_orderkey % 20 as r, cast(floor(o_orderkey / 20) as bigint) as k from {orders}),
f as (select *, case when r = 9 and k % 8 = 6 then 5 when r = 15 then k % 9 else k % 8 end as file_no from b)
select idx, 'run' || cast(r as varchar(20)) as run, file_no,
       case when r = 5 and file_no = 7 then 9 else file_no % 8 end as rank,
       case when r = 3 and k = 5 then 4 else k end as example_index,
       case when r = 13 then 'math' when r <> 17 then 'gsm8k' end as dataset,
       cast(8 as bigint) as world_size,
       case when r = 7 and file_no = 2 then 'steps=64' when r <> 19 then 'steps=32' end as config,
       k
from f
"""

# Examples of the runs with their texts.
RUN_GENERATIONS = (
    "with g as (" + GENERATIONS + """)
select example_index as idx, 'run' || cast(example_index % 20 as varchar(20)) as run,
       case when example_index % 20 = 3 and floor(example_index / 20) = 5 then 4
            else cast(floor(example_index / 20) as bigint) end as example_index,
       completion as generations, gold as ground_truth, gold_num
from g
"""
)

# One row per worker file; a run's size is the sum over its files.
RANKS = (
    "with rows as (" + RUN_ROWS + """),
files as (select run, file_no, rank, dataset, world_size, config, count(*) as total_processed, max(k % 97) as slowest
          from rows group by run, file_no, rank, dataset, world_size, config)
select run, file_no, rank, dataset, world_size, config, total_processed,
       cast(sum(total_processed) over (partition by run) + case when run = 'run11' then 1 else 0 end as bigint) as dataset_size,
       cast(slowest as double) / 4 + 1 as wall_time_seconds
from files
"""
)

QUESTIONS = """
select doc_id as example_index, text as question, 'w #### ' || cast(n_chars as varchar(20)) as answer from {documents}
"""

# Micro-steps of training runs: 400 per run, four slots per step, with runs that start at 0, 96 or 100.
MICRO_STEPS = """
with b as (select cast(floor(o_orderkey / 400) as bigint) as run, o_orderkey % 400 as m from {orders})
select run, m % 4 as slot,
       cast(floor(m / 4) as bigint) + case run % 3 when 0 then 0 when 1 then 96 else 100 end as step
from b
"""

LOGITS = """
select cast(floor(vec_id / 10) as bigint) as seq_id, vec_id % 10 as pos, vec_id,
       (vec_id * 7) % 16 as unmask_step, cast(label as bigint) as token_id, embedding
from {embeddings}
"""

# Words of each document with their position, in DuckDB; Spark's is in words().
WORDS = """
select doc_id, unnest(l) as word, cast(unnest(range(len(l))) as bigint) as pos
from (select doc_id, string_split(text, ' ') as l from {documents})
"""

TOKENS = """
select doc_id as seq_id, doc_id % 100 as batch_id, pos,
       cast((length(word) * 7 + pos) % 997 as bigint) as token_id,
       cast(case when (pos + doc_id) % 29 = 0 then -1 else (pos * 5 + doc_id * 3 + length(word)) % 16 end as bigint) as unmask_step,
       cast(length(word) as bigint) as width
from {words}
"""

# Log-probabilities are multiples of 1/64, so that their sums are exact.
LOGPS = """
select doc_id as seq_id, doc_id % 100 as batch_id, pos,
       -cast(pos % 7 + length(word) % 5 + 1 as double) / 16 as old_logp,
       -cast(pos % 7 + length(word) % 5 + 1 as double) / 16 + cast(pos % 7 - 3 as double) / 32 as new_logp,
       -cast(pos % 7 + length(word) % 5 + 1 as double) / 16 + cast((pos + doc_id) % 5 - 2 as double) / 64 as ref_logp,
       cast(doc_id % 5 - 2 as double) as advantage,
       (pos * 3 + doc_id) % 4 <> 0 and pos % 500 < 400 and doc_id % 11 <> 0 as is_sampled,
       (pos + doc_id) % 17 <> 0 and doc_id % 13 <> 0 as is_valid,
       -cast(pos % 5 + length(word) % 3 + 1 as double) / 16 as old_pos_logp,
       -cast(pos % 5 + length(word) % 3 + 1 as double) / 16 + cast(length(word) % 5 - 2 as double) / 32 as new_pos_logp
from {words}
"""

# Scores of every position in every segment's forward pass, for position likelihood over long texts.
POSITION_SCORES = """
select doc_id as seq_id, cast(s as bigint) as segment, pos,
       cast(case when (pos + doc_id) % 29 = 0 then -1 else (pos * 5 + doc_id * 3 + length(word)) % 16 end as bigint) as unmask_step,
       cast((pos * 37 + length(word) * 11 + s * 5) % 101 as double) / 32 - 1 as own_score,
       cast((pos * 53 + length(word) * 7 + s * 3) % 103 as double) / 32 as confidence
from {segment_words}
"""

# A decode step's scores: which positions are still masked, and how many may be revealed. Eight steps
# work on each block of 1,024 words to the document's end; every seventh word is scored a block early.
DECODE_SCORES = """
with w as (select doc_id, pos, word, (pos + length(word)) % 8 as s,
                  cast(floor(pos / 1024) as bigint) - case when pos % 7 = 0 and pos >= 1024 then 1 else 0 end as b from {words})
select doc_id as seq_id, cast(b * 8 + s as bigint) as step, pos,
       cast((pos * 37 + length(word) * 11) % 101 as double) / 101 as confidence,
       (pos + doc_id) % 3 <> 0 as is_masked,
       cast((b + 1) * 1024 as bigint) as block_end,
       cast(1 + (doc_id + s) % 3 as bigint) as k
from w
"""

# A decode trace that follows the quota but for some words.
TRACE = """
select doc_id as seq_id, pos,
       cast(case when (pos + doc_id) % 291 = 0 then -1
            else floor(pos / 32) * 4 + pos % 32 % 4 + case when length(word) = 13 then 1 else 0 end end as bigint) as unmask_step
from {words}
"""

# Confidences of a trace's decode steps, logged for the step that revealed a word and the one before.
TRACE_SCORES = """
with t as (select doc_id as seq_id, pos, word, cast(floor(pos / 32) * 4 + pos % 32 % 4 as bigint) as st from {words}),
e as (select *, st as step from t union all select *, st - 1 as step from t where st % 4 > 0)
select seq_id, step, pos, cast((pos * 37 + length(word) * 11 + step * 5) % 101 as double) / 101 as confidence from e
"""

# The words once per segment, in DuckDB; Spark's are in segment_words().
SEGMENT_WORDS = "select *, unnest(range(4)) as s from {words}"

USED_COLUMNS = {
    "orders": ["o_orderkey", "o_custkey"],
    "documents": ["doc_id", "text", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "events": ["event_id", "ts", "user_id", "event_type", "value"],
    "part": ["p_partkey", "p_size"],
}
TABLES = tuple(USED_COLUMNS)


#: Rows of a task at most: a document holds hundreds of words, and what a task sorts or keeps for its shuffle grows with them.
TASK_ROWS = {"documents": 2_500}
OTHER_ROWS = 250_000


def is_spread(rows: DataFrame) -> bool:
    """Whether the files' own splits keep all cores busy: none holds more than two cores' share of the rows."""
    held = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    return bool(held) and max(held) * rows.sparkSession.sparkContext.defaultParallelism <= 2 * sum(held)


def read(spark: SparkSession, sf_dir: str, table: str, dealt: bool = True) -> DataFrame:
    """A table's columns, dealt over the cores: the given files are single splits. A larger table has more tasks, not larger ones.

    Dealing writes the whole table to disk once. Where what follows holds a bounded number of a task's rows, however many it has,
    ``dealt=False`` leaves a table as it is if its files are spread over the cores already.
    """
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*USED_COLUMNS[table])
    if not dealt and is_spread(rows):
        return rows
    tasks = -(-rows.count() // TASK_ROWS.get(table, OTHER_ROWS))
    return rows.repartition(max(spark.sparkContext.defaultParallelism, tasks))


def words(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """One row per word of each document, with its 0-based position."""
    return read(spark, sf_dir, "documents", dealt).select("doc_id", F.posexplode(F.split("text", " ")).alias("p", "word")).select(
        "doc_id", "word", F.col("p").cast("bigint").alias("pos")
    )


def segment_words(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    return words(spark, sf_dir, dealt).withColumn("s", each_below(SEGMENTS))


def derive(spark: SparkSession, sf_dir: str, text: str, dealt: bool = True) -> DataFrame:
    """Run a fixture's SQL in Spark; ``dealt`` as in ``read``."""
    used = {name: read(spark, sf_dir, name, dealt) for name in TABLES if "{" + name + "}" in text}
    if "{words}" in text:
        used["words"] = words(spark, sf_dir, dealt)
    if "{segment_words}" in text:
        used["segment_words"] = segment_words(spark, sf_dir, dealt)
    return spark.sql(text, **used)


def duck(text: str) -> str:
    """The same SQL for DuckDB, as a parenthesised subquery."""
    names = {name: name for name in TABLES}
    names["words"] = "(" + WORDS.format(**names) + ")"
    names["segment_words"] = "(" + SEGMENT_WORDS.format(**names) + ")"
    return "(" + text.format(**names) + ")"
