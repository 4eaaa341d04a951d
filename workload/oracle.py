"""SQL for DuckDB that checks the queries, written independently of the Spark expressions."""

from __future__ import annotations

from rollscore.functions import prompts
from workload import fixtures as fx
from workload.queries import LATE_SEGMENTS, LATE_STEPS, SCAN_STEPS, SEED, TEMPLATE, WEIGHTS

G = fx.duck(fx.GENERATIONS)
M = fx.duck(fx.MATH_ANSWERS)
RUN_ROWS = fx.duck(fx.RUN_ROWS)
RANKS = fx.duck(fx.RANKS)
Q = fx.duck(fx.QUESTIONS)
STEPS = fx.duck(fx.MICRO_STEPS)
V = fx.duck(fx.LOGITS)
WORDS = fx.duck(fx.WORDS)
T = fx.duck(fx.TOKENS)
LOGPS = fx.duck(fx.LOGPS)
SCORES = fx.duck(fx.POSITION_SCORES)
DECODE = fx.duck(fx.DECODE_SCORES)
TRACE_SCORES = fx.duck(fx.TRACE_SCORES)
TRACE = fx.duck(fx.TRACE)

WIDTH = fx.STEPS // fx.SEGMENTS


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r6(expression: str) -> str:
    return f"(round({expression}, 6) + 0.0)"


def r9(expression: str) -> str:
    return f"(round({expression}, 9) + 0.0)"


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def uniform(*keys: str) -> str:
    parts = " || '|' || ".join(f"cast({k} as varchar)" for k in keys)
    return f"((cast('0x' || substr(md5({parts}), 1, 8) as bigint) + 0.5) / 4294967296.0)"


# --- answers ------------------------------------------------------------------------------------


def xml_answer(text: str) -> str:
    return strip(f"string_split(string_split({text}, '<answer>')[-1], '</answer>')[1]")


def number_in(text: str) -> str:
    """A whole number text as float() reads it, for texts without underscores or words like inf."""
    return rf"case when regexp_full_match({strip(text)}, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') then try_cast({strip(text)} as double) end"


def tag_body(text: str) -> str:
    return strip(f"regexp_extract({text}, '(?s)<answer>(.*?)</answer>', 1)")


def has_tag(text: str) -> str:
    return f"regexp_matches({text}, '(?s)<answer>.*?</answer>')"


def gsm_prediction(text: str) -> str:
    box = rf"coalesce({number_in('b')}, try_cast(regexp_extract(b, '-?\d+\.?\d*') as double))"
    boxes = rf"list_transform(regexp_extract_all({text}, '\\boxed\{{(.*?)\}}', 1), lambda b: {box})"
    body = tag_body(text)
    last = rf"regexp_extract_all({body}, '-?\d+\.?\d*')[-1]"
    return (
        f"coalesce(list_filter({boxes}, lambda x: x is not null)[1], "
        f"case when {has_tag(text)} then coalesce({number_in(body)}, try_cast({last} as double)) end)"
    )


def count_char(text: str, char: str) -> str:
    return f"(length({text}) - length(replace({text}, '{char}', '')))"


def balanced(tail: str) -> str:
    """Cut at the first closing brace at which as many braces have closed as opened."""
    prefix = f"substr({tail}, 1, i)"
    closes = f"substr({tail}, i, 1) = '}}' and {count_char(prefix, '{')} = {count_char(prefix, '}')}"
    return f"substr({tail}, 1, list_filter(range(1, length({tail}) + 1), lambda i: {closes})[1])"


def last_boxed(text: str) -> str:
    boxed = rf"('\boxed' || string_split({text}, '\boxed')[-1])"
    framed = rf"('\fbox' || string_split({text}, '\fbox')[-1])"
    return (
        rf"case when contains({text}, '\boxed ') then '\boxed ' || string_split(string_split({text}, '\boxed ')[-1], '$')[1] "
        rf"when contains({text}, '\boxed') then {balanced(boxed)} when contains({text}, '\fbox') then {balanced(framed)} "
        f"else {text} end"
    )


def unbox(box: str) -> str:
    return (
        rf"case when contains({box}, '\boxed ') then case when starts_with({box}, '\boxed ') then substr({box}, 8) end "
        rf"when starts_with({box}, '\boxed{{') and ends_with({box}, '}}') then substr({box}, 8, length({box}) - 8) else {box} end"
    )


def chain(source: str, *steps: str) -> str:
    """Apply select lists one after another, each on stored rows, so that none is written out twice."""
    parts = [f"s0 as materialized (select * from {source})"]
    parts += [f"s{i} as materialized (select {step} from s{i - 1})" for i, step in enumerate(steps, 1)]
    return f"(with {', '.join(parts)} select * from s{len(steps)})"


def boxed_columns(source: str, text: str, prefix: str = "") -> str:
    """Add ``boxed`` and ``unboxed`` columns of a text column."""
    return chain(
        source, f"*, {last_boxed(text)} as {prefix}boxed", f"*, {unbox(prefix + 'boxed')} as {prefix}unboxed"
    )


def normal_form(source: str, column: str, out: str) -> str:
    """Add the normal form of a column, step by step; NULL where it fails."""
    steps = [
        r"replace(replace(replace(x, chr(10), ''), '\!', ''), '\\', '\')",
        r"replace(replace(replace(replace(x, 'tfrac', 'frac'), 'dfrac', 'frac'), '\left', ''), '\right', '')",
        r"replace(replace(replace(x, '^{\circ}', ''), '^\circ', ''), '\$', '')",
        units("x"),
        r"replace(replace(replace(x, '\%', ''), ' .', ' 0.'), '{.', '{0.')",
        "case when starts_with(x, '.') then '0' || x else x end",
        "case when len(string_split(x, '=')) = 2 and length(string_split(x, '=')[1]) <= 2 then string_split(x, '=')[2] else x end",
        square_roots("x"),
        "replace(x, ' ', '')",
        fractions("x"),
        r"case when x = '0.5' then '\frac{1}{2}' else x end",
        slash("x"),
    ]
    return chain(
        source, f"*, {column} as x", *[f"* exclude (x), {e} as x" for e in steps], f"* exclude (x), x as {out}"
    )


def units(x: str) -> str:
    parts = rf"string_split({x}, '\text{{ ')"
    return f"case when len({parts}) <= 2 then {parts}[1] end"


def square_roots(x: str) -> str:
    pieces = rf"string_split({x}, '\sqrt')"
    braced = "case when starts_with(p, '{') then p else '{' || substr(p, 1, 1) || '}' || substr(p, 2) end"
    rebuilt = rf"{pieces}[1] || array_to_string(list_transform({pieces}[2:], lambda p: '\sqrt' || {braced}), '')"
    return f"case when list_contains({pieces}[2:], '') then null when len({pieces}) = 1 then {x} else {rebuilt} end"


def fractions(x: str) -> str:
    pieces = rf"string_split({x}, '\frac')"
    offender = f"list_filter({pieces}[2:], lambda p: p = '' or (length(p) = 1 and p <> '{{'))"
    braced = (
        "case when starts_with(p, '{') then p "
        "when substr(p, 2, 1) = '{' then '{' || substr(p, 1, 1) || '}' || substr(p, 2) "
        "else '{' || substr(p, 1, 1) || '}{' || substr(p, 2, 1) || '}' || substr(p, 3) end"
    )
    rebuilt = rf"{pieces}[1] || array_to_string(list_transform({pieces}[2:], lambda p: '\frac' || {braced}), '')"
    return (
        f"case when len({pieces}) = 1 then {x} when len({offender}) = 0 then {rebuilt} "
        f"when {offender}[1] = '' then null else {x} end"
    )


def slash(x: str) -> str:
    parts = f"string_split({x}, '/')"
    integer = r"'\s*[+-]?\d+\s*'"
    number = "cast(try_cast({} as bigint) as varchar)"
    a, b = number.format(f"{parts}[1]"), number.format(f"{parts}[2]")
    return (
        f"case when {x} is null or len({parts}) <> 2 then {x} "
        f"when not (regexp_full_match({parts}[1], {integer}) and regexp_full_match({parts}[2], {integer})) then null "
        rf"when {a} = {parts}[1] and {b} = {parts}[2] then '\frac{{' || {a} || '}}{{' || {b} || '}}' else {x} end"
    )


def equivalent(source: str, left: str, right: str, out: str) -> str:
    both = normal_form(normal_form(source, left, "n1"), right, "n2")
    equal = f"case when {left} is null or {right} is null then {left} is null and {right} is null else coalesce(n1 = n2, {left} = {right}) end"
    return f"(select * exclude (n1, n2), {equal} as {out} from {both})"


def on_text(expression: str) -> str:
    return f"select example_index, {expression} as value from {G}"


def on_math(expression: str) -> str:
    return f"select example_index, {expression} as value from {M}"


def math_prediction(source: str) -> str:
    """Add ``prediction``: the box, or the first tag if the box is missing or empty."""
    body = f"case when {has_tag('completion')} then {tag_body('completion')} end"
    return chain(
        boxed_columns(source, "completion"),
        f"*, case when unboxed <> '' then unboxed else coalesce({body}, unboxed) end as prediction",
    )


# --- rewards ------------------------------------------------------------------------------------

NL = "chr(10)"


def once(text: str, tag: str) -> str:
    return f"len(string_split({text}, {tag})) = 2"


def tag_count(text: str) -> str:
    open_r, close_r = f"('<reasoning>' || {NL})", f"({NL} || '</reasoning>' || {NL})"
    open_a, close_a = f"({NL} || '<answer>' || {NL})", f"({NL} || '</answer>')"
    after_line = f"length(string_split({text}, {NL} || '</answer>' || {NL})[-1])"
    after_tag = f"(length(string_split({text}, {close_a})[-1]) - 1)"
    return (
        f"(case when {once(text, open_r)} then 0.125::double else 0 end + case when {once(text, close_r)} then 0.125::double else 0 end "
        f"+ case when {once(text, open_a)} then 0.125::double - {after_line} * 0.001::double else 0 end "
        f"+ case when {once(text, close_a)} then 0.125::double - {after_tag} * 0.001::double else 0 end)"
    )


def strict(text: str) -> str:
    return rf"case when regexp_matches({text}, '\A<reasoning>\n[^\n]*?\n</reasoning>\n<answer>\n[^\n]*?\n</answer>\n\n?\z') then 0.5::double else 0.0::double end"


def soft(text: str) -> str:
    return rf"case when regexp_matches({text}, '\A<reasoning>[^\n]*?</reasoning>\s*<answer>[^\n]*?</answer>') then 0.5::double else 0.0::double end"


def integer(text: str) -> str:
    return rf"case when regexp_full_match({xml_answer(text)}, '\d+') then 0.5::double else 0.0::double end"


def correct(text: str, gold: str) -> str:
    return f"case when {xml_answer(text)} = {gold} then 2.0::double else 0.0::double end"


def boxed_format(text: str) -> str:
    tagged = f"contains({text}, '<answer>')"
    body = f"case when {tagged} then string_split(string_split({text}, '<answer>')[2], '</answer>')[1] else {text} end"
    return f"(case when {tagged} then 0.5::double else 0.0 end + case when contains({body}, chr(8) || 'oxed') then 0.5::double else 0.25 end)"


def on_reward(expression: str) -> str:
    return f"select example_index, {r6(expression)} as reward from {G}"


def all_rewards(source: str, keys: str, gold: str) -> str:
    parts = {
        "tag_count": tag_count("completion"), "soft_format": soft("completion"), "strict_format": strict("completion"),
        "integer_answer": integer("completion"), "correct_answer": correct("completion", gold),
    }
    selects = [f"select {keys}, '{name}' as func, cast({e} as double) as reward from src" for name, e in parts.items()]
    return f"(with src as (select * from {source}) {' union all '.join(selects)})"


LONG = (
    "(select step, group_id, sample_id, func, case when (group_id * 4 + sample_id) % 7 = 3 "
    "or (func = 'tag_count' and group_id % 5 = 1) then null else reward end as reward "
    f"from {all_rewards(G, 'step, group_id, sample_id', 'gold')})"
)
_WEIGHT = "case func " + " ".join(f"when '{n}' then {w}::double" for n, w in WEIGHTS.items()) + " end"
TOTALS = (
    f"(select step, group_id, sample_id, coalesce(sum({_WEIGHT} * reward), 0.0) as reward from {LONG} "
    "group by step, group_id, sample_id)"
)
GROUPED = (
    "(select *, sum(reward) over g as gs, count(*) over g as gn, stddev_samp(reward) over g as sd "
    f"from {TOTALS} window g as (partition by step, group_id))"
)


def advantage(expression: str) -> str:
    return f"select step, group_id, sample_id, {r6('reward')} as reward, {r6(expression)} as advantage from {GROUPED}"


RLOO = "reward - (gs - reward) / (gn - 1)"
REWARD_STATS = (
    "(select step, avg(reward) as reward_mean, avg(sd) as reward_std, "
    "avg(case when sd < 1e-6 then 1.0 else 0.0 end) as zero_std_ratio, cast(count(*) as bigint) as n_samples "
    f"from {GROUPED} group by step)"
)

DOCUMENTS = (
    "(select 0 as step, source as group_id, doc_id as sample_id, "
    f"'<reasoning>' || {NL} || text || {NL} || '</reasoning>' || {NL} || '<answer>' || {NL} || cast(n_chars as varchar) || {NL} || '</answer>' || {NL} as completion, "
    "cast(length(text) as varchar) as gold from documents)"
)

# --- runs ---------------------------------------------------------------------------------------

RUN_TEXTS = f"(select *, generations as completion from {fx.duck(fx.RUN_GENERATIONS)})"
GSM_SCORED = (
    "(select run, idx, example_index, p as extracted_answer, coalesce(p = gold_num, false) as is_correct "
    f"from (select *, {gsm_prediction('completion')} as p from {RUN_TEXTS}))"
)
MATH_SCORED = (
    "(select run, idx, prediction is not null and same as is_correct from "
    + equivalent(math_prediction(RUN_TEXTS), "prediction", "ground_truth", "same") + ")"
)


_HALF = r"case when doc_id % 2 = 0 then '\frac{' || cast(n_chars as varchar) || '}{2}' else cast(n_chars as varchar) end"
DOCUMENT_TEXTS = (
    f"(select source as run, doc_id, text || chr(10) || '<answer>' || chr(10) || '\\boxed{{' || {_HALF} || '}}' || chr(10) || '</answer>' as completion, "
    f"case when doc_id % 6 < 4 then {_HALF} else '1' end as ground_truth from documents)"
)
DOCUMENT_SCORED = (
    f"(select *, {gsm_prediction('completion')} as number, {number_in('ground_truth')} as gold_num, prediction is not null and same as is_correct from "
    + equivalent(math_prediction(DOCUMENT_TEXTS), "prediction", "ground_truth", "same") + ")"
)


def accuracy(scored: str) -> str:
    return (
        "select run, cast(count(*) filter (where is_correct) as bigint) as correct, count(*) as total, "
        f"{r6('count(*) filter (where is_correct) / count(*)')} as accuracy from {scored} group by run"
    )


VALIDATE = f"""
(with f as (select run, min(dataset) as dataset, count(distinct dataset) as nd, count(distinct config) as nc,
                  count(distinct dataset_size) as ns, count(distinct world_size) as nw, count(*) as n_files,
                  count(distinct rank) as n_ranks, count(*) filter (where rank < 0 or rank >= world_size) as bad,
                  max(world_size) as world_size, max(dataset_size) as dataset_size from {RANKS} group by run),
 e as (select run, count(*) as n_rows, count(distinct example_index) as n_examples, min(example_index) as lo,
              max(example_index) as hi from {RUN_ROWS} group by run)
select f.run, f.dataset, n_files, n_ranks, world_size, dataset_size, coalesce(n_rows, 0) as n_rows,
       coalesce(n_examples, 0) as n_examples,
       case when dataset is null or dataset <> 'gsm8k' then 'wrong dataset'
            when nd > 1 or nc > 1 or ns > 1 or nw > 1 then 'mixed configurations'
            when nc = 0 then 'missing configuration'
            when n_files <> n_ranks or bad > 0 then 'duplicate or invalid rank'
            when n_ranks <> world_size then 'missing ranks'
            when not (n_rows = dataset_size and n_examples = dataset_size and lo = 0 and hi = dataset_size - 1)
              then 'incomplete or duplicate examples'
            else '' end as problem
from f left join e on f.run = e.run)
"""

SCORE_RUNS = f"""
select v.run, v.dataset, v.problem, case when problem = '' then correct else -1 end as correct,
       case when problem = '' then total else -1 end as total, case when problem = '' then accuracy end as accuracy
from {VALIDATE} v left join ({accuracy(GSM_SCORED)}) a on v.run = a.run
"""

# --- trajectories -------------------------------------------------------------------------------

VALID = (
    "(select *, pos <= coalesce(min(case when token_id = 7 then pos end) over (partition by seq_id), pos) as is_valid "
    f"from {T})"
)
# Interval join of the definition, against the list of segments.
SEGMENTED = (
    f"(select t.*, s.n as segment from {VALID} t left join (select unnest(range({fx.SEGMENTS})) as n) s "
    f"on t.unmask_step > s.n * {WIDTH} and t.unmask_step <= (s.n + 1) * {WIDTH})"
)
SAMPLES = f"""
(with seg as (select * from {SEGMENTED}),
 batches as (select distinct batch_id from seg),
 found as (select distinct batch_id, segment from seg where is_valid and segment is not null),
 pool as (select batch_id, segment from found
          union all select batch_id, unnest(range({fx.SEGMENTS})) from batches where batch_id not in (select batch_id from found)),
 each as (select batch_id, segment, iter from pool, (select unnest(range({fx.ITERATIONS})) as iter))
select batch_id, iter, segment from each
qualify row_number() over (partition by batch_id, iter
  order by md5(cast(batch_id * {fx.ITERATIONS} + iter as varchar) || '|' || cast(segment as varchar)), segment) <= {fx.SAMPLED})
"""
MASKED = f"""
(with seg as (select * from {SEGMENTED}), smp as (select * from {SAMPLES}),
 each as (select seg.*, i.iter from seg, (select unnest(range({fx.ITERATIONS})) as iter) i)
select each.*, smp.segment is not null as is_sampled
from each left join smp on each.batch_id = smp.batch_id and each.iter = smp.iter and each.segment = smp.segment)
"""
INPUTS = f"""
with seg as (select * from {SEGMENTED}), act as (select distinct batch_id, segment from seg where segment is not null),
rows as (select seg.seq_id, act.segment, seg.pos, unmask_step > act.segment * {WIDTH} or unmask_step = -1 as hidden,
                coalesce(seg.segment = act.segment, false) as target, seg.token_id
         from seg join act on seg.batch_id = act.batch_id)
select seq_id, segment, count(*) as n_tokens, count(*) filter (where hidden) as n_hidden,
       count(*) filter (where target) as n_targets,
       cast(sum(case when hidden then {fx.MASK_ID} else token_id end * (pos + 1)) as bigint) as checksum
from rows group by seq_id, segment
"""
AUDIT = f"""
with t as (select seq_id, cast(floor(pos / {fx.BLOCK}) as bigint) as block, unmask_step as step from {TRACE}),
sizes as (select seq_id, block, count(*) as n from t group by seq_id, block),
want as (select seq_id, block, block * {fx.STEPS_PER_BLOCK} + i as step,
                n // {fx.STEPS_PER_BLOCK} + case when i < n % {fx.STEPS_PER_BLOCK} then 1 else 0 end as expected
         from sizes, (select unnest(range({fx.STEPS_PER_BLOCK})) as i)),
got as (select seq_id, block, step, count(*) as actual from t group by seq_id, block, step)
select seq_id, block, step, cast(coalesce(expected, 0) as bigint) as expected, cast(coalesce(actual, 0) as bigint) as actual,
       case when step = -1 then 'never_revealed' when expected is null then 'outside_block' else 'wrong_count' end as problem
from want full join got using (seq_id, block, step)
where coalesce(expected, 0) <> coalesce(actual, 0)
"""
# As-of join: the last refill of the slot at or before each step.
SCHEDULE = f"""
with l as (select *, step % 12 = 0 or step = min(step) over (partition by run, slot) as is_refreshed from {STEPS})
select run, slot, step, is_refreshed,
       max(case when is_refreshed then step end) over (partition by run, slot order by step) as rollout_step,
       step * 4 + slot + 1 as counter, (step * 4 + slot + 1) % 12 as iteration
from l
"""
SELECTED = f"""
select seq_id, step, pos, {r6('confidence')} as confidence from {DECODE} where is_masked and pos < block_end
qualify row_number() over (partition by seq_id, step order by confidence desc, pos) <= k
"""

def selection_audit(scores: str, traj: str) -> str:
    """Positions chosen and not revealed, or revealed at a logged step and not chosen."""
    return f"""
select coalesce(c.seq_id, r.seq_id) as seq_id, coalesce(c.step, r.step) as step, coalesce(c.pos, r.pos) as pos,
       case when r.pos is null then 'not_revealed' else 'not_selected' end as problem
from (select seq_id, step, pos from {scores} where is_masked and pos < block_end
      qualify row_number() over (partition by seq_id, step order by confidence desc, pos) <= k) c
full join (select seq_id, unmask_step as step, pos from {traj} where unmask_step >= 0
           and (seq_id, unmask_step) in (select (seq_id, step) from {scores})) r
  on c.seq_id = r.seq_id and c.step = r.step and c.pos = r.pos
where c.pos is null or r.pos is null
"""


SELECTION_AUDIT = selection_audit(DECODE, T)
_STEP_U = uniform(str(SEED), "s.seq_id", "s.step", "s.pos")
TRACE_STATE = f"""
(with b as (select seq_id, pos // {fx.BLOCK} as block, count(*) as size from {TRACE} group by all)
select s.seq_id, s.step, s.pos, s.confidence - ln(-ln({_STEP_U} + 1e-8) + 1e-8) * 0.5 as confidence,
       t.unmask_step = -1 or t.unmask_step >= s.step as is_masked, (s.step // {fx.STEPS_PER_BLOCK} + 1) * {fx.BLOCK} as block_end,
       size // {fx.STEPS_PER_BLOCK} + case when s.step % {fx.STEPS_PER_BLOCK} < size % {fx.STEPS_PER_BLOCK} then 1 else 0 end as k
from {TRACE_SCORES} s join {TRACE} t on t.seq_id = s.seq_id and t.pos = s.pos
join b on b.seq_id = s.seq_id and b.block = s.step // {fx.STEPS_PER_BLOCK})
"""

# --- losses -------------------------------------------------------------------------------------

LOW, HIGH = 1 - fx.CLIP_LOW, 1 + fx.CLIP_HIGH


def token_terms(sampled: bool, low: float, high: float, position: bool = False) -> str:
    """Tokens with mask ``m`` (0 or 1), ratio, clipped ratio and clip flags."""
    mask = "is_valid and is_sampled" if sampled else "is_valid"
    new, old = ("new_pos_logp", "old_pos_logp") if position else ("new_logp", "old_logp")
    return (
        f"(select *, ratio < {low} as lo, ratio > {high} as hi, greatest(least(ratio, {high}), {low}) as cr "
        f"from (select *, case when {mask} then 1 else 0 end as m, exp({new} - {old}) as ratio, exp(new_logp - old_logp) as tr from {LOGPS}))"
    )


def token_loss(kind: str, sampled: bool, averaging: str = "token", position: bool = False) -> str:
    high = 1 + fx.CLIP_LOW if kind == "grpo" else HIGH
    terms = token_terms(sampled, LOW, high, position)
    value = "-advantage * new_logp * m" if kind == "reinforce" else "-least(ratio * advantage * m, cr * advantage * m)"
    if averaging == "token":
        loss = "coalesce(sum(v) / nullif(sum(m), 0), 0)"
    else:
        loss = "sum(v) / count(distinct seq_id)"
    columns = [f"{r6(loss)} as loss", "cast(sum(m) as bigint) as total_tokens"]
    if sampled:
        columns.append(f"{r6('avg(case when is_sampled then 1 else 0 end)')} as sampled_tokens_ratio")
    if kind != "reinforce":
        columns += [
            f"{r6(f'coalesce({f}(ratio) filter (where m = 1), {f}(ratio))')} as ratio_{n}"
            for f, n in (("avg", "mean"), ("max", "max"), ("min", "min"))
        ]
    flag = "avg(case when {0} then 1 else 0 end) filter (where m = 1)"
    every = "avg(case when {0} then 1 else 0 end)"
    if kind == "grpo":
        columns.append(f"{r6('coalesce(' + flag.format('lo or hi') + ', 0)')} as clipfrac")
    if kind == "dapo":
        for names, name in (("lo", "low"), ("hi", "high"), ("lo or hi", "total")):
            columns.append(f"{r6('coalesce(' + flag.format(names) + ', ' + every.format(names) + ')')} as clipfrac_{name}")
    return f"select batch_id, {', '.join(columns)} from (select *, {value} as v from {terms}) group by batch_id"


def sequence_terms(sampled: bool, position: bool = False) -> str:
    terms = token_terms(sampled, LOW, HIGH, position)
    new, old = ("new_pos_logp", "old_pos_logp") if position else ("new_logp", "old_logp")
    sums = (
        "select batch_id, seq_id, count(*) as n, sum(m) as nm, max(case when is_valid then 1 else 0 end) as ok, "
        f"sum(case when is_sampled then 1 else 0 end) as nsam, greatest(sum(m), 1) as len, max(advantage) as a, "
        f"exp(sum(({new} - {old}) * m) / greatest(sum(m), 1)) as ratio from {terms} group by batch_id, seq_id"
    )
    return f"(select *, greatest(least(ratio, {HIGH}), {LOW}) as cr, least(ratio * a, greatest(least(ratio, {HIGH}), {LOW}) * a) as s from ({sums}))"


def gspo_loss() -> str:
    return "coalesce(-sum(s * ok) / nullif(sum(ok), 0), 0)"


def gspo(sampled: bool) -> str:
    extra = ""
    if sampled:
        extra = f", {r6('sum(nsam) / sum(n)')} as sampled_tokens_ratio, {r6('avg(len / greatest(nm, 1))')} as sampling_rate"
    return (
        f"select batch_id, {r6(gspo_loss())} as loss, {r6('avg(ratio)')} as ratio_mean, "
        f"{r6('coalesce(stddev_samp(ratio), 0)')} as ratio_std, {r6('max(ratio)')} as ratio_max, {r6('min(ratio)')} as ratio_min, "
        f"{r6('avg(case when ratio <> cr then 1 else 0 end)')} as clipped_fraction, {r6('avg(len)')} as avg_sequence_length, "
        f"cast(sum(ok) as bigint) as valid_sequences{extra} from {sequence_terms(sampled)} group by batch_id"
    )


GSPO_TOKEN = f"""
with s as (select * from {sequence_terms(True)}),
t as (select l.batch_id, l.m, s.ratio, s.cr, -least(s.ratio * l.advantage, s.cr * l.advantage) * l.m as v, l.is_sampled
      from {token_terms(True, LOW, HIGH)} l join s on l.seq_id = s.seq_id),
per as (select batch_id, avg(ratio) as seq_ratio_mean, avg(len) as avg_sequence_length from s group by batch_id)
select t.batch_id, {r6('coalesce(sum(v) / nullif(sum(m), 0), 0)')} as loss, cast(sum(m) as bigint) as total_tokens,
       {r6('any_value(seq_ratio_mean)')} as seq_ratio_mean, {r6('avg(ratio)')} as token_ratio_mean,
       {r6('avg(case when ratio <> cr then 1 else 0 end)')} as clipped_fraction,
       {r6('any_value(avg_sequence_length)')} as avg_sequence_length,
       {r6('avg(case when is_sampled then 1 else 0 end)')} as sampled_tokens_ratio
from t join per on t.batch_id = per.batch_id group by t.batch_id
"""
CLIP_HANDOVER = f"""
select batch_id, {r6('coalesce(sum(-ratio * advantage * m * keep) / nullif(sum(m), 0), 0)')} as loss,
       cast(sum(m) as bigint) as total_tokens, {r6('avg(case when is_sampled then 1 else 0 end)')} as sampled_tokens_ratio,
       {r6('coalesce(avg(ratio) filter (where m = 1), avg(ratio))')} as ratio_mean,
       {r6('coalesce(max(ratio) filter (where m = 1), max(ratio))')} as ratio_max,
       {r6('coalesce(min(ratio) filter (where m = 1), min(ratio))')} as ratio_min,
       {r6('coalesce(avg(case when lo then 1 else 0 end) filter (where m = 1), avg(case when lo then 1 else 0 end))')} as clipfrac_low,
       {r6('coalesce(avg(case when hi then 1 else 0 end) filter (where m = 1), avg(case when hi then 1 else 0 end))')} as clipfrac_high,
       {r6('coalesce(avg(case when lo or hi then 1 else 0 end) filter (where m = 1), avg(case when lo or hi then 1 else 0 end))')} as clipfrac_total,
       {r6('avg(1 - keep)')} as token_clip_masked_frac
from (select *, case when tr < {LOW} or tr > {HIGH} then 0 else 1 end as keep from {token_terms(True, LOW, HIGH, True)})
group by batch_id
"""
KL = (
    "(select batch_id, coalesce(sum(exp(ref_logp - new_logp) - (ref_logp - new_logp) - 1) filter (where is_valid and is_sampled), 0) "
    "/ greatest(count(*) filter (where is_valid and is_sampled), 1) as kl "
    f"from {LOGPS} group by batch_id)"
)
TOTAL = f"""
with a as (select batch_id, {gspo_loss()} as x from {sequence_terms(True)} group by batch_id),
b as (select batch_id, {gspo_loss()} as x from {sequence_terms(True, True)} group by batch_id)
select a.batch_id, {r6('a.x')} as policy_loss, {r6('b.x')} as position_loss, {r6('b.x * 0.5')} as weighted_position_loss,
       {r6('kl')} as kl, {r6('a.x + 0.5 * b.x + 0.04 * kl')} as total_loss
from a join b on a.batch_id = b.batch_id join {KL} k on a.batch_id = k.batch_id
"""

def long_metrics(prefix: str, query: str, names: str) -> str:
    """Metric columns as rows."""
    listed = ", ".join(f"cast({n} as double) as {n}" for n in names.split())
    return (
        f"select batch_id, '{prefix}' || name as name, value from (unpivot (select batch_id, {listed} from ({query})) "
        f"on {', '.join(names.split())} into name name value value)"
    )


_RATIOS = "ratio_mean ratio_max ratio_min"
UPDATE_METRICS = " union all ".join([
    long_metrics("policy/", gspo(True), f"loss {_RATIOS} ratio_std clipped_fraction avg_sequence_length valid_sequences sampled_tokens_ratio sampling_rate"),
    long_metrics("position/", token_loss("dapo", True, position=True), f"loss {_RATIOS} total_tokens sampled_tokens_ratio clipfrac_low clipfrac_high clipfrac_total"),
    long_metrics("", f"""
      select a.batch_id, {r6('a.x')} as policy_loss, {r6('b.x')} as position_loss, {r6('b.x * 0.5')} as weighted_position_loss,
             {r6('kl')} as kl, {r6('a.x + 0.5 * b.x + 0.04 * kl')} as total_loss
      from (select batch_id, {gspo_loss()} as x from {sequence_terms(True)} group by batch_id) a
      join (select batch_id, coalesce(sum(-least(ratio * advantage * m, cr * advantage * m)) / nullif(sum(m), 0), 0) as x
            from {token_terms(True, LOW, HIGH, True)} group by batch_id) b on a.batch_id = b.batch_id
      join {KL} k on a.batch_id = k.batch_id""", "policy_loss position_loss weighted_position_loss kl total_loss"),
    long_metrics("", f"select batch_id, {r6('avg(a)')} as advantage_mean, {r6('coalesce(stddev_samp(a), 0)')} as advantage_std "
                 f"from (select batch_id, seq_id, max(advantage) as a from {LOGPS} group by all) group by batch_id", "advantage_mean advantage_std"),
    long_metrics("", f"select batch_id, {r6('count(*) filter (where is_valid and is_sampled) / nullif(count(*) filter (where is_valid), 0)')} as token_coverage "
                 f"from {LOGPS} group by batch_id", "token_coverage"),
])

# --- logits -------------------------------------------------------------------------------------

# One row per logit, for reductions by plain grouping.
CELLS = f"(select * exclude (embedding), unnest(embedding)::double as x, unnest(range(len(embedding))) as tok from {V})"
SEGMENT_CELLS = f"(select c.* exclude (x), s.segment, x * (1 + s.segment / 4) as x from {CELLS} c, (select unnest(range({fx.SEGMENTS})) as segment) s)"


def reduced(cells: str, keys: str) -> str:
    """Per array: maximum, log-sum-exp, target logit, two best and negative entropy."""
    one = (
        f"select {keys}, max(x) as top, ln(sum(exp(x))) as lse, max(case when tok = token_id then x end) as tgt, "
        f"max(x, 2)[2] as second, arg_max(tok, x) as best, sum(x * exp(x)) / sum(exp(x)) as mean_x from {cells} group by {keys}"
    )
    return f"(select *, mean_x - lse as neg_entropy from ({one}))"


VKEYS = "vec_id, seq_id, pos, unmask_step, token_id"
REDUCED = reduced(CELLS, VKEYS)
SEGMENT_REDUCED = reduced(SEGMENT_CELLS, VKEYS + ", segment")
OWN = f"(select * from {SEGMENT_REDUCED} where unmask_step > segment * {WIDTH} and unmask_step <= (segment + 1) * {WIDTH})"
U = uniform(str(SEED), "vec_id")
GUMBEL = f"-ln(-ln({U} + 1e-8) + 1e-8)"
CELL_U = (
    f"((cast('0x' || substr(md5(md5('{SEED}|' || cast(vec_id as varchar)) || '|' || cast(tok as varchar)), 1, 8) as bigint) + 0.5) / 4294967296.0)"
)


LATE_WIDTH = LATE_STEPS // LATE_SEGMENTS
LATE_REDUCED = reduced(
    f"(select c.* exclude (x, unmask_step), vec_id * 7 % 19 as unmask_step, s.segment, x * (1 + s.segment / 4) as x "
    f"from {CELLS} c, (select unnest(range({LATE_SEGMENTS})) as segment) s)", VKEYS + ", segment"
)


def position_pairs(threshold: str, tau: float = 0.5, source: str = SEGMENT_REDUCED, width: int = WIDTH) -> str:
    """Every target with every competitor, as in the definition."""
    return f"""
(with s as (select seq_id, segment, pos, unmask_step, tgt as own, top as conf from {source}),
 target as (select *, {threshold} as th from s where unmask_step > segment * {width} and unmask_step <= (segment + 1) * {width}),
 pairs as (select t.seq_id, t.segment, t.pos, any_value(t.own) / {tau} as o,
                  coalesce(sum(exp(c.conf / {tau})), 0) as others,
                  coalesce(sum(-ln(1 + exp(-(t.own - c.conf) / {tau}))), 0) as bt
           from target t left join s c on c.seq_id = t.seq_id and c.segment = t.segment and c.unmask_step > t.th
           group by t.seq_id, t.segment, t.pos)
select s.seq_id, s.segment, s.pos, coalesce(o - ln(exp(o) + others), 0) as softmax, coalesce(bt, 0) as bt
from s left join pairs p on p.seq_id = s.seq_id and p.segment = s.segment and p.pos = s.pos)
"""


SEGMENT_END = f"(segment + 1) * {WIDTH}"


def long_position(threshold: str) -> str:
    """Suffix sums over the steps of each sequence and segment."""
    return f"""
(with s as (select * from {SCORES}),
 steps as (select seq_id, segment, unmask_step as st, sum(exp(confidence / 0.5)) as z from s where unmask_step >= 0 group by all),
 target as (select *, unmask_step > segment * {WIDTH} and unmask_step <= (segment + 1) * {WIDTH} as here, {threshold} as th from s),
 others as (select t.seq_id, t.segment, t.th, sum(z) as z from (select distinct seq_id, segment, th from target where here) t
            join steps on steps.seq_id = t.seq_id and steps.segment = t.segment and st > t.th group by all)
select t.seq_id, t.segment, t.pos, t.here, others.z,
       case when here then own_score / 0.5 - ln(exp(own_score / 0.5) + coalesce(others.z, 0)) else 0 end as pos_logp
from target t left join others on others.seq_id = t.seq_id and others.segment = t.segment and others.th = t.th)
"""


def long_position_sums(threshold: str) -> str:
    return (
        f"select seq_id, segment, cast(sum(cast(round(pos_logp * 1e6) as bigint)) as bigint) as pos_logp_micros, {r6('min(pos_logp)')} as lowest, count(*) as n "
        f"from {long_position(threshold)} group by seq_id, segment"
    )


def scan_sums(steps: int, tau: float) -> str:
    """Running sums over the steps of each document, from the latest down."""
    return f"""
with s as (select seq_id, pos, own_score / {tau} as own, exp(confidence / {tau}) as e,
                  case when unmask_step >= 0 then (pos * 5 + seq_id * 3) % {steps} else -1 end as st from {SCORES} where segment = 0),
 steps as (select seq_id, st, sum(e) as z from s where st > 0 group by all),
 later as (select seq_id, st, sum(z) over (partition by seq_id order by st desc rows between unbounded preceding and 1 preceding) as z from steps),
 each as (select s.seq_id, case when s.st > 0 then own - ln(exp(own) + coalesce(z, 0)) else 0 end as v
          from s left join later on later.seq_id = s.seq_id and later.st = s.st)
select seq_id, cast(sum(cast(round(v * 1e6) as bigint)) as bigint) as pos_logp_micros, {r6('min(v)')} as lowest, count(*) as n from each group by seq_id
"""


def block_sums(threshold: str) -> str:
    """Equal targets and equal competitors of a document are counted once, with their numbers."""
    return f"""
with s as (select * from {SCORES}),
 rival as (select seq_id, segment, unmask_step as st, confidence as c, count(*) as m from s where unmask_step >= 0 group by all),
 target as (select *, unmask_step > segment * {WIDTH} and unmask_step <= (segment + 1) * {WIDTH} as here, {threshold} as th from s),
 sums as (select t.seq_id, t.segment, t.th, t.own_score, sum(-m * ln(1 + exp(-(own_score - c) / 0.5))) as v
          from (select distinct seq_id, segment, th, own_score from target where here) t
          join rival r on r.seq_id = t.seq_id and r.segment = t.segment and r.st > t.th group by all)
select t.seq_id, t.segment, cast(sum(cast(round(case when here then coalesce(v, 0) else 0 end * 1e6) as bigint)) as bigint) as pos_logp_micros,
  {r6('min(case when here then coalesce(v, 0) else 0 end)')} as lowest, count(*) as n
from target t left join sums x on x.seq_id = t.seq_id and x.segment = t.segment and x.th = t.th and x.own_score = t.own_score
group by t.seq_id, t.segment
"""


CLOSED = f"(select * replace (case when (pos + seq_id) % 3 = 0 then cast('-infinity' as double) else top end as top) from {SEGMENT_REDUCED})"


def islands(kind: str, flagged: str) -> str:
    return f"""select run, '{kind}' as kind, min(i) as first_index, max(i) as last_index, count(*) as n
 from (select run, i, i - row_number() over (partition by run order by i) as g from ({flagged})) group by run, g"""


GAPS = f"""
with r as (select run, example_index as i, count(*) as c from {RUN_ROWS} where example_index % 37 <> 5 or run = 'run2' group by all),
 z as (select run, max(dataset_size) as size from {RANKS} group by run),
 every as (select run, unnest(range(0, size)) as i from z)
{islands('missing', 'select run, i from every anti join r using (run, i)')} union all
{islands('repeated', 'select run, i from r join z using (run) where c > 1 and i >= 0 and i < size')} union all
{islands('outside', 'select run, i from r left join z using (run) where i < 0 or i >= coalesce(size, 0)')}
"""


# --- prompts ------------------------------------------------------------------------------------


def rendered(role: str, content: str) -> str:
    before, between, after = (quote(TEMPLATE[k]) for k in ("before", "between", "after"))
    return f"{before} || {role} || {between} || {content} || {after}"


def eval_prompt(system: str, gold: str, tail: str) -> str:
    content = f"question || chr(10) || chr(10) || {quote(system)}"
    return (
        f"select example_index, {rendered(quote('user'), content)} || {quote(TEMPLATE['header'] + tail)} as prompt_input, "
        f"{gold} as ground_truth from {Q}"
    )


_HEADER = quote(TEMPLATE["header"])
_USER = rendered(quote("user"), "question")
_ASSISTANT = rendered(quote("assistant"), "answer")
IDS = "(select doc_id as seq_id, doc_id // 4 as batch_id, list_transform(string_split(text, ' '), lambda w: length(w)) as ids from documents)"
HASH_NUMBER = r"try_cast(replace(regexp_extract({0}, '####\s*\$?([\d,]+(?:\.\d+)?)', 1), ',', '') as double)"


ORACLE: dict[str, str] = {
    "score_runs": SCORE_RUNS,
    "e1_xml": on_text(xml_answer("completion")),
    "e2_hash": on_text(f"case when contains(completion, '####') then {strip('string_split(completion, ' + quote('####') + ')[2]')} end"),
    "e3_hash_number": on_text(HASH_NUMBER.format("completion")),
    "e4_gsm": on_text(gsm_prediction("completion")),
    "e5_math": f"select example_index, prediction as value from {math_prediction(G)}",
    "e6_last_boxed": on_text(last_boxed("completion")),
    "e7_unbox": f"select example_index, unboxed as value from {boxed_columns(G, 'completion')}",
    "n1_units": on_math(units("answer")),
    "n2_sqrt": on_math(square_roots("answer")),
    "n3_fracs": on_math(fractions("answer")),
    "n4_slash": on_math(slash("answer")),
    "e8_normalize": f"select example_index, n as value from {normal_form(M, 'answer', 'n')}",
    "e9_equiv": f"select example_index, same as is_equal from {equivalent(M, 'answer', 'gold', 'same')}",
    "e9_close_words": "select example_index, case when example_index % 2 = 0 then example_index % 9 in (3, 4) "
    f"else example_index % 9 in (2, 5) end as is_close from {M}",
    "e9_close": f"select example_index, coalesce(abs(try_cast({xml_answer('completion')} as double) - gold_num) < 1e-6, false) as is_close from {G}",
    "r1_correct": on_reward(correct("completion", "gold")),
    "r2_integer": on_reward(integer("completion")),
    "r3_strict": on_reward(strict("completion")),
    "r4_soft": on_reward(soft("completion")),
    "r5_tags": on_reward(tag_count("completion")),
    "r6_math": "select example_index, case when same then 2.0::double else 0.0::double end as reward from "
    + equivalent(f"(select *, coalesce(unboxed, completion) as shown from {boxed_columns(G, 'completion')})", "shown", "gold", "same"),
    "r6_math_answers": "select example_index, case when g_unboxed is null then null when same then 2.0::double else 0.0::double end as reward from "
    + equivalent(
        "(select *, coalesce(a_unboxed, abox) as shown from "
        + boxed_columns(boxed_columns(
            rf"(select example_index, '\boxed{{' || answer || '}}' as abox, '\boxed{{' || gold || '}}' as gbox from {M})", "abox", "a_"
        ), "gbox", "g_") + ")",
        "shown", "g_unboxed", "same",
    ),
    "r7_boxed": on_reward(boxed_format("completion")),
    "f1_reward_table": f"select step, group_id, sample_id, func, {r6('reward')} as reward from {LONG}",
    "f1_documents": f"select group_id, sample_id, func, {r6('reward')} as reward from {all_rewards(DOCUMENTS, 'group_id, sample_id', 'gold')}",
    "f3_store": rf"select example_index, case when completion <> '' then cast(length(regexp_replace(completion, '[^0-9]', '', 'g')) as double) end as reward from {G}",
    "j2_gold": f"with g as (select * from {G}), k as (select group_id, max(gold) as answer from g group by group_id) "
    f"select example_index, g.group_id, answer, {correct('completion', 'answer')} as reward from g join k on g.group_id = k.group_id",
    "j2_lost": f"with g as (select * from {G}), k as (select group_id, max(gold) as answer from g where group_id % 5 <> 0 group by group_id) "
    "select example_index, g.group_id, answer from g left join k on g.group_id = k.group_id",
    "j2_without_gold": f"select group_id, count(*) as n_completions from {G} where group_id % 5 = 0 group by group_id",
    "a1_total": f"select step, group_id, sample_id, {r6('reward')} as reward from {TOTALS}",
    "a2_all_null": f"select step, group_id, sample_id, count(*) as n_funcs from {LONG} group by step, group_id, sample_id having count(reward) = 0",
    "a3_func_mean": f"select step, func, {r9('avg(reward)')} as mean_reward, count(reward) as n_scored from {LONG} group by step, func",
    "a4_std": f"select step, {r9('reward_mean')} as reward_mean, {r9('reward_std')} as reward_std, n_samples from {REWARD_STATS}",
    "a5_zero_std": f"select step, {r9('zero_std_ratio')} as zero_std_ratio from {REWARD_STATS}",
    "a7_adv_stats": f"select step, {r9('avg(a)')} as advantage_mean, {r9('coalesce(stddev_samp(a), 0)')} as advantage_std "
    f"from (select step, {RLOO} as a from {GROUPED}) group by step",
    "w1_rloo": advantage(RLOO),
    "w2_grpo": advantage("reward - gs / gn"),
    "w3_none": advantage("reward"),
    "w4_group_std": f"select step, group_id, sample_id, {r6('reward')} as reward, {r6('sd')} as group_std from {GROUPED}",
    "a10_accuracy": accuracy(GSM_SCORED),
    "a10_accuracy_math": accuracy(MATH_SCORED),
    "a10_document_items": "select doc_id, number, coalesce(number = gold_num, false) as is_number_correct, prediction as extracted_answer, "
    f"is_correct from {DOCUMENT_SCORED}",
    "a10_documents": accuracy(DOCUMENT_SCORED),
    "a10_items": f"select run, idx, extracted_answer, is_correct from {GSM_SCORED}",
    "a22_validate": f"select * from {VALIDATE}",
    "a23_summary": "select run, count(*) as n_files, cast(sum(total_processed) as bigint) as n_rows, "
    f"{r6('max(wall_time_seconds)')} as wall_time_seconds, {r6('sum(total_processed) / max(wall_time_seconds)')} as rows_per_second "
    f"from {RANKS} group by run",
    "j8_missing_ranks": f"with r as (select run, rank, world_size from {RANKS}) "
    "select distinct run, unnest(range(world_size)) as rank from r except select run, rank from r",
    "u2_duplicates": f"select run, example_index, count(*) as n from {RUN_ROWS} group by run, example_index having count(*) > 1",
    "s5_log": f"select g.step, 'q' || cast(g.group_id as varchar) as prompt, completion, {r6('t.reward')} as reward "
    f"from {G} g join {TOTALS} t on g.step = t.step and g.group_id = t.group_id and g.sample_id = t.sample_id where g.step % 3 = 0",
    "s6_metrics": f"select step, 'reward/' || name as name, {r9('value')} as value from (unpivot (select step, reward_mean, reward_std, "
    f"zero_std_ratio, cast(n_samples as double) as n_samples from {REWARD_STATS}) on reward_mean, reward_std, zero_std_ratio, n_samples "
    "into name name value value)",
    "s1_quarantine": "select doc_id as example_index, case when doc_id % 6 = 0 then 'malformed line' when doc_id % 6 = 4 or text is null then 'no question' "
    "when doc_id % 6 = 3 then 'no gold' when doc_id % 6 in (1, 2) then 'no readable box' else '' end as reason, "
    "case when doc_id % 6 not in (0, 4) then cast(length(text) as bigint) end as n_chars from documents",
    "p13_shard": f"select example_index, example_index % 7 as rank, (example_index // 7) // 4 as batch from {G}",
    "p13_one_shard": f"select example_index from {G} where example_index % 8 = 3",
    "p14_shuffle": f"select example_index, row_number() over (order by md5('{SEED}|' || cast(example_index as varchar)), example_index) - 1 as position from {G}",
    "p15_batches": f"select example_index // 6 as batch, count(*) as n, min(example_index) as first, max(example_index) as last from {G} group by example_index // 6",
    "p1_prompt": f"select example_index, 'user' as role, {quote(prompts.TRAIN_SYSTEM)} || chr(10) || chr(10) || question as content, "
    f"{strip('string_split(answer, ' + quote('####') + ')[2]')} as answer from {Q}",
    "p2_prompt": f"select example_index, 'user' as role, {quote(prompts.TRAIN_SYSTEM)} || chr(10) || chr(10) || {quote(prompts.TRAIN_MATH_EXTRA)} "
    f"|| chr(10) || chr(10) || question as content, answer from {Q}",
    "p3_prompt": eval_prompt(prompts.EVAL_GSM, HASH_NUMBER.format("answer"), prompts.REASONING_START),
    "p3_prompt_math": eval_prompt(prompts.EVAL_MATH, "answer", ""),
    "p4_template": f"select example_index, {_USER} || case when example_index % 3 = 0 then {_ASSISTANT} else '' end || {_HEADER} as rendered from {Q}",
    "p8_bootstrap": "select example_index, cast(1 as bigint) as n_messages, case when example_index % 3 = 0 then answer else '' end "
    f"|| ' done ' || cast(example_index as varchar) as completion from {Q}",
    "s1_dense_index": "select key, doc_id, row_number() over (order by key, doc_id) - 1 as example_index "
    "from (select doc_id * 7919 % 100003 as key, doc_id from documents)",
    "p5_truncate": f"select seq_id, array_to_string(ids[greatest(len(ids) - 199, 1):], ',') as ids from {IDS}",
    "p6_pad": f"with p as (select *, max(len(ids)) over (partition by batch_id) as w from {IDS}) "
    "select seq_id, w as width, md5(array_to_string(list_concat(list_transform(range(w - len(ids)), lambda i: 0), ids), ',')) as ids_md5, "
    "md5(array_to_string(list_concat(list_transform(range(w - len(ids)), lambda i: 0), list_transform(ids, lambda i: 1)), ',')) as mask_md5 from p",
    "p7_split": f"select seq_id, array_to_string(ids[1:{fx.PROMPT_WORDS}], ',') as prompt, "
    f"md5(array_to_string(ids[{fx.PROMPT_WORDS + 1}:], ',')) as completion_md5 from {IDS}",
    "p9_eos": f"select seq_id, pos, is_valid from {VALID}",
    "p10_state": f"select seq_id, pos, case when unmask_step > 6 or unmask_step = -1 then {fx.MASK_ID} else token_id end as input_id from {T}",
    "p11_prompt_mask": f"select seq_id, pos, case when pos >= {fx.PROMPT_WORDS} or {uniform(str(SEED), 'seq_id', 'pos')} < 0.3::double "
    f"then {fx.MASK_ID} else token_id end as input_id, case when pos < {fx.PROMPT_WORDS} then 0.3::double else 1.0::double end as p_mask from {T}",
    "p12_seeds": "select run, step, iter, cast('0x' || substr(md5("
    f"'{SEED}|' || cast(run as varchar) || '|' || cast(step as varchar) || '|' || cast(iter as varchar)), 1, 8) as bigint) % 4096 as mask_seed, "
    f"cast(42 as bigint) as constant_seed from (select distinct run, step from {STEPS}), (select unnest(range({fx.ITERATIONS})) as iter)",
    "a6_length": f"select batch_id, {r6('avg(n)')} as completion_length from (select batch_id, seq_id, count(*) filter (where is_valid) as n "
    f"from {VALID} group by batch_id, seq_id) group by batch_id",
    "t1_segment": f"select seq_id, pos, coalesce(segment, -1) as segment from {SEGMENTED}",
    "t2_active": f"select distinct seq_id, segment from {SEGMENTED} where segment is not null",
    "t3_inputs": INPUTS,
    "t3_packed": INPUTS,
    "k4_sample": f"select batch_id, iter, segment from {SAMPLES}",
    "t5_sample_mask": "select seq_id, iter, count(*) filter (where is_sampled) as n_sampled, "
    f"cast(coalesce(sum(case when is_sampled then pos end), 0) as bigint) as checksum from {MASKED} group by seq_id, iter",
    "a8_coverage": f"select batch_id, iter, {r6('count(*) filter (where is_valid and is_sampled) / count(*) filter (where is_valid)')} as token_coverage, "
    f"{r6('avg(case when is_sampled then 1 else 0 end)')} as sampled_tokens_ratio from {MASKED} group by batch_id, iter",
    "t6_schedule": AUDIT,
    "t7_schedule": SCHEDULE,
    "j7_asof": "select e.event_id, e.user_id, coalesce(c.event_id, -1) as click_id, coalesce(c.value, 0) as value from "
    "(select * from events where event_type = 'error') e asof left join (select * from events where event_type = 'click') c "
    "on e.user_id = c.user_id and e.ts >= c.ts",
    "j5_ranges": "with i as (select p_partkey, case when p_partkey % 1000 <> 7 then p_partkey end as low, case when p_partkey % 1000 <> 3 "
    "then p_partkey + case when p_partkey % 50 = 0 then p_size * 40 else p_size - 2 end end as high from part) "
    "select p_partkey, count(*) as n_orders, min(o_custkey) as first, max(o_custkey) as last, cast(sum(o_orderkey) as bigint) as keys "
    "from i join orders on (low is null or o_custkey > low) and (high is null or o_custkey <= high) group by p_partkey",
    "u2_gaps": GAPS,
    "s2_ranges": "select shard_rank as rank, example_index, md5(completion) as question_md5, md5(completion) as md5, gold as ground_truth, "
    f"'}}' as prompt_input, cast(8 as bigint) as world_size, '{{\"generations\":[{{\"x\":\"]}}\"}}]}}' as config from {G}",
    "l3_block_segment": block_sums(SEGMENT_END),
    "l3_block_position": block_sums("unmask_step"),
    "l6_scan": scan_sums(SCAN_STEPS, 0.25),
    "l4_closed_segment": f"select seq_id, segment, pos, {r6('softmax')} as pos_logp from {position_pairs(SEGMENT_END, 0.5, CLOSED)}",
    "l4_closed_position": f"select seq_id, segment, pos, {r6('softmax')} as pos_logp from {position_pairs('unmask_step', 0.5, CLOSED)}",
    "l3_closed_segment": f"select seq_id, segment, pos, {r6('bt')} as pos_logp from {position_pairs(SEGMENT_END, 0.5, CLOSED)}",
    "l3_closed_position": f"select seq_id, segment, pos, {r6('bt')} as pos_logp from {position_pairs('unmask_step', 0.5, CLOSED)}",
    "w5_quota": "select doc_id as seq_id, step, n // 12 + case when step < n % 12 then 1 else 0 end as quota "
    "from (select doc_id, len(string_split(text, ' ')) as n from documents), (select unnest(range(12)) as step)",
    "k1_select": SELECTED,
    "k1_audit": SELECTION_AUDIT,
    "k1_trace": f"select seq_id, step, cast(-1 as bigint) as pos, problem from ({AUDIT}) union all "
    f"select seq_id, step, pos, problem from ({selection_audit(TRACE_STATE, TRACE)})",
    "j3_unmatched": "select batch_id, count(*) as n_tokens, count(*) filter (where (pos + seq_id) % 23 = 0) as no_old_logp, "
    f"count(*) filter (where seq_id % 7 = 0) as no_advantage from {LOGPS} group by batch_id",
    "j3_logps": f"select batch_id, seq_id, pos, new_logp, old_logp, ref_logp, advantage from {LOGPS}",
    "a11_reinforce": token_loss("reinforce", True),
    "a12_grpo": token_loss("grpo", True),
    "a13_dapo": token_loss("dapo", True),
    "a13_tokens": f"select seq_id, pos, {r6('ratio')} as ratio, lo or hi as is_clipped, m = 1 as is_counted, "
    f"{r6('-least(ratio * advantage * m, cr * advantage * m)')} as token_loss from {token_terms(True, LOW, HIGH)}",
    "a14_gspo": gspo(False),
    "a15_gspo_partial": gspo(True),
    "a16_gspo_token": GSPO_TOKEN,
    "a17_token_avg": token_loss("dapo", False),
    "a18_seq_avg": token_loss("dapo", True, "sequence"),
    "a19_clip_mask": CLIP_HANDOVER,
    "a20_kl": f"select batch_id, {r6('kl')} as kl from {KL}",
    "a21_total": TOTAL,
    "s6_update_metrics": UPDATE_METRICS,
    "r8_token_logp": f"select vec_id, {r6('tgt - lse')} as logp from {REDUCED}",
    "r9_confidence": f"select vec_id, {r6('top')} as max_logit, {r6('exp(top - lse)')} as top_prob, {r6('neg_entropy')} as neg_entropy, "
    f"{r6('exp(top - lse) - exp(second - lse)')} as margin from {REDUCED}",
    "r10_cfg": f"select vec_id, tok as token, {r6('x * 0.5 + 2.5 * (x - x * 0.5)')} as value from {CELLS}",
    "r8_chunks": f"select vec_id, {r6('tgt - lse')} as logp, {r6('top')} as max_logit, {r6('exp(top - lse)')} as top_prob, "
    f"{r6('neg_entropy')} as neg_entropy, {r6('exp(top - lse) - exp(second - lse)')} as margin, best as token from {REDUCED}",
    "r10_chunks": f"select vec_id, case when vec_id % 9 <> 0 then {r6('tgt - lse')} end as logp, case when vec_id % 9 <> 0 then {r6('top')} end as max_logit "
    f"from {reduced(f'(select * replace (x * 0.5 + 2.5 * (x - x * 0.5) as x) from {CELLS})', VKEYS)}",
    "r11_gumbel": f"select vec_id, arg_max(tok, s) as token, {r6('max(s)')} as score from (select vec_id, tok, exp(x) / pow(-ln({CELL_U}), 0.9::double) as s from {CELLS}) group by vec_id",
    "r10_lost": f"select vec_id, {r6('case when vec_id % 3 <> 0 then max(x * 0.5 + 2.5 * (x - x * 0.5)) end')} as top from {CELLS} group by vec_id",
    "r12_infinite": f"select vec_id, vec_id % 7 = 0 as is_closed, case when vec_id % 7 <> 0 then {r6(f'exp(top - lse) + ({GUMBEL}) * 0.5')} end as noisy "
    f"from {REDUCED}",
    "r12_noise": f"select vec_id, {r6(f'ln(exp(top - lse) + 1e-8) + ({GUMBEL}) * 0.5')} as decoupled, "
    f"{r6(f'exp(top - lse) + ({GUMBEL}) * 0.5')} as stochastic from {REDUCED}",
    "k2_argmax": f"select vec_id, best as token from {REDUCED}",
    "k3_remask": f"with c as (select vec_id, arg_max(tok, exp(x) / pow(-ln({CELL_U}), 0.9::double)) as chosen from {CELLS} group by vec_id), "
    f"p as (select c.vec_id, chosen, any_value(x) as px from c join {CELLS} l on l.vec_id = c.vec_id and tok = chosen group by all) "
    f"select r.vec_id, chosen, {r6('exp(px - lse)')} as low_confidence, {r6('exp(top - lse)')} as decoupled, {r6(uniform(str(SEED), 'r.vec_id'))} as random "
    f"from {REDUCED} r join p on p.vec_id = r.vec_id",
    "t4_seg_logps": f"select seq_id, segment, pos, {r6('tgt - lse')} as logp from {OWN}",
    "a9_merge": f"select v.seq_id, v.pos, v.unmask_step, {r6('coalesce(m.a, 0)')} as logp from {V} v "
    f"left join (select seq_id, pos, avg(tgt - lse) as a from {OWN} group by seq_id, pos) m on v.seq_id = m.seq_id and v.pos = m.pos",
    "a9_lost": f"select v.seq_id, v.pos, v.unmask_step, case when v.unmask_step between 1 and {WIDTH * fx.SEGMENTS} then {r6('m.a')} else 0 end as logp "
    f"from {V} v left join (select seq_id, pos, avg(tgt - lse) as a from {OWN} where vec_id % 5 <> 0 group by seq_id, pos) m "
    "on v.seq_id = m.seq_id and v.pos = m.pos",
    "t4_plain": f"select seq_id, pos, unmask_step, iter, {r6('tgt - lse')} as logp from "
    + reduced(f"(select c.* exclude (x), i.iter, x * (1 + i.iter / 8) as x from {CELLS} c, (select unnest(range({fx.ITERATIONS})) as iter) i)", VKEYS + ", iter"),
    "t4_sampled": f"select v.seq_id, v.pos, v.unmask_step, case when v.unmask_step between 1 and {WIDTH * fx.SEGMENTS} then {r6('m.a')} else 0 end as logp "
    f"from {V} v left join (select seq_id, pos, avg(tgt - lse) as a from {OWN} where (seq_id // 5 + segment) % 2 = 0 group by seq_id, pos) m "
    "on v.seq_id = m.seq_id and v.pos = m.pos",
    "t4_targets": f"select seq_id, pos, segment, {r6('tgt - lse')} as logp from {OWN} where vec_id % 4 <> 0",
    "l1_self": f"select vec_id, segment, {r6('tgt')} as gt_logit, {r6('exp(tgt - lse)')} as gt_prob, "
    f"{r6('exp(top - lse) - exp(second - lse)')} as max_margin from {SEGMENT_REDUCED}",
    "l3_bt": f"select seq_id, segment, pos, {r6('bt')} as pos_logp from {position_pairs('unmask_step')}",
    "l3_bt_segment": f"select seq_id, segment, pos, {r6('bt')} as pos_logp from {position_pairs(SEGMENT_END)}",
    **{
        name: f"select seq_id, segment, pos, {r6(column)} as pos_logp from {position_pairs(threshold, 0.5, LATE_REDUCED, LATE_WIDTH)}"
        for name, column, threshold in (
            ("l3_late", "bt", "unmask_step"), ("l3_late_segment", "bt", f"(segment + 1) * {LATE_WIDTH}"),
            ("l4_late", "softmax", "unmask_step"), ("l4_late_segment", "softmax", f"(segment + 1) * {LATE_WIDTH}"),
        )
    },
    "l4_softmax": f"select seq_id, segment, pos, {r6('softmax')} as pos_logp from {position_pairs(SEGMENT_END)}",
    "l5_segment": f"select seq_id, segment, count(*) as n_targets, {r6('ln(any_value(z))')} as others "
    f"from {long_position(SEGMENT_END)} where here group by seq_id, segment",
    "l6_position": f"select seq_id, segment, pos, {r6('softmax')} as pos_logp from {position_pairs('unmask_step')}",
    "l8_block_segment": long_position_sums(SEGMENT_END),
    "l8_block_position": long_position_sums("unmask_step"),
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
