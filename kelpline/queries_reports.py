"""Queries whose rows are a report's lines, with their places."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import queries_more  # noqa: F401  its SQL is used here
from .common import row_numbers, shared_dir, table
from .plans import experiment_report as R
from .plans.report import KEYS
from .queries import _HALVES, _NEGATIVE, _REDUNDANT, SQL, TRIALS, _trials, query
from .sources import star
from .streaming import results


def _placed(report):
    return row_numbers(report, [], list(KEYS), "place").select("place", "line")


def _up(x, digits=2):
    """So many decimals, halves of the binary value up, in SQL."""
    whole = f"round(printf('%.25f', ({x})::double)::decimal(38, 25), {digits})"
    return f"({whole}::decimal(18, {digits})::varchar)" if digits else f"({whole}::bigint::varchar)"


def _signed(x, plus="+"):
    return f"(case when {x} < 0 then '-' else '{plus}' end || {_up(f'abs({x})')})"


def _rpad(x, n):
    return f"({x} || repeat(' ', greatest(0, {n} - length({x}))))"


def _said(rows, section, line, k1="'-inf'", k2="0", k3="''", sub="0"):
    return f"select {section} as section, ({k1})::double as k1, ({k2})::double as k2, ({k3})::varchar as k3, {sub} as sub, {line} as line from {rows}"


def _texts(section, *texts, k1="'-inf'", rows="(select 1)"):
    return "\nunion all ".join(_said(rows, section, "'" + t.replace("'", "''") + "'", k1, sub=str(i)) for i, t in enumerate(texts))


def _report(parts):
    return "(" + "\nunion all ".join(parts) + ")"


_NUMBERED = "select row_number() over (order by section, k1, k2, k3, sub) as place, line from {0}"
_ARMS = "arms2 as (select condition, arg_min(condition_name, trial) as name, min(trial) as ord from trials group by 1)"
_PLAIN = "case when {0} = floor({0}) then {0}::bigint::varchar else {0}::varchar end"
_MARKS = "case kind when 'non-discriminating' then '!' when 'flaky' then '~' when 'redundant' then '#' else 'v' end"
_STATS = [
    _texts(1, R.STATS, ""),
    _said("st", 1, f"'  ' || {_rpad('name', 24)} || ' ' || {_up('mean')} || ' +/- ' || {_up('deviation')} || '  (min ' || {_up('least')} || ', max ' || {_up('most')} || ')'", "-mean", "ord"),
    _texts(1, "", k1="'inf'"),
    _said("pr", 2, f"'  Cliff''s Delta (' || a || ' vs ' || b || '):  ' || {_signed('delta')} || ' [' || magnitude || ']  CI: [' || {_PLAIN.format('lo')} || ', ' || {_PLAIN.format('hi')} || ']'", "a_ord", "b_ord"),
    _said("pr", 2, "'  Win rate: ' || a || ' wins ' || wins || '/' || total || ', ties ' || ties || ', loses ' || losses", "a_ord", "b_ord", sub="1"),
    _texts(2, "", k1="'inf'"),
    _said("st", 3, f"'    ' || {_rpad('name', 20)} || ' PASS ' || {_up('passed * 100', 0)} || '% | PARTIAL ' || {_up('partial * 100', 0)} || '% | FAIL ' || {_up('failed * 100', 0)} || '%'", "-mean", "ord"),
    _texts(3, "", k1="'inf'"),
    _texts(4, R.DIAGNOSTICS, ""),
    _said("kinds", 4, "'  ' || replace(upper(kind), 'NEGATIVE-SIGNAL', 'NEGATIVE SIGNAL') || ':'", "k", "'-inf'"),
    _said("dk", 4, f"'  ' || {_MARKS} || ' ' || question || ': \"' || assertion || '\"'", "k", "rord", "spot", "1"),
    _said("dk", 4, "'    ' || detail", "k", "rord", "spot", "2"),
    _said("kinds", 4, "''", "k", "'inf'"),
    _texts(5, "  BUDGET SUMMARY:", k1="0"),
    _said("bu", 5, f"'    Wasted on non-discriminating: ~$' || {_up('wasted_on_non_discriminating')}", "0", sub="1"),
    _said("bu", 5, f"'    Recoverable from redundant:   ~$' || {_up('recoverable_from_redundant')}", "0", sub="2"),
    _said("bu", 5, "'    Total savings available:       ~' || savings_percent || '%'", "0", sub="3"),
    _texts(5, "", k1="'inf'"),
    _texts(6, R.TOOLS, "", rows="(select 1 where (select count(*) from tl) > 0)"),
    _said("tl", 6, f"'  ' || {_rpad('name', 28)} || ' avg calls: ' || {_up('mean', 1)} || '  self-sufficient: ' || {_up('none * 100', 0)} || '%  (' || n || ' trials)'", "first"),
    _texts(6, "", k1="'inf'", rows="(select 1 where (select count(*) from tl) > 0)"),
]


@query(f"""with {_REDUNDANT}, {_NEGATIVE}, {_ARMS},
st as (select s.*, name, ord from ({SQL["condition_stats"]}) s join arms2 using (condition)),
pr as (select c.*, lo, hi, wins, losses, ties, total, x.ord as a_ord, y.ord as b_ord from ({SQL["cliffs_delta"]}) c join ({SQL["bootstrap_ci"]}) i using (a, b) join ({SQL["win_rate"]}) w using (a, b) join arms2 x on x.condition = a join arms2 y on y.condition = b),
bu as ({SQL["budget"]}),
tl as (select condition, any_value(name) as name, avg(tools) as mean, avg((tools = 0)::int) as none, count(*) as n, min(trial) as first from trials join arms2 using (condition) where tools is not null group by 1),
res as (select codebase, question, min(trial) as rord from trials group by 1, 2),
found as (
  select codebase, question, kind, assertion, detail, place as f, 0 as s, case kind when 'flaky' then 1 else 0 end as ki, 0 as ph
  from ({SQL["diagnostics_union"]}) d join (select codebase, question, assertion::varchar as assertion, place from seq) q using (codebase, question, assertion) where kind in ('non-discriminating', 'flaky')
  union all
  select d.codebase, d.question, kind, d.assertion, detail, y.place, x.place, 2, 1
  from ({SQL["diagnostics_union"]}) d join redundant r on r.codebase = d.codebase and r.question = d.question and r.assertion::varchar = d.assertion
  join seq x on x.codebase = r.codebase and x.question = r.question and x.assertion = r.assertion join seq y on y.codebase = r.codebase and y.question = r.question and y.assertion = r.like_ where kind = 'redundant'
  union all
  select d.codebase, d.question, kind, assertion, detail, 1 - better_score, 1 - worse_score, 3, 2
  from ({SQL["diagnostics_union"]}) d join negative n on n.codebase = d.codebase and n.question = d.question and n.worse || ' vs ' || n.better = d.assertion where kind = 'negative-signal'),
ordered as (select *, printf('%020.9f', f::double) || ' ' || printf('%020.9f', s::double) || ' ' || assertion as spot from found join res using (codebase, question)),
kinds as (select kind, row_number() over (order by min((rord, ph, f, ki))) as k from ordered group by 1),
dk as (select * from ordered join kinds using (kind))
{_NUMBERED.format(_report(_STATS))}""")
def stats_report(spark, sf_dir):
    return _placed(R.stats_report(_trials(spark, sf_dir)))


_COMPARED = [
    _texts(1, "=== ITERATION COMPARISON: early -> late ===", ""),
    _said("arm", 1, f"'  ' || {_rpad('name', 24)} || ' ' || {_up('b')} || ' -> ' || {_up('a')} || '  (' || {_signed('d')} || ')  Cliff''s d=' || {_signed('delta', '')}", "ord"),
    _texts(1, "", k1="'inf'"),
]
for _i, (_title, _test) in enumerate((("  IMPROVEMENTS:", "after - before > 0.1"), ("  REGRESSIONS:", "after - before < -0.1"))):
    _any = f"(select 1 where exists (select 1 from b2 where {_test}))"
    _COMPARED += [
        _texts(2 + _i, _title, rows=_any),
        _said(f"b2 where {_test}", 2 + _i, f"'    ' || question || ' [' || condition || ']: ' || {_up('before')} || ' -> ' || {_up('after')}", "c", "q"),
        _texts(2 + _i, "", k1="'inf'", rows=_any),
    ]
_COMPARED.append(_said("co", 4, f"'  Cost: $' || {_up('cost_before')} || ' -> $' || {_up('cost_after')} || ' (' || case when cost_after >= cost_before then '+' else '' end || '$' || {_signed('(cost_after - cost_before)', '')} || ')'", "0"))


@query(f"""with {TRIALS},
{_HALVES},
early as (select * from trials where ts < timestamp '2024-01-16'),
names as (select condition, arg_min(condition_name, trial) as name, min(trial) as ord from early group by 1),
asked as (select condition, question, min(trial) as q from early group by 1, 2),
b2 as (select h.*, n.ord as c, n.name, q from h join names n using (condition) join asked using (condition, question) where before is not null and after is not null),
d as (select condition, avg(sign(x.after - y.before)) as delta from b2 x join b2 y using (condition) group by 1),
arm as (select condition, any_value(name) as name, any_value(c) as ord, floor(avg(before) * 100 + 0.5) / 100 as b, floor(avg(after) * 100 + 0.5) / 100 as a, floor((avg(after) - avg(before)) * 100 + 0.5) / 100 as d, any_value(delta) as delta from b2 join d using (condition) group by 1),
co as ({SQL["compare_costs"]})
{_NUMBERED.format(_report(_COMPARED))}""")
def comparison_report(spark, sf_dir):
    t, cut = _trials(spark, sf_dir), F.to_timestamp(F.lit("2024-01-16"))
    return _placed(R.comparison_report(t.where(F.col("ts") < cut), t.where(F.col("ts") >= cut), ("early", "late")))


_MARKDOWN = [
    _texts(1, "## Results: star", "", "*one, two — 2024-01-01*", "", "### Overall Scores by Condition", "", "| Condition | Avg Score | Avg Tokens (in) | Avg Latency |", "|-----------|-----------|------------------|-------------|"),
    _said("st", 1, f"'| ' || name || ' | ' || {_up('score')} || ' | ' || format('{{:,}}', floor(i + 0.5)::bigint) || ' | ' || {_up('ms / 1000', 1)} || 's |'", "ord"),
    _texts(1, "", k1="'inf'"),
    _texts(2, "### Scores by Task Type", ""),
    _said("(select string_agg(name, ' | ' order by ord) as n from arms2)", 2, "'| Task Type | ' || n || ' |'", sub="2"),
    _said("(select string_agg('-----------', '|') as n from arms2)", 2, "'|-----------|' || n || '|'", sub="3"),
    _said("(select task_type, string_agg(cell, ' | ' order by ord) as cells from typed group by 1)", 2, "'| ' || task_type || ' | ' || cells || ' |'", "0", k3="task_type"),
    _texts(2, "", k1="'inf'"),
    _texts(3, "### Per-Question Detail", ""),
    _said("res", 3, "'<details><summary><strong>' || question || '</strong> (task' || question % 5 || ') — ' || question || '</summary>'", "r", "'-inf'"),
    _said("res", 3, "''", "r", "'-inf'", sub="1"),
    _said("arm", 3, f"'**' || name || '**: avg ' || {_up('score')} || ' (trials: ' || every || ')'", "r", "t"),
    _said("first", 3, "'  ' || case verdict when 'PASS' then '+' when 'PARTIAL' then '~' else '-' end || ' ' || verdict || ': ' || assertion", "r", "trial", "'a' || assertion", "1"),
    _said("arm", 3, "''", "r", "t", "'b'", "2"),
    _said("res", 3, "'</details>'", "r", "'inf'"),
    _said("res", 3, "''", "r", "'inf'", sub="1"),
    _texts(4, "### Cost Summary", ""),
    _said("su", 4, "'- **API calls**: ' || calls", "0"),
    _said("su", 4, "'- **Tokens**: ' || format('{:,}', tokens_in) || ' in / ' || format('{:,}', tokens_out) || ' out'", "0", sub="1"),
    _said("su", 4, f"'- **Estimated cost**: $' || {_up('cost')}", "0", sub="2"),
    _said("su", 4, "'- **Duration**: 2s'", "0", sub="3"),
    _texts(4, "", k1="'inf'"),
]


@query(f"""with {TRIALS}, {_ARMS},
st as (select condition, any_value(name) as name, any_value(a.ord) as ord, any_value(i) as i, any_value(ms) as ms, avg(score) as score from scores join arms2 a using (condition) join (select condition, avg(tokens_in) as i, avg(latency) as ms from trials group by 1) using (condition) group by 1),
kinds as (select distinct 'task' || question % 5 as task_type from trials),
typed as (
  select k.task_type, a.ord, coalesce({_up("m")}, '—') as cell from kinds k join arms2 a on true
  left join (select 'task' || question % 5 as task_type, condition, avg(score) as m from scores group by 1, 2) m on m.task_type = k.task_type and m.condition = a.condition),
res as (select codebase, question, min(trial) as r from trials group by 1, 2),
arm as (
  select t.codebase, t.question, t.condition, any_value(name) as name, any_value(r) as r, min(trial) as t, any_value(score) as score, string_agg({_up("s")}, ', ' order by trial) as every
  from trials t join res using (codebase, question) join arms2 using (condition) join (select codebase, question, condition, score from scores) using (codebase, question, condition) group by 1, 2, 3),
first as (select trials.*, r from trials join arm a on a.codebase = trials.codebase and a.question = trials.question and a.condition = trials.condition and a.t = trials.trial),
su as ({SQL["run_summary"]})
{_NUMBERED.format(_report(_MARKDOWN))}""")
def markdown_report(spark, sf_dir):
    t = _trials(spark, sf_dir).withColumn("task_type", F.concat(F.lit("task"), (F.col("question") % 5).cast("string")))
    return _placed(R.markdown_report(t, "star", "one, two", "2024-01-01", 1500))


_JUDGED = [
    _texts(1, R.JUDGE, ""),
    _said("k", 1, "'  Sample size: ' || n || ' pairs x ' || times || ' repetitions'", "0"),
    _said("k", 1, f"'  Consistency: ' || {_up('c * 100', 0)} || '%'", "0", sub="1"),
    _said("s", 1, f"'  Verdict distribution: PASS ' || {_up('p * 100', 0)} || '% | PARTIAL ' || {_up('h * 100', 0)} || '% | FAIL ' || {_up('f * 100', 0)} || '%'", "0", sub="2"),
    _texts(2, "", "  INCONSISTENT PAIRS:"),
    _said("per where not same", 2, "'    ' || question || ': \"' || assertion || '\" -> [' || array_to_string(v, ', ') || ']'", "ord"),
    _texts(3, ""),
]


@query(f"""with {TRIALS},
per as (select question, assertion, min(trial) as ord, list(verdict order by trial) as v, count(distinct verdict) = 1 as same from trials group by 1, 2),
k as (select count(*) as n, avg(same::int) as c, max(len(v)) as times from per),
s as (select avg((verdict = 'PASS')::int) as p, avg((verdict = 'PARTIAL')::int) as h, avg((verdict = 'FAIL')::int) as f from trials)
{_NUMBERED.format(_report(_JUDGED))}""")
def judge_report(spark, sf_dir):
    """All verdicts on a question's assertion as a judge's repetitions."""
    t = _trials(spark, sf_dir)
    first = t.groupBy("question", "assertion").agg(F.min("trial").alias("ord"))
    return _placed(R.judge_report(t.select("question", "assertion", F.col("trial").alias("repetition"), "verdict").join(first, ["question", "assertion"])))


@query(f"""with {TRIALS},
per as (select question, codebase, condition, count(*) as n, count(distinct verdict) as kinds from trials group by 1, 2, 3),
wanted as (select question, codebase, condition from (select distinct question from trials) q, (select distinct codebase from trials) c, (select distinct condition from trials) k)
select question, codebase, condition, coalesce(n, 0) + 1 as first from wanted left join per using (question, codebase, condition) where coalesce(n, 0) < 8 and not (coalesce(n, 0) >= 3 and kinds = 1)""")
def resume_after_replay(spark, sf_dir):
    """What is left of eight trials each, after a stream of results whose batches were all run twice; some are unanimous before that."""
    folder = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    stream = star.trials_of(spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]"))  # a glob, as streams take no single file
    results.record(stream, f"{folder}/a", f"{folder}/offsets-a")
    results.record(stream, f"{folder}/a", f"{folder}/offsets-b")
    got = results.recorded(spark, f"{folder}/a", stream.schema)
    done = results.finished(got, 8)
    # Whatever was asked of one is asked of all; dimensions are lists of a configuration.
    each = got.agg(*[F.collect_set(c).alias(c) for c in ("codebase", "condition")])
    wanted = got.select("question").distinct().crossJoin(F.broadcast(each)).select("question", F.explode("codebase").alias("codebase"), "condition").select("question", "codebase", F.explode("condition").alias("condition"))
    return results.left_over(wanted, done, 8)
