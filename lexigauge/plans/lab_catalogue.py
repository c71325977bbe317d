"""Registered queries of the lab: effects of arms, positions and texts, costs, designs, and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigauge.operators import lab
from lexigauge.operators import metrics as me
from lexigauge.operators import panel as pa
from lexigauge.operators import resampling as rs
from lexigauge.plans import design as de
from lexigauge.plans.registry import query
from lexigauge.sources import corpus as c
from lexigauge.sources.corpus import oracle

CALLS = """calls as (select l_orderkey * 10 + l_linenumber as call_id, category, model_id, query_id, case l_returnflag when 'A' then 'incumbent' when 'N' then 'small' else 'fictional' end as identity,
  case when l_linestatus = 'O' then 'control' else concat('text', l_linenumber % 3) end as variant, cast(l_linenumber % 5 + 1 as integer) as position, case when l_discount > 0.05 then 1 else 0 end as first, case when l_tax > 0.03 then 1 else 0 end as mentioned,
  case when l_quantity <= 25 then cast(l_quantity as integer) % 5 + 1 end as picked_position, cast(l_quantity as bigint) as tokens_in, cast(floor(l_extendedprice / 1000) as bigint) as tokens_out, case when l_tax < 0.01 then 'error' else 'completed' end as status,
  cast(l_partkey % 13 as integer) as sentence, cast(l_suppkey % 5 as integer) as brand from lineitem join responses on l_orderkey = record_id)"""


def _calls(s: SparkSession, d: str) -> DataFrame:
    """Line items stand in for the calls of an experiment."""
    rows = c.table(s, d, "lineitem").join(c.responses(s, d), F.col("l_orderkey") == F.col("record_id"))
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), "category", "model_id", "query_id",
        F.when(F.col("l_returnflag") == "A", "incumbent").when(F.col("l_returnflag") == "N", "small").otherwise("fictional").alias("identity"),
        F.when(F.col("l_linestatus") == "O", "control").otherwise(F.concat(F.lit("text"), (F.col("l_linenumber") % 3).cast("string"))).alias("variant"),
        (F.col("l_linenumber") % 5 + 1).cast("int").alias("position"), (F.col("l_discount") > 0.05).cast("int").alias("first"), (F.col("l_tax") > 0.03).cast("int").alias("mentioned"),
        F.when(F.col("l_quantity") <= 25, F.col("l_quantity").cast("int") % 5 + 1).alias("picked_position"), F.col("l_quantity").cast("long").alias("tokens_in"), F.floor(F.col("l_extendedprice") / 1000).alias("tokens_out"),
        F.when(F.col("l_tax") < 0.01, "error").otherwise("completed").alias("status"), (F.col("l_partkey") % 13).cast("int").alias("sentence"), (F.col("l_suppkey") % 5).cast("int").alias("brand"),
    )


def _effects(arm: str, of: str, base: str) -> str:
    return oracle(f"""select scope, arm, n, coalesce(n_base, 0) as n_base, round(first, 6) as first_rate, round(first - bf, 6) as first_effect, round(mentioned, 6) as mentioned_rate, round(mentioned - bm, 6) as mentioned_effect
      from (select scope, cast({arm} as varchar) as arm, count(*) as n, avg(first) as first, avg(mentioned) as mentioned from part group by 1, 2) left join (select scope, count(*) as n_base, avg(first) as bf, avg(mentioned) as bm from part where {base} group by 1) using (scope)""",
                  CALLS, f"part as (select *, unnest(['ALL', category]) as scope from calls where {of})")


# ---- effects --------------------------------------------------------------------------------------------------------
@query(_effects("identity", "variant = 'control'", "identity = 'fictional'"))
def identity_effects(s, d):
    return lab.identity_effects(_calls(s, d), "fictional")


@query(_effects("variant", "identity = 'fictional'", "variant = 'control'"))
def content_effects(s, d):
    return lab.content_effects(_calls(s, d), "fictional")


@query(_effects("position", "true", "position = 5"))
def position_effects(s, d):
    return lab.position_effects(_calls(s, d))


@query(oracle("""select scope, cast(position as integer) as position, n, round(coalesce(hits, 0) / cast(n as double), 6) as share from (select scope, count(*) as n from part group by 1) cross join (select range as position from range(1, 6)) left join (select scope, picked_position as position, count(*) as hits from part group by 1, 2) using (scope, position)""",
              CALLS, "part as (select *, unnest(['ALL', category]) as scope from calls where picked_position is not null)"))
def pick_share(s, d):
    return lab.pick_share(_calls(s, d))


@query(oracle("""select sentence, f.n as n_filler, r.n as n_full, round(f.w, 6) as filler_share, round(r.w, 6) as full_share, round(f.w - r.w, 6) as difference from (select sentence, count(*) as n, avg(first) as w from calls where variant <> 'control' group by 1) f join (select sentence, count(*) as n, avg(first) as w from calls where variant = 'control' group by 1) r using (sentence)""", CALLS))
def filler_contrast(s, d):
    """Wins of a sentence among fillers (texts that are not the control) and among rivals."""
    rows = _calls(s, d).withColumn("won", F.col("first"))
    return lab.filler_contrast(rows.where("variant <> 'control'"), rows.where("variant = 'control'"))


@query(oracle("select sentence, brand, count(*) as appearances, sum(first) as wins, round(avg(first), 6) as share, any_value(overall) as overall from calls join (select sentence, round(avg(first), 6) as overall from calls group by 1) using (sentence) group by 1, 2", CALLS))
def cross_shares(s, d):
    return lab.cross_shares(_calls(s, d).withColumn("won", F.col("first")))


@query(oracle("select model_id, count(*) as calls, round(avg(i), 6) as mean_in, round(avg(o), 6) as mean_out from (select model_id, call_id, max(tokens_in) as i, max(tokens_out) as o from (select * from calls union all select * from calls where identity = 'small') group by 1, 2) group by 1", CALLS))
def cost_line(s, d):
    """Calls that several arms share count once."""
    rows = _calls(s, d)
    return lab.cost_line(rows.unionByName(rows.where("identity = 'small'")))


@query(oracle("select model_id, coalesce(status, 'ALL') as status, count(*) as calls, sum(tokens_in) as tokens_in, sum(tokens_out) as tokens_out from calls group by grouping sets ((model_id, status), (model_id))", CALLS))
def completed_calls(s, d):
    return lab.completed(_calls(s, d))


# ---- designs --------------------------------------------------------------------------------------------------------
@query(oracle("select category, query_id, model_id, condition, concat_ws('_', model_id, condition, query_id, '001') as cell_id from (select category, min(query_id) as query_id from responses group by 1) cross join (select distinct model_id from responses) cross join (select distinct condition from responses)"))
def pilot_cells(s, d):
    """The first query of every category under every model and condition, once."""
    return de.pilot(c.responses(s, d))


_POSITIONS = "(run + (cast('0x' || substr(sha256(cell_id), 1, 8) as bigint) % 5)) % 5 + 1"


@query(oracle(f"select cell_id, cast(run as integer) as run, {_POSITIONS} as position from (select distinct concat_ws('_', model_id, query_id) as cell_id from responses) cross join (select range as run from range(1, 6))"))
def lab_positions(s, d):
    """Where the target's card stands in each repetition of a cell: every position once in five."""
    cells = c.responses(s, d).select(F.concat_ws("_", "model_id", "query_id").alias("cell_id")).distinct()
    return de.card_position(cells.crossJoin(F.broadcast(s.range(1, 6).select(F.col("id").cast("int").alias("run")))))


@query(oracle("""select query_id, arm, target, cast(rep as integer) as rep, case when arm = 'control' then concat_ws('|', query_id, 'control', rep) else concat_ws('|', query_id, target, arm, rep) end as job_id from
  (select distinct query_id from responses) cross join (select unnest(['Brand#1', 'Brand#2']) as target) cross join (select unnest(['control', 'top', 'low']) as arm) cross join (select range as rep from range(1, 4))"""))
def intervention_jobs(s, d):
    """Arms of every query and target; the control's answers are shared by the targets."""
    return de.jobs(c.responses(s, d).select("query_id").distinct(), ["Brand#1", "Brand#2"], ["control", "top", "low"], 3)


@query(oracle("""select category, wave, kind, sentence, other, cast(row_number() over (partition by category order by wave, kind, sentence, other) as integer) as place from (
  select category, 1 as wave, 'filler' as kind, cast(range as integer) as sentence, cast((range + 6) % 13 as integer) as other from (select distinct category from responses) cross join range(13)
  union all select category, 2, 'cross', cast(a.range as integer), cast(b.range as integer) from (select distinct category from responses) cross join range(4) a cross join range(4) b where a.range < b.range)"""))
def second_round_plan(s, d):
    """Filler and cross jobs of the second round, in the order of their waves."""
    return de.second_round(c.responses(s, d).select("category").distinct(), 13, 4)


@query(oracle("""select record_id, cast(position as integer) as position, text from (select record_id, position, concat('Result ', position, ': ', brand, ' (', kind, ')') as text from results where position < 3
  union all select record_id, 3, concat('Comparison of ', string_agg(brand, ', ' order by position), '.') from results where position < 3 group by 1)"""))
def comparison_pages(s, d):
    """The first two results of an answer, and a page that compares their brands, put behind them."""
    return de.comparison_page(c.results(s, d), 3)


# ---- intervals ------------------------------------------------------------------------------------------------------
KEPT = "kept as (select * from scored where condition = 'search_on' and confidence <> 'low' and response_decided = 1)"


def _kept(s: SparkSession, d: str) -> DataFrame:
    return c.scored(pa.panel_filter(c.pairs(s, d)))


def draws_sql(rows: str, by: str, block: str, draws: int, seed: int = 42, tag: str = "") -> str:
    """CTEs of ``weights``: how often a draw picks a block of ``rows``."""
    return f"""numbered{tag} as (select *, row_number() over (partition by {by} order by {block}) - 1 as k, count(*) over (partition by {by}) as n from (select distinct {by}, {block} from {rows})),
 times{tag} as (select {by}, {block}, draw, count(*) as times from (select {by}, draw, cast('0x' || substr(md5(concat_ws('|', '{seed}', cast(draw as varchar), cast(k as varchar))), 1, 8) as bigint) % n as k from numbered{tag} cross join (select range as draw from range({draws}))) join numbered{tag} using ({by}, k) group by {by}, {block}, draw)"""


def ends_sql(values: str, by: str) -> str:
    return f"select {by}, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high from {values} group by {by}"


def ap_sql(tag: str, score: str) -> str:
    """CTE ap<tag>: average precision of every draw."""
    return f"""ap{tag} as (select category, draw, case when max(p) > 0 and max(p) < max(seen) then round(sum(h * tp / cast(seen as double)) / max(p), 9) end as v from (select category, draw, h, sum(h) over w as tp, sum(n) over w as seen, sum(h) over (partition by category, draw) as p
  from (select category, draw, x, sum(h * times) as h, sum(n * times) as n from (select category, query_id, {score} as x, sum(y_top) as h, count(*) as n from kept group by 1, 2, 3) join times using (category, query_id) group by 1, 2, 3) window w as (partition by category, draw order by x desc)) group by 1, 2)"""


@query(oracle(ends_sql("apa", "category"), KEPT, draws_sql("kept", "category", "query_id", 400), ap_sql("a", "score")))
def average_precision_ci(s, d):
    return rs.ends(rs.average_precision_draws(_kept(s, d), "category", "query_id", 400), ["category"])


_OTHER = "case when n_results_mentioning > 0 then n_results_mentioning / 10.0e0 else 0.0e0 end"


@query(oracle("select * from (" + ends_sql("delta", "category") + ")", KEPT, draws_sql("kept", "category", "query_id", 400), ap_sql("a", "score"), ap_sql("b", f"round({_OTHER}, 6)"), "delta as (select category, draw, round(a.v - b.v, 9) as v from apa a join apb b using (category, draw))"))
def paired_precision_ci(s, d):
    """Position against volume as a score, compared in the same draws."""
    rows = _kept(s, d)
    other = rows.withColumn("score", F.round(F.when(F.col("n_results_mentioning") > 0, F.col("n_results_mentioning") / F.lit(10.0)).otherwise(F.lit(0.0)), 6))
    both = [rs.average_precision_draws(x, "category", "query_id", 400) for x in (rows, other)]
    return rs.ends(rs.paired(*both, ["category"]), ["category"])


@query(oracle(ends_sql("v", "category"), "events_ as (select category, query_id, brand, count(*) as n from answers join mentions using (record_id) where condition = 'search_on' group by 1, 2, 3)", draws_sql("events_", "category", "query_id", 2000),
              "v as (select category, draw, round(sum(n) * sum(n) / cast(sum(n * n) as double), 9) as v from (select category, draw, brand, sum(n * times) as n from events_ join times using (category, query_id) group by 1, 2, 3) group by 1, 2)"))
def concentration_ci(s, d):
    """Effective number of brands under 2000 draws of queries."""
    rows = c.answers(s, d).where("condition = 'search_on'").join(c.mentions(c.results(s, d)), "record_id")
    return rs.ends(rs.concentration_draws(rows.groupBy("category", "query_id", "brand").agg(F.count(F.lit(1)).alias("n")), ["category"], "query_id", 2000), ["category"])


_UNITS = "units as (select category, model_id, query_id as unit, avg(first) as value from calls group by 1, 2, 3)"


@query(oracle("select category, model_id, n, mean, case when n >= 2 then low end as low, case when n >= 2 then high end as high from (select category, model_id, count(*) as n, round(avg(value), 6) as mean from units group by 1, 2) left join (" + ends_sql("v", "category, model_id") + ") using (category, model_id)",
              CALLS, _UNITS, draws_sql("units", "category, model_id", "unit", 2000), "v as (select category, model_id, draw, round(sum(value * times) / sum(times), 9) as v from units join times using (category, model_id, unit) group by 1, 2, 3)"))
def mean_rate_ci(s, d):
    """Mean rate over queries with an interval from 2000 draws."""
    units = _calls(s, d).groupBy("category", "model_id", "query_id").agg(F.avg("first").alias("value"))
    return rs.mean_interval(units, ["category", "model_id"], "query_id", "value", 2000)


_TWO = "two as (select category, unit, model_id in ('1-URGENT', '2-HIGH') as arm, value from (select category, concat(query_id, model_id) as unit, model_id, avg(first) as value from calls group by 1, 2, 3)), one_ as (select * from two where arm), base_ as (select * from two where not arm)"


@query(oracle("""select category, n_arm, n_base, effect, case when n_arm >= 2 and n_base >= 2 then low end as low, case when n_arm >= 2 and n_base >= 2 then high end as high from (select category, count(*) filter (where arm) as n_arm, count(*) filter (where not arm) as n_base, round(avg(value) filter (where arm) - avg(value) filter (where not arm), 6) as effect from two group by 1) left join (""" + ends_sql("v", "category") + ") using (category)",
              CALLS, _TWO, draws_sql("one_", "category", "unit", 2000, 42, "1"), draws_sql("base_", "category", "unit", 2000, 43, "2"),
              "v as (select category, draw, round(x.v - y.v, 9) as v from (select category, draw, round(sum(value * times) / sum(times), 9) as v from one_ join times1 using (category, unit) group by 1, 2) x join (select category, draw, round(sum(value * times) / sum(times), 9) as v from base_ join times2 using (category, unit) group by 1, 2) y using (category, draw))"))
def rate_difference_ci(s, d):
    """Rate of two models' cells minus that of the others', both drawn independently."""
    units = _calls(s, d).groupBy("category", "model_id", F.concat("query_id", "model_id").alias("unit")).agg(F.avg("first").alias("value"))
    return rs.difference_interval(units, ["category"], "unit", "value", F.col("model_id").isin("1-URGENT", "2-HIGH"), 2000)


@query(oracle(ends_sql("v", "sentence"), CALLS, "sums as (select sentence, query_id, sum(first) as a, count(*) as b from calls group by 1, 2)", draws_sql("sums", "sentence", "query_id", 2000), "v as (select sentence, draw, round(sum(a * times) / cast(sum(b * times) as double), 9) as v from sums join times using (sentence, query_id) group by 1, 2)"))
def tournament_ci(s, d):
    """Win share of each sentence, whole queries drawn: a ratio of sums."""
    sums = _calls(s, d).groupBy("sentence", "query_id").agg(F.sum("first").alias("a"), F.count(F.lit(1)).alias("b"))
    return rs.ends(rs.ratio_draws(sums, ["sentence"], "query_id", 2000), ["sentence"])


@query(oracle("""select category, 'first_place' as baseline, round(avg(hit), 6) as top1 from (select category, record_id, max(case when rn = 1 then y_top end) as hit from (select *, row_number() over (partition by record_id order by score desc, brand) as rn from kept) group by 1, 2) group by 1
  union all select category, 'frequency', round(avg(hit), 6) from (select category, record_id, max(case when rn = 1 then y_top end) as hit from (select *, row_number() over (partition by record_id order by f desc, brand) as rn from (select k.*, f from kept k join (select category, brand, avg(y_top) as f from kept group by 1, 2) using (category, brand))) group by 1, 2) group by 1""", KEPT))
def naive_baselines(s, d):
    """The two baselines every model must beat: first retrieved, and most often recommended in the category."""
    rows = _kept(s, d)
    often = rows.groupBy("category", "brand").agg(F.avg("y_top").alias("f"))
    frequent = rows.join(often, ["category", "brand"]).withColumn("score", F.col("f"))
    one = lambda x, name: me.ranked(x).where("place = 1").groupBy("category").agg(F.lit(name).alias("baseline"), F.round(F.avg("y_top"), 6).alias("top1"))
    return one(rows, "first_place").unionByName(one(frequent, "frequency"))
