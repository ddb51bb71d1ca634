"""Queries of spectra, scores, episodes and retrieval over the given tables, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from brainstate.functions import scoring as cl
from brainstate.functions.text import cn_duration, cn_timestamp, memory_text_close, memory_text_open
from brainstate.functions.vectors import cosine_distance
from brainstate.operators import dashboard as dw
from brainstate.operators import episode_blocks as eb
from brainstate.operators import episodes as ep
from brainstate.operators import retrieval as rt
from brainstate.operators import signal as sp
from brainstate.plans import tables as t
from brainstate.sources import io
from brainstate.sources.shared import new_folder, stored

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def us(column: str):
    return F.unix_micros(column)


def rounded(df, columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


# Spectra: a recording of event values for each event type.

_SMP = """smp as (
  select event_type as session_id, row_number() over (partition by event_type order by ts, event_id) - 1 as idx,
         ts, value as v
  from events)"""
_PSD = f"""{_SMP},
sg as (select session_id, m * 4 as s0, idx - m * 4 as i, v
       from (select *, unnest(range(greatest(0, ceil((idx - 31) / 4.0))::bigint, idx // 4 + 1)) as m from smp)),
seg as (select *, (v - avg(v) over (partition by session_id, s0)) * (0.54 - 0.46 * cos(2 * pi() * i / 32)) as x,
               count(*) over (partition by session_id, s0) as n from sg),
ft as (select session_id, s0, j, sum(x * cos(2 * pi() * j * i / 32)) as re, sum(x * sin(2 * pi() * j * i / 32)) as im
       from seg, (select unnest(range(1, 17)) as j) where n = 32 group by all),
w2 as (select sum(pow(0.54 - 0.46 * cos(2 * pi() * k / 32), 2)) as s from (select unnest(range(0, 32)) as k)),
pw as (select session_id, s0, j * 2.0 as freq, (re * re + im * im) / (64 * s) * (case when j = 16 then 1 else 2 end) as p
       from ft, w2),
psd as (select a.session_id, a.s0 // 4 as win_id, a.freq, (a.p + b.p) / 2 as power
        from pw a join pw b on a.session_id = b.session_id and a.freq = b.freq and b.s0 = a.s0 + 32),
bd as (select session_id, win_id, band, sum(area) as area from (
         select session_id, win_id, band,
                (power + lead(power) over w) / 2 * (lead(freq) over w - freq) / width as area
         from (select *, case when freq >= 4 and freq < 8 then 'theta' when freq >= 8 and freq < 13 then 'alpha'
                              when freq >= 13 and freq < 30 then 'beta' end as band,
                      case when freq < 8 then 4.0 when freq < 13 then 5.0 else 17.0 end as width
               from psd where freq >= 4 and freq < 30)
         window w as (partition by session_id, win_id, band order by freq)) group by all),
ft3 as (select session_id, win_id, max(area) filter (band = 'theta') as theta, max(area) filter (band = 'alpha') as alpha,
               max(area) filter (band = 'beta') as beta from bd group by all)"""


@query(
    f"""with {_SMP}, c as (select session_id, max(idx) + 1 as n from smp group by 1),
    w as (select session_id, unnest(range(0, (n - 64) // 4 + 1)) as win_id from c where n >= 64)
    select w.session_id, win_id, win_id * 4 as start_idx, 64::bigint as n, epoch_us(s.ts) as end_us
    from w join smp s on s.session_id = w.session_id and s.idx = win_id * 4 + 63"""
)
def sp1_sliding_windows(spark, d):
    out = sp.sliding_windows(t.samples(spark, d), t.WINDOW, t.HOP)
    return out.select("session_id", "win_id", "start_idx", "n", us("ts").alias("end_us"))


def _features(spark, d):
    return sp.window_features(t.samples(spark, d), t.FS, t.WINDOW, t.HOP, t.N_FFT)


@query(f"with {_PSD} select session_id, win_id, freq, round(power, 4) as power from psd")
def sp2_welch_psd(spark, d):
    return rounded(sp.psd_long(_features(spark, d), t.FS, t.N_FFT), ["power"], 4)


@query(f"with {_PSD} select session_id, freq, round(avg(power), 4) as power, count(*) as n from psd group by all")
def sp3_mean_psd(spark, d):
    psd = sp.psd_long(_features(spark, d), t.FS, t.N_FFT)
    out = psd.groupBy("session_id", "freq").agg(F.avg("power").alias("power"), F.count("*").alias("n"))
    return rounded(out, ["power"], 4)


#: Three channels, the recordings of which are sessions of their own in SQL.
_CHANNELS = {"0": "value", "1": "value * value / 100", "2": "100 - value"}
_SMP_OF = " union all ".join(
    f"""select event_type || '|{k}' as session_id, row_number() over (partition by event_type order by ts, event_id) - 1 as idx, ts, {x} as v
    from events"""
    for k, x in _CHANNELS.items()
)
_PSD_OF = _PSD.replace(_SMP, f"smp as ({_SMP_OF})")


@query(
    f"""with {_PSD_OF} select split_part(session_id, '|', 1) as session_id, win_id, freq, round(avg(power), 3) as power
    from psd group by 1, 2, 3"""
)
def sp3_mean_over_channels(spark, d):
    """The mean of three different channels for each window."""
    value = F.element_at("ch", 1)
    rows = t.samples(spark, d).withColumn("ch", F.array(value, value * value / 100, 100 - value))
    return rounded(sp.psd_long(sp.window_features(rows, t.FS, t.WINDOW, t.HOP, t.N_FFT), t.FS, t.N_FFT), ["power"], 3)


_BANDS = "round(theta, 4) as theta, round(alpha, 4) as alpha, round(beta, 4) as beta"


@query(f"with {_PSD} select session_id, win_id, {_BANDS} from ft3")
def sp4_band_power(spark, d):
    return rounded(sp.band_power(_features(spark, d), t.FS, t.N_FFT), ["theta", "alpha", "beta"], 4)


@query(f"with {_PSD} select session_id, win_id, list_value(round(theta, 4), round(alpha, 4), round(beta, 4)) as vector from ft3")
def sp5_feature_vector(spark, d):
    return _features(spark, d).select("session_id", "win_id", F.transform("vector", lambda x: F.round(x, 4)).alias("vector"))


#: Chunks of three and five samples in turn.
_CHUNK = "sample_idx div 8 * 2 + if(sample_idx % 8 >= 3, 1, 0)"
_ARRIVED = f"""{_SMP},
ends as (select session_id, idx // 8 * 2 + (idx % 8 >= 3)::int as chunk, max(idx) as e from smp group by all having max(idx) >= 63),
sg as (select w.session_id, chunk, e, k, s.idx - (e - 63 + 32 * k) as i, v
       from ends w, (select unnest([0, 1]) as k), smp s where s.session_id = w.session_id and s.idx between e - 63 + 32 * k and e - 32 + 32 * k),
seg as (select *, (v - avg(v) over (partition by session_id, e, k)) * (0.54 - 0.46 * cos(2 * pi() * i / 32)) as x from sg),
ft as (select session_id, chunk, e, k, j, sum(x * cos(2 * pi() * j * i / 32)) as re, sum(x * sin(2 * pi() * j * i / 32)) as im
       from seg, (select unnest(range(2, 15)) as j) group by all),
w2 as (select sum(pow(0.54 - 0.46 * cos(2 * pi() * k / 32), 2)) as s from (select unnest(range(0, 32)) as k)),
pw as (select session_id, chunk, e, j * 2.0 as freq, avg((re * re + im * im) / (64 * s) * 2) as power from ft, w2 group by all),
bd as (select *, (power + lead(power) over w) / 2 * (lead(freq) over w - freq) / width as area
       from (select *, case when freq < 8 then 'theta' when freq < 13 then 'alpha' else 'beta' end as band,
                    case when freq < 8 then 4.0 when freq < 13 then 5.0 else 17.0 end as width from pw where freq >= 4 and freq < 30)
       window w as (partition by session_id, e, band order by freq))"""


@query(
    f"""with {_ARRIVED} select session_id, chunk::bigint as chunk, e as end_idx, {", ".join(f"round(sum(area) filter (band = '{b}'), 4) as {b}" for b in ("theta", "alpha", "beta"))}
    from bd group by session_id, chunk, e"""
)
def sp1_chunk_windows(spark, d):
    """A window for each chunk that arrives, of the samples up to its last."""
    rows = t.samples(spark, d).withColumn("chunk", F.expr(_CHUNK))
    out = sp.chunk_features(rows, t.FS, t.WINDOW, t.N_FFT, block_samples=500)
    return rounded(out.select("session_id", F.col("chunk").cast("long").alias("chunk"), "end_idx", "theta", "alpha", "beta"), ["theta", "alpha", "beta"], 4)


# States: band triples of each user and day.

_FEAT = """feat as (
  select user_id as session_id, ts::date as day, sum(case when event_type = 'error' then value else 0 end) as theta,
         sum(case when event_type = 'view' then value else 0 end) as alpha,
         sum(case when event_type = 'click' then value else 0 end) as beta, max(ts) as ts
  from events group by all),
rel as (select *, theta / (theta + alpha + beta + 1e-6::double) as p_theta, alpha / (theta + alpha + beta + 1e-6::double) as p_alpha,
               beta / (theta + alpha + beta + 1e-6::double) as p_beta from feat),
raw as (select *, case when p_alpha > 0.5 then p_alpha else 0.0 end::double as calm,
               case when p_theta > 0.5 then p_theta else 0.0 end::double as fatigue,
               case when p_beta > 0.2 then p_beta * 3.5::double else 0.0 end::double as focus,
               case when p_alpha > 0.3 and p_beta > 0.15 then p_alpha * p_beta * 3.5::double * 2 else 0.0 end::double as happy,
               case when p_theta > 0.3 and p_beta > 0.15 then p_theta * p_beta * 3.5::double * 2 else 0.0 end::double as distress
        from rel),
lab as (select *, case when greatest(calm, fatigue, focus, happy, distress) < 0.4 then 'neutral'
                       when calm = greatest(calm, fatigue, focus, happy, distress) then 'calm'
                       when fatigue = greatest(calm, fatigue, focus, happy, distress) then 'fatigue'
                       when focus = greatest(calm, fatigue, focus, happy, distress) then 'focus'
                       when happy = greatest(calm, fatigue, focus, happy, distress) then 'happy' else 'distress' end as label
        from raw)"""
_FIVE = ("calm", "fatigue", "focus", "happy", "distress")
_SHARP = ", ".join(
    f"case when label = 'neutral' then {s} when label = '{s}' then least({s}, 1.0) else {s} * 0.2::double end as {s}_s" for s in _FIVE
)


def _r(names, places=6, suffix=""):
    return ", ".join(f"round({n}{suffix}, {places}) as {n}" for n in names)


@query(f"with {_FEAT} select session_id, epoch_us(ts) as us, {_r(('p_theta', 'p_alpha', 'p_beta'))} from rel")
def cl1_relative_power(spark, d):
    out = cl.relative_power(t.features(spark, d))
    return rounded(out.select("session_id", us("ts").alias("us"), "p_theta", "p_alpha", "p_beta"), ["p_theta", "p_alpha", "p_beta"])


@query(f"with {_FEAT} select session_id, epoch_us(ts) as us, {_r(_FIVE)} from raw")
def cl2_state_scores(spark, d):
    out = cl.state_scores(cl.relative_power(t.features(spark, d)))
    return rounded(out.select("session_id", us("ts").alias("us"), *_FIVE), _FIVE)


@query(f"with {_FEAT} select session_id, epoch_us(ts) as us, label from lab")
def cl3_pick_state(spark, d):
    out = cl.pick_state(cl.state_scores(cl.relative_power(t.features(spark, d))))
    return out.select("session_id", us("ts").alias("us"), "label")


@query(f"with {_FEAT}, s as (select *, {_SHARP} from lab) select session_id, epoch_us(ts) as us, label, {_r(_FIVE, 6, '_s')} from s")
def cl4_sharpen_scores(spark, d):
    out = cl.sharpen_scores(cl.pick_state(cl.state_scores(cl.relative_power(t.features(spark, d)))))
    return rounded(out.select("session_id", us("ts").alias("us"), "label", *_FIVE), _FIVE)


_IDX = ", ".join(f"round({s}_s * 100, 4) as {s}_idx" for s in _FIVE)


@query(f"with {_FEAT}, s as (select *, {_SHARP} from lab) select session_id, epoch_us(ts) as us, label, {_IDX} from s")
def cl5_state_indices(spark, d):
    out = cl.classify(t.features(spark, d)).select("session_id", us("ts").alias("us"), "label", *[f"{s}_idx" for s in _FIVE])
    return rounded(out, [f"{s}_idx" for s in _FIVE], 4)


@query(f"with {_FEAT}, s as (select *, {_SHARP} from lab) select session_id, epoch_us(ts) as us, label, {_IDX} from s")
def cl6_classify_model(spark, d):
    """The built-in rules again, through the hook for a model of the user's."""
    schema = "label string, calm double, fatigue double, focus double, happy double, distress double"

    @F.pandas_udf(schema)
    def model(vector: pd.Series) -> pd.DataFrame:
        v = pd.DataFrame(vector.tolist(), columns=["t", "a", "b"])
        p = v.div(v.sum(axis=1) + 1e-6, axis=0)
        w = cl.BETA_WEIGHT
        s = pd.DataFrame(
            {
                "calm": p.a.where(p.a > 0.5, 0.0),
                "fatigue": p.t.where(p.t > 0.5, 0.0),
                "focus": (p.b * w).where(p.b > 0.2, 0.0),
                "happy": (p.a * p.b * w * 2).where((p.a > 0.3) & (p.b > 0.15), 0.0),
                "distress": (p.t * p.b * w * 2).where((p.t > 0.3) & (p.b > 0.15), 0.0),
            }
        )
        label = s.idxmax(axis=1).where(s.max(axis=1) >= cl.MIN_SCORE, cl.NEUTRAL)
        for k in cl.STATES:
            sharp = s[k].clip(upper=1.0).where(label == k, s[k] * 0.2)
            s[k] = s[k].where(label == cl.NEUTRAL, sharp)
        s.insert(0, "label", label)
        return s

    out = cl.classify(sp.feature_vector(t.features(spark, d)), model)
    out = out.select("session_id", us("ts").alias("us"), "label", *[f"{s}_idx" for s in _FIVE])
    return rounded(out, [f"{s}_idx" for s in _FIVE], 4)


# Episodes: events of a user as hops.

_HOPS = """hops as (
  select user_id as session_id, ts, event_id, value, case event_type when 'click' then 'focus' when 'view' then 'calm'
         when 'purchase' then 'happy' when 'error' then 'distress' else 'neutral' end as label
  from events),
e as (select *, sum((label = 'neutral')::int) over w as epoch,
             min(case when label = 'neutral' then ts end) over (partition by session_id order by ts, event_id
                 rows between current row and unbounded following) as reset_ts,
             case when label = lag(label) over w then 0 else 1 end as chg
      from hops window w as (partition by session_id order by ts, event_id)),
r as (select *, sum(chg) over (partition by session_id order by ts, event_id) as run_id from e),
n as (select *, row_number() over (partition by session_id, run_id order by ts, event_id) as hop_no,
             min(ts) over (partition by session_id, run_id) as run_start from r),
k as (select session_id, epoch, run_id, label, min(run_start) as run_start,
             min(case when hop_no > 1 and epoch_us(ts) - epoch_us(run_start) >= 21600000000 then ts end) as confirm_ts,
             min(reset_ts) as reset_ts
      from n where label <> 'neutral' group by all having confirm_ts is not null),
s as (select * from (select *, lag(label) over w as pl, lag(epoch) over w as pe from k
                     window w as (partition by session_id order by confirm_ts, run_id))
      where not coalesce(pl = label and pe = epoch, false)),
o as (select session_id, 'evt_' || (epoch_us(confirm_ts) // 1000000) as evt_id, label as state, confirm_ts as start_ts,
             coalesce(case when lead(epoch) over w = epoch then lead(confirm_ts) over w end, reset_ts) as end_ts
      from s window w as (partition by session_id order by confirm_ts, run_id)),
epi as (select o.*, (epoch_us(end_ts) - epoch_us(start_ts)) // 1000000 as duration_sec, h.value
        from o join hops h on h.session_id = o.session_id and h.ts = o.start_ts)"""


def _episodes(spark, d):
    return eb.episodes(t.hops(spark, d), t.SUSTAIN, t.BLOCK)


@query(f"with {_HOPS} select session_id, epoch_us(ts) as us, label, run_id::bigint as run_id, hop_no, epoch_us(run_start) as run_start_us from n")
def ep1_label_runs(spark, d):
    out = eb.label_runs(t.hops(spark, d), t.BLOCK)
    return out.select("session_id", us("ts").alias("us"), "label", F.col("run_id").cast("long"), F.col("hop_no").cast("long"), us("run_start").alias("run_start_us"))


@query(f"with {_HOPS} select session_id, run_id::bigint as run_id, label, epoch_us(run_start) as run_start_us, epoch_us(confirm_ts) as confirm_us from k")
def ep2_sustained_runs(spark, d):
    out = ep.sustained_runs(eb.label_runs(t.hops(spark, d), t.BLOCK), t.SUSTAIN)
    return out.select("session_id", F.col("run_id").cast("long"), "label", us("run_start").alias("run_start_us"), us("confirm_ts").alias("confirm_us"))


@query(f"with {_HOPS} select session_id, epoch_us(ts) as us, epoch::bigint as epoch, epoch_us(reset_ts) as reset_us from e")
def ep3_neutral_epochs(spark, d):
    out = eb.label_runs(t.hops(spark, d), t.BLOCK)
    return out.select("session_id", us("ts").alias("us"), F.col("epoch").cast("long"), us("reset_ts").alias("reset_us"))


@query(f"with {_HOPS} select session_id, label, epoch_us(confirm_ts) as confirm_us from s")
def ep4_edge_triggered_starts(spark, d):
    runs = ep.sustained_runs(eb.label_runs(t.hops(spark, d), t.BLOCK), t.SUSTAIN)
    return eb.edge_triggered_starts(runs, t.BLOCK).select("session_id", "label", us("confirm_ts").alias("confirm_us"))


@query(f"with {_HOPS} select session_id, evt_id, state, epoch_us(start_ts) as start_us, round(value, 6) as value from epi")
def ep5_open_event(spark, d):
    out = _episodes(spark, d)
    return out.select("session_id", "evt_id", "state", us("start_ts").alias("start_us"), F.round(F.element_at("vector", 1), 6).alias("value"))


@query(f"with {_HOPS} select session_id, evt_id, epoch_us(end_ts) as end_us from epi")
def ep6_close_event(spark, d):
    """By blocks of time, as long sessions are."""
    return eb.episodes(t.hops(spark, d), t.SUSTAIN, t.BLOCK, 0).select("session_id", "evt_id", us("end_ts").alias("end_us"))


@query(f"with {_HOPS} select session_id, evt_id, state, duration_sec from epi")
def ep7_episode_duration(spark, d):
    return _episodes(spark, d).select("session_id", "evt_id", "state", "duration_sec")


_ACTIONS = """act as (
  select session_id, 'start' as action, evt_id, start_ts as at_ts, state from epi
  union all select session_id, 'end', evt_id, end_ts, null from epi where end_ts is not null)"""


@query(
    f"""with {_HOPS}, {_ACTIONS} select session_id, action, evt_id, epoch_us(at_ts) as at_us, state,
    row_number() over (partition by session_id order by at_ts, action = 'start', evt_id) as seq from act"""
)
def ep8_start_end_actions(spark, d):
    out = ep.start_end_actions(_episodes(spark, d))
    return out.select("session_id", "action", "evt_id", us("at_ts").alias("at_us"), "state", F.col("seq").cast("long"))


_NAMES = "(values " + ", ".join(f"('{k}', '{v}')" for k, v in dw.DISPLAY.items()) + ") as m(state, display_name)"


@query(f"with {_HOPS} select session_id, epoch_us(ts) as us, display_name from hops join {_NAMES} on label = state")
def pf6_display_state(spark, d):
    return dw.display_state(t.hops(spark, d), "label").select("session_id", us("ts").alias("us"), "display_name")


@query(
    f"""with {_HOPS}, l as (select *, row_number() over (partition by session_id, state order by start_ts desc) as rn from epi)
    select session_id, state, evt_id, epoch_us(start_ts) as start_us, epoch_us(end_ts) as end_us, duration_sec,
           end_ts is null as still_open from l where rn = 1"""
)
def rt7_last_state_occurrence(spark, d):
    out = rt.last_state_occurrence(_episodes(spark, d))
    return out.select("session_id", "state", "evt_id", us("start_ts").alias("start_us"), us("end_ts").alias("end_us"), "duration_sec", "still_open")


@query(
    f"""with {_HOPS} select session_id, strftime(start_ts, '%Y-%m-%d') as day, state, count(*) as n_episodes,
    coalesce(sum(duration_sec), 0)::bigint as total_sec, epoch_us(min(start_ts)) as first_us, epoch_us(max(start_ts)) as last_us
    from epi group by all"""
)
def rt8_states_of_day(spark, d):
    out = rt.states_of_day(_episodes(spark, d))
    return out.select("session_id", F.col("day").cast("string").alias("day"), "state", "n_episodes", "total_sec", us("first_ts").alias("first_us"), us("last_ts").alias("last_us"))


# Memory: episodes as documents.

_CN = "%Y年%m月%d日 %H时%M分%S秒"
_DUR = "case when duration_sec // 60 > 0 then (duration_sec // 60) || '分' else '' end || (duration_sec % 60) || '秒'"
_DOCS = f"""{_HOPS}, docs as (
  select epi.*, '【状态】: ' || display_name || chr(10) || '【开始时间】: ' || strftime(start_ts, '{_CN}') || chr(10) ||
         '【当时AI分析/环境推断】: ' || 'advice ' || epi.state || chr(10) || '【结束时间】: [状态持续中...]' as open_doc
  from epi join {_NAMES} on epi.state = m.state),
closed as (select *, case when end_ts is null then open_doc else replace(open_doc, '【结束时间】: [状态持续中...]',
         '【结束时间】: ' || strftime(end_ts, '{_CN}') || chr(10) || '【持续总时长】: ' || {_DUR}) end as document from docs)"""


def _memory(spark, d):
    """Started events with the document that is open then; it names the state as it is displayed."""
    rows = dw.display_state(_episodes(spark, d), "state")
    opened = memory_text_open(F.col("display_name"), F.col("start_ts"), F.concat(F.lit("advice "), F.col("state")))
    return rows.withColumn("document", opened).withColumn("context", F.col("document")).drop("display_name")


def _closed(spark, d):
    rows = _memory(spark, d)
    closed = memory_text_close(F.col("document"), F.col("end_ts"), F.col("duration_sec"))
    return rows.withColumn("document", F.when(F.col("end_ts").isNull(), F.col("document")).otherwise(closed))


@query(f"with {_DOCS} select session_id, evt_id, open_doc as document from docs")
def sc1_memory_text_open(spark, d):
    return _memory(spark, d).select("session_id", "evt_id", "document")


@query(f"with {_DOCS} select session_id, evt_id, document from closed")
def sc2_memory_text_close(spark, d):
    return _closed(spark, d).select("session_id", "evt_id", "document")


@query(f"select event_id, strftime(ts, '{_CN}') as cn from events")
def sc3_cn_timestamp(spark, d):
    return t.events(spark, d).select("event_id", cn_timestamp(F.col("ts")).alias("cn"))


@query(f"select event_id, {_DUR} as cn from (select event_id, event_id * 7 % 4000 as duration_sec from events)")
def sc4_cn_duration(spark, d):
    return t.events(spark, d).select("event_id", cn_duration(F.col("event_id") * 7 % 4000).alias("cn"))


@query(f"with {_DOCS} select session_id, evt_id, epoch_us(start_ts) as us, length(open_doc) as n, round(value, 6) as v from docs")
def io5_append_memory(spark, d):
    """Both memories, appended in two parts and read back."""
    folder = new_folder(spark, "memory")
    paths = f"{folder}/eeg", f"{folder}/text"
    rows = _memory(spark, d)
    for part in ("session_id % 2 = 0", "session_id % 2 <> 0"):
        io.append_memory(rows.filter(part), *paths)
    eeg, text = map(spark.read.parquet, paths)
    both = eeg.join(text.select("session_id", "evt_id", "document"), ["session_id", "evt_id"])
    return both.select("session_id", "evt_id", us("ts").alias("us"), F.length("document").cast("long").alias("n"), F.round(F.element_at("embedding", 1), 6).alias("v"))


@query(f"with {_DOCS} select session_id, evt_id, document, document as context from closed")
def io6_close_memory(spark, d):
    rows = _memory(spark, d)
    _, text = io.memory_rows(rows)
    ends = rows.filter(F.col("end_ts").isNotNull()).select("session_id", "evt_id", "end_ts", "duration_sec")
    return io.close_memory(text, ends).select("session_id", "evt_id", "document", "context")


@query(f"with {_DOCS} select session_id, evt_id, round(value, 6) as v, document as context from closed")
def io6_close_vector_memory(spark, d):
    """The contexts of the vector memory follow those of the text memory."""
    rows = _memory(spark, d)
    eeg, text = io.memory_rows(rows)
    ends = rows.filter(F.col("end_ts").isNotNull()).select("session_id", "evt_id", "end_ts", "duration_sec")
    out = io.close_vectors(eeg, io.close_memory(text, ends))
    return out.select("session_id", "evt_id", F.round(F.element_at("embedding", 1), 6).alias("v"), "context")


@query(f"with {_DOCS} select session_id, evt_id, document, document as context from closed")
def io6_close_stored_memory(spark, d):
    """The same on a store: the ends come in two parts, each of which rewrites the buckets of its sessions."""
    path = new_folder(spark, "memory")
    rows = stored(_memory(spark, d), "events")
    _, text = io.memory_rows(rows)
    io.write_version(text, path, 0)
    ends = rows.filter(F.col("end_ts").isNotNull()).select("session_id", "evt_id", "end_ts", "duration_sec")
    for version, part in ((1, "session_id % 5 = 0"), (2, "session_id % 5 <> 0")):
        io.close_stored(spark, path, text.schema, ends.filter(part), version)
    return io.newest(spark, path, text.schema).select("session_id", "evt_id", "document", "context")


@query(f"with {_DOCS} select session_id, evt_id, open_doc as document from docs where session_id % 3 = 0 and state = 'focus'")
def io7_get_memory(spark, d):
    rows = _memory(spark, d)
    _, text = io.memory_rows(rows)
    ids = rows.filter((F.col("session_id") % 3 == 0) & (F.col("state") == "focus")).select("session_id", "evt_id")
    return io.get_memory(text, ids).select("session_id", "evt_id", "document")


@query(
    f"""with {_DOCS} select h.session_id, count(docs.session_id) as n, count(docs.session_id) = 0 as is_empty
    from (select distinct session_id from hops) h left join docs on docs.session_id = h.session_id group by 1"""
)
def io7_memory_counts(spark, d):
    """The guard of an empty memory, for every session."""
    _, text = io.memory_rows(_memory(spark, d))
    return io.memory_counts(text, t.hops(spark, d).select("session_id").distinct())


@query(
    f"""with {_DOCS} select 'eeg' as name, count(*) as n_before, 0::bigint as n_after from docs
    union all select 'text', count(*), 0 from docs"""
)
def io8_clear_memory(spark, d):
    folder = new_folder(spark, "memory")
    paths = {"eeg": f"{folder}/eeg", "text": f"{folder}/text"}
    io.append_memory(_memory(spark, d), *paths.values())
    counted = lambda name: F.count("*").alias(name)
    before = {k: spark.read.parquet(p).agg(counted("n")).first().n for k, p in paths.items()}
    io.clear_memory(spark, *paths.values())
    out = None
    for k, p in paths.items():
        one = spark.read.parquet(p).agg(counted("n_after"))
        one = one.select(F.lit(k).alias("name"), F.lit(before[k]).cast("long").alias("n_before"), "n_after")
        out = one if out is None else out.unionByName(one)
    return out


_RECENT = f"""{_DOCS}, rec as (
  select *, row_number() over (partition by session_id order by start_ts desc, evt_id desc) as back from closed)"""


@query(
    f"""with {_RECENT} select session_id, evt_id, row_number() over (partition by session_id order by back desc) as place
    from rec where back <= 10"""
)
def rt5_recent_timeline(spark, d):
    out = rt.recent_timeline(_closed(spark, d).withColumn("ts", F.col("start_ts")))
    return out.select("session_id", "evt_id", F.col("place").cast("long"))


def _timelines(spark, d):
    recent = rt.recent_timeline(_closed(spark, d).withColumn("ts", F.col("start_ts")))
    return rt.timeline_text(recent, t.hops(spark, d).select("session_id").distinct())


_TIMELINE = f"""{_RECENT}, tl as (
  select session_id, string_agg(document, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by back desc) as timeline
  from rec where back <= 10 group by 1)"""


@query(
    f"""with {_TIMELINE} select h.session_id, coalesce(timeline, '无相关历史记录。') as timeline
    from (select distinct session_id from hops) h left join tl using (session_id)"""
)
def rt6_timeline_text(spark, d):
    return _timelines(spark, d)


@query(
    f"""with {_FEAT}, l as (select *, row_number() over (partition by session_id order by ts desc) as rn from feat)
    select session_id, epoch_us(ts) as us, round(theta, 6) as theta, round(alpha, 6) as alpha, round(beta, 6) as beta from l where rn = 1"""
)
def rt9_latest_metrics(spark, d):
    out = rt.latest_metrics(t.features(spark, d).drop("day"))
    return rounded(out.select("session_id", us("ts").alias("us"), "theta", "alpha", "beta"), ["theta", "alpha", "beta"])


@query(
    f"""with {_HOPS}, l as (select *, row_number() over (partition by session_id order by start_ts desc) as rn from epi)
    select session_id, evt_id, state from l where rn = 1"""
)
def rt9_latest_event(spark, d):
    rows = _episodes(spark, d).select("session_id", F.col("start_ts").alias("ts"), "evt_id", "state")
    first = rows.withColumn("state", F.concat("state", F.lit(rt.PROCESSING)))
    return rt.latest_event(first.unionByName(rows)).select("session_id", "evt_id", "state")


# Similarity: embeddings, a session for each label.

_COS = """v as (select label as session_id, vec_id as mem_seq, embedding::double[] as v from embeddings),
dist as (select a.session_id, a.mem_seq, b.mem_seq as past,
                1 - list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) as d
         from v a join v b on a.session_id = b.session_id and b.mem_seq < a.mem_seq),
near as (select *, row_number() over (partition by session_id, mem_seq order by d, past) as rn from dist)"""


@query(
    """with v as (select vec_id, label, embedding::double[] as v, lead(embedding::double[]) over (partition by label order by vec_id) as n
    from embeddings) select vec_id, round(1 - list_inner_product(v, n) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(n, n))), 6) as distance
    from v where n is not null"""
)
def rt1_cosine_distance(spark, d):
    rows = t.vectors(spark, d)
    w = Window.partitionBy("session_id").orderBy("mem_seq")
    rows = rows.withColumn("next", F.lead("vector").over(w)).filter(F.col("next").isNotNull())
    return rows.select(F.col("mem_seq").alias("vec_id"), F.round(cosine_distance(F.col("vector"), F.col("next")), 6).alias("distance"))


@query(
    f"""with {_COS} select v.session_id, v.mem_seq, past, round(d, 6) as distance
    from v left join near on near.session_id = v.session_id and near.mem_seq = v.mem_seq and rn = 1"""
)
def rt2_nearest_prior_trial(spark, d):
    return rounded(rt.nearest_prior(t.vectors(spark, d)), ["distance"])


@query("select label as session_id, vec_id as trial_id from embeddings where vec_id % 3 <> 0")
def rt3_new_trials_only(spark, d):
    rows = t.vectors(spark, d).select("session_id", F.col("mem_seq").alias("trial_id"))
    return rt.new_trials_only(rows, rows.filter("trial_id % 3 = 0"))


_NEAR_COS = _COS.replace("embedding::double[] as v", "list_transform(embedding, lambda x: x::double + 0.25) as v")


@query(
    f"""with {_NEAR_COS} select v.session_id, v.mem_seq, case when d < 0.2 then 'memory ' || past else '无相似记忆' end as similar_context
    from v left join near on near.session_id = v.session_id and near.mem_seq = v.mem_seq and rn = 1"""
)
def rt4_similar_state_context(spark, d):
    """At the reference's threshold of 0.2; the vectors are moved off the origin, as powers are, so that some have such neighbours."""
    rows = t.vectors(spark, d).withColumn("start_ts", F.col("mem_seq"))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x.cast("double") + 0.25))
    rows = rows.withColumn("context", F.concat(F.lit("memory "), F.col("mem_seq").cast("string")))
    return rt.similar_state_context(rows, 0.2).select("session_id", "mem_seq", "similar_context")
