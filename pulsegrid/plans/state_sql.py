"""Recursive DuckDB SQL for the state machines of the tracker and of the device queue."""

from __future__ import annotations

from ..operators.tracking import MAD_SCALE
from ..params import INSTRUMENTS, PredictorParams, QueueParams


def _d(x: float) -> str:
    return f"{float(x)!r}::double"


def _mid(values: str) -> str:
    return f"case when len({values}) % 2 = 1 then {values}[(len({values}) + 1) // 2] else ({values}[len({values}) // 2] + {values}[len({values}) // 2 + 1]) / 2 end"


def _clamp(x: str) -> str:
    return f"least(1.0::double, greatest(0.0::double, {x}))"


def predictor(p: PredictorParams, frames: str = "f") -> str:
    """CTEs up to ``told``: the trackers of every frame that emits, one row an instrument, from frames with one instrument each.

    A recursion step is one frame of one instrument: predict, then the updates of a hit, each on top of the one before.
    """
    dt, low, high = p.hop_size / p.sample_rate, 60.0 / p.max_bpm, 60.0 / p.min_bpm
    names = ", ".join(f"('{n}', {i})" for i, n in enumerate(INSTRUMENTS))
    turn = "(phase + {0}) - floor(phase + {0})".format(f"{_d(dt)} / period")
    moving = "warm and period > 1e-6"
    return f"""beat as (select stream_id, frame_idx, instrument, frame_idx * {_d(dt)} as now from {frames}),
    track as (
        select stream_id, i.name as inst, i.idx, -1::bigint as frame_idx, false as warm, []::double[] as times, 0::bigint as seen, -1.0::double as last, 0.5::double as median, 0.0::double as mad,
            0.5::double as period, 0.0::double as phase, 0.01::double as p00, 0.0::double as p01, 0.01::double as p11 from (select distinct stream_id from {frames}), (values {names}) as i(name, idx)
        union all
        select stream_id, inst, idx, frame_idx, warm, times, seen, last, median, mad,
            case when tracked then least({_d(high)}, greatest({_d(low)}, period)) else period end, phase, p00, p01, p11
        from (select * replace (case when gain and abs(off) > 0.1 then period + -off * period * 0.1 else period end as period)
        from (select * replace (
                case when gain then period - k0 * off else period end as period,
                case when gain then (phase - k1 * off) - floor(phase - k1 * off) else phase end as phase,
                case when gain then greatest(1e-6, p00 - k0 * spread * k0) else p00 end as p00,
                case when gain then p01 - k0 * spread * k1 else p01 end as p01,
                case when gain then greatest(1e-6, p11 - k1 * spread * k1) else p11 end as p11)
        from (select *, tracked and spread >= 1e-9 as gain, p01 / spread as k0, p11 / spread as k1
        from (select *, (phase + 0.5) - floor(phase + 0.5) - 0.5 as off, p11 + {_d(p.r_base)} * (1 + case when period > 1e-6 then mad / period else 0.0::double end) as spread
        from (select * replace (warm or warming as warm, case when warming then median else period end as period, case when warming then 0.0::double else phase end as phase,
                case when warming then mad * mad else p00 end as p00, case when warming then 0.01::double else p11 end as p11), hit and (warm or warming) and len(times) >= 2 as tracked
        from (select *, hit and not warm and len(times) >= 2 and seen >= {p.warmup_hits} and len(gaps) >= {p.warmup_hits - 1} as warming
        from (select * replace (case when many then {_d(MAD_SCALE)} * ({_mid('away')}) else mad end as mad)
        from (select *, list_sort(list_transform(gaps, lambda g: abs(g - median))) as away
        from (select * replace (case when many then {_mid('gaps')} else median end as median)
        from (select *, hit and len(gaps) >= 2 as many
        from (select *, list_sort(list_filter(list_transform(range(1, len(times)), lambda i: times[i + 1] - times[i]), lambda g: g >= {_d(low)} and g <= {_d(4 * high)})) as gaps
        from (select * replace (case when hit then list_append(times, now)[-20:] else times end as times, case when hit then now else last end as last, case when hit then seen + 1 else seen end as seen)
        from (select * replace (case when moved then p11 + ({_d(p.q_phase * dt)} + slope * slope * p00) else p11 end as p11, case when moved then p01 + slope * p00 else p01 end as p01)
        from (select s.stream_id, s.inst, s.idx, b.frame_idx, b.now, b.instrument = s.inst as hit, warm, times, seen, last, median, mad, period, {moving} as moved,
                case when {moving} then {turn} else phase end as phase, case when {moving} then -{_d(dt)} / (period * period) else 0.0::double end as slope,
                case when warm then p00 + {_d(p.q_period * dt)} else p00 end as p00, p01, p11
            from track s join beat b on b.stream_id = s.stream_id and b.frame_idx = s.frame_idx + 1))))))))))))))),
    emission as (
        select distinct stream_id, -1::bigint as frame_idx, null::double as last, false as emits from {frames}
        union all
        select b.stream_id, b.frame_idx, case when e.emits_now then b.now else e.last end, e.emits_now from (
            select e.*, n.instrument is not null or n.now - coalesce(e.last, 0.0) >= {_d(p.periodic_interval)} as emits_now
            from emission e join beat n on n.stream_id = e.stream_id and n.frame_idx = e.frame_idx + 1) e
        join beat b on b.stream_id = e.stream_id and b.frame_idx = e.frame_idx + 1),
    told as (select t.*, b.now, warm and period >= 1e-6 as ready,
        {_clamp(f'''0.4 * {_clamp('1 - 10 * sqrt(greatest(0.0, p11))')} + 0.3 * (case when mad > 0 and period > 1e-6 then {_clamp('1 - mad / period')} else 0.0::double end)
            + 0.3 * (case when t.last > 0 and period > 1e-6 then exp(-(b.now - t.last) / ({_d(p.decay)} * period)) else 1.0::double end)''')} as belief,
        greatest(0.001, sqrt(phase * phase * greatest(0.0, p00) + period * period * greatest(0.0, p11) + case when mad > 0 then 0.25 * mad * mad else 0.0::double end)) as sigma
        from track t join emission e on e.stream_id = t.stream_id and e.frame_idx = t.frame_idx and e.emits join beat b on b.stream_id = t.stream_id and b.frame_idx = t.frame_idx),
    forecast as (select *, now + (1 - phase) * period + (k - 1) * period as t_pred from told, unnest(range(1, {p.max_predictions + 1})) as u(k)
        where ready and belief >= {_d(p.confidence_min)} and now + (1 - phase) * period + (k - 1) * period <= now + {_d(p.horizon_seconds)})"""


def device_queue(p: QueueParams, arrivals: str = "d") -> str:
    """CTEs up to ``done``: one step of the recursion runs the head of a stream's queue, or admits its next arrival."""
    event = "struct_pack(due := {0}, id := {1}, kind := {2}, r := {3}, g := {4}, b := {5})"
    arrived = event.format("execute_time_us", "event_id % 256", "'on'", "red", "green", "blue")
    off = event.format(f"run_at + {p.flash_us}", "head.id", "'off'", "false", "false", "false")
    put = lambda queue, new: f"list_concat(list_concat(list_filter({queue}, lambda x: x.due <= {new}.due), [{new}]), list_filter({queue}, lambda x: x.due > {new}.due))"
    nothing = event.format("0::bigint", "0", "''", "false", "false", "false")
    return f"""arrival as (select *, row_number() over (partition by stream_id order by arrival_us, seq) as k, {arrived} as event from {arrivals}),
    step as (
        select distinct stream_id, 0::bigint as k, list_filter([{nothing}], lambda x: false) as queue, null::bigint as now, null::bigint as at_us, null::integer as event_id, null::varchar as kind, false as red, false as green, false as blue from {arrivals}
        union all
        select stream_id, case when runs then k else k + 1 end,
            case when runs and full_or_dark then rest when runs then {put('rest', 'flash_end')} when len(queue) >= {p.capacity} then queue else {put('queue', 'event')} end,
            case when runs then now else arrival_us end,
            case when runs then run_at when len(queue) >= {p.capacity} then arrival_us end,
            case when runs then head.id when len(queue) >= {p.capacity} then event.id end,
            case when runs then head.kind when len(queue) >= {p.capacity} then 'rejected' end,
            case when runs then head.r else event.r end, case when runs then head.g else event.g end, case when runs then head.b else event.b end
        from (select *, {off} as flash_end from (select *, greatest(head.due, coalesce(now, head.due)) as run_at, queue[2:] as rest, len(queue) >= {p.capacity} or not (head.r or head.g or head.b) as full_or_dark
            from (select s.stream_id, s.k, s.queue, s.now, s.queue[1] as head, a.arrival_us, a.event, len(s.queue) > 0 and (a.k is null or s.queue[1].due <= a.arrival_us) as runs
                from step s left join arrival a on a.stream_id = s.stream_id and a.k = s.k + 1 where len(s.queue) > 0 or a.k is not null)))),
    done as (select stream_id, at_us, event_id, kind, red, green, blue from step where kind is not null)"""
