"""DuckDB SQL for the rows of ``front``'s queries."""

from __future__ import annotations

from ..functions.arrays import masks
from ..operators.dsp import blackman_harris
from ..operators.frames import NOISE_FACTOR, NOISE_LEVEL, NOISE_MODULUS, SILENT_POWER
from ..params import INSTRUMENTS, CutterParams, MaskParams
from . import front as Q
from . import oracle, state_sql
from . import queries as S
from .oracle import B, F, H, P

_S = f"{B}, s as (select stream_id, frame_idx * 64 + u.i - 1 as pos, bands[u.i] as x, vec_id from b, unnest(range(1, 65)) as u(i))"


def cut(p: CutterParams, samples: str = "s") -> str:
    """CTE fr: stream_id, frame_idx and samples a of every whole frame."""
    size, hop = p.frame_size, p.hop_size
    return f"""fr as (select stream_id, k as frame_idx, list(x order by pos) as a from (select *, unnest(range(greatest(0, (pos - {size}) // {hop}), pos // {hop} + 1)) as k from {samples})
        where pos between k * {hop} and k * {hop} + {size - 1} group by 1, 2 having count(*) = {size})"""


def bands(p: CutterParams, n: int) -> str:
    """CTEs sp (power a bin) and m (energy a band) of the frames fr."""
    size, bins, top = p.frame_size, p.frame_size // 2 + 1, p.sample_rate / 2
    window = ", ".join(repr(float(w)) for w in blackman_harris(size))
    mel = f"2595 * log10(1 + {top!r}::double / 700)"
    return f"""w as (select [{window}] as w), turns as (select list(cos(2 * pi() * i / {size}) order by i) as c, list(sin(2 * pi() * i / {size}) order by i) as z from range({size}) as r(i)),
    wd as (select stream_id, frame_idx, list_transform(range(1, {size + 1}), lambda i: a[i] * w[i]) as a from fr, w),
    sp as (select stream_id, frame_idx, k, pow(list_sum(list_transform(range(1, {size + 1}), lambda i: a[i] * c[k * (i - 1) % {size} + 1])), 2) + pow(list_sum(list_transform(range(1, {size + 1}), lambda i: a[i] * z[k * (i - 1) % {size} + 1])), 2) as power from wd, turns, range({bins}) as r(k)),
    e as (select i, 700 * (pow(10, i * ({mel}) / {n + 1} / 2595) - 1) as hz from range({n + 2}) as r(i)),
    tri as (select l.i as band, k, greatest(0.0, least((k * {top!r}::double / {bins - 1} - l.hz) / (c.hz - l.hz), (h.hz - k * {top!r}::double / {bins - 1}) / (h.hz - c.hz))) * 2 / (h.hz - l.hz) as weight from e l join e c on c.i = l.i + 1 join e h on h.i = l.i + 2, range({bins}) as r(k)),
    m as (select stream_id, frame_idx, band, sum(weight * power) as energy from sp join tri using (k) group by 1, 2, 3)"""


def noise(stream: str, place: str, seed: int) -> str:
    k = f"(({place}) % {NOISE_MODULUS} * {NOISE_FACTOR} + {stream} % {NOISE_MODULUS} * 16807 + {seed}) % {NOISE_MODULUS}"
    return f"(({k}) * {NOISE_FACTOR} % {NOISE_MODULUS}) / {NOISE_MODULUS / 2.0!r} - 1.0"


def p2(q: float, name: str) -> str:
    """CTE ``name``: the five markers h and their places n after each row."""
    want = [0.0, q / 2, q, (1 + q) / 2, 1.0]
    made = f"select a.stream_id, r.frame_idx, r.c, r.x, a.h, a.n from {name} a join numbered r on r.stream_id = a.stream_id and r.c = a.c + 1"
    cell = "((x >= h[2])::int + (x >= h[3])::int + (x >= h[4])::int)"
    made = f"""select stream_id, frame_idx, c, case when c <= 5 then list_sort(list_append(h, x)) else [least(h[1], x), h[2], h[3], h[4], greatest(h[5], x)] end as h,
        case when c <= 5 then [1, 2, 3, 4, 5] else [n[1], n[2] + ({cell} < 1)::int, n[3] + ({cell} < 2)::int, n[4] + ({cell} < 3)::int, n[5] + 1] end as n from ({made})"""
    for j in (2, 3, 4):
        off = f"(1 + {want[j - 1]!r}::double * (c - 1) - n[{j}])"
        made = f"select *, case when c <= 5 then 0 when {off} >= 1 and n[{j + 1}] - n[{j}] > 1 then 1 when {off} <= -1 and n[{j}] - n[{j - 1}] > 1 then -1 else 0 end as d from ({made})"
        right, left = f"((h[{j + 1}] - h[{j}]) / (n[{j + 1}] - n[{j}]))", f"((h[{j}] - h[{j - 1}]) / (n[{j}] - n[{j - 1}]))"
        bent = f"h[{j}] + d / (n[{j + 1}] - n[{j - 1}]) * ((n[{j}] - n[{j - 1}] + d) * {right} + (n[{j + 1}] - n[{j}] - d) * {left})"
        line = f"h[{j}] + d * (h[{j} + d] - h[{j}]) / (n[{j} + d] - n[{j}])"
        made = f"select *, case when d = 0 then h[{j}] when {bent} > h[{j - 1}] and {bent} < h[{j + 1}] then {bent} else {line} end as t from ({made})"
        put = lambda v, new: "[" + ", ".join(new if i == j else f"{v}[{i}]" for i in range(1, 6)) + "]"  # noqa: E731, B023
        made = f"select stream_id, frame_idx, c, case when d = 0 then h else {put('h', 't')} end as h, case when d = 0 then n else {put('n', f'n[{j}] + d')} end as n from ({made})"
    at = f"({q!r}::double * (c - 1))"
    value = f"case when c > 5 then h[3] else h[cast(floor({at}) as int) + 1] + ({at} - floor({at})) * (h[least(cast(floor({at}) as int) + 2, c)] - h[cast(floor({at}) as int) + 1]) end"
    return f"""{name} as (select stream_id, frame_idx, c, [x] as h, [1, 2, 3, 4, 5] as n from numbered where c = 1 union all {made}),
    {name}_value as (select stream_id, frame_idx, {value} as v from {name})"""


_MATCHED = f"""{P}, rows as (select stream_id, instrument, t as tm, 0 as kind, null::bigint as frame_idx, null::integer as hit_index from h
        union all select stream_id, instrument, round(t_pred_sec, 6), 1, frame_idx, hit_index from p),
    numbered as (select *, row_number() over (partition by stream_id, instrument order by tm, kind, frame_idx, hit_index) as n from rows),
    walk as (select stream_id, instrument, n, kind, [{{'tm': tm, 'f': frame_idx, 'i': hit_index}}] as open, null::double as t_pred, null::double as t_hit, null::bigint as frame_idx, null::integer as hit_index from numbered where n = 1
        union all select stream_id, instrument, n, case when pair then was else kind end, case when pair then open[2:] else list_append(open, {{'tm': tm, 'f': f, 'i': i}}) end,
            case when pair then case when kind = 0 then open[1].tm else tm end end, case when pair then case when kind = 0 then tm else open[1].tm end end,
            case when pair then case when kind = 0 then open[1].f else f end end, case when pair then case when kind = 0 then open[1].i else i end end
        from (select *, len(open) > 0 and was != kind as pair from (select r.stream_id, r.instrument, r.n, r.kind, r.tm, r.frame_idx as f, r.hit_index as i, w.kind as was, list_filter(w.open, lambda o: r.tm - o.tm <= {Q.TOLERANCE}) as open
            from walk w join numbered r on r.stream_id = w.stream_id and r.instrument = w.instrument and r.n = w.n + 1))),
    pairs as (select stream_id, instrument, t_pred, t_hit, frame_idx, hit_index from walk where t_pred is not null),
    matched as (select * from pairs
        union all select stream_id, instrument, tm, null, frame_idx, hit_index from rows r where kind = 1 and not exists (select 1 from pairs x where x.stream_id = r.stream_id and x.instrument = r.instrument and x.frame_idx = r.frame_idx and x.hit_index = r.hit_index)
        union all select stream_id, instrument, null, tm, null, null from rows r where kind = 0 and not exists (select 1 from pairs x where x.stream_id = r.stream_id and x.instrument = r.instrument and x.t_hit = r.tm))"""
_inv = {(0, 0): "c11 * c22 - c12 * c12", (0, 1): "c02 * c12 - c01 * c22", (0, 2): "c01 * c12 - c02 * c11", (1, 1): "c00 * c22 - c02 * c02", (1, 2): "c01 * c02 - c00 * c12", (2, 2): "c00 * c11 - c01 * c01"}
_inverse = " union all ".join(f"select stream_id, {i} as i, {j} as j, round(({_inv[min(i, j), max(i, j)]}) / det, 5) + 0.0 as icov from d" for i in range(3) for j in range(3))
_masks = list(masks(MaskParams(sample_rate=Q.LIVE.sample_rate)).items())
_live = ", ".join(f"round(list_dot_product(v, [{', '.join(repr(float(x)) for x in w)}]) * 1e6, 4) as {n}" for n, w in _masks)

ORACLE_SQL = {
    "chunk_frames": f"with {_S}, {cut(Q.CUT)} select stream_id, frame_idx, round(a[1], 6) as first, round(a[100], 6) as last, round(list_sum(list_transform(a, lambda v: v * v)), 6) as energy from fr",
    "noise_frames": f"""with {_S}, z as (select stream_id, pos, case when vec_id % 4 = 0 then 0.0 else x end as x from s), {cut(Q.NOISY, "z")},
    y as (select stream_id, frame_idx, list_transform(range(1, 17), lambda i: a[i] + {NOISE_LEVEL!r}::double * ({noise("stream_id", "frame_idx * 16 + i - 1", Q.NOISY.seed)})) as v from fr where list_sum(list_transform(a, lambda x: x * x)) / 16 < {SILENT_POWER!r}::double)
    select stream_id, frame_idx, round(v[4] * 1e9, 3) as fourth, round(list_sum(list_transform(v, lambda x: x * x)) * 1e12, 3) as energy from y""",
    "front_end": f"""with {_S}, {cut(Q.FRONT)}, {bands(Q.FRONT, Q.FRONT_BANDS)}, peak as (select stream_id, frame_idx, arg_max(k, power) as peak_bin from sp group by 1, 2),
    cep as (select stream_id, frame_idx, arg_max(band, energy) as peak_band, max(energy) as top_band, sum(10 * log10(greatest(1e-10, energy))) / sqrt({Q.FRONT_BANDS}) as c0, sum(10 * log10(greatest(1e-10, energy)) * cos(pi() * (2 * band + 1) / {2 * Q.FRONT_BANDS})) * sqrt(2 / {Q.FRONT_BANDS}) as c1 from m group by 1, 2)
    select stream_id, frame_idx, peak_bin, peak_band, round(top_band, 9) as top_band, round(c0, 4) as c0, round(c1, 4) as c1 from peak join cep using (stream_id, frame_idx)""",
    "refractory_segments": oracle.ORACLE_SQL["refractory"],
    "quantile_gate_segments": oracle.ORACLE_SQL["quantile_gate"],
    "clock_offset_segments": oracle.ORACLE_SQL["clock_offset"],
    "onset_gate_segments": f"with recursive {oracle.onset(Q.SEGMENT_ONSET)} select stream_id, frame_idx, hit from gated",
    "p2_quantiles": f"with recursive {F}, numbered as (select stream_id, frame_idx, frame_idx + 1 as c, x from f), {p2(0.98, 'hi')}, {p2(0.8, 'lo')} select stream_id, frame_idx, round(a.v, 9) as hi, round(b.v, 9) as lo from hi_value a join lo_value b using (stream_id, frame_idx)",
    "quantile_sketch": f"with {F} select event_type, count(x) as n, true as median_near, true as high_near from f group by 1",
    "hit_matches": f"with recursive {_MATCHED} select stream_id, instrument, t_pred, t_hit, frame_idx, hit_index from matched",
    "match_report": f"""with recursive {_MATCHED}, c as (select stream_id, instrument, count(t_pred) as n_predictions, count(t_hit) as n_hits, count(t_pred + t_hit) as n_pairs, avg(t_hit - t_pred) as e, avg(abs(t_hit - t_pred)) as ae from matched group by 1, 2)
    select stream_id, instrument, n_predictions, n_hits, n_pairs, round(n_pairs / nullif(n_predictions, 0), 6) as precision, round(n_pairs / nullif(n_hits, 0), 6) as recall, round(2 * n_pairs / (n_predictions + n_hits), 6) as f1, round(e, 6) as mean_error, round(ae, 6) as mean_abs_error from c""",
    "trailing_predictions": f"""with {P}, z as (select stream_id, instrument, frame_idx * 100000 as t_us, count(*) as n from p group by 1, 2, 3)
    select stream_id, instrument, t_us, cast(sum(n) over (partition by stream_id, instrument order by t_us range unbounded preceding) as bigint) as total, cast(sum(n) over w as bigint) as recent, round(sum(n) over w / 2, 6)::double as rate from z
    window w as (partition by stream_id, instrument order by t_us range 1999999 preceding)""",
    "mixed_covariance": f"""with {B}, v as (select stream_id, vec_id, u.i - 1 as i, bands[u.i] + 1000000 as x from b, unnest(range(1, 5)) as u(i) where u.i <= 4 - vec_id % 3)
    select a.stream_id, cast(a.i as integer) as i, cast(c.i as integer) as j, count(*) as n, round(covar_pop(a.x - 1000000, c.x - 1000000), 6) + 0.0 as cov from v a join v c on a.stream_id = c.stream_id and a.vec_id = c.vec_id and a.i <= c.i group by all""",
    "band_precision": f"""with {B}, c as (select stream_id, {', '.join(f'covar_pop(bands[{i + 1}], bands[{j + 1}]) as c{i}{j}' for i, j in _inv)} from b group by 1),
    d as (select *, c00 * ({_inv[0, 0]}) + c01 * ({_inv[0, 1]}) + c02 * ({_inv[0, 2]}) as det from c) {_inverse}""",
    "topic_messages": f"with {F} select stream_id, count(*) as n, cast(sum(frame_idx) as bigint) as times, case event_type when 'click' then 'schedule' else 'sync' end as topic from f where event_type in ('click', 'view') group by stream_id, event_type",
    "flagged_beats": f"with {H} select stream_id, frame_idx, row_number() over w as beat_no, round(t - lag(t) over w, 9) as ibi from h where instrument = 'kick' window w as (partition by stream_id order by frame_idx)",
    "last_sync": f"with {F} select stream_id as device_id, max(event_id) as received_us, arg_max(frame_idx, event_id) as unix_time, arg_max(frame_idx * 7, event_id) as microseconds from f where event_type = 'view' group by 1",
    "short_gates": f"""with recursive {F}, g as (select stream_id, instrument, cast(row_number() over (partition by stream_id order by frame_idx) - 1 as bigint) as frame_idx from f where event_id % 7 != 0), {state_sql.predictor(S.PREDICTOR, "g")}
    select stream_id, round(now, 6) as now, inst as instrument, cast(k as integer) as hit_index, round(t_pred, 6) as t_pred_sec, round(belief, 6) as confidence from forecast""",
    "live_sums": f"with {_S}, {cut(Q.LIVE)}, {bands(Q.LIVE, 64)}, v as (select stream_id, frame_idx, list(energy order by band) as v from m group by 1, 2) select stream_id, frame_idx, {_live} from v",
}
assert [n for n, _ in _masks] == list(INSTRUMENTS)
