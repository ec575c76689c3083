"""The queries of ``queries`` as SQL for DuckDB over the same tables, written independently of the Spark plans."""

from __future__ import annotations

from vaneworks.schema import FEATURES

OBS = """obs as (
  select user_id as series_id, ts as timestamp, event_id,
         value as temperature, cast(json_extract_string(props, '$.k') as double) as humidity,
         1e3 + day(ts) as pressure, cast(event_id % 31 as double) as wind_speed, hour(ts) * 15e0 as wind_direction,
         case when event_type = 'purchase' then value else 0e0 end as precipitation,
         minute(ts) / 60e0 * 100e0 as cloud_cover, second(ts) / 6e0 as visibility,
         case when event_type = 'error' then 1 else 0 end as storm_event
  from events)"""

IMAGERY = """imagery as (
  select e.user_id as series_id, e.ts as timestamp, concat('a/', cast(e.event_id as varchar)) as path,
         v.embedding as pixels, v.vec_id
  from events e join embeddings v on v.vec_id = e.event_id % (select count(*) from embeddings) where e.event_id % 50 <> 0
  union all
  select e.user_id, e.ts, concat('b/', cast(e.event_id as varchar)), v.embedding, v.vec_id
  from events e join embeddings v on v.vec_id = (e.event_id + 1) % (select count(*) from embeddings) where e.event_id % 20 = 0)"""

PREDS = """preds as (
  select event_id, ts, user_id, 1e0 / (1e0 + exp(-(value - 50) / 40)) as p,
         case when event_type = 'error' then 1 else 0 end as y
  from events)"""

HISTORY = """history as (
  select user_id as run, row_number() over (partition by user_id order by ts, event_id) as epoch,
         value / 100 as val_loss
  from events)"""

REQUESTS = """requests as (
  select *, case when event_id % 23 = 0 then 'unsupported_content_type' when event_id % 17 = 0 then 'malformed'
                 when event_id % 19 = 0 then 'missing_image' when event_id % 13 = 0 then 'missing_feature'
                 else 'ok' end as reason
  from obs)"""

FIT = "fit as (" + " union all ".join(
    f"select '{f}' as feature, avg({f}) as mean, case when stddev_pop({f}) = 0 then 1e0 else stddev_pop({f}) end as scale,"
    f" count({f}) as n from obs"
    for f in FEATURES
) + ")"

# marked observations, one frame of 24 rows per row and the row after it
FRAMES = """marked as (
  select o.*, k.h from obs o
  left join (select distinct series_id, timestamp, 1 as h from imagery) k
    on o.series_id = k.series_id and o.timestamp = k.timestamp),
framed as (
  select *, count(*) over f as n_rows, count(h) over f as n_images,
         lead(storm_event, 24) over (partition by series_id order by timestamp, event_id) as label,
         lead(timestamp, 24) over (partition by series_id order by timestamp, event_id) as label_time
  from marked
  window f as (partition by series_id order by timestamp, event_id rows between current row and 23 following))"""

_LABELLED = "where n_images = 24 and label is not null"

LATEST = """latest as (
  select series_id, timestamp, max(path) as path, arg_max(pixels, path) as pixels, arg_max(vec_id, path) as vec_id
  from imagery group by series_id, timestamp)"""

BATCHED = """batched as (
  select *, (row_number() over (order by md5(concat('42:', cast(event_id as varchar))), event_id) - 1) // 32 as batch_id
  from preds),
ranked as (
  select *, count(*) filter (y = 0) over (partition by batch_id order by p
                                          range between unbounded preceding and current row) as neg_upto,
         count(*) filter (y = 0) over (partition by batch_id, p) as neg_at
  from batched),
per_batch as (
  select batch_id, count(*) as n,
         avg(-(y * greatest(ln(p), -100e0) + (1e0 - y) * greatest(ln(1e0 - p), -100e0))) as loss,
         avg(case when (p > 0.5) = (y = 1) then 1e0 else 0e0 end) as accuracy,
         case when sum(y) = 0 or sum(y) = count(*) then 0e0
              else sum(case when y = 1 then neg_upto - neg_at / 2e0 end) / (sum(y) * (count(*) - sum(y)))
         end as auc
  from ranked group by batch_id)"""

SHOWN = ", ".join(f"round({f}, 6) as {f}" for f in FEATURES)


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def _scores(by: str = "") -> str:
    """Per distinct score: positives and negatives there and below."""
    part = f"partition by {by} " if by else ""
    cols = f"{by}, " if by else ""
    return f"""scores as (
  select {cols}p, sum(y) as pos, count(*) - sum(y) as neg from preds group by {cols}p),
below as (
  select *, coalesce(sum(neg) over ({part}order by p rows between unbounded preceding and 1 preceding), 0) as neg_below,
         sum(pos) over ({part}order by p desc) as tp, sum(neg) over ({part}order by p desc) as fp,
         sum(pos) over ({f'partition by {by}' if by else ''}) as all_pos,
         sum(neg) over ({f'partition by {by}' if by else ''}) as all_neg
  from scores)"""


AUC = """case when max(all_pos) = 0 or max(all_neg) = 0 then 0e0
 else sum(cast(pos as double) * (neg_below + neg / 2e0)) / (cast(max(all_pos) as double) * max(all_neg)) end"""

POINTWISE = """count(*) filter (p > 0.5 and y = 1) as tp, count(*) filter (p > 0.5 and y = 0) as fp,
 count(*) filter (p <= 0.5 and y = 1) as fn, count(*) filter (p <= 0.5 and y = 0) as tn,
 avg(case when (p > 0.5) = (y = 1) then 1e0 else 0e0 end) as accuracy,
 avg(-(y * greatest(ln(p), -100e0) + (1e0 - y) * greatest(ln(1e0 - p), -100e0))) as loss,
 avg((p - y) * (p - y)) as brier, count(*) as n"""

RATIOS = """round(case when tp + fp = 0 then 0e0 else cast(tp as double) / (tp + fp) end, 6) as precision,
 round(case when tp + fn = 0 then 0e0 else cast(tp as double) / (tp + fn) end, 6) as recall,
 round(case when 2 * tp + fp + fn = 0 then 0e0 else 2e0 * tp / (2 * tp + fp + fn) end, 6) as f1"""

_NAME = """case when vec_id % 10 = 0 then strftime(timestamp '2024-01-01' + to_hours(vec_id), '%Y%m%d')
 else strftime(timestamp '2024-01-01' + to_hours(vec_id), '%Y%m%d_%H%M%S') end || '_v' || vec_id"""
_FILE_TIME = """date_trunc(case when vec_id % 10 = 0 then 'day' else 'hour' end, timestamp '2024-01-01' + to_hours(vec_id))"""

_PIXELS = "select vec_id, unnest(range(len(embedding))) as pos, cast(unnest(embedding) as double) as x from embeddings"

_POOLED = ",\n ".join(
    f"round({fn}({f}) over f, 6) as {kind}_{f}"
    for kind, fn in (("mean", "avg"), ("min", "min"), ("max", "max"), ("last", "last_value"))
    for f in FEATURES
)
# cell c of a 2 x 2 raster on 8 x 8 pixels: rows 4*(c//2)..+3, columns 4*(c%2)..+3
_CELLS = ", ".join(
    f"list_avg(list_transform(range(16), lambda i: cast(pixels[8 * ({4 * (c // 2)} + i // 4) + {4 * (c % 2)} + i % 4 + 1]"
    f" as double))) as cell_{c}"
    for c in range(4)
)
_MEAN_CELLS = ", ".join(f"round(avg(cell_{c}) over f, 6) as mean_cell_{c}" for c in range(4))

_SCALED = ", ".join(f"(o.{f} - m.{f}_mean) / m.{f}_scale as {f}" for f in FEATURES)
_WIDE = ", ".join(
    f"avg({f}) as {f}_mean, case when stddev_pop({f}) = 0 then 1e0 else stddev_pop({f}) end as {f}_scale" for f in FEATURES
)
SCALED = f"wide as (select {_WIDE} from obs), scaled as (select o.series_id, o.timestamp, o.event_id, o.storm_event, {_SCALED} from obs o, wide m)"
SERIES_SCALED = (
    f"wide as (select series_id, {_WIDE} from obs group by series_id), scaled as (select o.series_id, o.event_id, {_SCALED}"
    " from obs o join wide m on o.series_id = m.series_id)"
)

_TRAILING = """ending as (
  select series_id, event_id, avg(temperature) over f as mt, avg(humidity) over f as mh, count(*) over f as n
  from obs
  window f as (partition by series_id order by timestamp, event_id rows between 23 preceding and current row))"""

_EARLY = """hh as materialized (select * from history),
fold as (
  select run, cast(0 as bigint) as epoch, 'infinity'::double as best, cast(-1 as bigint) as be, 0 as c,
         cast(-1 as bigint) as stop
  from (select distinct run from hh)
  union all
  select s.run, h.epoch,
         case when h.val_loss < s.best - 0.001e0 then h.val_loss else s.best end,
         case when h.val_loss < s.best - 0.001e0 then h.epoch else s.be end,
         case when h.val_loss < s.best - 0.001e0 then 0 else s.c + 1 end,
         case when not (h.val_loss < s.best - 0.001e0) and s.c + 1 >= 10 then h.epoch else -1 end
  from fold s join hh h on h.run = s.run and h.epoch = s.epoch + 1 where s.stop < 0),
stopped as (
  select run, arg_max(be, epoch) as best_epoch, arg_max(best, epoch) as best_loss, arg_max(stop, epoch) as stop_epoch
  from fold group by run)"""

ORACLES: dict[str, str] = {
    "a1_read_csv": _with(OBS)
    + f"select series_id, epoch_us(timestamp) as time_us, event_id, {SHOWN}, storm_event from obs",
    "a2_timestamp_coercion": """select event_id, epoch_us(ts) as strict_us,
 case when event_id % 7 = 0 then -1 else epoch_us(ts) end as lenient_us from events""",
    "a3_read_images": f"""with p as ({_PIXELS}), t as (select vec_id, {_FILE_TIME} as t from embeddings)
select p.vec_id, epoch_us(t.t) as time_us, p.pos, round(p.x, 6) as pixel from p join t on p.vec_id = t.vec_id""",
    "a3_packed_images": f"""with p as ({_PIXELS}), t as (select vec_id, {_FILE_TIME} as t from embeddings)
select p.vec_id, case when p.vec_id % 3 = 0 then 2 else 1 end as run, epoch_us(t.t) as time_us, p.pos, round(p.x, 6) as pixel
from p join t on p.vec_id = t.vec_id""",
    "a4_file_time": """select event_id,
 epoch_us(date_trunc(case when event_id % 10 = 0 then 'day' else 'second' end, ts)) as full_us,
 epoch_us(date_trunc('day', ts)::timestamp) as token_us from events""",
    "a5_decode_requests": _with(OBS, REQUESTS)
    + "select event_id as request_id, reason, "
    + ", ".join(f"case when reason = 'ok' then round({f}, 6) else -1e0 end as {f}" for f in FEATURES)
    + ", case when reason = 'ok' then round(cast(cast(temperature as float) as double), 3) else -1e0 end as pixel from requests",
    "a5_decode_sequences": _with(OBS)
    + f"select event_id, 3 as steps, round(3 * ({' + '.join(FEATURES)}), 6) as total from obs",
    "a6_encode_responses": _with(PREDS)
    + "select event_id, round(p, 6) as prediction, round(p, 6) as probability from preds",
    "a7_scaler_state": _with(OBS, FIT) + "select feature, round(mean, 6) as mean, round(scale, 6) as scale, n from fit",
    "a9_quarantine": _with(OBS, REQUESTS) + "select reason, count(*) as n from requests group by reason",
    "b1_feature_vector": _with(OBS)
    + " union all ".join(
        f"select event_id, {i} as pos, round(cast({f} as double), 6) as value from obs" for i, f in enumerate(FEATURES)
    ),
    "b2_present_columns": _with(OBS, SCALED)
    + "select event_id, "
    + ", ".join(f"round({f}, 6) as {f}" for f in FEATURES if f not in ("humidity", "visibility"))
    + " from scaled",
    "b3_image_standardise": f"""with p as ({_PIXELS})
select vec_id, pos, round((x - avg(x) over v) / stddev_samp(x) over v, 6) as value from p
window v as (partition by vec_id)""",
    "b4_pixel_scale": f"with p as ({_PIXELS}) select vec_id, pos, round(cast(cast(x / 255 as float) as double), 6) as value from p",
    "b5_sequence_standardise": f"""with p as ({_PIXELS})
select vec_id, pos, round((x - avg(x) over v) / stddev_pop(x) over v, 6) as value from p
window v as (partition by vec_id)""",
    "b6_snapshot_sequence": _with(OBS)
    + f"select event_id, 24 as steps, 8 as width, round(24 * ({' + '.join(FEATURES)}), 6) as total from obs",
    "b7_threshold": _with(PREDS)
    + "select event_id, cast(p >= 0.5 as int) as scored, cast(p > 0.5 as int) as evaluated, round(p, 6) as unchanged from preds",
    "b8_label_cast": _with(OBS) + "select event_id, cast(storm_event as double) as label from obs",
    "b9_suffix_filter": f"select {_NAME} || '.npy' as name from embeddings",
    "c1_time_join": _with(OBS, IMAGERY)
    + """select series_id, event_id, cast(exists (select 1 from imagery i
 where i.series_id = obs.series_id and i.timestamp = obs.timestamp) as int) as has_image from obs""",
    "c2_latest_image": _with(IMAGERY, LATEST)
    + """select series_id, epoch_us(timestamp) as time_us, path,
 round(list_sum(list_transform(pixels, lambda x: cast(x as double))), 5) as pixel_sum from latest""",
    "c3_apply_scaler": _with(OBS, SCALED) + f"select event_id, {SHOWN} from scaled",
    "c3_apply_series_scaler": _with(OBS, SERIES_SCALED) + f"select series_id, event_id, {SHOWN} from scaled",
    "c4_window_images": _with(OBS, IMAGERY, LATEST, FRAMES)
    + """, numbered as (
  select *, row_number() over (partition by series_id order by timestamp, event_id) as rn from framed)
select w.series_id, w.event_id, cast(r.rn - w.rn as int) as pos,
       round(list_sum(list_transform(l.pixels, lambda x: cast(x as double))), 5) as pixel_sum
from numbered w
join numbered r on r.series_id = w.series_id and r.rn between w.rn and w.rn + 23
join latest l on l.series_id = r.series_id and l.timestamp = r.timestamp
where w.n_images = 24 and w.label is not null""",
    "d1_fit_scaler": _with(OBS, FIT) + "select feature, round(mean, 6) as mean, round(scale, 6) as scale, n from fit",
    "d1_fit_series_scaler": _with(OBS)
    + " union all ".join(
        f"select series_id, '{f}' as feature, round(avg({f}), 6) as mean,"
        f" round(case when stddev_pop({f}) = 0 then 1e0 else stddev_pop({f}) end, 6) as scale, count({f}) as n"
        " from obs group by series_id"
        for f in FEATURES
    ),
    "d2_accuracy": _with(PREDS) + f"select round(accuracy, 6) as accuracy from (select {POINTWISE} from preds)",
    "d3_log_loss": _with(PREDS) + f"select round(loss, 6) as loss from (select {POINTWISE} from preds)",
    "d4_roc_auc": _with(PREDS, _scores()) + f"select round({AUC}, 6) as auc from below",
    "d4_roc_auc_by_series": _with(PREDS, _scores("user_id"))
    + f"select user_id, round({AUC}, 6) as auc from below group by user_id",
    "d5_batch_metrics": _with(PREDS, BATCHED)
    + "select batch_id, n, round(loss, 6) as loss, round(accuracy, 6) as accuracy, round(auc, 6) as auc from per_batch",
    "d5_mean_over_batches": _with(PREDS, BATCHED)
    + """select count(*) as batches, round(avg(loss), 6) as loss, round(avg(accuracy), 6) as accuracy,
 round(avg(auc), 6) as auc, round(sum(loss * n) / sum(n), 6) as row_loss,
 round(sum(accuracy * n) / sum(n), 6) as row_accuracy from per_batch""",
    "d6_confusion": _with(PREDS) + f"select tp, fp, fn, tn, {RATIOS} from (select {POINTWISE} from preds)",
    "d6_pointwise_by_series": _with(PREDS)
    + f"""select user_id, n, tp, fp, fn, tn, round(accuracy, 6) as accuracy, round(loss, 6) as loss,
 round(brier, 6) as brier, {RATIOS} from (select user_id, {POINTWISE} from preds group by user_id)""",
    "d7_brier": _with(PREDS) + f"select round(brier, 6) as brier from (select {POINTWISE} from preds)",
    "d8_calibration": _with(PREDS)
    + """select least(cast(floor(p * 10) as int), 9) as bin, count(*) as n, round(avg(p), 6) as mean_p,
 round(avg(y), 6) as observed_rate from preds group by 1""",
    "d8_calibration_error": _with(PREDS)
    + """select round(sum(abs(mp - r) * n) / sum(n), 6) as ece from
 (select least(cast(floor(p * 10) as int), 9) as bin, count(*) as n, avg(p) as mp, avg(y) as r from preds group by 1)""",
    "d9_average_precision": _with(PREDS, _scores())
    + "select round(sum(cast(pos as double) / all_pos * (cast(tp as double) / (tp + fp))), 6) as average_precision from below",
    "d9_precision_recall_curve": _with(
        "preds as (select value / 1000 as p, case when event_type = 'error' then 1 else 0 end as y from events)", _scores()
    )
    + """select round(p, 6) as threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp,
 round(cast(tp as double) / (tp + fp), 6) as precision, round(cast(tp as double) / all_pos, 6) as recall from below""",
    "d10_class_balance": _with(OBS)
    + """, ranked as (
  select *, row_number() over (order by md5(concat('42:', cast(event_id as varchar)))) as r, count(*) over () as n from obs)
select case when r <= floor(n * 0.8e0) then 'train' when r <= floor(n * 0.8e0) + floor(n * 0.1e0) then 'val' else 'test' end
 as split, storm_event, count(*) as n from ranked group by 1, 2""",
    "e1_series_position": _with(OBS)
    + "select series_id, event_id, row_number() over (partition by series_id order by timestamp, event_id) - 1 as pos from obs",
    "e2_sliding_windows": _with(OBS)
    + f"""numbered as (select *, row_number() over (partition by series_id order by timestamp, event_id) as rn,
  count(*) over (partition by series_id) as n from obs)
select w.series_id, w.event_id, cast(r.rn - w.rn as int) as step, {", ".join(f"round(r.{f}, 6) as {f}" for f in FEATURES)}
from numbered w join numbered r on r.series_id = w.series_id and r.rn between w.rn and w.rn + 23
where w.rn + 24 <= w.n""".replace("numbered as", ", numbered as", 1),
    "e3_complete_windows": _with(OBS, IMAGERY)
    + """, k as (select distinct series_id, timestamp, 1 as h from imagery),
j as (select o.*, k.h from obs o left join k on o.series_id = k.series_id and o.timestamp = k.timestamp),
w as (select series_id, event_id, count(h) over f as n, avg(temperature) over f as m,
             lead(storm_event, 24) over (partition by series_id order by timestamp, event_id) as y
      from j
      window f as (partition by series_id order by timestamp, event_id rows between current row and 23 following))
select series_id, event_id, round(m, 6) as mean_temperature, y as label from w where n = 24 and y is not null""",
    "e4_next_label": _with(OBS, IMAGERY, FRAMES)
    + "select series_id, event_id, epoch_us(label_time) as label_us, label from framed where label_time is not null",
    "e5_image_cells": """with c as (
  select vec_id, unnest(range(64)) as k, cast(unnest(embedding) as double) as x from embeddings)
select vec_id, cast((k // 8 * 3 // 8) * 3 + (k % 8) * 3 // 8 as int) as pos, round(avg(x), 6) as value from c group by 1, 2""",
    "e5_pool_and_fuse": _with(OBS, IMAGERY, LATEST)
    + f""", cells as (select series_id, timestamp, {_CELLS} from latest),
j as (select o.*, c.* exclude (series_id, timestamp), c.series_id is not null as has from obs o
      left join cells c on o.series_id = c.series_id and o.timestamp = c.timestamp),
w as (select series_id, event_id, count(*) filter (has) over f as n,
      lead(storm_event, 24) over (partition by series_id order by timestamp, event_id) as label, {_POOLED}, {_MEAN_CELLS}
      from j
      window f as (partition by series_id order by timestamp, event_id rows between current row and 23 following))
select * exclude (n) from w where n = 24 and label is not null""",
    "e6_one_giant_series": _with(OBS)
    + """, w as (select event_id, round(avg(temperature) over f, 6) as mean_temperature,
  round(avg(humidity) over f, 6) as mean_humidity, lead(storm_event, 24) over (order by timestamp, event_id) as label
  from obs window f as (order by timestamp, event_id rows between current row and 23 following))
select * from w where label is not null""",
    "f1_random_split": _with(OBS)
    + """, ranked as (
  select event_id, row_number() over (order by md5(concat('42:', cast(event_id as varchar)))) as r, count(*) over () as n
  from obs)
select event_id, case when r <= floor(n * 0.8e0) then 'train' when r <= floor(n * 0.8e0) + floor(n * 0.1e0) then 'val'
 else 'test' end as split from ranked""",
    "f2_head_split": _with(OBS)
    + """, ranked as (select event_id, row_number() over (order by timestamp, event_id) as r, count(*) over () as n from obs)
select event_id, case when r <= floor(n * 0.8e0) then 'train' else 'val' end as split from ranked""",
    "f2_series_head_split": _with(OBS)
    + """, ranked as (select series_id, event_id, row_number() over (partition by series_id order by timestamp, event_id) as r,
  count(*) over (partition by series_id) as n from obs)
select series_id, event_id, case when r <= floor(n * 0.8e0) - 2 then 'train' when r <= floor(n * 0.8e0) then 'gap'
 else 'val' end as split from ranked""",
    "f2_window_gap_split": _with(OBS, IMAGERY, FRAMES)
    + """, win as (select *, row_number() over (order by timestamp, event_id) as r, count(*) over () as n
  from framed where n_images = 24 and label is not null),
cut as (select min(timestamp) as t from win where r > floor(n * 0.8e0))
select series_id, event_id, case when r > floor(n * 0.8e0) then 'val' when label_time >= cut.t then 'gap' else 'train' end
 as split from win, cut""",
    "f3_shuffled_batches": _with(OBS)
    + """select event_id, (row_number() over (order by md5(concat('42:', cast(event_id as varchar)))) - 1) // 32 as batch_id
 from obs""",
    "f3_ordered_batches": _with(OBS)
    + "select event_id, (row_number() over (order by timestamp, event_id) - 1) // 32 as batch_id from obs",
    "f4_samples_at": _with(OBS)
    + """select * from (select row_number() over (order by timestamp, event_id) - 1 as sample_idx, event_id,
 round(temperature, 6) as temperature from obs) where sample_idx in (0, 7, 31, 500, 999, 1000000000)""",
    "g3_linear_score": _with(OBS, IMAGERY, SCALED)
    + """, k as (select distinct series_id, timestamp, 1 as h from imagery),
j as (select o.*, k.h from scaled o left join k on o.series_id = k.series_id and o.timestamp = k.timestamp),
w as (select series_id, event_id, count(h) over f as n, avg(temperature) over f as mt, max(humidity) over f as xh,
             last_value(pressure) over f as lp,
             lead(storm_event, 24) over (partition by series_id order by timestamp, event_id) as y
      from j
      window f as (partition by series_id order by timestamp, event_id rows between current row and 23 following)),
s as (select *, 1e0 / (1e0 + exp(-(-0.25e0 + 0.75e0 * mt - 0.5e0 * xh + 0.125e0 * lp))) as p
      from w where n = 24 and y is not null)
select series_id, event_id, round(p, 6) as p, cast(p >= 0.5 as int) as decision from s""",
    "g5_early_stopping": "with recursive "
    + HISTORY
    + ", "
    + _EARLY
    + " select run, best_epoch, stop_epoch from stopped",
    "g6_best_checkpoint": "with recursive "
    + HISTORY
    + ", "
    + _EARLY
    + """ select s.run, s.best_epoch, m.min_epoch, round(s.best_loss, 6) as best_loss, round(m.min_loss, 6) as min_loss
from stopped s join (select run, min(val_loss) as min_loss, arg_min(epoch, struct_pack(l := val_loss, e := epoch)) as min_epoch
 from hh group by run) m on s.run = m.run""",
    "g7_epoch_report": _with(HISTORY)
    + """select run, cast(epoch as int) as epoch, round(val_loss, 6) as val_loss,
 round(coalesce(val_loss - lag(val_loss) over w, 0e0), 6) as delta,
 round(min(val_loss) over (partition by run order by epoch), 6) as best_so_far
from history window w as (partition by run order by epoch)""",
    "h1_stream_scoring": _with(OBS, REQUESTS, SCALED)
    + """, s as (select r.event_id, r.reason,
  1e0 / (1e0 + exp(-(-0.25e0 + 0.75e0 * s.temperature - 0.5e0 * s.humidity + 0.125e0 * s.pressure))) as p
  from requests r join scaled s on r.event_id = s.event_id)
select event_id as request_id, reason, case when reason = 'ok' then round(p, 6) else -1e0 end as p,
 case when reason = 'ok' then round(p, 6) else -1e0 end as probability,
 case when reason = 'ok' then cast(p >= 0.5 as int) else -1 end as decision from s""",
    "h1_sequence_scoring": _with(OBS, f"wide as (select {_WIDE} from obs)")
    + """, s as (select o.event_id,
  1e0 / (1e0 + exp(-(-0.25e0 + 0.75e0 * (o.temperature - m.temperature_mean) / m.temperature_scale
    - 0.5e0 * (o.humidity - m.humidity_mean) / m.humidity_scale
    + 0.125e0 * (o.pressure - m.pressure_mean) / m.pressure_scale))) as p,
  1e0 / (1e0 + exp(-(-0.25e0 + 0.75e0 * (2 * o.temperature - m.temperature_mean) / m.temperature_scale
    - 0.5e0 * (3 * o.humidity - m.humidity_mean) / m.humidity_scale
    + 0.125e0 * (3 * o.pressure - m.pressure_mean) / m.pressure_scale))) as p2
  from obs o, wide m)
select event_id as request_id, reason, case when reason = 'ok' then round(p, 6) end as p,
 case when reason = 'ok' then cast(p >= 0.5 as int) end as decision, case when reason = 'ok' then round(p, 6) end as first,
 case when reason = 'ok' then round(p2, 6) end as second
from (select *, case when event_id % 29 = 0 then 'empty_sequence' when event_id % 31 = 0 then 'missing_sequence'
  when event_id % 11 = 0 then 'wrong_width' when event_id % 13 = 0 then 'missing_value' when event_id % 17 = 0 then 'empty_sequence'
  when event_id % 19 = 0 then 'wrong_length' when event_id % 23 = 0 then 'empty_sequence' else 'ok' end as reason from s)""",
    "a8_model_state": _with(OBS, IMAGERY, FRAMES) + f"select series_id, event_id, 1 as same, 1 as decided from framed {_LABELLED}",
    "g1_fit_logistic": _with(OBS, IMAGERY, FRAMES) + f"select series_id, event_id, 1 as same, 1 as flat from framed {_LABELLED}",
    "g3_batch_score": _with(OBS, IMAGERY, FRAMES) + f"select series_id, event_id, 1 as same, 1 as decided from framed {_LABELLED}",
    "g2_boosted_trees": _with(OBS, IMAGERY, FRAMES.replace("count(*) over f as n_rows,", "count(*) over f as n_rows, avg(temperature) over f as m,"))
    + f""", r as (select cast(m > 50 as int) as label, count(*) over () as total,
  row_number() over (order by md5(concat('42:', cast(series_id as varchar), ':', cast(event_id as varchar)))) as r from framed {_LABELLED})
select case when r <= floor(total * 0.8e0) then 'train' when r <= floor(total * 0.8e0) + floor(total * 0.1e0) then 'val' else 'test' end as split,
 label, count(*) as n, 1 as learned from r group by 1, 2""",
    "g4_search": "select cast(t as int) as trial, 1 as chosen, 1 as repeated from range(8) as r(t)",
    "g8_train_and_evaluate": _with(OBS, IMAGERY, FRAMES)
    + """, win as (select *, row_number() over (order by timestamp, event_id) as r, count(*) over () as total
  from framed where n_images = 24 and label is not null),
cut as (select min(timestamp) as t from win where r > floor(total * 0.8e0))
select case when r > floor(total * 0.8e0) then 'val' when label_time >= cut.t then 'gap' else 'train' end as split, count(*) as n, 1 as sound
from win, cut group by 1""",
    "h2_stream_windows": _with(OBS, _TRAILING)
    + "select series_id, event_id, round(mt, 6) as mean_temperature, round(mh, 6) as mean_humidity from ending where n = 24",
    "h3_stream_window_scores": _with(OBS, _TRAILING)
    + """, s as (select *, 1e0 / (1e0 + exp(-(-1e0 + 0.0625e0 * mt - 0.03125e0 * mh))) as p from ending where n = 24)
select series_id, event_id, round(p, 6) as p, cast(p >= 0.5 as int) as decision from s""",
}
ORACLES["h3_stream_image_windows"] = ORACLES["e3_complete_windows"]
ORACLES["h3_stream_model_scores"] = (
    _with(OBS, _TRAILING) + "select series_id, event_id, round(mt, 6) as mean_temperature, 1 as same, 1 as decided from ending where n = 24"
)
ORACLES["h1_model_sequences"] = (
    ORACLES["e3_complete_windows"].split("select series_id, event_id, round(m, 6)")[0].replace(", 24)", ", 6)").replace("23 following", "5 following")
    + "select series_id, event_id, family, 1 as same, 1 as decided from w, (values ('logistic'), ('trees')) as f(family) where n = 6 and y is not null"
)
ORACLES["g4_halving_search"] = "select cast(i as int) as trial, 1 as same, 1 as chosen, 3 as finished from range(20) as r(i)"
ORACLES["g5_stopped_fits"] = "select family, 1 as kept_state, 1 as learned, 1 as ended from (values ('logistic'), ('trees')) as f(family)"
