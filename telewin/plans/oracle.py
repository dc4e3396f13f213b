"""The same results in SQL over the same parquet tables."""

from telewin.operators.windows import HALF_MINUTE_MS, MINUTE_MS, grace_ms
from telewin.functions.partitioning import MULTIPLIER, SEED
from telewin.plans.catalog import OUTPUT_PARTITIONS, OUTPUT_TOPIC
from telewin.sources.tables import LATE_SHIFT_MS, PARTITIONS, VIEW_SPEEDUP, VIEW_START_MS

_RAW = f"""
raw as (
  select event_id as off,
         cast((user_id % 10) % 4 as bigint) as part,
         cast((user_id % 10 + length(event_type)) % 4 as bigint) as rpart,
         'ep-' || lpad(cast(user_id % 10 as varchar), 2, '0') as ep,
         '/' || event_type as path,
         epoch_us(ts) // 1000 as raw_ms,
         {VIEW_START_MS} + (epoch_us(ts) // 1000 - {VIEW_START_MS}) // {VIEW_SPEEDUP} as ts_ms,
         case when event_type in ('click', 'view')
              then cast(json_extract_string(props, '$.k') as bigint) end as lng,
         case when event_type not in ('click', 'view') then value end as dbl
  from events
)"""

_OBS = f"""{_RAW},
obs as (
  select *, coalesce(cast(lng as double), dbl) as v, ep || '.' || path as ep_path from raw
)"""

_BAD = f"""{_RAW},
bad as (
  select off,
         case when off % 101 <> 0 then ep end as ep,
         case when off % 103 = 0 then -1 else ts_ms end as ts_ms,
         case when off % 107 <> 0 then path end as path
  from raw
),
kept as (select * from bad where ep is not null and ts_ms >= 0)"""

_NAN = f"""{_RAW},
readings as (
  select *, ep || '.' || path as ep_path,
         case when lng is not null then cast(lng as double)
              when off % 11 = 0 then cast('NaN' as double) else dbl end as v
  from raw
)"""


# The producer's hash of the JSON key, step by step; unsigned numbers below 2**32.
_HASHED = f"""{_RAW},
names as (
  select ep_path, list_transform(string_split('{{"ep":"' || ep_path || '"}}', ''), lambda c: cast(ascii(c) as bigint)) as b
  from (select distinct ep || '.' || path as ep_path from raw)
),
words as (
  select ep_path, b, len(b) // 4 * 4 as whole,
         list_transform(range(len(b) // 4), lambda i: b[4 * i + 1] + 256 * b[4 * i + 2] + 65536 * b[4 * i + 3] + 16777216 * b[4 * i + 4]) as w
  from names
),
mixed as (
  select *, list_transform(list_transform(w, lambda k: k * {MULTIPLIER} % 4294967296),
                           lambda k: xor(k, k // 16777216) * {MULTIPLIER} % 4294967296) as m
  from words
),
reduced as (
  select ep_path, list_reduce(m, lambda h, k: xor(h * {MULTIPLIER} % 4294967296, k), xor(cast({SEED} as bigint), len(b))) as h,
         case when len(b) > whole
              then b[whole + 1] + 256 * coalesce(b[whole + 2], 0) + 65536 * coalesce(b[whole + 3], 0) end as tail
  from mixed
),
tailed as (
  select ep_path, case when tail is null then h else xor(h, tail) * {MULTIPLIER} % 4294967296 end as h from reduced
),
stirred as (select ep_path, xor(h, h // 8192) * {MULTIPLIER} % 4294967296 as h from tailed),
hashes as (select ep_path, xor(h, h // 32768) % 2147483648 as h from stirred)"""


def _late_hashed(size_ms: int) -> str:
    return f"""{_HASHED},
shifted as (
  select off, raw.ep, raw.path, hashes.ep_path, h, h % {PARTITIONS} as hpart,
         coalesce(cast(lng as double), dbl) as v,
         raw_ms - case when off % 97 = 0 then {LATE_SHIFT_MS} else 0 end as ts_ms
  from raw join hashes on hashes.ep_path = raw.ep || '.' || raw.path
),
flagged as (
  select *, ts_ms // {size_ms} * {size_ms} + {size_ms}
            <= max(ts_ms) over (partition by hpart order by off
                                rows between unbounded preceding and current row)
               - {grace_ms(size_ms)} as late
  from shifted
)"""


def _late(size_ms: int, part: str) -> str:
    return f"""{_RAW},
shifted as (
  select off, part, rpart, ep, path, ep || '.' || path as ep_path,
         coalesce(cast(lng as double), dbl) as v,
         raw_ms - case when off % 97 = 0 then {LATE_SHIFT_MS} else 0 end as ts_ms
  from raw
),
flagged as (
  select *, ts_ms // {size_ms} * {size_ms} + {size_ms}
            <= max(ts_ms) over (partition by {part} order by off
                                rows between unbounded preceding and current row)
               - {grace_ms(size_ms)} as late
  from shifted
)"""


def _bounds(size_ms: int) -> str:
    start = f"ts_ms // {size_ms} * {size_ms}"
    return f"{start} as window_start_ms, {start} + {size_ms} as window_end_ms"


def _count(name: str, source: str, ctes: str, where: str = "true") -> str:
    return f"""with {ctes}
select {name}, {_bounds(MINUTE_MS)}, count(*) as n
from {source} where {where} group by all"""


def _best(source: str, ctes: str, columns: str, where: str = "true") -> str:
    return f"""with {ctes},
ranked as (
  select *, row_number() over (partition by ep_path, ts_ms // {HALF_MINUTE_MS}
                               order by v desc, off desc) as place
  from {source} where {where}
)
select ep_path, {_bounds(HALF_MINUTE_MS)}, {columns} from ranked where place = 1"""


_WINNER = "ts_ms, v, path || '-max' as path, path || '-max' as value_path"

_SCAN = f"""with {_OBS}
select off, part, ep, path, ts_ms, v, lng is not null as is_long from obs"""

_BOTH = f"""with {_OBS}
select 'ep' as level, ep as name, {_bounds(MINUTE_MS)}, count(*) as n from obs group by all
union all
select 'ep_path' as level, ep_path as name, {_bounds(MINUTE_MS)}, count(*) as n
from obs group by all"""

_NAN_BEST = f"""with {_NAN},
marked as (
  select *,
         max(case when isnan(v) then off end) over g as ln,
         max(off) over g as lo
  from readings
  window g as (partition by ep_path, ts_ms // {HALF_MINUTE_MS})
),
ranked as (
  select *, row_number() over (partition by ep_path, ts_ms // {HALF_MINUTE_MS}
                               order by v desc, off desc) as place
  from marked
  where ln is null or off > ln or (off = ln and ln = lo)
)
select ep_path, {_bounds(HALF_MINUTE_MS)}, off, isnan(v) as is_nan,
       case when isnan(v) then -1.0 else v end as v_or_minus_one
from ranked where place = 1"""


def _assign(size_ms: int) -> str:
    return f"with {_OBS} select off, {_bounds(size_ms)} from obs"


def _count_updates(name: str) -> str:
    return f"""with {_OBS}
select {name}, {_bounds(MINUTE_MS)}, off,
       count(*) over (partition by {name}, ts_ms // {MINUTE_MS} order by off
                      rows between unbounded preceding and current row) as n
from obs"""


_MAX_UPDATES = f"""with {_OBS},
running as (
  select *, max(struct_pack(v := v, o := off)) over (
              partition by ep_path, ts_ms // {HALF_MINUTE_MS} order by off
              rows between unbounded preceding and current row) as best
  from obs
)
select ep_path, {_bounds(HALF_MINUTE_MS)}, off, best.o as best_off, best.v as best_v,
       path || '-max' as path, path || '-max' as value_path
from running"""

# A NaN opens a segment; inside its segment it loses to whatever follows.
_NAN_UPDATES = f"""with {_NAN},
segments as (
  select *, sum(case when isnan(v) then 1 else 0 end) over (
              partition by ep_path, ts_ms // {HALF_MINUTE_MS} order by off
              rows between unbounded preceding and current row) as segment
  from readings
),
running as (
  select *, max(struct_pack(r := case when isnan(v) then '-infinity'::double else v end, o := off, v := v)) over (
              partition by ep_path, ts_ms // {HALF_MINUTE_MS}, segment order by off
              rows between unbounded preceding and current row) as best
  from segments
)
select ep_path, {_bounds(HALF_MINUTE_MS)}, off, best.o as best_off, isnan(best.v) as best_is_nan,
       case when isnan(best.v) then -1.0 else best.v end as best_v_or_minus_one,
       path || '-max' as path, path || '-max' as value_path
from running"""

_KEYS = f"""with {_OBS},
keys as (select distinct ep_path, {_bounds(HALF_MINUTE_MS)} from obs)"""

_COUNT_EP = _count("ep", "obs", _OBS)
_COUNT_PATH = _count("ep_path", "obs", _OBS)
_MAX = _best("obs", _OBS, f"off, {_WINNER}")
_LATE_PATH = _count("ep_path", "flagged", _late(MINUTE_MS, "rpart"), "not late")
_LATE_MAX = _best("flagged", _late(HALF_MINUTE_MS, "rpart"), f"off, {_WINNER}", "not late")
_LATE_EP = _count("ep", "flagged", _late(MINUTE_MS, "part"), "not late")

ORACLE: dict[str, str] = {
    "count_by_ep_1m": _COUNT_EP,
    "count_by_ep_path_1m": _COUNT_PATH,
    "count_both_levels_1m": _BOTH,
    "max_by_ep_path_30s": _MAX,
    "max_by_ep_path_30s_nan_replay": _NAN_BEST,
    "updates_count_by_ep_1m": _count_updates("ep"),
    "updates_count_by_ep_path_1m": _count_updates("ep_path"),
    "updates_max_by_ep_path_30s": _MAX_UPDATES,
    "updates_max_by_ep_path_30s_nan_replay": _NAN_UPDATES,
    "observations_scan": _SCAN,
    "wire_frame_decode": f"""with {_OBS}
select off, cast(length(path) as bigint) * 256 + 7 as schema_id, path from obs""",
    "event_time_extract": f"with {_OBS} select off, ts_ms * 1000 as event_time_us from obs",
    "valid_records_filter": f"with {_BAD} select off, ep, ts_ms from kept",
    "resource_extract": f"""with {_OBS}
select off, path, coalesce(cast(lng as varchar), 'null') as lng_text,
       coalesce(dbl, -1.0) as dbl_or_minus_one
from obs""",
    "numeric_value": f"with {_OBS} select off, v from obs",
    "rekey_ep_path": f"""with {_BAD}
select off, coalesce(ep, 'null') || '.' || coalesce(path, 'null') as ep_path, ts_ms from kept""",
    "map_max_path": f"""with {_OBS}
select off, ep_path, path || '-max' as value_path, path || '-max' as resource_path, ts_ms, v
from obs""",
    "tumbling_assign_1m": _assign(MINUTE_MS),
    "tumbling_assign_30s": _assign(HALF_MINUTE_MS),
    "late_flag": f"with {_late(MINUTE_MS, 'part')} select off, part, late from flagged",
    "late_count_by_ep_1m": _LATE_EP,
    "late_count_by_ep_path_1m": _LATE_PATH,
    "late_max_by_ep_path_30s": _LATE_MAX,
    "windowed_key_encode": f"""{_KEYS}
select ep_path, window_start_ms,
       concat(hex(ep_path), format('{{:016X}}', window_start_ms)) as key_hex
from keys""",
    "windowed_key_decode": f"{_KEYS} select ep_path, window_start_ms, window_end_ms from keys",
    "publish_partition_colocation": f"""{_KEYS}
select ep_path, count(*) as n_windows, cast(1 as bigint) as n_partitions
from keys group by ep_path""",
    "publish_partition_by_key_hash": f"""with {_HASHED},
keys as (select distinct ep || '.' || path as name, ts_ms // {HALF_MINUTE_MS} as w from raw)
select ep_path, cast(any_value(h) % {OUTPUT_PARTITIONS} as integer) as "partition", count(*) as n_windows
from keys join hashes on name = ep_path group by ep_path""",
    "publish_max_30s": _best("obs", _OBS, f"'{OUTPUT_TOPIC}' as topic, {_WINNER}"),
    "stream_observations_scan": _SCAN,
    "stream_count_by_ep_1m": _COUNT_EP,
    "stream_count_by_ep_path_1m": _COUNT_PATH,
    "stream_count_both_levels_1m": _BOTH,
    "stream_max_by_ep_path_30s": _MAX,
    "compacted_count_by_ep_1m": _COUNT_EP,
    "compacted_count_by_ep_path_1m": _COUNT_PATH,
    "compacted_max_by_ep_path_30s": _MAX,
    "store_count_by_ep_1m": _COUNT_EP,
    "store_count_by_ep_path_1m": _COUNT_PATH,
    "store_max_by_ep_path_30s": _MAX,
    "stream_late_count_by_ep_1m": _LATE_EP,
    "stream_late_count_by_ep_path_1m": _LATE_PATH,
    "stream_late_max_by_ep_path_30s": _LATE_MAX,
    "stream_max_by_ep_path_30s_nan_replay": _NAN_BEST,
    "exact_job_counts_1m": f"""
select 'ep' as level, * rename (ep as name) from ({_LATE_EP})
union all
select 'ep_path' as level, * rename (ep_path as name)
from ({_count("ep_path", "flagged", _late_hashed(MINUTE_MS), "not late")})""",
    "exact_job_updates_count_by_ep_1m": f"""with {_late(MINUTE_MS, "part")}
select ep, {_bounds(MINUTE_MS)}, off,
       count(*) over (partition by ep, ts_ms // {MINUTE_MS} order by off
                      rows between unbounded preceding and current row) as n
from flagged where not late""",
    "exact_job_updates_max_by_ep_path_30s": _NAN_UPDATES,
    "exact_job_publish_max_30s": _best(
        "flagged",
        _late_hashed(HALF_MINUTE_MS),
        f"'{OUTPUT_TOPIC}' as topic, cast(h % {OUTPUT_PARTITIONS} as integer) as \"partition\", {_WINNER}",
        "not late",
    ),
}
