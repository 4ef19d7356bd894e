select case when cast(floor(event_id / 600) as bigint) % 2 = 0 then concat('A', cast(cast(floor(event_id / 60) as bigint) as string)) else concat('B', cast(cast(floor(event_id / 30) as bigint) as string)) end as commit_id,
 event_id as pos, concat('src/app/utils/part', regexp_extract(props, '([0-9]+)', 1), case when cast(regexp_extract(props, '([0-9]+)', 1) as int) % 3 = 0 then '.ts' else '.tsx' end) as path from events
