select user_id as job_id, event_id as seq, case event_type when 'signup' then 'queued' when 'purchase' then 'completed' when 'error' then 'failed' else 'processing' end as status,
 case event_type when 'signup' then 0 when 'purchase' then 100 when 'error' then 0 else cast(floor(value) as int) % 100 end as progress, concat('msg ', event_type) as message, ts from events
