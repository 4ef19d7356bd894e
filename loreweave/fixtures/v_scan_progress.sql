select user_id as job_id, event_id as seq, cast(floor(value) as int) % 60 - 5 as p from events
