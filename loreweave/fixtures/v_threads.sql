select user_id % 10 as thread_id, event_id as turn, concat(event_type, ' ', cast(event_id % 7 as string)) as intent from events
