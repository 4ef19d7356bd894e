select event_type as spec_id, event_id, ts, value >= 20 as success from events
