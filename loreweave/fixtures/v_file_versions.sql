select concat('svc/u', cast(user_id as string), '.py') as path, event_id as commit_seq,
 concat('def setup():', chr(10), '    return 0', chr(10), chr(10), 'def on_', event_type, '(x):', chr(10), '    return x * ', cast(event_id % 3 as string), chr(10), chr(10), 'def k', cast(event_id % 10 as string), '(y):', chr(10), '    return y', chr(10),
   case when event_id % 25 = 0 then 'x = = 1' else '' end) as content from events
