select conv_id as thread_id, turn, concat(text, case when conv_id % 5 = 0 then concat(' about spec-', cast(conv_id as string)) else '' end) as intent from conversations where role = 'user'
