select o_orderkey as intent_id, case when o_orderkey % 17 = 0 then 'sorry, no json' when o_orderkey % 3 = 0 then concat('```json', chr(10), body, chr(10), '```') when o_orderkey % 3 = 1 then concat('```', chr(10), body, chr(10), '```') else body end as reply
from (select l_orderkey as o_orderkey, concat('{"implicated_features":[', listagg(s, ',') within group (order by s), '],"clarification_needed":', case when l_orderkey % 11 = 0 then 'true' else 'false' end, ',"clarification_message":""}') as body
 from (select distinct l_orderkey, concat('"SRC', cast(l_partkey % 20 as string), '"') as s from lineitem) x group by l_orderkey) y
