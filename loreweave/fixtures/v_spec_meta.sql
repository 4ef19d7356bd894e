select spec_id, case when o_custkey % 20 = 19 then '{bad' else concat('{"spec_id":"', spec_id, '","entry_files":["', entry, '"],"related_files":[],"dependencies":[', listagg(dep, ',') within group (order by f), '],"tags":["nextjs"]}') end as meta_json
from (select o_custkey, concat('SPEC-', cast(o_custkey as string)) as spec_id, concat('src/app/api/g', cast(o_custkey % 20 as string), '/route.ts') as entry, f,
  concat('{"type":"util","name":"k', cast(l_partkey % 10 as string), '","file":"', f, '"}') as dep
  from (select distinct o_custkey, l_partkey, concat('src/app/utils/part', cast(l_partkey as string), case when l_partkey % 3 = 0 then '.ts' else '.tsx' end) as f from lineitem join orders on o_orderkey = l_orderkey) j) q
group by o_custkey, spec_id, entry
