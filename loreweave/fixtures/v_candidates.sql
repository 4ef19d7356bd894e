select concat('r', cast(l_orderkey % 4 as string)) as repo_id, concat('CAND-', cast(l_orderkey as string)) as spec_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos,
 case when l_partkey % 2 = 0 then concat('src/app/utils/part', cast(l_partkey as string), '.ts') else concat('wrong/dir/part', cast(l_partkey as string), '.tsx') end as path from lineitem
