select l_orderkey as job_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos, l_returnflag <> 'R' as success from lineitem
