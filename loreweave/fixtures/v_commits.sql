select concat('r', cast(o_orderkey % 4 as string)) as repo_id, o_orderkey as seq, md5(cast(o_orderkey as string)) as hexsha,
 case when o_custkey % 10 = 0 then null else concat('dev', cast(o_custkey as string)) end as author, concat('  ', o_orderpriority, ' ') as message, repeat(md5(cast(o_custkey as string)), 100) as diff from orders
