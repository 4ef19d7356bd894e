select concat('r', cast(o_orderkey % 4 as string)) as repo_id,
       concat('src/app/api/g', cast(o_custkey % 20 as string), '/o', cast(o_orderkey as string), '/route.ts') as path,
       concat(listagg(line, chr(10)) within group (order by l_linenumber, line), chr(10),
         case when o_orderkey % 3 = 0 then concat('requireAuth(req);', chr(10)) else '' end,
         'export async function ', case when o_orderkey % 2 = 0 then 'POST' else 'GET' end, '(req) {}') as content
from (select l_orderkey, l_linenumber, concat('import { fn', cast(l_linenumber as string), ', x as y } from "@/app/utils/part', cast(l_partkey as string), '";') as line from lineitem) l
join orders on o_orderkey = l_orderkey group by o_orderkey, o_custkey
union all
select concat('r', cast(k as string)), concat('src/app/utils/part', cast(p_partkey as string), case when p_partkey % 3 = 0 then '.ts' else '.tsx' end),
       concat('export const part', cast(p_partkey as string), ' = 1;') from part cross join (values (0),(1),(2),(3)) t(k) where p_partkey % 3 < 2
union all
select concat('r', cast(c_custkey % 4 as string)), concat('services/cust', cast(c_custkey as string), '.py'),
       concat('from fastapi import APIRouter, Depends', chr(10), 'from utils.security import get_current_user', chr(10), 'import os', chr(10), 'def c', cast(c_custkey as string), '(x):', chr(10), '    return x', chr(10)) from customer
union all
select concat('r', cast(s_suppkey % 4 as string)), concat('lib/s', cast(s_suppkey as string), case s_suppkey % 6 when 0 then '.java' when 1 then '.rs' when 2 then '.rb' when 3 then '.go' when 4 then '.cs' else '.c' end),
       case s_suppkey % 6 when 0 then concat('import com.x.Svc', cast(s_suppkey as string), ';', chr(10), 'import java.util.List;')
         when 1 then concat('use crate::db::Pool;', chr(10), 'mod s', cast(s_suppkey as string), ';')
         when 2 then concat('require ''sinatra''', chr(10), 'require_relative ''ctl/s', cast(s_suppkey as string), '''')
         when 3 then concat('import (', chr(10), '  "fmt"', chr(10), '  "net/http"', chr(10), ')', chr(10), 'import "x/s', cast(s_suppkey as string), '"')
         when 4 then 'using System.Text;' else concat('#include <stdio.h>', chr(10), '#include "s', cast(s_suppkey as string), '.h"') end from supplier
union all select * from (values ('r0','next.config.ts','export default {};'), ('r1','requirements.txt','fastapi==0.1'), ('r2','package.json','{"dependencies":{"react":"18"}}'), ('r3','notes.txt','plain')) m(a,b,c)
union all select 'r0', concat('node_modules/n', cast(n_nationkey as string), '/index.js'), 'module.exports = 1;' from nation
union all select 'r0', concat('src/app/services/n', cast(n_nationkey as string), '.ts'), concat('export class N', cast(n_nationkey as string), ' {}', chr(10), 'export function f', cast(n_nationkey as string), '() {}') from nation
union all select 'r0', concat('src/app/config/r', cast(r_regionkey as string), '.ts'), 'export const cfg = 1;' from region
union all select 'r1', concat('mod', cast(r_regionkey as string), '/routes.py'), concat('def handler(x):', chr(10), '    return x', chr(10)) from region
union all select 'r3', concat('pkg', cast(r_regionkey as string), '/main.py'), 'import os' from region
