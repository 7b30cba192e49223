"""Lifecycle tables derived from the star-schema test data.

One SQL text per table serves Spark and DuckDB, so query and oracle start from
the same rows at every scale. Every table grows with its source; a third of the
literal facts share one value on purpose.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

SQL = {}

SQL["registry_ids"] = """
select ord, 'model_id' as kind, provider, deprecated, replacement, status, shutdown_date, source_url,
  case when k%23=15 then null when k%19=13 then 'cirrus.wrong-id'
       else concat(provider,'.',deprecated,'.retirement-',coalesce(shutdown_date,'undated')) end as entry_id,
  v_status,
  case when v_status is null then null else k%4<>3 end as v_official,
  case when v_status is null then null else k%6<>5 end as v_replacement,
  case when v_status is null then null when v_status='verified' then k%9<>7 else k%12=3 end as v_auto,
  case when k%16=12 then 'sources disagree' end as quarantine_reason,
  case when v_status is null or k%10=9 then null else concat('2025-1',k%3,'-0',1+k%9) end as checked_at,
  case k%6 when 0 then concat('live: ',replacement) when 1 then 'seen in the docs'
    when 2 then 'stale mapping|see ticket' when 3 then concat('live: ',replacement,'|checked by hand') end as reasons
from (
 select p_partkey as ord, p_partkey as k,
  case p_partkey%3 when 0 then 'acme' when 1 then 'borealis' else 'cirrus' end as provider,
  concat('acme-m',case when p_partkey%50=14 then p_partkey-1 else p_partkey end) as deprecated,
  case when p_partkey%41=4 then '' when p_partkey%37=11 then concat('cirrus-image-',p_partkey%5)
       when p_partkey%29=5 then concat('acme-m',p_partkey%10)
       else concat('acme-x',p_partkey%9,case when p_partkey%10=3 then '-20250101' else '' end) end as replacement,
  case when p_partkey%7=2 then null when p_partkey%2=0 then 'retired' else 'deprecated' end as status,
  case when p_partkey%5=2 then null else concat('202',5+p_partkey%2,'-0',1+p_partkey%9,'-15') end as shutdown_date,
  case when p_partkey%11=3 then null when p_partkey%13=5 then '  ' else 'https://docs.acme.example/d' end as source_url,
  case p_partkey%8 when 3 then 'unverified' when 4 then 'quarantined' when 5 then 'unverifiable' when 6 then null else 'verified' end as v_status
 from {part}) b
"""

SQL["registry_params"] = """
select s_suppkey as ord, case when s_suppkey%3=0 then 'param_rename' else 'param_removal' end as kind, 'acme' as provider,
 case s_suppkey%4 when 0 then 'temperature' when 1 then 'max_tokens' when 2 then 'top_p' else 'logprobs' end as param,
 case when s_suppkey%3=0 then 'max_output' end as replacement,
 concat('acme-m',s_suppkey,',acme-x',s_suppkey%7) as on_models
from {supplier}
"""

SQL["registry_raw"] = """
select p_partkey as ord, case p_partkey%16
 when 0 then concat('{{"provider":"acme","kind":"model_id","deprecated":"m',p_partkey,'","replacement":"x"}}')
 when 1 then concat('{{"provider":"","kind":"model_id","deprecated":"m',p_partkey,'","replacement":"x"}}')
 when 2 then concat('{{"provider":"acme","kind":"other","deprecated":"m',p_partkey,'","replacement":"x"}}')
 when 3 then concat('{{"provider":"acme","kind":"model_id","deprecated":"m',p_partkey,'","replacement":""}}')
 when 4 then concat('{{"provider":"acme","kind":"model_id","deprecated":"m',p_partkey,'","replacement":"x","verification":{{"status":"verified","officialSourceConfirmed":"yes"}}}}')
 when 5 then concat('{{"provider":"acme","kind":"model_id","deprecated":"m',p_partkey,'","replacement":"x","verification":{{"status":"quarantined","quarantineReason":" "}}}}')
 when 6 then concat('{{"provider":"acme","kind":"model_id","deprecated":"m',p_partkey,'","replacement":"x","evidence":[]}}')
 when 7 then concat('{{"provider":"acme","kind":"model_id","deprecated":"m',p_partkey,'","replacement":"x","evidence":[{{"sourceUrl":"u","contentHash":"sha256:12","retrievedAt":"t"}}]}}')
 when 8 then concat('{{"provider":"acme","kind":"param_removal","param":"t","on_models":["m',p_partkey,'"]}}')
 when 9 then concat('{{"provider":"acme","kind":"param_rename","param":"t","on_models":["m',p_partkey,'"]}}')
 when 10 then '{{"provider":"acme","kind":"param_removal","param":"t","on_models":[]}}'
 when 11 then concat('{{"provider":"acme","kind":"model_id","deprecated":"m',p_partkey,'","replacement":"x","status":"gone","note":7}}')
 when 12 then concat('{{"provider":"acme","kind":"model_id","deprecated":"m',p_partkey,'","replacement":"x","verification":{{"status":"verified","checkedAt":5,"reasons":["a",1]}}}}')
 when 13 then concat('{{"provider":"acme","kind":"model_id","deprecated":"m',p_partkey,'","replacement":"x","verification":null,"shutdownDate":3,"entryId":""}}')
 when 14 then '[1]'
 else concat('{{"provider":"acme","kind":"model_id","deprecated":"m',p_partkey,'","replacement":"x","verification":{{"status":"verified","autoApplyAllowed":true,"sources":["s"],"checkedAt":"2025-01-01"}},"evidence":[{{"sourceUrl":"u","contentHash":"sha256:$HEX64","retrievedAt":"t","excerpt":"q"}}]}}')
 end as record
from {part}
"""

SQL["official"] = """
select concat('acme-m',p_partkey) as deprecated,
  concat('acme-x',case when p_partkey%12=1 then p_partkey%9 else (p_partkey+1)%9 end,case when p_partkey%10=3 and p_partkey%12=1 then '-20250101' else '' end) as recommended
 from {part} where p_partkey%6=1
union all select 'acme-x8','acme-x1' from {region} where r_regionkey=0
union all select concat('ch-',p_partkey), concat('Ch-',p_partkey+1) from {part} where p_partkey%16<>0
union all select concat('cy.',p_partkey), concat('cy-',case when p_partkey%3=2 then p_partkey-2 else p_partkey+1 end)
 from {part} where p_partkey < (select 3*cast(floor(count(*)/3) as bigint) from {part})
"""

SQL["catalog_raw"] = """
select concat(case when p_partkey%4=0 then '~' else '' end, case p_partkey%3 when 0 then 'Acme' when 1 then 'borealis' else 'thirdparty' end,'/',
  replace(p_name,' ','-'),'-',p_size%10,'.',p_partkey%7,case when p_partkey%5=0 then '-20250101' else '' end,case when p_partkey%6=0 then ':free' else '' end) as id from {part}
union all select concat('acme/acme-x',p_partkey%7,case when p_partkey%3=0 then '-2025-01-01' else '' end,case when p_partkey%4=1 then ':batch' else '' end) from {part}
union all select concat(case when p_partkey%2=0 then 'acme/' else '' end,'acme-m',p_partkey) from {part} where p_partkey%40=3
union all select concat('acme/acme-c',c_custkey) from {customer} where c_custkey%6=1
"""

SQL["candidates"] = """
select c_custkey as pos, concat('acme:c',c_custkey) as candidate_id, 'acme' as provider,
 case when c_custkey%31=0 then concat('Acme/acme-m',c_custkey) else concat('acme-c',cast(floor(c_custkey/2) as bigint)) end as deprecated,
 case c_custkey%9 when 4 then 'acme-x8' when 5 then 'acme-tts-1' when 6 then 'acme-zz' else concat('acme-x',c_custkey%4) end as replacement,
 case when c_custkey%11=0 then null when c_custkey%5=1 then 'deprecated' else 'retired' end as status,
 case when c_custkey%3=0 then '2026-01-15' end as shutdown_date,
 case when c_custkey%17=0 then null else 'https://docs.acme.example/d' end as source_url
from {customer}
"""

SQL["evidence_refs"] = """
select concat('acme:c',c_custkey) as candidate_id,
 case when c_custkey%31=0 then concat('Acme/acme-m',c_custkey) else concat('acme-c',cast(floor(c_custkey/2) as bigint)) end as deprecated,
 concat('row: ',case when c_custkey%9=0 then 'another-id' when c_custkey%31=0 then concat('ACME.M',c_custkey) else concat('Acme.C',cast(floor(c_custkey/2) as bigint)) end,' | acme-x1') as excerpt,
 concat('sha256:',$SHA[concat('doc',c_custkey%40)]) as content_hash, concat('2025-0',1+c_custkey%9,'-01T00:00:00Z') as retrieved_at
from {customer} where c_custkey%7<>0
union all
select concat('acme:c',c_custkey), concat('acme-c',cast(floor(c_custkey/2) as bigint)), null, concat('sha256:',$SHA[concat('extra',c_custkey%13)]), 'not a date'
from {customer} where c_custkey%7<>0 and c_custkey%14=1 and c_custkey%31<>0
"""

SQL["stored_docs"] = """
select distinct $SHA[concat('doc',c_custkey%40)] as doc_key from {customer} where c_custkey%40<>10
union select distinct $SHA[concat('extra',c_custkey%13)] from {customer} where c_custkey%13<>5
"""

SQL["requests"] = """
select c_custkey*10 as pos, concat('acme:c',c_custkey) as candidate_id from {customer}
union all select c_custkey*10+1, concat('acme:c',c_custkey) from {customer} where c_custkey%8=3
union all select c_custkey*10+2, concat('acme:none',c_custkey) from {customer} where c_custkey%100=5
"""

SQL["lookup_terms"] = """
select concat('acme-m',p_partkey) as term from {part} where p_partkey%4=0
union all select concat('Acme/ACME.M',p_partkey,':free') from {part} where p_partkey%4=1
union all select concat('borealis.acme-m',p_partkey,'.retirement-undated') from {part} where p_partkey%4=2
union all select concat('nothing-',p_partkey) from {part} where p_partkey%4=3
"""

SQL["provider_pages"] = """
select c_custkey as page_id, case c_custkey%3 when 0 then 'acme' when 1 then 'borealis' else 'cirrus' end as provider,
 c_custkey%3 as provider_pos, concat('https://p.example/',c_custkey) as url,
 concat('<html><script nonce="n">var t=',c_custkey,';</script><TABLE class="d"><tr><th>',
  case c_custkey%4 when 0 then 'Shutdown date' when 1 then 'Retirement&nbsp;date' when 2 then 'Sunset' else 'When' end,'</th><th>',
  case when c_custkey%13=0 then 'Name' else 'Model' end,'</th><th>',
  case when c_custkey%10=7 then 'Model replacement</th><th>Substitute' when c_custkey%10=8 then 'Notes' else 'Recommended <b>replacement</b>' end,
  '</th><th>Model price</th></tr>',
  '<tr><td>',case c_custkey%5 when 0 then concat('202',c_custkey%8,'-0',1+c_custkey%9,'-1',c_custkey%10) when 1 then 'Oct 23, 2026'
    when 2 then concat('202',c_custkey%8,'&#8209;0',1+c_custkey%9,'&#8209;1',c_custkey%10) when 3 then 'December 5,2025' else 'soon' end,
   '</td><td><code>acme-',c_custkey%700,'-a</code></td><td>acme-x',c_custkey%9,case when c_custkey%7=0 then ' or acme-9999' else '' end,'*</td><td>1</td></tr>',
  '<tr><td>2025-01-01</td><td>borealis-',c_custkey,case when c_custkey%6=0 then concat(' / borealis-',c_custkey,'b') else '' end,'</td><td>',
    case when c_custkey%11=0 then concat('Borealis-',c_custkey) when c_custkey%9=0 then 'none' else 'borealis-next-1' end,'</td><td>2</td></tr>',
  '<tr><td colspan="4">Section ',c_custkey,'</td></tr>',
  '<tr><td>2027-02-03</td><td>cirrus-',cast(floor(c_custkey/2) as bigint),'</td><td>cirrus-z.',c_custkey%3,'</td><td>3</td></tr>',
  '</TABLE><table><tr><td>only</td></tr></table></html>') as html
from {customer}
"""

SQL["discovery_registry"] = """
select 'model_id' as kind, concat('Acme/acme-',p_partkey,'-a') as deprecated from {part} where p_partkey%5=0
"""

SQL["discovery_queue"] = """
select concat('cirrus-',p_partkey) as deprecated from {part} where p_partkey%7=0
"""

SQL["captures"] = """
select url, concat('2025-0',v,'-0',1+page_id%9,'T00:00:00Z') as retrieved_at, page_id, v,
 concat(replace(replace(html,'track(',concat('track(9',v)),'<style>',concat('<style nonce="n',v,'">')),case when v>=3 and page_id%5=0 then ' changed' else '' end) as text
from (select url,html,page_id,1 as v from {pages} union all select url,html,page_id,2 from {pages}
 union all select url,html,page_id,3 from {pages} union all select url,html,page_id,4 from {pages}) c
"""

SQL["spec_docs"] = """
select concat('api',p_partkey%5) as api, 'A' as version, doc as doc, k from (
 select p_partkey, p_partkey as k, concat('{{"components":{{"schemas":{{"S',p_partkey,'":{{"properties":{{"id":{{"type":"string"}},"amount":{{"type":',
  case when p_partkey%4=0 then '["string","null"]' else '"number"' end,'}},"status":{{"type":"string","enum":["a","b","c"]}},"legacy":{{"type":"string"}},"free":{{}},',
  '"card":{{"properties":{{"name":{{"type":"string"}},"brand":{{"type":"string"}},"addr":{{"type":"object","properties":{{"zip":{{"type":"string"}},"geo":{{"properties":{{"lat":{{"type":"number"}},"ref":{{"properties":{{"datum":{{"properties":{{"code":{{"type":"string"}}}}}}}}}}}}}}}}}}}}}}}}}}}}}}}}') as doc
 from {part}) a
union all
select concat('api',k%5), 'B', doc, k from (
 select p_partkey as k, concat('{{"components":{{"schemas":{{"',case when p_partkey%31=0 then 'T' else 'S' end,p_partkey,'":{{"properties":{{"id":{{"type":"string"}},"amount":{{"type":',
  case when p_partkey%17=0 then '"integer"' when p_partkey%4=0 then '["null","string"]' else '"number"' end,'}},"status":{{"type":"string"',
  case when p_partkey%19=0 then ',"enum":["a","b"]' when p_partkey%23=0 then ',"enum":["c","a","b"]' when p_partkey%29=0 then '' else ',"enum":["a","b","c"]' end,'}},',
  case when p_partkey%11=1 then '"legacy2":{{"type":"string"}},' when p_partkey%11=2 then '"legacy3":{{"type":"number"}},' when p_partkey%11=3 then '' else '"legacy":{{"type":"string"}},' end,
  '"free":{{"type":"string"}},"card":',
  case when p_partkey%37=0 then '{{"type":"string"}}' else concat('{{"properties":{{',
    case when p_partkey%3=1 then '"holder":{{"type":"string"}},"brand":{{"type":"string"}}' when p_partkey%7=2 then '"other":{{"type":"string"}}' else '"name":{{"type":"string"}},"brand":{{"type":"string"}}' end,
    ',"addr":{{"type":"object","properties":{{',case when p_partkey%13=0 then '"zip":{{"type":"number"}}' when p_partkey%13=1 then '"post":{{"type":"string"}}' else '"zip":{{"type":"string"}}' end,
    ',"geo":{{"properties":{{"lon":{{"type":"number"}},"ref":{{"properties":{{"datum":{{"properties":{{',
    case when p_partkey%5=0 then '"code":{{"type":"integer"}}' when p_partkey%5=1 then '"name":{{"type":"string"}}' else '"code":{{"type":"string","enum":["x"]}}' end,'}}}}}}}}}}}}}}}}}}}}') end,'}}}}}}}}}}') as doc
 from {part}) b
"""

SQL["usage"] = """
select concat(case when l_suppkey%2=0 then 'API.' when l_suppkey%3=0 then 'Api.' else '' end,'S',case when l_orderkey%3=0 then 0 else l_partkey end,
 case l_orderkey%5 when 0 then '.card.name' when 1 then '.legacy' when 2 then '.status' when 3 then '.amount' else '.card.addr.zip' end) as path_key,
 concat('api',case when l_suppkey%7=0 then l_partkey+1 when l_orderkey%3=0 then 0 else l_partkey end%5) as api,
 concat('r',l_suppkey) as repo, concat('src/f',l_orderkey%997,'.ts') as file, l_orderkey%500 as line, l_linenumber as col
from {lineitem}
"""

SQL["literal_facts"] = """
select concat('r',l_suppkey) as repo,
 concat(case when l_orderkey%13=0 then 'tests/' else 'src/' end,case when l_orderkey%29=0 then 'prices' else 'f' end,l_orderkey%997,case when l_orderkey%2=0 then '.ts' else '.py' end) as path,
 case when l_orderkey%2=0 then 'ts' else 'py' end as lang, l_orderkey as line, l_linenumber as col,
 case when l_orderkey%3=1 then 'acme-m1' when l_partkey%5=4 then concat('other-',l_partkey) else concat('acme-m',l_partkey) end as value,
 case cast(floor(l_quantity) as int)%9 when 0 then 'property_value' when 1 then 'property_key' when 2 then 'kwarg' when 3 then 'variable' when 4 then 'param_default' when 5 then 'call_arg' when 6 then 'array_element' when 7 then 'comparison' else 'class_property' end as enclosure,
 case l_partkey%5 when 0 then 'model' when 1 then 'deployment_name' when 2 then 'label' when 3 then 'defaultModel' else 'Deployment' end as encl_name,
 l_linestatus='O' as in_call,
 case l_partkey%3 when 0 then 'openai' when 1 then 'GenerativeModel' else 'log' end as callee,
 case l_returnflag when 'R' then 'ModelId' when 'A' then 'string' end as cast_type
from {lineitem}
"""

SQL["sink_facts"] = """
select distinct concat('r',o_custkey%100) as repo, concat('src/f',o_orderkey%997,'.py') as path, case when o_orderstatus='F' then 'model' else 'defaultModel' end as name from {orders}
"""

SQL["option_objects"] = """
select concat('r',l_suppkey) as repo, concat('src/f',l_orderkey%997,'.ts') as path, l_orderkey*10+l_linenumber as obj_id, 'model' as key,
 case when l_partkey%4=0 then 'shorthand' when l_partkey%9=0 then 'method' else 'property' end as key_kind,
 case when l_partkey%4=0 then null when l_partkey%2=1 then concat('acme-m',l_partkey%100,case when l_suppkey%3=0 then '-mini' when l_suppkey%5=0 then '0' else '' end) end as value_literal,
 case when l_partkey%4=0 then 'model' when l_partkey%2=0 then 'chosen' end as value_ident, l_partkey as key_start
from {lineitem}
union all select concat('r',l_suppkey), concat('src/f',l_orderkey%997,'.ts'), l_orderkey*10+l_linenumber,
 case l_linenumber%4 when 0 then 'temperature' when 1 then 'max_tokens' when 2 then 'top_p' else 'stream' end,
 case when l_partkey%7=0 then 'spread' else 'property' end, '0', null, 100000000+l_partkey from {lineitem}
"""

SQL["const_bindings"] = """
select concat('r',o_custkey%100) as repo, concat('src/f',o_orderkey%997,'.ts') as path, case when o_orderkey%2=0 then 'model' else 'chosen' end as ident,
 concat('acme-x',o_orderkey%9) as literal, o_orderkey as literal_start from {orders}
"""

SQL["source_files"] = """
select concat('r',o_custkey%100) as repo,
 concat(case when o_orderkey%17=0 then 'tests/' when o_orderkey%19=0 then 'node_modules/lib/' else 'src/' end,'f',o_orderkey,case when o_orderkey%2=0 then case when o_orderkey%46=0 then '.d.ts' else '.ts' end else '.py' end) as path,
 concat(case o_orderkey%50 when 7 then concat('# scan: ignore-file',chr(10)) when 8 then concat('// scan: model-catalog',chr(10)) else '' end,
  case when o_orderkey%2=0 then concat(case when o_orderkey%5=0 then 'let r = client.create({{ model: "other-1", stop: "acme" }});' else concat('const r = client.create({{ model: "acme-m',o_custkey,'", temperature: 0 }});') end,chr(10),
     'const T = {{ "acme-m',o_orderkey%2000,'": 1 }};',chr(10))
  else concat('model = "',case when o_orderkey%5=0 then 'other-2' else concat('acme-m',o_custkey) end,'"',chr(10),case when o_orderkey%3=0 then 'run(model=model)' else 'print(model)' end,chr(10)) end,
  case when o_orderkey%4=0 then concat('// acme-m1 in a comment',chr(10)) else '' end) as text
from {orders}
"""

SQL["gate_outcomes"] = """
select concat('r',user_id) as repo, case when event_id%2=0 then 'ts' else 'py' end as lang,
 case event_type when 'signup' then 'typecheck' when 'purchase' then 'typecheck' when 'view' then 'eval' else 'tests' end as gate, event_id as seq,
 case when event_id%97=0 then 'fail' when event_id%13=0 then 'inconclusive' when event_id%7=0 then 'not-configured' when event_id%5=0 then 'not-applicable' else 'pass' end as outcome from {events}
"""

SQL["gate_config"] = """
select concat('r',s_suppkey) as repo, case s_suppkey%8 when 0 then null when 1 then '{{"gates":{{"tests":{{"required":true}}}}}}'
 when 2 then '{{"evalCommand":" run-eval "}}' when 3 then '{{"gates":{{"eval":{{"command":"run-eval","required":false}}}}}}'
 when 4 then '{{"gates":{{"test":{{}}}}}}' when 5 then '{{"evalCommand":"a","gates":{{"eval":{{"command":"b"}}}}}}'
 when 6 then '{{"gates":{{"typecheck":{{"required":"no"}}}},"other":1}}' else '{{"evalTimeoutMs":-1}}' end as config from {supplier}
"""

SQL["diagnostics"] = """
select concat('r',user_id) as repo, case when event_id%2=0 then 'baseline' else 'patched' end as side, concat('src/f',user_id%50,'.ts') as path,
 2000+cast(floor(value) as int)%7 as code, event_type as message from {events}
"""

SQL["run_logs"] = """
select event_id, case event_id%6 when 0 then concat('Test Files  17 passed',chr(10),'Tests  ',event_id%9,' failed | ',event_id%200,' passed')
 when 1 then concat('Tests:       ',event_id%9,' failed, ',event_id%200,' passed') when 2 then concat('  ',event_id%200,' passing (12ms)',chr(10),'  ',event_id%9,' failing')
 when 3 then concat(event_id%9,' failed, ',event_id%200,' passed in 0.12s') when 4 then concat(event_id%200,' passing') else 'no summary here' end as log from {events}
"""

SQL["edits"] = """
select concat('r',l_orderkey%20) as repo, concat('src/f',l_orderkey,'.ts') as path, cast((l_partkey*7+l_linenumber)%30 as bigint) as pos,
 cast((l_partkey*7+l_linenumber)%30+l_suppkey%12 as bigint) as upto, concat('t',l_suppkey%3) as new_text, cast(l_linenumber as bigint) as ord
from {lineitem}
"""

SQL["finding_feed"] = """
select event_id, ts, concat('r',user_id%20) as repo, case event_type when 'error' then 'A' when 'click' then 'B' when 'signup' then 'B' else 'C' end as tier from {events}
"""

HEX64 = "0123456789abcdef" * 4


def _dialect(text: str, spark: bool) -> str:
    text = text.replace("$HEX64", HEX64)
    template = r"sha2(\1,256)" if spark else r"sha256(\1)"
    return re.sub(r"\$SHA\[([^\]]*)\]", template, text)


def duck_sql(name: str) -> str:
    return _dialect(SQL[name], spark=False).format(**{t: t for t in TABLES}).strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as Spark computes it from the test tables."""
    text = _dialect(SQL[name], spark=True)
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier and parameter records in the engine's registry schema."""
    ids = fixture(spark, sf_dir, "registry_ids").withColumn("reasons", F.split("reasons", r"\|"))
    params = fixture(spark, sf_dir, "registry_params").withColumn("on_models", F.split("on_models", ","))
    return ids.unionByName(params, allowMissingColumns=True)


def id_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "registry_ids").withColumn("reasons", F.split("reasons", r"\|"))


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option objects with the columns of an extraction that knows no spans."""
    base = fixture(spark, sf_dir, "option_objects")
    for name in ("value_start", "line", "col", "key_end", "prop_start", "prop_end"):
        base = base.withColumn(name, F.lit(None).cast("bigint"))
    return base.withColumn("key_quote", F.lit(None).cast("string"))
