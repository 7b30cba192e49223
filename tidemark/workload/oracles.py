"""The registered queries as DuckDB SQL over the same derived tables.

Written from the meaning of each operator and not from its Spark plan: theta
joins, correlated lookups and windows appear here where the engine uses
equality lookups and aggregates.
"""

from __future__ import annotations

from .. import config as C
from .fixtures import duck_sql

ORACLES: dict[str, str] = {}


def oracle(name: str, fixtures: str, body: str, recursive: bool = False) -> None:
    parts = [f"{f} as ({duck_sql(f)})" for f in fixtures.split()]
    lead = "with recursive " if recursive else "with "
    body = body.strip()
    ORACLES[name] = (lead + ",\n".join([*parts, body])) if parts else lead + body


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canon(x: str) -> str:
    return (
        f"replace(list_last(string_split(split_part(regexp_replace(lower(trim({x})),'^~',''),':',1),'/')),'.','-')"
    )


def family(x: str) -> str:
    return rf"regexp_replace(regexp_replace({canon(x)},'-\d\d\d\d-\d\d-\d\d$',''),'-\d\d\d\d\d\d\d\d$','')"


def klass(x: str) -> str:
    cases = " ".join(f"when regexp_matches({canon(x)},{q(p)}) then {q(n)}" for n, p in C.MODEL_CLASSES)
    return f"case {cases} else 'chat' end"


def verifiable(cls: str) -> str:
    return f"({cls}) not in ('moderation','image','audio','tts')"


def entry_id(a: str) -> str:
    return (
        f"{a}.provider||'.'||{a}.deprecated||'.retirement-'||"
        f"(case when coalesce({a}.shutdown_date,'')='' then 'undated' else {a}.shutdown_date end)"
    )


ELIGIBLE = "coalesce(v_status='verified' and v_official and v_replacement and v_auto,false)"
STATE = (
    f"case when v_status is null then 'unstamped' when v_status<>'verified' then v_status "
    f"when {ELIGIBLE} then 'verified' else 'withheld' end"
)
FIRST_PARTY = """
live as (
 select distinct unnest([c,f]) as form from (
  select {canon} as c, {family} as f from (
   select substr(s, instr(s,'/')+1) as id from (
     select split_part(regexp_replace(id,'^~',''),':',1) as s from catalog_raw) where instr(s,'/')>0
     and split_part(s,'/',1) in ('acme','borealis','cirrus')) where {canon}<>''))
""".format(canon=canon("id"), family=family("id")).strip()
OFFICIAL = f"off as (select {canon('deprecated')} as dep_canon, max(recommended) as recommended from official group by 1)"


def verdict_cte(source: str) -> str:
    """``verdict`` and ``verdict_reasons`` for every row of ``source``."""
    dep_cls, rep_cls = klass("r.deprecated"), klass("r.replacement")
    return f"""
{FIRST_PARTY},
{OFFICIAL},
judged as (
 select r.*, {dep_cls} as dc, {rep_cls} as rc, o1.recommended as onward, o2.recommended as official_rec,
  exists(select 1 from live where form={canon('r.replacement')} or form={family('r.replacement')}) as is_live
 from {source} r left join off o1 on o1.dep_canon={canon('r.replacement')}
 left join off o2 on o2.dep_canon={canon('r.deprecated')}),
classified as (
 select *, case when not {verifiable('dc')} or not {verifiable('rc')} then 'unverifiable'
   when onward is not null or not is_live or (official_rec is not null and {canon('official_rec')}<>{canon('replacement')}) then 'unverified'
   else 'verified' end as verdict,
  case when not {verifiable('dc')} then ['out of class: '||dc] when not {verifiable('rc')} then ['out of class: '||rc]
   when onward is not null then ['chained: '||replacement||' -> '||onward]
   when not is_live then list_filter(['not live: '||replacement,
      case when official_rec is not null and {canon('official_rec')}<>{canon('replacement')} then 'official is '||official_rec end], lambda x: x is not null)
   else list_filter(['live: '||replacement, case when official_rec is null then null
      when {canon('official_rec')}<>{canon('replacement')} then 'official is '||official_rec else 'official agrees: '||official_rec end], lambda x: x is not null)
  end as verdict_reasons
 from judged)
""".strip()


# --- identifiers and catalogs ------------------------------------------------

oracle("canon_ids", "catalog_raw", f"""
x as (select id, {canon('id')} as canon, {family('id')} as family from catalog_raw)
select id, canon, family, canon='acme-x1' as equals_x1, family='acme-x1' as family_of_x1,
 case when regexp_matches(canon,'\\d') then regexp_extract(canon,'^(.*?\\d+)',1) else canon end as replacement_family from x
""")

oracle("model_class", "registry_ids", f"""
x as (select replace(p_name,' ','/')||'-'||(['embedding-3','embed-x','tts-1','whisper','gpt-audio-mini','dall-e-3','Omni.Moderation','latest'])[p_partkey%8+1] as id from part
 union all select replacement from registry_ids),
y as (select id, {klass('id')} as class from x)
select id, class, {verifiable('class')} as verifiable from y
""")

oracle("live_forms", "catalog_raw", f"""
{FIRST_PARTY}
select form from live
""")

oracle("catalog_payloads", "", """
x as (select 'aggregator' as source, replace(replace(p_brand,'~',''),':free','') as id from part
 union all select 'provider_map', lower(p_type) from part where p_partkey%2=0)
select source, id, count(*) as n from x group by 1,2
""")

# --- registry ----------------------------------------------------------------

CHECKED = """
p as (select ord, record::json as j from registry_raw),
t as (select ord, j, json_type(j) as jt, json_extract_string(j,'$.kind') as kind,
  json_type(j,'$.verification') as vt, json_extract_string(j,'$.verification.status') as vs,
  json_type(j,'$.evidence') as et from p),
c as (select ord, case when jt<>'OBJECT' then ['not_an_object'] else list_filter([
  case when coalesce(json_type(j,'$.provider')<>'VARCHAR' or json_extract_string(j,'$.provider')='',true) then 'invalid_provider' end,
  case when coalesce(kind not in ('model_id','param_rename','param_removal'),true) then 'invalid_kind' end,
  case when json_type(j,'$.note')<>'VARCHAR' then 'invalid_note' end,
  case when kind='model_id' and json_type(j,'$.status') is not null and coalesce(json_extract_string(j,'$.status') not in ('retired','deprecated'),true) then 'invalid_status' end,
  case when kind='model_id' and json_type(j,'$.shutdownDate') not in ('VARCHAR','NULL') then 'invalid_shutdown_date' end,
  case when kind='model_id' and json_type(j,'$.sourceUrl') not in ('VARCHAR','NULL') then 'invalid_source_url' end,
  case when kind='model_id' and json_type(j,'$.entryId')<>'NULL' and (json_type(j,'$.entryId')<>'VARCHAR' or json_extract_string(j,'$.entryId')='') then 'invalid_entry_id' end,
  case when kind='model_id' and coalesce(json_type(j,'$.deprecated')<>'VARCHAR' or json_extract_string(j,'$.deprecated')='',true) then 'invalid_deprecated' end,
  case when kind='model_id' and coalesce(json_type(j,'$.replacement')<>'VARCHAR' or json_extract_string(j,'$.replacement')='',true) then 'invalid_replacement' end,
  case when kind='model_id' and vt<>'OBJECT' then 'invalid_verification' end,
  case when kind='model_id' and vt='OBJECT' and coalesce(vs not in ('verified','quarantined','unverified','unverifiable'),true) then 'invalid_verification_status' end,
  case when kind='model_id' and vt='OBJECT' and json_type(j,'$.verification.quarantineReason') not in ('VARCHAR','NULL') then 'invalid_quarantine_reason' end,
  case when kind='model_id' and vt='OBJECT' and vs='quarantined' and trim(coalesce(json_extract_string(j,'$.verification.quarantineReason'),''))='' then 'quarantine_without_reason' end,
  case when kind='model_id' and vt='OBJECT' and json_type(j,'$.verification.officialSourceConfirmed')<>'BOOLEAN' then 'invalid_switch_officialSourceConfirmed' end,
  case when kind='model_id' and vt='OBJECT' and json_type(j,'$.verification.replacementConfirmed')<>'BOOLEAN' then 'invalid_switch_replacementConfirmed' end,
  case when kind='model_id' and vt='OBJECT' and json_type(j,'$.verification.autoApplyAllowed')<>'BOOLEAN' then 'invalid_switch_autoApplyAllowed' end,
  case when kind='model_id' and vt='OBJECT' and json_type(j,'$.verification.checkedAt')<>'VARCHAR' then 'invalid_checked_at' end,
  case when kind='model_id' and json_type(j,'$.verification.sources') is not null and (json_type(j,'$.verification.sources')<>'ARRAY' or len(list_filter(json_extract(j,'$.verification.sources[*]'), lambda x: json_type(x)<>'VARCHAR'))>0) then 'invalid_sources' end,
  case when kind='model_id' and json_type(j,'$.verification.reasons') is not null and (json_type(j,'$.verification.reasons')<>'ARRAY' or len(list_filter(json_extract(j,'$.verification.reasons[*]'), lambda x: json_type(x)<>'VARCHAR'))>0) then 'invalid_reasons' end,
  case when kind='model_id' and et<>'ARRAY' then 'invalid_evidence' end,
  case when kind='model_id' and et='ARRAY' and json_array_length(j,'$.evidence')=0 then 'empty_evidence' end,
  case when kind='model_id' and et='ARRAY' and len(list_filter(json_extract(j,'$.evidence[*]'), lambda x: coalesce(json_extract_string(x,'$.sourceUrl'),'')='' or coalesce(json_extract_string(x,'$.contentHash'),'')='' or coalesce(json_extract_string(x,'$.retrievedAt'),'')=''))>0 then 'invalid_evidence_field' end,
  case when kind='model_id' and et='ARRAY' and len(list_filter(json_extract(j,'$.evidence[*]'), lambda x: not regexp_matches(json_extract_string(x,'$.contentHash'),'^sha256:[0-9a-f]{64}$')))>0 then 'malformed_content_hash' end,
  case when kind='model_id' and et='ARRAY' and len(list_filter(json_extract(j,'$.evidence[*]'), lambda x: json_type(x,'$.excerpt')<>'VARCHAR'))>0 then 'invalid_excerpt' end,
  case when kind='model_id' and et='ARRAY' and len(list_filter(json_extract(j,'$.evidence[*]'), lambda x: length(json_extract_string(x,'$.excerpt'))>240))>0 then 'excerpt_too_long' end,
  case when kind in ('param_rename','param_removal') and coalesce(json_extract_string(j,'$.param'),'')='' then 'invalid_param' end,
  case when kind in ('param_rename','param_removal') and (coalesce(json_type(j,'$.on_models')<>'ARRAY',true) or json_array_length(j,'$.on_models')=0) then 'invalid_on_models' end,
  case when kind='param_rename' and coalesce(json_extract_string(j,'$.replacement'),'')='' then 'invalid_param_replacement' end
 ], lambda x: x is not null) end as codes from t)
"""
oracle("registry_rejects", "registry_raw", CHECKED + """
select ord, array_to_string(codes,'|') as problems from c where len(codes)>0
""")
oracle("registry_files", "registry_raw", CHECKED.rstrip() + """,
f as (select ord, ord//1000 as file, row_number() over (partition by ord//1000 order by ord)-1 as pos from registry_raw)
select file::bigint as file, pos, case when len(codes)=0 then kind end as kind, case when len(codes)=0 then json_extract_string(j,'$.deprecated') end as deprecated,
  array_to_string(codes,'|') as problems from f join c using (ord) join t using (ord)
""")

MARKERS = "[" + ",".join(q(m) for m in C.CAVEAT_MARKERS) + "]"
VIOLATIONS = f"""
d as (select r.*, {entry_id('r')} as derived_id, coalesce(r.entry_id, {entry_id('r')}) as display_id from registry_ids r),
v as (
 select ord, display_id, 'verified_without_official_source' as code from d where v_status='verified' and not coalesce(v_official,false)
 union all select ord, display_id, 'verified_without_replacement_confirmation' from d where v_status='verified' and not coalesce(v_replacement,false)
 union all select ord, display_id, 'verified_without_auto_apply' from d where v_status='verified' and not coalesce(v_auto,false)
 union all select ord, display_id, 'auto_apply_without_verified_status' from d where coalesce(v_status,'')<>'verified' and v_auto
 union all select ord, display_id, 'quarantined_without_reason' from d where v_status='quarantined' and trim(coalesce(quarantine_reason,''))=''
 union all select ord, display_id, 'missing_replacement' from d where trim(coalesce(replacement,''))=''
 union all select ord, display_id, 'missing_lifecycle' from d where coalesce(status,'')='' and coalesce(shutdown_date,'')=''
 union all select ord, display_id, 'caveat_over_auto_apply' from d where v_auto and len(list_filter({MARKERS}, lambda m: contains(lower(coalesce(reasons,'')), m)))>0
 union all select ord, display_id, 'missing_entry_id' from d where coalesce(entry_id,'')=''
 union all select ord, display_id, 'entry_id_mismatch' from d where entry_id<>'' and entry_id<>derived_id
 union all select ord, display_id, 'duplicate_entry_id' from (select ord, display_id, count(*) over (partition by display_id) as n from d) where n>1)
"""
oracle("registry_violations", "registry_ids", VIOLATIONS + "select ord, display_id, code from v")
oracle("violation_tally", "registry_ids", VIOLATIONS + "select code, count(*) as violations from v group by 1")

oracle("registry_state", "registry_ids", f"""
x as (select * from registry_ids)
select ord, deprecated, {ELIGIBLE} as auto_apply, {STATE} as state,
 case when v_status is null then '' else array_to_string(list_filter([case when not coalesce(v_official,false) then 'officialSourceConfirmed' end,
  case when not coalesce(v_replacement,false) then 'replacementConfirmed' end, case when not coalesce(v_auto,false) then 'autoApplyAllowed' end], lambda x: x is not null),'|') end as withheld
from x
""")

oracle("registry_provenance", "registry_ids", f"""
x as (select *, {ELIGIBLE} as ok, {STATE} as st from registry_ids)
select count(*) as records, count(*) filter (ok) as eligible,
 {', '.join(f"count(*) filter (not ok and st='{s}') as {s}" for s in C.REVIEW_STATES)},
 min(checked_at) as oldest, max(checked_at) as newest, count(*) filter (checked_at is null) as undated,
 date '2025-12-20' - max(checked_at)::date > 30 as stale from x
""")

oracle("registry_lookup", "registry_ids lookup_terms", f"""
d as (select r.*, {entry_id('r')} as derived_id from registry_ids r),
hits as (
 select term, 1 as f, ord, deprecated, entry_id, derived_id from lookup_terms join d on entry_id=term
 union all select term, 2, ord, deprecated, entry_id, derived_id from lookup_terms join d on derived_id=term
 union all select term, 3, ord, deprecated, entry_id, derived_id from lookup_terms join d on deprecated=term
 union all select term, 4, ord, deprecated, entry_id, derived_id from lookup_terms join d on {canon('deprecated')}={canon('term')}),
r as (select *, row_number() over (partition by term order by f, ord) as rn from hits)
select term, f as matched_form, ord, deprecated, coalesce(entry_id,derived_id) as display_id from r where rn=1
""")

oracle("registry_first_declared", "registry_ids", """
x as (select *, row_number() over (partition by deprecated order by ord) as rn from registry_ids)
select deprecated, ord, replacement from x where rn=1
""")

# --- verdicts ----------------------------------------------------------------

oracle("replacement_verdict", "registry_ids catalog_raw official", f"""
{verdict_cte('registry_ids')}
select ord, deprecated, verdict, array_to_string(verdict_reasons,'|') as verdict_reasons from classified
""")

oracle("replacement_chain", "official", f"""
e as (select {canon('deprecated')} as d, {canon('max(recommended)')} as n from official group by 1),
walk(d, cur, hops) as (
 select d, n, 1 from e
 union
 select w.d, e.n, w.hops+1 from walk w join e on e.d=w.cur where w.hops < 20),
done as (select w.* from walk w where not exists (select 1 from e where e.d=w.cur)),
f as (select e.d, max(x.hops) as hops, max(x.cur) as final from e left join done x on x.d=e.d group by 1)
select d as dep_canon, hops::bigint as hops, final, final is null as cyclic from f
""", recursive=True)

MACHINE = "^(out of class: |chained: |not live: |live: |official is |official agrees: )"
RESTAMP = f"""
{verdict_cte('registry_ids')},
s as (
 select *, coalesce(v_status='quarantined',false) as held, trim(coalesce(source_url,''))<>'' and (coalesce(status,'')<>'' or coalesce(shutdown_date,'')<>'') as off_ok from classified),
r as (
 select c.ord, {entry_id('c')} as entry_id, coalesce(c.v_status,'unstamped') as was, case when c.held then 'quarantined' else c.verdict end as now,
  c.off_ok as v_official, c.verdict='verified' as v_replacement, not c.held and c.off_ok and c.verdict='verified' as v_auto,
  case when c.held then c.quarantine_reason end as quarantine_reason,
  array_to_string(list_concat(c.verdict_reasons, list_filter(coalesce(string_split(c.reasons,'|'),[]), lambda x: not regexp_matches(trim(x),{q(MACHINE)}) and not list_contains(c.verdict_reasons,x))),'|') as reasons
 from s c)
"""
oracle("restamp", "registry_ids catalog_raw official", RESTAMP + """
select ord, entry_id, now as v_status, v_official, v_replacement, v_auto, quarantine_reason, '2025-12-20' as checked_at, reasons from r
""")
oracle("restamp_audit", "registry_ids catalog_raw official", RESTAMP + """
select was, now, count(*) as records, count(*) filter (was<>now) as flips, count(*) filter (was<>now and was='verified') as unsafe_flips from r group by 1,2
""")
oracle("candidate_stamps", "candidates catalog_raw official", f"""
{verdict_cte('candidates')},
s as (select *, trim(coalesce(source_url,''))<>'' and (coalesce(status,'')<>'' or coalesce(shutdown_date,'')<>'') as off_ok from classified)
select candidate_id, verdict as v_status, off_ok as v_official, verdict='verified' as v_replacement, off_ok and verdict='verified' as v_auto from s
""")

# --- claims and promotion ----------------------------------------------------

CLAIM = f"""
refs as (select e.*, replace(content_hash,'sha256:','') as k from evidence_refs e),
marked as (select r.*, exists(select 1 from stored_docs s where s.doc_key=r.k) as backed,
  coalesce(contains(replace(lower(excerpt),'.','-'), replace(lower(deprecated),'.','-')) or contains(replace(lower(excerpt),'.','-'), {canon('deprecated')}),false) as quoting from refs r),
summary as (select candidate_id, count(*) as refs, count(*) filter (not backed) as unbacked, count(*) filter (quoting) as quoting from marked group by 1),
claims as (select c.*, coalesce(s.refs,0) as refs, coalesce(s.unbacked,0) as unbacked,
  list_filter([case when c.status is null then 'no_status' end,
   case when c.status='retired' and exists(select 1 from live where form={canon('c.deprecated')}) then 'retired_but_live' end,
   case when c.status='deprecated' and coalesce(c.shutdown_date,'')='' then 'deprecated_without_date' end,
   case when coalesce(s.quoting,0)=0 then 'no_quoting_excerpt' end,
   case when coalesce(s.unbacked,0)>0 then 'unbacked_ref' end], lambda x: x is not null) as claim_reasons
  from classified c left join summary s using (candidate_id))
"""
oracle("claim_check", "candidates evidence_refs stored_docs catalog_raw official", f"""
{verdict_cte('candidates')}, {CLAIM.strip()}
select candidate_id, unbacked, array_to_string(claim_reasons,'|') as claim_reasons from claims
""")
oracle("unbacked_evidence", "evidence_refs stored_docs", """
x as (select *, replace(content_hash,'sha256:','') as k from evidence_refs)
select candidate_id, content_hash from x where k not in (select doc_key from stored_docs)
""")

# The sequential rule, step by step: a request is promoted when it passes and no
# earlier passing request has the same identifier.
DECIDE = f"""
{verdict_cte('candidates')}, {CLAIM.strip()},
asked as (select r.pos, r.candidate_id, c.deprecated, c.refs, c.verdict, {canon('c.deprecated')} as canon,
  exists(select 1 from registry_ids g where {canon('g.deprecated')}={canon('c.deprecated')}) as active, len(c.claim_reasons)=0 as claim_ok
 from requests r left join claims c using (candidate_id)),
passing as (select *, coalesce(refs>0 and not active and verdict='verified' and claim_ok,false) as passes from asked),
run as (select *, coalesce(sum(passes::int) over w,0) as earlier,
   first_value(case when passes then candidate_id end ignore nulls) over (partition by canon order by pos rows between unbounded preceding and 1 preceding) as winner from passing
  window w as (partition by canon order by pos rows between unbounded preceding and 1 preceding)),
decided as (select pos, candidate_id, deprecated, case when canon is null then 'unknown'
   when passes and earlier=0 then 'promoted' when winner=candidate_id then 'repeated' when refs=0 then 'no_evidence'
   when active or earlier>0 then 'already_active' when verdict<>'verified' then 'not_verified' else 'claim_fails' end as decision from run)
"""
PROMOTE_TABLES = "candidates evidence_refs stored_docs catalog_raw official registry_ids requests"
oracle("promote", PROMOTE_TABLES, DECIDE + "select pos, candidate_id, decision from decided")
oracle("promote_transition", PROMOTE_TABLES, DECIDE + f"""
select 'registry' as state, entry_id as id, v_status, v_auto from registry_ids
union all select 'registry', {entry_id('c')}, 'verified', trim(coalesce(c.source_url,''))<>'' and (coalesce(c.status,'')<>'' or coalesce(c.shutdown_date,'')<>'')
 from decided d join candidates c using (candidate_id) where d.decision='promoted'
union all select 'queue', candidate_id, null, null from candidates where candidate_id not in (select candidate_id from decided where decision='promoted')
""")

oracle("versioned_state", PROMOTE_TABLES, DECIDE + f"""
select 'failed' as moment, 'registry' as state, entry_id as id from registry_ids
union all select 'failed', 'queue', candidate_id from candidates
union all select 'repeated', 'registry', entry_id from registry_ids
union all select 'repeated', 'registry', {entry_id('c')} from decided d join candidates c using (candidate_id) where d.decision='promoted'
union all select 'repeated', 'queue', candidate_id from candidates where candidate_id not in (select candidate_id from decided where decision='promoted')
""")

# --- discovery and documents -------------------------------------------------

CELL = (
    "trim(regexp_replace(replace(replace(regexp_replace({x},'<[^>]+>',' ','g'),'&nbsp;',' '),'&#8209;',chr(8209)),'\\s+',' ','g'))"
)
MONTHS = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"


def date_of(x: str) -> str:
    text = f"regexp_replace({x},'[\u2010-\u2015\u2212]','-','g')"
    named = r"\b([A-Z][a-z][a-z])[a-z]*\.?\s+(\d\d?),\s*(\d\d\d\d)\b"
    month = f"list_position({MONTHS}, lower(regexp_extract({text},{q(named)},1)))"
    return (
        f"case when regexp_matches({text},'\\d\\d\\d\\d-\\d\\d-\\d\\d') then regexp_extract({text},'\\d\\d\\d\\d-\\d\\d-\\d\\d') "
        f"when {month}>0 then regexp_extract({text},{q(named)},3)||'-'||lpad({month}::varchar,2,'0')||'-'||lpad(regexp_extract({text},{q(named)},2),2,'0') end"
    )


def ids_in(cell: str) -> str:
    shape = "^[a-z][a-z0-9]*(?:[.-][a-z0-9]+)+$"
    return (
        f"list_filter(list_transform(regexp_split_to_array(regexp_replace({cell},'[\u2010-\u2015\u2212]','-','g'),'[\\s,|/()]+'), lambda t: regexp_replace(lower(t),'[.,;:*]+$','')), "
        f"lambda t: regexp_matches(t,{q(shape)}) and starts_with(t, provider||'-'))"
    )


DISCOVER = f"""
tabs as (select page_id, provider, provider_pos, url, unnest(range(len(t))) as table_no, unnest(t) as tab from (
  select *, regexp_extract_all(html,'(?is)<table.*?</table>') as t from provider_pages)),
trs as (select *, regexp_extract_all(tab,'(?is)<tr.*?</tr>') as rows from tabs),
heads as (select *, list_transform(regexp_extract_all(rows[1],'(?is)<t[dh][^>]*>.*?</t[dh]>'), lambda x: {CELL.format(x='x')}) as h from trs where len(rows)>=2),
cols as (select *, list_filter(range(1,len(h)+1), lambda i: regexp_matches(h[i],'(?i)\\b(replacement|substitute)\\b')) as rc,
  list_filter(range(1,len(h)+1), lambda i: not regexp_matches(h[i],'(?i)\\b(replacement|substitute)\\b') and regexp_matches(h[i],'(?i)\\bmodel\\b') and not regexp_matches(h[i],'(?i)\\bprice\\b')) as dc,
  list_filter(range(1,len(h)+1), lambda i: not regexp_matches(h[i],'(?i)\\b(replacement|substitute)\\b') and regexp_matches(h[i],'(?i)\\b(shutdown|retirement|deactivation|sunset)\\b')) as tc from heads),
bad as (select page_id, table_no, 0 as row_no, case when len(rc)<>1 then 'replacement_columns' else 'model_columns' end as skip, array_to_string(h,' | ') as row_text
  from cols where len(rc)<>1 or len(dc)<>1),
body as (select *, unnest(range(len(rows)-1)) as row_no, unnest(rows[2:]) as tr from cols where len(rc)=1 and len(dc)=1),
cells as (select *, list_transform(regexp_extract_all(tr,'(?is)<t[dh][^>]*>.*?</t[dh]>'), lambda x: {CELL.format(x='x')}) as c from body),
found as (select *, {ids_in("coalesce(c[dc[1]],'')")} as di, {ids_in("coalesce(c[rc[1]],'')")} as ri, coalesce(c[tc[1]],'') as when_text from cells),
judged as (select page_id, provider, provider_pos, url, table_no, row_no, array_to_string(c,' | ') as row_text, di, ri, when_text, len(tc)>0 as dated,
  case when len(list_distinct(di))>1 then 'several_models' when len(ri)=0 then 'no_replacement' when len(list_distinct(ri))>1 then 'several_replacements'
   when {canon('di[1]')}={canon('ri[1]')} then 'maps_to_itself' end as skip from found where len(di)>0),
good as (select page_id, provider, provider_pos, url, table_no, row_no, row_text, di[1] as deprecated, ri[1] as replacement,
  case when dated then {date_of('when_text')} end as shutdown_date from judged where skip is null)
"""
oracle("discover_rows", "provider_pages", DISCOVER + """
select page_id, table_no, row_no, deprecated, replacement, shutdown_date, row_text from good
""")
oracle("discover_skips", "provider_pages", DISCOVER + """
select page_id, table_no, row_no, skip, row_text from judged where skip is not null union all select page_id, table_no, row_no, skip, row_text from bad
""")
FRESH = DISCOVER.rstrip() + f""",
known as (select {canon('deprecated')} as k from discovery_registry union select {canon('deprecated')} from discovery_queue),
cand as (select *, {canon('deprecated')} as cn, row_number() over (partition by {canon('deprecated')} order by provider_pos, page_id, table_no, row_no) as rn
  from good where {canon('deprecated')} not in (select k from known)),
fresh as (select * from cand where rn=1)
"""
DISCOVER_TABLES = "provider_pages discovery_registry discovery_queue"
oracle("discover_new", DISCOVER_TABLES, FRESH + """
select provider||':'||cn as candidate_id, deprecated, replacement, case when shutdown_date is null then null when shutdown_date<='2026-02-01' then 'retired' else 'deprecated' end as status,
 shutdown_date, url as source_url, row_text as excerpt from fresh
""")
oracle("discover_summary", DISCOVER_TABLES, FRESH.rstrip() + """,
every as (select provider, skip is null as ok from judged union all select p.provider, false from bad b join provider_pages p using (page_id))
select e.provider, count(*) filter (ok) as readable, count(*) filter (not ok) as skipped,
 coalesce(any_value(a.n),0) as added from every e left join (select provider, count(*) as n from fresh group by 1) a on a.provider=e.provider group by 1
""")
oracle("stream_discover", DISCOVER_TABLES, FRESH + "select cn as canon from fresh")

oracle("shutdown_dates", "", f"""
x as (select o_orderkey, case o_orderkey%4 when 0 then strftime(o_orderdate,'%b %-d, %Y') when 1 then 'after '||strftime(o_orderdate,'%B %d,%Y')
  when 2 then replace(strftime(o_orderdate,'%Y-%m-%d'),'-',chr(8209)) else o_orderpriority end as cell from orders),
y as (select o_orderkey, {date_of('cell')} as shutdown_date from x)
select o_orderkey, shutdown_date, case when shutdown_date is not null then case when shutdown_date<='1996-01-01' then 'retired' else 'deprecated' end end as lifecycle from y
""")

FLAT = "trim(regexp_replace({x},'[\\s\\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+',' ','g'))"
HASHED = f"""
n as (select *, {FLAT.format(x="regexp_replace(regexp_replace(text,'(?is)<script\\b[^>]*>.*?</script\\s*>','<script></script>','g'),'(?i)\\s(nonce|integrity)\\s*=\\s*(\"[^\"]*\"|''[^'']*'')','','g')")} as flat from captures),
h as (select url, retrieved_at, text, 'sha256:'||sha256(flat) as content_hash from n)
"""
oracle("doc_hash", "captures", HASHED + f"""
select url, retrieved_at, content_hash, substr(content_hash,8) as doc_key, case when length({FLAT.format(x='text')})>240 then left({FLAT.format(x='text')},237)||'...' else {FLAT.format(x='text')} end as excerpt from h
""")
DRIFT = HASHED.rstrip() + """,
d as (select url, retrieved_at, content_hash, lag(content_hash) over (partition by url order by retrieved_at, content_hash nulls first) as previous_hash from h)
"""
oracle("doc_drift", "captures", DRIFT + """
select *, coalesce(content_hash<>previous_hash,false) as changed from d
""")
oracle("doc_sessions", "captures", DRIFT + """
select url, count(*) as captures, 1+count(*) filter (content_hash<>previous_hash) as sessions, min(retrieved_at) as first_seen, max(retrieved_at) as last_seen from d group by 1
""")
oracle("stream_drift", "captures", DRIFT + """
select * from d where content_hash<>previous_hash
""")
oracle("doc_stale", "evidence_refs", """
x as (select * from evidence_refs)
select candidate_id, content_hash, retrieved_at, coalesce(timestamp '2025-07-01' - try_cast(replace(retrieved_at,'Z','') as timestamp) > interval 90 days, true) as stale from x
""")
oracle("doc_store", "captures", HASHED.replace("from captures", "from grown").replace("n as (", "grown as (select * replace (case when page_id%101=0 then text||repeat('0123456789abcde ',70000) else text end as text) from captures),\nn as (", 1).rstrip() + """,
r as (select *, row_number() over (partition by content_hash order by retrieved_at, url) as rn from h)
select substr(content_hash,8) as doc_key, url, retrieved_at, length(text) as chars from r where rn=1
""")

# --- specs and usage ---------------------------------------------------------


def type_of(n: str) -> str:
    return (
        f"case when json_type({n},'$.type')='ARRAY' then array_to_string(list_sort(json_extract_string({n},'$.type[*]')),'|') "
        f"when json_type({n},'$.type')='VARCHAR' then json_extract_string({n},'$.type') "
        f"when json_type({n},'$.properties')='OBJECT' then 'object' else '' end"
    )


PROPS = """
s as (select api, version, unnest(json_keys(doc::json,'$.components.schemas')) as name, doc::json as doc from spec_docs),
allp as (select api, version, '' as parent, name, -1 as depth, name as path, json_extract(doc,'$.components.schemas.'||name) as node from s
 union all
 select api, version, path, k, depth+1, path||'.'||k, json_extract(node,'$.properties.'||k) from (select *, unnest(json_keys(node,'$.properties')) as k from allp)),
props as (select api, version, parent, name, depth, path, {t} as type, case when json_type(node,'$.enum')='ARRAY' then json_extract_string(node,'$.enum[*]') end as en,
  coalesce(json_type(node,'$.properties')='OBJECT',false) as is_object from allp)
""".replace("{t}", type_of("node"))
oracle("spec_properties", "spec_docs", PROPS + """
select api, version, parent, name, depth, type, '['||coalesce(array_to_string(en,', '),'')||']' as enum, is_object from props
""", recursive=True)
DIFF = PROPS.rstrip() + """,
a as (select * from props where version='A'), b as (select * from props where version='B'),
pairs as (select coalesce(a.api,b.api) as api, coalesce(a.parent,b.parent) as parent, coalesce(a.name,b.name) as name, coalesce(a.path,b.path) as path,
  a.name is not null as in_a, b.name is not null as in_b, a.type as ta, b.type as tb, a.en as ea, b.en as eb, a.is_object and b.is_object as obj
  from a full join b on a.api=b.api and a.parent=b.parent and a.name=b.name),
top as (select api, path from pairs where parent='' and in_a and in_b),
cmp as (select p.* from pairs p join top t on p.api=t.api and p.parent=t.path
 union all select p.* from pairs p join cmp t on p.api=t.api and p.parent=t.path and t.obj),
ren as (select api, parent, max(name) filter (not in_b) as f, max(name) filter (not in_a) as t from cmp group by 1,2
  having count(*) filter (not in_b)=1 and count(*) filter (not in_a)=1 and max(ta) filter (not in_b)=max(tb) filter (not in_a)),
changes as (
 select api, 'field_rename' as kind, parent||'.'||f as path, f as "from", t as "to" from ren
 union all select c.api, 'field_removed', c.path, null, null from cmp c where not c.in_b and not exists (select 1 from ren r where r.api=c.api and r.parent=c.parent)
 union all select api, 'type_change', path, ta, tb from cmp where in_a and in_b and ta<>'' and tb<>'' and ta<>tb
 union all select api, 'enum_value_change', path, '['||coalesce(array_to_string(ea,', '),'')||']', '['||coalesce(array_to_string(eb,', '),'')||']'
  from cmp where in_a and in_b and list_sort(ea) is distinct from list_sort(eb))
"""
oracle("spec_diff", "spec_docs", DIFF + 'select api, kind, path, "from", "to" from changes', recursive=True)
oracle("change_order", "spec_docs", DIFF + """select list_position(['field_rename','field_removed','type_change','enum_value_change'], kind)::bigint as kind_rank, kind, api, path from changes
""", recursive=True)
oracle("spec_change_counts", "spec_docs", DIFF + "select api, kind, count(*) as changes from changes group by 1,2", recursive=True)
oracle("usage_summary", "usage", """
d as (select distinct repo, path_key, file, line, col from usage)
select repo, count(distinct path_key) as paths, count(*) as sites from d group by 1
""")
oracle("usage_prefixes", "usage", """
e as (select *, unnest(range(2,len(string_split(path_key,'.'))+1)) as n from usage),
d as (select distinct repo, array_to_string(string_split(path_key,'.')[1:n],'.') as p, file, line, col from e)
select repo, count(distinct p) as paths, count(*) as sites from d group by 1
""")
SITES = DIFF.rstrip() + """,
u as (select distinct repo, api, regexp_replace(path_key,'^(?i:Api)[.]','') as path, file, line, col from usage),
sites as (select u.*, c.kind, c."from", c."to" from u join changes c using (api, path))
"""
oracle("affected_sites", "spec_docs usage", SITES + "select * from sites", recursive=True)
oracle("unused_changes", "spec_docs usage", SITES + "select api, kind, path from changes c where not exists (select 1 from u where u.api=c.api and u.path=c.path)", recursive=True)
oracle("spec_usage_impact", "spec_docs usage", SITES + """
select repo, kind, count(distinct api||path) as changes, count(*) as sites, kind='field_rename' as auto_fix from sites group by 1,2
""", recursive=True)
oracle("rename_targets", "spec_docs usage", SITES + """
select repo, file, line, col, path, "from", "to" from sites where kind='field_rename' and list_last(string_split(path,'.'))="from"
""", recursive=True)

# --- occurrences and tiers ---------------------------------------------------

TS_TEST = "|".join(C.TS_TEST_PATTERNS)
PY_TEST = "|".join(C.PY_TEST_PATTERNS)
MODEL_LIKE = "coalesce(regexp_matches(encl_name,'(?i)model'),false)"
DEPLOY = "coalesce(encl_name in ('deployment','deploymentName','deployment_name'),false)"
TS_FACTORY = "coalesce(callee in (" + ",".join(q(n) for n in C.TS_FACTORIES) + "),false)"
PY_FACTORY = "coalesce(callee in (" + ",".join(q(n) for n in C.PY_FACTORIES) + "),false)"
TS_POSITION = f"""case when enclosure='property_value' then case when {DEPLOY} then 'azure_deployment' when {MODEL_LIKE} and in_call then 'model_arg' else 'data' end
 when enclosure in ('variable','class_property') then case when {DEPLOY} then 'azure_deployment' when {MODEL_LIKE} then 'model_arg' else 'data' end
 when enclosure='call_arg' and {TS_FACTORY} then 'model_arg' else 'data' end"""
PY_POSITION = f"""case when enclosure='kwarg' then case when {DEPLOY} then 'azure_deployment' when {MODEL_LIKE} then 'model_arg' else 'data' end
 when enclosure='property_value' then case when {DEPLOY} then 'azure_deployment' when {MODEL_LIKE} and in_call then 'model_arg' else 'data' end
 when enclosure in ('variable','param_default') then case when {DEPLOY} then 'azure_deployment' when {MODEL_LIKE} and sunk then 'model_arg' when {MODEL_LIKE} then 'usage_unverified' else 'data' end
 when enclosure='call_arg' and {PY_FACTORY} then 'model_arg' else 'data' end"""
PURPOSE = """case when position<>'data' then null when enclosure='property_key' then 'lookup_key' when enclosure='property_value' then 'catalog_entry'
 when enclosure='array_element' then 'list_entry' when enclosure='comparison' then 'comparison' else 'generic' end"""
PLACED = f"""
sunk as (select f.*, exists(select 1 from sink_facts s where s.repo=f.repo and s.path=f.path and s.name=f.encl_name) as sunk from literal_facts f),
pos0 as (select *, case when lang='ts' then {TS_POSITION} else {PY_POSITION} end as pos from sunk),
pos1 as (select * exclude (pos), lang='ts' and pos='model_arg' and coalesce(cast_type not in ('string','const'),false) as cast_masked,
  case when lang='ts' and pos='model_arg' and coalesce(cast_type not in ('string','const'),false) then 'data' else pos end as position from pos0),
placed as (select *, case when cast_masked then 'generic' else {PURPOSE} end as purpose from pos1)
"""
FIRST = f"""
first as (select * from (select *, row_number() over (partition by deprecated order by ord) as rn, {ELIGIBLE} as ok, {STATE} as st from registry_ids) where rn=1)
"""
OCC = PLACED.rstrip() + "," + FIRST.rstrip() + f""",
scoped as (select * from placed where case when lang='ts' then not ends_with(path,'.d.ts') and not regexp_matches(path,'(^|/)node_modules/') and not regexp_matches(path,{q(TS_TEST)}) else not regexp_matches(path,{q(PY_TEST)}) end),
matched as (select s.*, f.ord as record_ord, f.replacement, f.status as lifecycle, f.shutdown_date, f.v_status, f.v_official, f.v_replacement, f.checked_at, f.ok, f.st from scoped s join first f on f.deprecated=s.value),
occ as (select *, case when position='model_arg' and ok then 'A' when position in ('model_arg','azure_deployment','usage_unverified') or cast_masked then 'B' else 'C' end as tier,
  case when position='model_arg' and not ok then 'replacement_unverified' when position='azure_deployment' then 'platform_blocked' when position='usage_unverified' then 'usage_unverified' when cast_masked then 'type_cast_masked' end as reason,
  case when position='model_arg' and not ok and st='verified' then 'unverified' else st end as verdict from matched)
"""
T = "literal_facts sink_facts registry_ids"
oracle("occ_match", "literal_facts registry_ids", FIRST.strip() + f"""
select repo, value, f.ord as record_ord, coalesce(f.entry_id,{entry_id('f')}) as entry_id, f.st as state, count(*) as n
from literal_facts l join first f on f.deprecated=l.value group by all
""")
oracle("occ_position_ts", "literal_facts sink_facts", PLACED + """
select enclosure, encl_name, in_call, callee, cast_type, position, purpose, cast_masked, count(*) as n from placed where lang='ts' group by all
""")
oracle("occ_position_py", "literal_facts sink_facts", PLACED + """
select repo, enclosure, encl_name, in_call, callee, position, purpose, count(*) as n from placed where lang='py' group by all
""")
oracle("finding_keys", T, OCC + "select path||':'||line||':'||col||':'||value as key, count(*) as findings from occ group by 1")
oracle("occ_tiers", T, OCC + "select repo, path, lang, line, col, value, position, purpose, tier, reason, verdict from occ")
oracle("occ_views", T, OCC + """
select lang, case when position='model_arg' and ok then 'swap' when position='model_arg' then 'blocked' when position='azure_deployment' then 'alias' when position='usage_unverified' then 'usage_unverified' else 'data' end as view, tier, count(*) as n from occ group by all
""")
SWAPS = OCC.rstrip() + ",\nsw as (select * from occ where tier='A' and value<>replacement)\n"
oracle("occ_swaps", T, SWAPS + "select repo, path, line, col, value, replacement from sw")
oracle("tier_rollup", T, OCC + """
select repo, tier, coalesce(reason,'-') as reason, count(*) as occurrences, 0 as level from occ group by 1,2,3
union all select repo, tier, null, count(*), 1 from occ group by 1,2
union all select repo, null, null, count(*), 3 from occ group by 1
union all select null, null, null, count(*), 7 from occ
""")
oracle("tier_gate", T, OCC + "select repo, bool_or(tier='A') as tripped from occ group by 1")
oracle("tier_unique", T, OCC + """
select repo, count(distinct (path,line,col,value)) as model_ids, count(*) as tier_sum, 0 as param_sites, count(distinct (path,line,col,value)) as total,
 count(distinct (path,line,col,value))=count(*) as reconciles from occ group by 1
""")
oracle("tier_collisions", T, OCC + """
select repo, path, line, col, value, string_agg(distinct tier,'+' order by tier) as tiers from occ group by 1,2,3,4,5 having count(distinct tier)>1
""")
oracle("terminal_tier", T, OCC + "select repo, path, line, col, value, min(tier) as terminal_tier from occ group by 1,2,3,4,5")
oracle("multi_tier_notes", T, OCC.rstrip() + """,
s as (select distinct repo, value, tier, path, line from occ),
m as (select repo, value, count(distinct path)=1 as one_file from s group by 1,2 having count(distinct tier)>1),
r as (select s.*, one_file, row_number() over (partition by repo, value, tier order by path, line) as rn, count(*) over (partition by repo, value, tier) as n from s join m using (repo, value))
select repo, value, tier, one_file, string_agg(case when one_file then 'L'||line else path||':'||line end, ', ' order by rn) as shown, greatest(max(n)-4,0) as more from r where rn<=4 group by 1,2,3,4
""")
RANK = "case reason " + " ".join(f"when '{r}' then {i}" for i, r in enumerate(C.REVIEW_REASONS, 1)) + " else 7 end"
oracle("review_top", T, OCC.rstrip() + f""",
s as (select distinct repo, reason, path, line, col, value, verdict from occ where tier='B'),
r as (select *, row_number() over (partition by repo order by {RANK}, path, line, col, value) as rank, count(*) over (partition by repo) as n from s)
select repo, reason, path, line, col, value, verdict, rank, greatest(n-12,0) as more from r where rank<=12
""")
oracle("review_findings", T, OCC + "select repo, path, line, col, value, reason, verdict from occ where tier='B'")
FILES = OCC.rstrip() + """,
fr as (select repo, path, count(*) as hits, count(distinct value) as ids, count(*) filter (purpose='comparison') as comparisons from occ where tier='C' group by 1,2)
"""
oracle("file_rollup", T, FILES + """
select repo, path, hits, ids, comparisons, ids>10 or regexp_matches(list_last(string_split(path,'/')),'(?i)prices|models|constant|limits|llm-list|masks') as catalog_like from fr
""")
oracle("capped_listing", T, FILES.rstrip() + """,
r as (select *, row_number() over (partition by repo order by hits desc, path) as rank, count(*) over (partition by repo) as n from fr)
select repo, path, hits, rank, greatest(n-10,0) as more from r where rank<=10
""")
oracle("file_id_lines", T, OCC.rstrip() + """,
g as (select repo, path, value, line, count(*) as n from occ where tier='C' group by 1,2,3,4),
r as (select *, row_number() over (partition by repo, path, value order by line) as rn, count(*) over (partition by repo, path, value) as lines, sum(n) over (partition by repo, path, value) as hits from g)
select repo, path, value, max(hits)::bigint as hits, string_agg('L'||line,', ' order by rn) as shown, greatest(max(lines)-4,0) as more from r where rn<=4 group by 1,2,3
""")
oracle("swap_labels", T, SWAPS + """
select repo, '"'||value||'"'||case when lifecycle='retired' then ' (retired)' when lifecycle='deprecated' and coalesce(shutdown_date,'')<>'' then ' (shuts down '||shutdown_date||')' else '' end||' -> "'||replacement||'"' as label, count(*) as sites from sw group by 1,2
""")
oracle("mixed_family", T, SWAPS.rstrip() + """,
t as (select repo, replacement, count(*) as sites, case when regexp_matches(replacement,'\\d') then regexp_extract(replacement,'^(.*?\\d+)',1) else replacement end as family from sw group by 1,2),
m as (select repo, count(distinct family) as families from t group by 1 having count(distinct family)>1)
select t.*, families from t join m using (repo)
""")
EVIDENCE = SWAPS.rstrip() + """,
rec as (select distinct repo, value, v_status, v_official, v_replacement, checked_at from sw),
ev as (select o.repo, count(r.value) as records, bool_and(r.v_status='verified' and r.v_replacement) as good, bool_and(r.v_official) as offi, min(r.checked_at) as oldest,
  count(*) filter (r.value is not null and r.checked_at is null) as undated from (select distinct repo from occ) o left join rec r using (repo) group by 1)
"""
oracle("patch_evidence", T, EVIDENCE + """
select repo, records, case when records=0 then 'n/a' when good then 'verified' else 'not verified' end as replacement_verdict,
 case when records=0 then 'n/a' when offi then 'confirmed' else 'not confirmed' end as official_source, oldest, undated from ev
""")

# --- parameters and rewriting ------------------------------------------------

oracle("param_sites", "option_objects const_bindings registry_params", """
fk as (select *, row_number() over (partition by repo, path, obj_id, key order by key_start) as rn from option_objects),
m as (select * from fk where rn=1 and key='model' and key_kind in ('property','shorthand')),
p as (select * from fk where rn=1 and key<>'model' and key_kind='property'),
c as (select * from (select *, row_number() over (partition by repo, path, ident order by literal_start) as rn from const_bindings) where rn=1),
r as (select m.repo, m.path, m.obj_id, coalesce(m.value_literal, c.literal) as model from m left join c on c.repo=m.repo and c.path=m.path and c.ident=case when m.key_kind='shorthand' then 'model' else m.value_ident end),
s as (select r.*, p.key as param, unnest(list_transform(range(1, len(string_split(r.model,'-'))+1), lambda i: array_to_string(string_split(r.model,'-')[1:i],'-'))) as family
 from r join p using (repo, path, obj_id)),
f as (select ord, kind, param, replacement, unnest(string_split(on_models,',')) as family from registry_params)
select distinct repo, path, obj_id, model, param, f.kind, f.replacement as new_name, f.ord as entry_ord from s join f using (param, family)
""")
oracle("family_matches", "option_objects registry_params", """
m as (select distinct value_literal as model from option_objects where key='model' and value_literal is not null),
f as (select distinct unnest(string_split(on_models,',')) as family from registry_params)
select model, family from m join f on model=family or starts_with(model, family||'-')
""")

SCOPED_FILES = f"""
sf as (select *, case when ends_with(path,'.py') then 'py' else 'ts' end as lang, regexp_extract(path,'f(\\d+)',1)::bigint as n from source_files
  where not starts_with(path,'tests/') and not starts_with(path,'node_modules/') and not ends_with(path,'.d.ts')),
noted as (select *, regexp_extract(text,'scan: (model-catalog|ignore-file)',1) as note from sf)
"""
# The template of every source is known, so each literal is cut out with a pattern of its own.
LITS = SCOPED_FILES.rstrip() + """,
clean as (select * from noted where note=''),
lines as (select repo, path, lang, text, unnest(range(1,len(string_split(text,chr(10)))+1)) as line, unnest(string_split(text,chr(10))) as l from clean),
model_lits as (select repo, path, lang, line, l, text, regexp_extract(l,'model(?: =|:) "([^"]*)"',1) as value, instr(l,'"') as col,
   case when lang='ts' then 'property_value' else 'variable' end as enclosure from lines where regexp_matches(l,'model(?: =|:) "')),
key_lits as (select repo, path, lang, line, l, text, regexp_extract(l,'"([^"]*)": 1',1) as value, instr(l,'"') as col, 'property_key' as enclosure from lines where regexp_matches(l,'^const T')),
stop_lits as (select repo, path, lang, line, l, text, 'acme' as value, instr(l,'"acme"') as col, 'property_value' as enclosure from lines where regexp_matches(l,'stop: "acme"'))
"""
SCANNED = LITS.rstrip() + "," + FIRST.rstrip() + """,
hit as (select s.*, f.replacement, f.ok, f.ord from (select * from model_lits union all select * from key_lits) s join first f on f.deprecated=s.value),
so as (select *, case when enclosure='property_key' then 'C' when lang='py' and not contains(text,'run(model=model)') then 'B' when ok then 'A' else 'B' end as tier,
  case when enclosure='property_key' then null when lang='py' and not contains(text,'run(model=model)') then 'usage_unverified' when not ok then 'replacement_unverified' end as reason from hit),
ed as (select *, replace(l,'"'||value||'"','"'||replacement||'"') as new_l from so where tier='A' and value<>replacement)
"""
S = "source_files registry_ids"
oracle("scan_occurrences", S, SCANNED + "select repo, path, line, col, value, enclosure, tier, reason from so")
oracle("stream_scan", S, SCANNED + "select repo, path, line, col, value, tier, reason from so")
oracle("patched_files", S, SCANNED + "select repo, path, 1 as edits, replace(text, l, new_l) as new_text from ed")
oracle("changed_lines", S, SCANNED + "select repo, path, line, l as before, new_l as after from ed")
oracle("edit_order", S, SCANNED + """
select repo, path, 1 as edit_no, instr(text,l)-1+col-1+(lang='py')::int as "start", instr(text,l)-1+col-1+(lang='py')::int+length(value)+case when lang='ts' then 2 else 0 end as "end",
 case when lang='ts' then '"'||replacement||'"' else replacement end as new_text from ed
""")
# temperature: 0 is the only parameter of the template; it is judged on the model after the swap.
COMBINED = SCANNED.rstrip() + """,
mods as (select m.repo, m.path, m.line, m.l, m.lang, coalesce(e.replacement, m.value) as model, coalesce(e.new_l, m.l) as base from model_lits m left join ed e using (repo, path, line)),
pe as (select m.*, g.kind, g.replacement as new_name, row_number() over (partition by m.repo, m.path order by g.ord) as rn from mods m join registry_params g on g.param='temperature'
  and len(list_filter(string_split(g.on_models,','), lambda v: m.model=v or starts_with(m.model, v||'-')))>0 where m.lang='ts' and contains(m.l,'temperature: 0')),
fin as (select m.repo, m.path, m.line, m.l as before, case when p.kind='param_removal' then replace(m.base,'temperature: 0 ','') when p.kind='param_rename' then replace(m.base,'temperature:',p.new_name||':') else m.base end as after
  from mods m left join (select * from pe where rn=1) p using (repo, path, line))
"""
oracle("combined_fix", S + " registry_params", COMBINED + "select * from fin where before<>after")
oracle("fix_summary", S + " registry_params", COMBINED.rstrip() + """,
cnt as (select repo, path, count(*) as k from (select repo, path from ed union all select repo, path from pe where rn=1) group by 1,2)
select repo, count(*) as changed_files, sum(k)::bigint as sites from cnt group by 1
""")
oracle("rename_fix", "spec_docs", DIFF.rstrip() + """,
r as (select *, regexp_extract(path,'^S(\\d+)',1)::bigint as k from changes where kind='field_rename' and regexp_matches(path,'^S\\d+[.]card[.]name$'))
select 'r'||(k%10) as repo, 'src/u'||k||'.ts' as path, 'const v = S'||k||'.card.'||"to"||';'||chr(10)||'log(v.name);'||chr(10) as new_text from r
""", recursive=True)
oracle("edit_choice", "edits", """
n as (select *, row_number() over (partition by repo, path order by pos, ord, upto, new_text) as rn, row_number() over (partition by repo, path, pos order by ord, upto, new_text) as rk,
  first_value(upto) over (partition by repo, path, pos order by ord, upto, new_text) as f_upto, first_value(new_text) over (partition by repo, path, pos order by ord, upto, new_text) as f_text
  from (select distinct * from edits)),
w as (select n.*, 'applied' as outcome, upto as reach from n where rn=1
 union all
 select x.* exclude (reach0), case when x.outcome='applied' then x.upto else x.reach0 end as reach from (
  select n.*, case when n.rk>1 and n.upto=n.f_upto and n.new_text=n.f_text then 'repeated' when n.rk>1 then 'same_start' when n.pos<w.reach then 'overlaps' else 'applied' end as outcome, w.reach as reach0
  from w join n on n.repo=w.repo and n.path=w.path and n.rn=w.rn+1) x)
select repo, path, pos, upto, new_text, ord, outcome from w
""", recursive=True)
PLAN = SCOPED_FILES.rstrip() + """,
pl as (select repo, path, case when n%4001=0 then 'listed_twice' when n%5003=1 then 'missing' when n%2003=2 then 'drifted' else 'ok' end as preflight from sf),
plan as (select *, case when bool_and(preflight='ok') over (partition by repo) then 'written' else 'refused' end as decision from pl)
"""
oracle("write_plan", "source_files", PLAN + "select * from plan")
oracle("write_disposition", "source_files gate_config " + T, PLAN.rstrip() + "," + OCC.rstrip() + """,
a_tier as (select repo, count(*) as tier_a from occ where tier='A' group by 1),
w as (select repo, bool_and(decision='written') as written from plan group by 1),
lab as (select repo, tier_a, case when repo in (select repo from gate_config where config is null) then 'downgraded' when coalesce(written,false) then 'applied' else 'refused' end as s from a_tier left join w using (repo))
select repo, tier_a, case when s='applied' then tier_a else 0 end as applied, 0::bigint as ready, case when s='refused' then tier_a else 0 end as refused, case when s='downgraded' then tier_a else 0 end as downgraded from lab
""")

# --- corpus ------------------------------------------------------------------

# Every token starts with acme-m or acme-x, so a text position decides by its longest digit run.
TOKENS = """
tok as (select deprecated as token from registry_ids union select unnest(string_split(on_models,',')) from registry_params),
pieces as (select repo, path, unnest(regexp_extract_all(text,'acme-[mx]\\d+')) as w from sf),
heads as (select repo, path, w, unnest(range(7,length(w)+1)) as k from pieces),
hits as (select distinct repo, path from heads where substr(w,1,k) in (select token from tok))
"""
C_TABLES = "source_files registry_ids registry_params"
oracle("prefilter", C_TABLES, SCOPED_FILES.rstrip() + "," + TOKENS + "select repo, path from hits")
oracle("coverage", C_TABLES, SCOPED_FILES.rstrip() + "," + TOKENS.rstrip() + """,
x as (select n.*, h.path is not null as hit from noted n left join hits h using (repo, path))
select s.repo, coalesce(count(x.path),0) as files, count(*) filter (x.lang='ts') as ts_files, count(*) filter (x.lang='py') as py_files, count(*) filter (x.hit) as matched,
 count(*) filter (x.note='ignore-file') as ignored, count(*) filter (x.note='model-catalog') as catalogs, count(x.path)>0 as scan_ok
from (select distinct repo from source_files) s left join x using (repo) group by 1
""")
oracle("uncovered", "source_files", SCOPED_FILES + "select repo, path from sf where n%10=3")
QUOTED = """
w as (select repo, path, unnest(regexp_extract_all(text,'"([^"\\n]*)"',1)) as id from {src}),
known as (select distinct repo, path, id from w where id in (select deprecated from registry_ids))
"""
oracle("catalog_ids", S, QUOTED.format(src="source_files") + "select repo, path, id from known")
oracle("annotated_files", S, SCOPED_FILES.rstrip() + ",\nmarked as (select * from noted where note<>''),\ncats as (select * from marked where note='model-catalog'),"
       + QUOTED.format(src="cats") + """
select m.repo, m.path, m.note as annotation, count(k.id) as ids from marked m left join known k using (repo, path) group by 1,2,3
""")

# --- extraction --------------------------------------------------------------

ALL_LITS = LITS.replace("clean as (select * from noted where note='')", "clean as (select * from noted)").rstrip()
oracle("extract_native", "source_files", ALL_LITS + """,
u as (select *, case when lang='ts' then true end as in_call, 'model' as encl_name from model_lits union all select *, null, null from key_lits union all select *, true, 'stop' from stop_lits)
select repo, path, lang, line, col, value, enclosure, encl_name, in_call, null::varchar as callee from u
""")
oracle("extract_ast", "source_files", ALL_LITS + """
select repo, path, line, col, value, enclosure, 'model' as encl_name from model_lits where lang='py'
""")
oracle("scan_function", C_TABLES, LITS.rstrip() + "," + TOKENS + """
select m.repo, m.path, m.line, m.value, m.enclosure from model_lits m join hits using (repo, path) where m.lang='py'
""")
oracle("extract_sinks", "source_files", SCOPED_FILES + """
select repo, path, 'model' as name from sf where lang='py' and contains(text,'run(model=model)')
""")
oracle("extract_options", "source_files", SCOPED_FILES + """
select repo, path, 'model' as key, 'property' as key_kind, regexp_extract(text,'model: "([^"]*)"',1) as value_literal, instr(text,'model: ')-1 as prop_start,
  instr(text,'model: ')-1+length(regexp_extract(text,'model: "[^"]*", ')) as prop_end from sf where lang='ts'
union all select repo, path, case when contains(text,'stop:') then 'stop' else 'temperature' end, 'property', case when contains(text,'stop:') then 'acme' end,
  instr(text,case when contains(text,'stop:') then 'stop: ' else 'temperature: ' end)-1, instr(text,' });')
 from sf where lang='ts'
union all select repo, path, regexp_extract(text,'const T = [{] "([^"]*)"',1), 'property', null, instr(text,'const T = { "')-1+12, instr(text,'1 };')-1+2 from sf where lang='ts'
""")

# --- gates -------------------------------------------------------------------

POLICY = """
pol as (select repo, case s when 4 then 'unknown_gate' when 5 then 'commands_disagree' when 6 then 'bad_required' when 7 then 'bad_eval_timeout' end as problem,
  case s when 2 then 'run-eval' when 3 then 'run-eval' when 5 then 'b' end as eval_command, true as req_typecheck, s=1 as req_tests, s in (2,5) as req_eval
 from (select *, regexp_extract(repo,'r(\\d+)',1)::int%8 as s from gate_config))
"""
GATES = POLICY.rstrip() + """,
go as (select o.*, case gate when 'typecheck' then coalesce(p.req_typecheck,true) when 'tests' then coalesce(p.req_tests,false) else coalesce(p.req_eval,false) end as required from gate_outcomes o left join pol p using (repo)),
bl as (select *, outcome='fail' or (outcome in ('inconclusive','not-configured') and required) as blocks from go)
"""
TIERS = GATES.rstrip() + """,
pl as (select repo, lang, bool_or(blocks and gate<>'eval') as code_blocked, bool_or(blocks and gate='eval') as ev from bl group by 1,2),
pr as (select l.repo, case when p.eval_command is null or bool_or(code_blocked) then coalesce(any_value(p.req_eval),false) else bool_or(ev) end as eval_blocked from pl l left join pol p using (repo) group by l.repo, p.eval_command),
gt as (select repo, lang, code_blocked, eval_blocked, code_blocked or eval_blocked as downgraded from pl join pr using (repo))
"""
oracle("gate_policy", "gate_config", POLICY + "select * from pol")
oracle("gate_blocks", "gate_outcomes gate_config", GATES + "select repo, lang, gate, seq, outcome, required from bl where blocks")
oracle("gate_first_block", "gate_outcomes gate_config", GATES + """
select repo, lang, count(*) as blocks, arg_min(gate, seq) as gate, arg_min(outcome, seq) as outcome from bl where blocks group by 1,2
""")
oracle("gate_tier", "gate_outcomes gate_config", TIERS + "select * from gt")
oracle("gate_downgrade", T + " gate_outcomes gate_config", OCC.rstrip() + "," + TIERS + """
select o.repo, o.lang, case when tier='A' and coalesce(g.downgraded,false) then 'A-held' else tier end as applied_tier, count(*) as n from occ o left join gt g on g.repo=o.repo and g.lang=o.lang group by 1,2,3
""")
oracle("diagnostics_new", "diagnostics", """
x as (select repo, path, code, message from diagnostics where side='patched' except all select repo, path, code, message from diagnostics where side='baseline')
select repo, path, code, message, count(*) as added from x group by 1,2,3,4
""")
oracle("diagnostics_verdict", "diagnostics", """
x as (select repo, path, code, message from diagnostics where side='patched' except all select repo, path, code, message from diagnostics where side='baseline'),
a as (select repo, count(*) as n from x group by 1),
b as (select repo, count(*) filter (side='baseline') as n from diagnostics group by 1)
select b.repo, coalesce(a.n,0) as new_diagnostics, b.n as baseline, coalesce(a.n,0)=0 as passed from b left join a using (repo)
""")
oracle("syntax_gate", "source_files", SCOPED_FILES + """
select repo, path, (contains(text,'//'))::int as baseline_errors, 1 as patched_errors from sf where lang='py' and n%9=0 and not contains(text,'//')
""")
oracle("test_counts", "run_logs", """
t as (select event_id, log, regexp_extract(log,'(?m)^\\s*Tests:?\\s+([^\\n]+)$',1) as line from run_logs),
s as (select event_id, case when line<>'' then line else log end as scope from t),
c as (select event_id, regexp_extract(scope,'(\\d+)\\s+pass(?:ed|ing)\\b',1) as p, regexp_extract(scope,'(\\d+)\\s+fail(?:ed|ing)\\b',1) as f from s)
select event_id, case when p='' and f='' then null when p='' then 0 else p::bigint end as passed, case when p='' and f='' then null when f='' then 0 else f::bigint end as failed from c
""")
oracle("clipped_logs", "", """
x as (select doc_id, text from documents)
select doc_id, case when length(text)<=400 then text else left(text,200)||chr(10)||'<< '||(length(text)-400)||' characters left out >>'||chr(10)||right(text,200) end as log from x
""")

# --- streaming ---------------------------------------------------------------

# Windows that end after the last watermark are open when the input ends.
WATERMARK = "(select max(date_trunc('millisecond', ts)) - interval 10 minutes from finding_feed)"
oracle("stream_rates", "finding_feed", f"""
x as (select time_bucket(interval 1 hour, ts) as window_start, tier, count(*) as findings from finding_feed group by 1,2)
select window_start, window_start + interval 1 hour as window_end, tier, findings, window_start + interval 1 hour > {WATERMARK} as open from x
""")
oracle("stream_sliding", "finding_feed", f"""
e as (select tier, time_bucket(interval 30 minutes, ts) - interval 30 minutes * k as window_start from finding_feed, (select unnest(range(4)) as k) r),
x as (select window_start, tier, count(*) as findings from e group by 1,2)
select window_start, window_start + interval 2 hours as window_end, tier, findings, window_start + interval 2 hours > {WATERMARK} as open from x
""")
# One of the findings of a moment is fresh, whichever; the range counts it for all of them.
oracle("stream_sessions", "finding_feed", f"""
g as (select *, case when ts - lag(ts) over (partition by repo, tier order by ts) <= interval 30 minutes then 0 else 1 end as fresh from finding_feed),
s as (select *, sum(fresh) over (partition by repo, tier order by ts range unbounded preceding) as sid from g),
x as (select repo, tier, sid, min(ts) as window_start, max(ts) + interval 30 minutes as window_end, count(*) as findings from s group by 1,2,3)
select window_start, window_end, repo, tier, findings, window_end > {WATERMARK} as open from x
""")
