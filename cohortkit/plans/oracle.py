"""Equivalent SQL for each driver query, written for DuckDB over the raw tables.

Every statement starts from the same fixture views as ``sources.fixtures`` and
re-derives the result independently (brute-force pair counts for the rank metrics,
plain window functions for ranks and BH). Doubles are rounded to 6 places.
"""

from __future__ import annotations

# Fixed values shared with the Spark side: fixture views (FIXTURES.md B).
BASE = """
persons as (
  select c.c_custkey as person_id,
         case when c.c_custkey % 20 = 19 then 'Other' when c.c_custkey % 2 = 0 then 'Man' else 'Woman' end as gender,
         c.c_mktsegment as race, r.r_name as ethnicity,
         cast(18 + c.c_custkey % 70 as double) as age,
         cast((c.c_custkey * 7) % 5 as int) as q1_score,
         cast((cast(floor(abs(c.c_acctbal)) as bigint)) % 5 as int) as q2_score,
         cast((cast(floor(abs(c.c_acctbal) * 3) as bigint)) % 5 as int) as q3_score
  from customer c join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey),
scored as (select p.*, q1_score + q2_score + q3_score as audit_c_score from persons p),
exposures as (
  select o.o_custkey as person_id, concat_ws(' ', p.p_name, p.p_type, p.p_size) as concept_name,
         cast(l.l_shipdate as date) as drug_exposure_start_date, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey join part p on l.l_partkey = p.p_partkey),
como_long as (
  select distinct o_custkey as person_id, substr(o_orderpriority, 3) as comorbidity
  from orders where o_orderstatus = 'F'),
packed_como as (
  select person_id, array_to_string(list_sort(list(comorbidity)), ',') as comorbidity
  from como_long group by person_id),
packed_drugs as (
  select person_id, array_to_string(list_sort(list(distinct concept_name)), ' | ') as standard_concept_name
  from exposures group by person_id),
demo_como as (
  select s.person_id, s.gender, s.race, s.ethnicity, s.age, pc.comorbidity,
         s.q1_score, s.q2_score, s.q3_score, s.audit_c_score
  from scored s left join packed_como pc on s.person_id = pc.person_id),
matched as (
  select d.*, pd.standard_concept_name from demo_como d join packed_drugs pd on d.person_id = pd.person_id),
labeled as (
  select m.*, case when (gender = 'Man' and audit_c_score >= 4) or (gender = 'Woman' and audit_c_score >= 3)
                   then 1 else 0 end as grp
  from matched m),
drug_long as (
  select distinct person_id, trim(t) as drug
  from (select person_id, unnest(string_split(standard_concept_name, ' | ')) as t from packed_drugs)
  where trim(t) <> ''),
ranked as (
  select person_id, concept_name, drug_exposure_start_date,
         row_number() over (partition by person_id order by drug_exposure_start_date desc, concept_name,
                            l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n
  from exposures),
wide as (
  select person_id,
    coalesce(max(case when n = 1 then concept_name end), '') as concept_name_1,
    coalesce(max(case when n = 2 then concept_name end), '') as concept_name_2,
    coalesce(max(case when n = 3 then concept_name end), '') as concept_name_3,
    coalesce(max(case when n = 1 then cast(drug_exposure_start_date as varchar) end), '') as drug_exposure_start_date_1,
    coalesce(max(case when n = 2 then cast(drug_exposure_start_date as varchar) end), '') as drug_exposure_start_date_2,
    coalesce(max(case when n = 3 then cast(drug_exposure_start_date as varchar) end), '') as drug_exposure_start_date_3
  from ranked where n <= 3 group by person_id),
three_drug as (
  select d.*, w.concept_name_1, w.concept_name_2, w.concept_name_3,
         w.drug_exposure_start_date_1, w.drug_exposure_start_date_2, w.drug_exposure_start_date_3
  from demo_como d join wide w on d.person_id = w.person_id),
split_rank as (
  select person_id, row_number() over (order by md5(concat('6179', ':', cast(person_id as varchar))), person_id) as r
  from three_drug),
split_cohort as (
  select t.*, case when s.r <= 100 then 'validation' when s.r <= 300 then 'test' else 'train' end as split
  from three_drug t join split_rank s on t.person_id = s.person_id),
preds as (
  select person_id, ethnicity as run_id, cast(audit_c_score as double) as label, round(age / 8, 1) as prediction
  from scored)
"""

# screen pieces: ordinal codes, value histograms, MWU
SCREEN = """,
codes_g as (select v, case when v = 'Man' then 0 else row_number() over (partition by v = 'Man' order by v) end as code
            from (select distinct gender as v from labeled where gender is not null)),
codes_r as (select v, case when v = 'BUILDING' then 0 else row_number() over (partition by v = 'BUILDING' order by v) end as code
            from (select distinct race as v from labeled where race is not null)),
codes_e as (select v, case when v = 'AFRICA' then 0 else row_number() over (partition by v = 'AFRICA' order by v) end as code
            from (select distinct ethnicity as v from labeled where ethnicity is not null)),
demo_long as (
  select 'gender' as feature, cast(coalesce(c.code, -1) as double) as value, l.grp from labeled l left join codes_g c on l.gender = c.v
  union all
  select 'race', cast(coalesce(c.code, -1) as double), l.grp from labeled l left join codes_r c on l.race = c.v
  union all
  select 'ethnicity', cast(coalesce(c.code, -1) as double), l.grp from labeled l left join codes_e c on l.ethnicity = c.v),
demo_hist as (
  select 'demo' as feature_group, feature, value, cast(sum(grp) as bigint) as a, cast(sum(1 - grp) as bigint) as b
  from demo_long group by feature, value),
tot as (select cast(sum(grp) as bigint) as n1, cast(sum(1 - grp) as bigint) as n0 from labeled),
drug_tok as (
  select distinct person_id, grp, trim(t) as token
  from (select person_id, grp, unnest(string_split(standard_concept_name, ' | ')) as t from labeled
        where standard_concept_name is not null)
  where trim(t) <> ''),
como_tok as (
  select distinct person_id, grp, trim(t) as token
  from (select person_id, grp, unnest(string_split(comorbidity, ',')) as t from labeled where comorbidity is not null)
  where trim(t) <> ''),
tok_sum as (
  select 'drug' as feature_group, token as feature, cast(sum(grp) as bigint) as a, cast(sum(1 - grp) as bigint) as b
  from drug_tok group by token
  union all
  select 'comorbidity', token, cast(sum(grp) as bigint), cast(sum(1 - grp) as bigint) from como_tok group by token),
sparse_hist as (
  select s.feature_group, s.feature, 0.0 as value, t.n1 - s.a as a, t.n0 - s.b as b from tok_sum s cross join tot t
  union all
  select feature_group, feature, 1.0, a, b from tok_sum),
hist as (select * from demo_hist union all select * from sparse_hist),
h2 as (
  select *, cast(a + b as double) as t,
         coalesce(sum(a + b) over (partition by feature_group, feature order by value
                                   rows between unbounded preceding and 1 preceding), 0) as pre
  from hist),
mw as (
  select feature_group, feature, cast(sum(a) as bigint) as n1, cast(sum(b) as bigint) as n0,
         sum(a * (pre + (t + 1) / 2.0)) as r1, sum(t * t * t - t) as ties,
         sum(value * a) as sv1, sum(value * b) as sv0
  from h2 group by feature_group, feature),
mw2 as (select *, r1 - n1 * (n1 + 1) / 2.0 as u1, cast(n1 as double) * n0 as nn, cast(n1 + n0 as double) as n from mw),
mw3 as (select *, greatest(u1, nn - u1) as u, nn / 12.0 * ((n + 1) - ties / (n * (n - 1))) as var from mw2),
mwu as (
  select feature_group, feature, n1, n0, u, var,
         case when n1 = 0 or n0 = 0 or var <= 0 then null else (u - nn / 2.0 - 0.5) / sqrt(var) end as z,
         case when n1 = 0 or n0 = 0 then null
              else log2((sv1 / n1) / ((sv0 / n0) + 1e-12) + 1e-12) end as log2fc
  from mw3),
tt as (
  select count(case when grp = 1 then age end) as n1, count(case when grp = 0 then age end) as n0,
         avg(case when grp = 1 then age end) as m1, avg(case when grp = 0 then age end) as m0,
         coalesce(var_samp(case when grp = 1 then age end), 0) as v1,
         coalesce(var_samp(case when grp = 0 then age end), 0) as v0
  from labeled),
ttest as (
  select 'age' as feature, n1, n0,
         (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2.0) * (1.0 / n1 + 1.0 / n0)) as t_stat,
         cast(n1 + n0 - 2 as double) as dof, log2(m1 / (m0 + 1e-12)) as log2fc
  from tt)
"""

HEAD_SQL = ("'### Score the user''s Alcohol Use Disorders Identification Test (AUDIT-C) "
            "from 0 to 12 based on the provided demographics and comorbidity data:' || chr(10)")

QUERIES: dict[str, str] = {}


def _q(name: str, body: str, screen: bool = False) -> None:
    QUERIES[name] = "with " + BASE + (SCREEN if screen else "") + "\n" + body


# ---------------------------------------------------------------- tokens
_q("token_long", "select person_id, drug from drug_long")
_q("token_vocab", "select drug, count(distinct person_id) as n_persons from drug_long group by drug")
_q("indicator_wide", """
select d.person_id,
  cast(coalesce(list_contains(list_transform(string_split(d.comorbidity, ','), lambda x: trim(x)), 'HIGH'), false) as int) as "HIGH",
  cast(coalesce(list_contains(list_transform(string_split(d.comorbidity, ','), lambda x: trim(x)), 'LOW'), false) as int) as "LOW",
  cast(coalesce(list_contains(list_transform(string_split(d.comorbidity, ','), lambda x: trim(x)), 'MEDIUM'), false) as int) as "MEDIUM",
  cast(coalesce(list_contains(list_transform(string_split(d.comorbidity, ','), lambda x: trim(x)), 'NOT SPECIFIED'), false) as int) as "NOT SPECIFIED",
  cast(coalesce(list_contains(list_transform(string_split(d.comorbidity, ','), lambda x: trim(x)), 'URGENT'), false) as int) as "URGENT"
from demo_como d""")
_q("indicator_substring", """
select distinct p.person_id, v.drug as drug_match
from packed_drugs p join (select distinct drug from drug_long) v on contains(p.standard_concept_name, v.drug)""")

# ---------------------------------------------------------------- sequence / pivot / roll-up
_q("top3_exposures", """
select person_id, cast(n as int) as n, concept_name, drug_exposure_start_date from ranked where n <= 3""")
_q("three_drug_pivot", "select * from three_drug")
_q("drug_rollup_6m", """
select e.person_id, array_to_string(list_sort(list(distinct e.concept_name)), ' | ') as standard_concept_name,
       count(distinct e.concept_name) as n_names
from exposures e join (select person_id, max(drug_exposure_start_date) as idx from exposures group by person_id) i
  on e.person_id = i.person_id
where e.drug_exposure_start_date >= i.idx - interval 6 month
group by e.person_id""")

# ---------------------------------------------------------------- joins
_q("matched_inner", "select * from matched")
_q("semi_match", "select * from scored where person_id in (select person_id from exposures)")
_q("left_exposures", """
select s.person_id, s.gender, e.concept_name, e.drug_exposure_start_date
from scored s left join exposures e on s.person_id = e.person_id""")
_q("anti_uncached", """
select k.doc_id, k.text_key from (select doc_id, md5(text) as text_key from documents) k
where not exists (select 1 from documents c where c.doc_id % 3 <> 0 and md5(c.text) = k.text_key)""")
_q("aligned_lookup", """
select s.person_id, s.gender, p.standard_concept_name
from scored s join packed_drugs p on s.person_id = p.person_id
where s.person_id in (select person_id from exposures)""")

# ---------------------------------------------------------------- split
_q("exact_split", "select person_id, split from split_cohort")
_q("split_counts", "select split, count(*) as n_rows from split_cohort group by split")

# ---------------------------------------------------------------- encodings
WITH_DRUGS = """,
people as (select d.*, pd.standard_concept_name as drug from demo_como d left join packed_drugs pd on d.person_id = pd.person_id)"""
_q("encode_reference", WITH_DRUGS + """,
cg as (select v, case when v = 'Man' then 0 else row_number() over (partition by v = 'Man' order by v) end as code
       from (select distinct gender as v from people where gender is not null)),
cr as (select v, case when v = 'BUILDING' then 0 else row_number() over (partition by v = 'BUILDING' order by v) end as code
       from (select distinct race as v from people where race is not null)),
ce as (select v, case when v = 'AFRICA' then 0 else row_number() over (partition by v = 'AFRICA' order by v) end as code
       from (select distinct ethnicity as v from people where ethnicity is not null)),
cd as (select v, row_number() over (order by v) as code from (select distinct drug as v from people where drug is not null))
select s.person_id, cast(coalesce(cg.code, -1) as int) as gender_code, cast(coalesce(cr.code, -1) as int) as race_code,
       cast(coalesce(ce.code, -1) as int) as ethnicity_code, cast(coalesce(cd.code, -1) as int) as drug_code
from people s left join cg on s.gender = cg.v left join cr on s.race = cr.v left join ce on s.ethnicity = ce.v
  left join cd on s.drug = cd.v""")
_q("category_offsets", WITH_DRUGS + """,
cg as (select v, dense_rank() over (order by v) - 1 as code from (select distinct gender as v from people where gender is not null)),
cr as (select v, dense_rank() over (order by v) - 1 as code from (select distinct race as v from people where race is not null)),
ce as (select v, dense_rank() over (order by v) - 1 as code from (select distinct ethnicity as v from people where ethnicity is not null)),
cd as (select v, dense_rank() over (order by v) - 1 as code from (select distinct drug as v from people where drug is not null)),
o as (select (select count(*) from cg) as ng, (select count(*) from cr) as nr, (select count(*) from ce) as ne)
select s.person_id, cast(coalesce(cg.code + 1, 0) as int) as gender_id,
       cast(coalesce(cr.code + 1 + ng, 0) as int) as race_id,
       cast(coalesce(ce.code + 1 + ng + nr, 0) as int) as ethnicity_id,
       cast(coalesce(cd.code + 1 + ng + nr + ne, 0) as int) as drug_id
from people s cross join o left join cg on s.gender = cg.v left join cr on s.race = cr.v left join ce on s.ethnicity = ce.v
  left join cd on s.drug = cd.v""")
_q("missing_token", WITH_DRUGS + """,
norm as (select person_id,
    case when lower(trim(coalesce(comorbidity, 'NaN'))) in ('na', 'missing', 'nan', 'n/a') then null else comorbidity end as c,
    case when lower(trim(coalesce(drug, 'NaN'))) in ('na', 'missing', 'nan', 'n/a') then null else drug end as d from people),
lv as (select c, row_number() over (order by c) as code from (select distinct c from norm where c is not null)),
ld as (select d, row_number() over (order by d) as code from (select distinct d from norm where d is not null))
select n.person_id, cast(case when n.c is null then 0 else lv.code end as int) as comorbidity_id,
       cast(case when n.d is null then 0 else ld.code end as int) as drug_id
from norm n left join lv on n.c = lv.c left join ld on n.d = ld.d""")
_q("one_hot", """,
cells as (
  select person_id, split, 1 as c, gender as v from split_cohort union all
  select person_id, split, 2, race from split_cohort union all
  select person_id, split, 3, ethnicity from split_cohort union all
  select person_id, split, 4, concept_name_1 from split_cohort),
ids as (select c, v, row_number() over (order by c, v) - 1 as feature_id
        from (select distinct c, v from cells where split = 'train' and v is not null))
select person_id, feature_id from cells join ids using (c, v)""")
_q("zscore_age", """,
st as (select avg(age) as m, stddev_samp(age) as s from split_cohort where split = 'train')
select person_id, split, round((age - st.m) / st.s, 6) as age_z from split_cohort cross join st""")

# ---------------------------------------------------------------- labels
_q("label_binary", """
select person_id, cast(case when (gender = 'Man' and audit_c_score >= 4) or (gender = 'Woman' and audit_c_score >= 3)
                            then 1 else 0 end as int) as label from scored""")
_q("label_parts", """
select person_id, concat_ws(',', q1_score, q2_score, q3_score) as target,
       cast(q1_score + q2_score + q3_score as int) as target_sum from scored""")
_q("label_severity", """
select event_id, user_id as person_id,
       cast(case event_type when 'view' then 0 when 'click' then 1 when 'signup' then 2 when 'purchase' then 3 end as int) as severity
from events where event_type is distinct from 'error'""")
_q("label_insurance", """,
flags as (select o_custkey as person_id,
                 cast(max(case when o_orderstatus = 'F' then 1 else 0 end) as int) as empl_merge,
                 cast(max(case when o_orderstatus = 'O' then 1 else 0 end) as int) as non_empl_merge
          from orders group by o_custkey)
select person_id, empl_merge, non_empl_merge, non_empl_merge as empl_insurance_or_not
from flags where empl_merge = 1 or non_empl_merge = 1""")
_q("score_nonzero", "select person_id, audit_c_score from scored where audit_c_score > 0")

# ---------------------------------------------------------------- narratives
_FLAG = "case when list_contains(coalesce(list_transform(string_split(d.comorbidity, ','), lambda x: trim(x)), []), '{v}') then '{v}' end"
_FLAGS = ", ".join(_FLAG.format(v=v) for v in ("HIGH", "LOW", "MEDIUM", "NOT SPECIFIED", "URGENT"))
_q("narrative_semicolon", f""",
fl as (select d.person_id, d.gender, d.race, d.ethnicity, d.age, concat_ws(', ', {_FLAGS}) as cm from demo_como d)
select f.person_id,
  'gender: ' || coalesce(f.gender, 'None') || '; race: ' || coalesce(f.race, 'None') ||
  '; ethnicity: ' || coalesce(f.ethnicity, 'None') || '; age: ' || coalesce(cast(f.age as varchar), 'None') ||
  '; Comorbidity: ' || case when f.cm = '' then 'None' else f.cm end ||
  '; Recent drug: ' || coalesce(replace(p.standard_concept_name, ' | ', ', '), 'None') || '.' as narrative
from fl f left join packed_drugs p on f.person_id = p.person_id""")
_q("narrative_comma", """
select person_id, concat_ws(', ',
  'gender: ' || coalesce(gender, 'None'), 'race: ' || coalesce(race, 'None'),
  'ethnicity: ' || coalesce(ethnicity, 'None'), 'age: ' || coalesce(cast(age as varchar), 'None'),
  'comorbidity: ' || coalesce(comorbidity, 'None'),
  'Concept Name: ' || coalesce(concept_name_1, 'None') || ' (Exposure Start Date: ' || coalesce(drug_exposure_start_date_1, 'None') || ')',
  'Concept Name: ' || coalesce(concept_name_2, 'None') || ' (Exposure Start Date: ' || coalesce(drug_exposure_start_date_2, 'None') || ')',
  'Concept Name: ' || coalesce(concept_name_3, 'None') || ' (Exposure Start Date: ' || coalesce(drug_exposure_start_date_3, 'None') || ')'
) as narrative from three_drug""")
_q("narrative_space", """
select person_id, concat_ws(' ',
  'person_id: ' || cast(person_id as varchar), 'gender: ' || coalesce(gender, 'None'),
  'race: ' || coalesce(race, 'None'), 'ethnicity: ' || coalesce(ethnicity, 'None'),
  'age: ' || coalesce(cast(age as varchar), 'None'), 'comorbidity: ' || coalesce(comorbidity, 'None'),
  'q1_score: ' || coalesce(cast(q1_score as varchar), 'None'), 'q2_score: ' || coalesce(cast(q2_score as varchar), 'None'),
  'q3_score: ' || coalesce(cast(q3_score as varchar), 'None')) as narrative
from demo_como""")
_q("prompt", f"""
select person_id, {HEAD_SQL} ||
  'Gender=' || coalesce(gender, 'None') || ',' || chr(10) || 'Race=' || coalesce(race, 'None') || ',' || chr(10) ||
  'Ethnicity=' || coalesce(ethnicity, 'None') || ',' || chr(10) || 'Age=' || coalesce(cast(age as varchar), 'None') ||
  ',' || chr(10) || 'Comorbidity=' || coalesce(comorbidity, 'None') || chr(10) ||
  chr(10) || '### AUDIT-C Score:' || ' ' || coalesce(cast(audit_c_score as varchar), 'None') as prompt
from demo_como""")
_q("drug_phrase", """
select s.person_id,
  'Recent drug: ' || coalesce(replace(p.standard_concept_name, ' | ', ', '), 'None') as drug_phrase,
  'Recent drug: ' || replace(p.standard_concept_name, ' | ', ', ') || '.' as drug_sentence,
  coalesce(p.standard_concept_name, 'no_drug') as drug_text
from scored s left join packed_drugs p on s.person_id = p.person_id""")
_q("parse_score", """,
completions as (
  select person_id, case person_id % 10 when 1 then '... ### AUDIT-C Score: text' when 2 then ''
                     when 3 then '... ### AUDIT-C Score: 99'
                     else concat('... ### AUDIT-C Score: ', cast(q1_score as varchar)) end as completion
  from scored),
tails as (select person_id, regexp_replace(string_split(completion, '### AUDIT-C Score:')[-1], '^\\s+|\\s+$', '', 'g') as tl
          from completions),
parsed as (select person_id, regexp_full_match(tl, '[+-]?[0-9]+') as is_int, tl from tails)
select person_id,
  case when is_int and try_cast(tl as bigint) between 0 and 12 then cast(tl as int) end as score,
  coalesce(is_int and try_cast(tl as bigint) between 0 and 12, false) as ok
from parsed""")

# ---------------------------------------------------------------- screen
_q("fold_change", """
select feature_group, feature, round(log2fc, 6) as log2fc from mwu
union all
select 'demo', feature, round(log2fc, 6) from ttest""", screen=True)
_q("mwu_u_z", """
select feature_group, feature, n1, n0, round(u, 6) as u_stat, round(z, 6) as z from mwu""", screen=True)
_q("ttest_stat", """
select feature, n1, n0, round(t_stat, 6) as t_stat, round(dof, 6) as dof, round(log2fc, 6) as log2fc from ttest""",
   screen=True)
_q("bh_fdr", """,
pp as (select feature_group, feature, case when z is null then null else least(1.0, exp(-0.5 * z * z)) end as p from mwu),
rk as (select feature_group, feature, p,
              count(*) over (partition by feature_group order by p range between unbounded preceding and current row) as rnk,
              count(*) over (partition by feature_group) as m
       from pp where p is not null),
qq as (select feature_group, feature,
              least(1.0, min(p * m / rnk) over (partition by feature_group order by p desc
                                                range between unbounded preceding and current row)) as q
       from rk)
select pp.feature_group, pp.feature, round(pp.p, 6) as p, round(qq.q, 6) as q
from pp left join qq on pp.feature_group = qq.feature_group and pp.feature = qq.feature""", screen=True)
_q("accumulated_effect", """
select d.person_id,
  round(coalesce(sum(case when m.log2fc > 0 then m.log2fc end), 0.0), 6) as pos_log2fc,
  round(coalesce(sum(case when m.log2fc < 0 then m.log2fc end), 0.0), 6) as neg_log2fc
from drug_long d join (select feature, log2fc from mwu where feature_group = 'drug') m on d.drug = m.feature
group by d.person_id""", screen=True)

# ---------------------------------------------------------------- metrics
_q("mse_rmse", """
select round(avg((prediction - label) * (prediction - label)), 6) as mse,
       round(sqrt(avg((prediction - label) * (prediction - label))), 6) as rmse from preds""")
_q("c_index", """
select round(sum(case when a.prediction < b.prediction then 1.0 when a.prediction = b.prediction then 0.5 else 0.0 end)
             / count(*), 6) as c_index
from preds a join preds b on a.label < b.label""")
_q("metrics_by_run", """,
r as (select run_id, avg((prediction - label) * (prediction - label)) as mse from preds group by run_id),
c as (select a.run_id,
             sum(case when a.prediction < b.prediction then 1.0 when a.prediction = b.prediction then 0.5 else 0.0 end)
               / count(*) as c_index
      from preds a join preds b on a.run_id = b.run_id and a.label < b.label group by a.run_id)
select r.run_id, round(r.mse, 6) as mse, round(sqrt(r.mse), 6) as rmse, round(c.c_index, 6) as c_index
from r full join c on r.run_id = c.run_id""")
_q("fine_grained", """,
flat as (
  select cast(q1_score as double) as label, round(age / 25, 1) as prediction from scored
  union all select cast(q2_score as double), round(age / 30, 1) from scored
  union all select cast(q3_score as double), round(age / 35, 1) from scored),
tot as (
  select cast(q1_score + q2_score + q3_score as double) as label,
         round(age / 25, 1) + round(age / 30, 1) + round(age / 35, 1) as prediction from scored),
fm as (select avg((prediction - label) * (prediction - label)) as mse from flat),
fc as (select sum(case when a.prediction < b.prediction then 1.0 when a.prediction = b.prediction then 0.5 else 0.0 end)
              / count(*) as c from flat a join flat b on a.label < b.label),
tm as (select avg((prediction - label) * (prediction - label)) as mse from tot),
tc as (select sum(case when a.prediction < b.prediction then 1.0 when a.prediction = b.prediction then 0.5 else 0.0 end)
              / count(*) as c from tot a join tot b on a.label < b.label)
select round(fm.mse, 6) as individual_mse, round(sqrt(fm.mse), 6) as individual_rmse, round(fc.c, 6) as individual_c_index,
       round(tm.mse, 6) as mse, round(sqrt(tm.mse), 6) as rmse, round(tc.c, 6) as c_index
from fm, fc, tm, tc""")
_BP = """,
bp as (select l.doc_id, l.quality as label, least(1.0, d.n_chars / 5000.0) as score
       from labels l join documents d on l.doc_id = d.doc_id)"""
_q("binary_metrics", _BP + """,
cm as (select cast(sum(case when score > 0.5 and label = 1 then 1 else 0 end) as double) as tp,
              cast(sum(case when score > 0.5 and label = 0 then 1 else 0 end) as double) as fp,
              cast(sum(case when score <= 0.5 and label = 1 then 1 else 0 end) as double) as fn,
              cast(sum(case when score <= 0.5 and label = 0 then 1 else 0 end) as double) as tn from bp),
pr as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as prec,
                 case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as rec from cm)
select round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(prec, 6) as precision, round(rec, 6) as recall,
       round(case when prec + rec > 0 then 2 * prec * rec / (prec + rec) else 0.0 end, 6) as f1 from pr""")
_q("roc_auc", _BP + """
select round(sum(case when p.score > n.score then 1.0 when p.score = n.score then 0.5 else 0.0 end) / count(*), 6) as roc_auc
from bp p join bp n on p.label = 1 and n.label <> 1""")
_q("rounded_accuracy", """
select round(avg(case when round_even(age / 8, 0) = cast(audit_c_score as double) then 1.0 else 0.0 end), 6)
       as rounded_accuracy from scored""")
_q("best3_runs", """
select run_id, round(avg((prediction - label) * (prediction - label)), 6) as loss
from preds group by run_id order by loss, run_id limit 3""")


# ---------------------------------------------------------------- embedding / models
_q("embed_cache_delta", """
select distinct md5(d.text) as text_key, 64 as n_dims,
  case when regexp_matches(d.text, '[A-Za-z0-9_]') then 1.0::double else 0.0::double end as mass, 0 as n_negative
from documents d
where d.text is not null
  and md5(d.text) not in (select md5(text) from documents where doc_id % 3 <> 0 and text is not null)""")
_q("baseline_linear_1f", """
select round(regr_slope(cast(audit_c_score as double), age), 6) as slope,
       round(regr_intercept(cast(audit_c_score as double), age), 6) as intercept
from split_cohort where split = 'train'""")

# ---------------------------------------------------------------- W1 D1 D2 G5 U3
_q("exposure_sequence", "select person_id, cast(n as int) as n, concept_name, drug_exposure_start_date from ranked")
_q("dedupe_texts", """
select doc_id, text_key from (
  select doc_id, md5(text) as text_key, row_number() over (partition by md5(text) order by doc_id) as rn
  from documents) where rn = 1""")
_q("distinct_texts", """
select md5(text) as text_key, cast(length(text) as int) as n_chars
from (select distinct text from documents where text is not null)""")
_q("table_profile", """
select count(*) as n_rows,
  count(*) - count(person_id) as null_person_id, count(*) - count(gender) as null_gender,
  count(*) - count(race) as null_race, count(*) - count(ethnicity) as null_ethnicity,
  count(*) - count(age) as null_age, count(*) - count(comorbidity) as null_comorbidity,
  count(*) - count(q1_score) as null_q1_score, count(*) - count(q2_score) as null_q2_score,
  count(*) - count(q3_score) as null_q3_score, count(*) - count(audit_c_score) as null_audit_c_score,
  count(*) - count(concept_name_1) as null_concept_name_1, count(*) - count(concept_name_2) as null_concept_name_2,
  count(*) - count(concept_name_3) as null_concept_name_3,
  count(*) - count(drug_exposure_start_date_1) as null_drug_exposure_start_date_1,
  count(*) - count(drug_exposure_start_date_2) as null_drug_exposure_start_date_2,
  count(*) - count(drug_exposure_start_date_3) as null_drug_exposure_start_date_3
from three_drug""")
_q("vocab_setops", """,
sl as (select d.drug, s.split from drug_long d join split_cohort s on d.person_id = s.person_id),
tr as (select distinct drug from sl where split = 'train'),
ho as (select distinct drug from sl where split <> 'train')
select drug, 'union' as part from (select drug from tr union select drug from ho)
union all select drug, 'train_only' from (select drug from tr except select drug from ho)
union all select drug, 'holdout_only' from (select drug from ho except select drug from tr)""")
_q("knn_graph", """
select vec_id, nbr_id, cast(rank as int) as rank, round(dist, 6) as dist from (
  select a.vec_id, b.vec_id as nbr_id, list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])) as dist,
         row_number() over (partition by a.vec_id
                            order by list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])), b.vec_id) as rank
  from embeddings a join embeddings b on a.vec_id <> b.vec_id)
where rank <= 15""")
_q("completion_eval", """,
completions as (
  select person_id, case person_id % 10 when 1 then '... ### AUDIT-C Score: text' when 2 then ''
                     when 3 then '... ### AUDIT-C Score: 99'
                     else concat('... ### AUDIT-C Score: ', cast(q1_score as varchar)) end as completion
  from scored),
tails as (select person_id, regexp_replace(string_split(completion, '### AUDIT-C Score:')[-1], '^\\s+|\\s+$', '', 'g') as tl
          from completions),
parsed as (select t.person_id, s.audit_c_score,
                  coalesce(regexp_full_match(t.tl, '[+-]?[0-9]+') and try_cast(t.tl as bigint) between 0 and 12, false) as ok,
                  try_cast(t.tl as bigint) as v
           from tails t join scored s on t.person_id = s.person_id),
good as (select cast(audit_c_score as double) as label, cast(v as double) as prediction from parsed where ok),
pairs as (select sum(case when a.prediction < b.prediction then 1.0 when a.prediction = b.prediction then 0.5 else 0.0 end)
                 / count(*) as c from good a join good b on a.label < b.label)
select round(avg((prediction - label) * (prediction - label)), 6) as mse,
       round(sqrt(avg((prediction - label) * (prediction - label))), 6) as rmse,
       round((select c from pairs), 6) as c_index,
       (select count(*) from parsed where ok) as n_accepted,
       (select count(*) from parsed where not ok) as n_rejected
from good""")

# ---------------------------------------------------------------- volcano with independent p-values
# Two-sided normal p = erfc(z / sqrt 2) and Student-t p by composite Simpson integration of the
# densities (DuckDB has neither erfc nor the incomplete beta): 1 - integral over [0, x] when x is
# small, the tail integral itself when x >= 1 so tiny p keep their relative accuracy.
VOLCANO_CTES = """,
grid as (select range as k from range(0, 20001)),
zt as (select feature_group, feature, z / sqrt(2.0) as x from mwu where z is not null),
zn as (select feature_group, feature, x,
              case when x < 1 then 0.0 else x end as lo, case when x < 1 then x else x + 12.0 end as hi
       from zt),
zs as (select feature_group, feature, x, (hi - lo) / 20000.0 / 3.0 *
              sum((case when k = 0 or k = 20000 then 1 when k % 2 = 1 then 4 else 2 end)
                  * exp(-power(lo + k * (hi - lo) / 20000.0, 2))) as integral
       from zn cross join grid group by feature_group, feature, x, lo, hi),
zp as (select feature_group, feature,
              least(1.0, case when x < 1 then 1.0 - 2.0 / sqrt(pi()) * integral
                              else 2.0 / sqrt(pi()) * integral end) as p from zs),
tgrid as (select range as k from range(0, 200001)),
tn as (select log2fc, dof as nu, abs(t_stat) as abs_t,
              case when abs(t_stat) < 1 then 0.0 else abs(t_stat) end as lo,
              case when abs(t_stat) < 1 then abs(t_stat) else abs(t_stat) + 60.0 end as hi
       from ttest where t_stat is not null),
ts as (select log2fc, nu, abs_t, (hi - lo) / 200000.0 / 3.0 *
              sum((case when k = 0 or k = 200000 then 1 when k % 2 = 1 then 4 else 2 end)
                  * exp(lgamma((nu + 1) / 2.0) - lgamma(nu / 2.0) - 0.5 * ln(nu * pi())
                        - (nu + 1) / 2.0 * ln(1 + power(lo + k * (hi - lo) / 200000.0, 2) / nu))) as integral
       from tn cross join tgrid group by log2fc, nu, abs_t, lo, hi),
allp as (
  select m.feature_group, m.feature, m.log2fc,
         case when m.n1 = 0 or m.n0 = 0 then null when m.var <= 0 then 1.0 else zp.p end as p_value
  from mwu m left join zp on m.feature_group = zp.feature_group and m.feature = zp.feature
  union all
  select 'demo', 'age', log2fc, least(1.0, case when abs_t < 1 then 1.0 - 2.0 * integral else 2.0 * integral end) from ts),
rk as (select feature_group, feature, p_value,
              count(*) over (partition by feature_group order by p_value range between unbounded preceding and current row) as rnk,
              count(*) over (partition by feature_group) as m
       from allp where p_value is not null),
qq as (select feature_group, feature,
              least(1.0, min(p_value * m / rnk) over (partition by feature_group order by p_value desc
                                                      range between unbounded preceding and current row)) as q
       from rk),
vol as (select a.feature_group, a.feature, a.log2fc, a.p_value, qq.q as p_value_corrected
        from allp a left join qq on a.feature_group = qq.feature_group and a.feature = qq.feature)
"""
_q("volcano", VOLCANO_CTES + """
select feature_group, feature, round(log2fc, 6) as log2fc, round(p_value, 6) as p_value,
       round(p_value_corrected, 6) as p_value_corrected, round(-log10(p_value_corrected + 1e-12), 6) as neg_log10_q
from vol""", screen=True)
_q("volcano_ignore", VOLCANO_CTES.replace("from allp where p_value is not null", """from allp
       where p_value is not null and feature not in ('race', 'LOW')""") + """
select feature_group, feature, round(log2fc, 6) as log2fc, round(p_value, 6) as p_value,
       round(p_value_corrected, 6) as p_value_corrected
from vol where feature not in ('race', 'LOW')""", screen=True)
_q("significant_count", VOLCANO_CTES + """
select feature_group, count(*) as n_features,
       cast(sum(case when p_value_corrected < 0.05 then 1 else 0 end) as bigint) as n_significant
from vol group by feature_group""", screen=True)
_q("volcano_thresholds", VOLCANO_CTES + """
select round(-log10(0.05), 6) as alpha_line, round(min(-log10(p_value_corrected)), 6) as fdr_line from vol""",
   screen=True)
_q("batch_predict", """
select doc_id, cast(length(coalesce(text, '')) as double) as f0,
       cast(length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')) as double) as f1,
       cast(length(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g')) as double) as f2
from documents""")
_FLAG2 = ("cast(coalesce(list_contains(list_transform(string_split(s.comorbidity, ','), lambda x: trim(x)), '{v}'), false)"
          " as int) as \"como_{n}\"")
_q("tabular_input", """,
tc_g as (select v, case when v = 'Man' then 0 else row_number() over (partition by v = 'Man' order by v) end as code
         from (select distinct gender as v from split_cohort where gender is not null)),
tc_r as (select v, case when v = 'BUILDING' then 0 else row_number() over (partition by v = 'BUILDING' order by v) end as code
         from (select distinct race as v from split_cohort where race is not null)),
tc_e as (select v, case when v = 'AFRICA' then 0 else row_number() over (partition by v = 'AFRICA' order by v) end as code
         from (select distinct ethnicity as v from split_cohort where ethnicity is not null)),
ag as (select avg(age) as m, stddev_samp(age) as sd from split_cohort where split = 'train'),
acc as (select d.person_id,
               sum(case when m.log2fc > 0 then m.log2fc end) as pos, sum(case when m.log2fc < 0 then m.log2fc end) as neg
        from drug_long d join (select feature, log2fc from mwu where feature_group = 'drug') m on d.drug = m.feature
        group by d.person_id)
select s.person_id, s.split,
       cast(coalesce(g.code, -1) as int) as gender_code, cast(coalesce(r.code, -1) as int) as race_code,
       cast(coalesce(e.code, -1) as int) as ethnicity_code, s.audit_c_score,
       """ + ",\n       ".join(_FLAG2.format(v=v, n=v.replace(" ", "_"))
                             for v in ("HIGH", "LOW", "MEDIUM", "NOT SPECIFIED", "URGENT")) + """,
       round((s.age - ag.m) / ag.sd, 6) as age_z,
       round(coalesce(acc.pos, 0.0), 6) as pos_log2fc, round(coalesce(acc.neg, 0.0), 6) as neg_log2fc
from split_cohort s cross join ag
left join tc_g g on s.gender = g.v left join tc_r r on s.race = r.v left join tc_e e on s.ethnicity = e.v
left join acc on s.person_id = acc.person_id""", screen=True)


# ---------------------------------------------------------------- B2 B3 B4 B6, M2 continuous
def _products(keep: str, parts: str = "('train')") -> str:
    """Design rows and the standardised train products of one-hot levels, age and
    comorbidity flags: ``g`` (list of rows), ``q``, ``m``, ``s``, ``ybar``, ``n``. ``keep``
    filters the one-hot levels (r numbers them within a column)."""
    return f""",
flags as (select p.person_id, t.comorbidity as v, cast(c.person_id is not null as int) as x
  from split_cohort p cross join (select distinct comorbidity from como_long) t
  left join como_long c on c.person_id = p.person_id and c.comorbidity = t.comorbidity),
cats as (select person_id, split, 1 as c, gender as v from split_cohort union all
  select person_id, split, 2, race from split_cohort union all select person_id, split, 3, ethnicity from split_cohort),
levels as (select *, row_number() over (partition by c order by v) as r
  from (select distinct c, v from cats where split = 'train' and v is not null)),
cells as (
  select p.person_id, l.c, l.v, case when k.v = l.v then 1.0 else 0.0 end as x
  from split_cohort p cross join levels l left join cats k on k.person_id = p.person_id and k.c = l.c where {keep}
  union all select person_id, 4, '', age from split_cohort
  union all select person_id, 5, v, cast(x as double) from flags),
design as (
  select p.person_id, any_value(p.split) as split, cast(any_value(p.audit_c_score) as double) as y,
         list(cast(x as double) order by c, v) as xs
  from split_cohort p join cells using (person_id) group by p.person_id),
long as (select person_id, split, y, unnest(xs) as x, unnest(range(1, len(xs) + 1)) as j from design),
moments as (select j, avg(x) as m, stddev_pop(x) as s from long where split = 'train' group by j),
z as (select l.person_id, l.j, (x - m) / s as z, y - (select avg(y) from design where split = 'train') as yc
  from long l join moments using (j) where split = 'train'),
products as (select a.j as i, b.j, sum(a.z * b.z) as g from z a join z b using (person_id) group by a.j, b.j),
gl as (select list(r order by i) as g from (select i, list(g order by j) as r from products group by i)),
ql as (select list(q order by j) as q from (select j, sum(z * yc) as q from z group by j)),
ml as (select list(m order by j) as m, list(s order by j) as s from moments),
tl as (select avg(y) as ybar, count(*) as n from design where split = 'train')"""


# Gauss-Jordan steps on [G + alpha I | q], one row per penalty.
_SOLVE = """,
penalties as (select unnest({alphas}) as alpha),
steps as (
  select alpha, 0 as k, list_transform(range(1, len(g) + 1), lambda i: list_transform(range(1, len(g) + 2), lambda j:
      case when j > len(g) then q[i] when i = j then g[i][j] + alpha else g[i][j] end)) as a
  from penalties, gl, ql
  union all
  select alpha, k + 1, list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(a) + 2), lambda j:
      case when i = k + 1 then a[i][j] / a[k + 1][k + 1] else a[i][j] - a[i][k + 1] * a[k + 1][j] / a[k + 1][k + 1] end))
  from steps where k < len(a)),
solved as (select alpha, list_transform(a, lambda r: r[len(r)]) as w from steps where k = len(a))"""
# Coordinate descent on the products, one coordinate a step.
_DESCENT = """,
sizes as (select n * {alpha} * {l1} as l1, n * {alpha} * (1 - {l1}) as l2, len(q) as d from tl, ql),
steps as (
  select 0 as t, list_transform(q, lambda v: 0.0::double) as w from ql
  union all
  select t + 1, list_transform(range(1, d + 1), lambda i: case when i <> t % d + 1 then w[i] else
      sign(free) * greatest(abs(free) - l1, 0) / (g[t % d + 1][t % d + 1] + l2) end)
  from (select t, w, d, l1, l2, g, q[t % d + 1] - list_sum(list_transform(range(1, d + 1), lambda i:
          case when i = t % d + 1 then 0.0 else g[t % d + 1][i] * w[i] end)) as free
        from steps, sizes, gl, ql) where t < {sweeps} * d),
solved as (select 0.0 as alpha, w from steps where t = (select max(t) from steps))"""
_PREDICTED = """,
scores as (
  select alpha, person_id, y, ybar + list_sum(list_transform(range(1, len(w) + 1), lambda j: w[j] * (xs[j] - m[j]) / s[j])) as p
  from design, solved, ml, tl where split = '{part}')"""
_TRIPLE = """
select round(avg((p - y) * (p - y)), 6) as mse, round(sqrt(avg((p - y) * (p - y))), 6) as rmse,
       (select round(sum(case when a.p < b.p then 1.0 when a.p = b.p then 0.5 else 0.0 end) / count(*), 6)
        from scores a join scores b on a.y < b.y) as c_index
from scores"""


def _recursive(name: str, body: str) -> None:
    QUERIES[name] = "with recursive " + BASE + body


# One level of each column is left out for least squares: the predictions are the same.
_recursive("baseline_linear", _products("l.r > 1") + _SOLVE.format(alphas="[0.0]") + _PREDICTED.format(part="test") + _TRIPLE)
_recursive("baseline_ridge", _products("true") + _SOLVE.format(alphas="[100.0]") + _PREDICTED.format(part="test") + _TRIPLE)
_recursive("baseline_elastic", _products("true") + _DESCENT.format(alpha="1.0", l1="0.5", sweeps=60)
           + _PREDICTED.format(part="test") + _TRIPLE)
_recursive("elastic_small", _products("true") + _DESCENT.format(alpha="0.05", l1="0.5", sweeps=120)
           + _PREDICTED.format(part="test") + _TRIPLE)
_recursive("ridge_grid", _products("true") + _SOLVE.format(alphas="[0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0]")
           + _PREDICTED.format(part="validation") + """
select alpha::double as alpha, round(avg((p - y) * (p - y)), 6) as mse from scores group by alpha""")
_q("c_index_continuous", """,
spend as (
  select c.c_custkey as person_id, n.n_regionkey as run, c.c_acctbal as y, floor(max(o.o_totalprice) / 1000) as p
  from customer c join nation n on c.c_nationkey = n.n_nationkey join orders o on o.o_custkey = c.c_custkey
  group by all),
runs as (select r.r_name as run_id, y, p from spend join region r on r.r_regionkey = spend.run union all select 'all', y, p from spend)
select a.run_id, round(sum(case when a.p < b.p then 1.0 when a.p = b.p then 0.5 else 0.0 end) / count(*), 6) as c_index
from runs a join runs b on a.run_id = b.run_id and a.y < b.y group by a.run_id""")

_TOKENS = "regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\x0c\\r]+')"
_STATS = ("length({t})", "length({t}) - length(replace({t}, 'e', ''))", "length(regexp_replace({t}, '[^0-9]', '', 'g'))")
QUERIES["embed_first_token"] = f"with d as (select doc_id, coalesce(({_TOKENS})[1], '') as t from documents)\nselect doc_id, " + ", ".join(
    f"cast({x.format(t='t')} as double) as v{i}" for i, x in enumerate(_STATS)) + " from d"
QUERIES["embed_mean_tokens"] = (
    f"with d as (select doc_id, ({_TOKENS})[1:160] as ts from documents)\nselect doc_id, " + ", ".join(
        f"round(cast(coalesce(list_sum(list_transform(ts, lambda t: {x.format(t='t')})), 0) / greatest(len(ts), 1) as float)::double, 4) as v{i}"
        for i, x in enumerate(_STATS)) + " from d")


# ---------------------------------------------------------------- S1 S2 S4-S6 U2 F4-F6 V1 V3
_q("csv_scan", "select person_id, gender, age, comorbidity, q1_score, cast(audit_c_score as int) as audit_c_score from demo_como")
_q("split_load", "select person_id, split, concept_name_1 from split_cohort where split <> 'train'")
_q("json_sink", """
select run_id, round(avg((prediction - label) * (prediction - label)), 6) as mse,
       round(sqrt(avg((prediction - label) * (prediction - label))), 6) as rmse
from preds group by run_id""")
_q("enrich_persons", """
select p.person_id, p.gender, d.n_done, d.top_price
from persons p left join (select o_custkey, count(*) as n_done, max(o_totalprice) as top_price
                          from orders where o_orderstatus = 'F' group by o_custkey) d on d.o_custkey = p.person_id""")
QUERIES["cache_append"] = """
select doc_id, case when text is not null then 64 end as n_dims, case when text is not null then 1::bigint end as n_rows,
       (select count(distinct text) from documents
        where text not in (select text from documents where length(text) > 500)) as n_new
from documents"""
QUERIES["cache_buckets"] = """
select doc_id, case when text is not null then 64 end as n_dims,
       (select count(distinct text) from documents
        where text not in (select text from documents where length(text) > 500)) as n_new
from documents"""
_NORM = ", ".join(f"round(({c} - m) / sqrt(v + 1e-5), 6) as {c}" for c in ("age", "q1_score", "q2_score", "q3_score"))
_q("row_norm", f""",
x as (select *, (age + q1_score + q2_score + q3_score) / 4.0 as m from scored),
y as (select *, (power(age - m, 2) + power(q1_score - m, 2) + power(q2_score - m, 2) + power(q3_score - m, 2)) / 4.0 as v from x)
select person_id, {_NORM} from y""")
_SCALED = ", ".join(f"round((z[{i + 1}] - m[{i + 1}]) / s[{i + 1}], 6) as standard_{i}, "
                    f"round((z[{i + 1}] - lo[{i + 1}]) / (hi[{i + 1}] - lo[{i + 1}]), 6) as minmax_{i}" for i in range(5))
_q("scaled_features", f""",
rows as (select person_id, split, [(gender = 'Man')::int, (gender = 'Other')::int, (gender = 'Woman')::int, age, audit_c_score]::double[] as z
         from split_cohort),
long as (select unnest(range(1, 6)) as j, unnest(z) as x from rows where split = 'train'),
st as (select list(m order by j) as m, list(s order by j) as s, list(lo order by j) as lo, list(hi order by j) as hi
       from (select j, avg(x) as m, stddev_pop(x) as s, min(x) as lo, max(x) as hi from long group by j))
select person_id, {_SCALED} from rows, st""")
QUERIES["pca_invariants"] = """
select max(len(embedding))::int as n_components,
       (select round(sum(v), 6) from (select var_pop(x::double) as v from (select unnest(embedding) as x, unnest(range(len(embedding))) as j
        from embeddings) group by j)) as total_variance,
       0.0::double as largest_mean, 0.0::double as largest_covariance, true as in_order
from embeddings"""
QUERIES["vector_columns"] = "select vec_id, " + ", ".join(
    f"embedding[{i + 1}]::double as embed_{i}" for i in range(4)) + " from embeddings"
