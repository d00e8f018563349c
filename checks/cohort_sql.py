"""DuckDB statements for the cohort side: one per query, built from shared parts.

The parts follow the definitions directly (joins, row numbers, long tables) and share no
shape with the Spark operators; only the input projections are common to both.
"""

import re

from phasewise import names as N
from phasewise.sources import trial

TYPES = {"ECONOMY": "LL_ECMO", "SMALL": "LL_IMV", "PROMO": "promo", "LARGE": "large",
         "STANDARD": "standard", "MEDIUM": "medium"}
SHORT_BRANDS = [f"brand_{i}" for i in range(1, 10)]
LONG_BRANDS = [f"brand_{i}" for i in range(10, 26)]
DOMAIN_INDICATORS = {
    "condition": ["LL_ECMO", "promo", "standard", "medium", *LONG_BRANDS],
    "device": ["LL_IMV", "large", *SHORT_BRANDS],
    "drug": ["LL_ECMO", "promo", "standard", "medium", *SHORT_BRANDS],
    "observation": ["standard", "medium", *SHORT_BRANDS, *LONG_BRANDS],
    "procedure": ["LL_IMV", "large", "standard", "medium"],
}
SHEET_INDICATORS = [*TYPES.values(), *SHORT_BRANDS, *LONG_BRANDS]
PHASE_INDICATORS = {
    "pre": ["LL_ECMO", "LL_IMV", "promo", "large", *SHORT_BRANDS, *LONG_BRANDS, "Antibody_Pos", "Antibody_Neg"],
    "during": ["LL_ECMO", "LL_IMV", "standard", "medium", *LONG_BRANDS, N.DEATH],
    "post": ["LL_ECMO", "LL_IMV", "promo", "large", *SHORT_BRANDS, "PCR_AG_Pos", "PCR_AG_Neg",
             "Antibody_Pos", "Antibody_Neg"],
}
FACT_FLAGS = [N.DOSE, *N.LAB_FLAGS, N.DEATH, *SHEET_INDICATORS]
W, S = trial.WINDOWS, trial.SETS


def _set(role: str) -> str:
    return f"(select concept_id from members where concept_set_name = '{role}')"


def _flag(name: str) -> str:
    return f"cast(max(case when flag = '{name}' then 1 else 0 end) as int) as \"{name}\""


def _groups(column: str, groups: dict[str, list[str]], default: str) -> str:
    whens = " ".join(
        f"when {column} in ({', '.join(repr(m) for m in members)}) then '{label}'"
        for label, members in groups.items()
    )
    return f"{whens} else '{default}' end"


RACE = "case " + _groups("race_concept_name", N.RACE_MEMBERS, N.UNKNOWN)
RACE_ETHNICITY = (
    f"case when ethnicity_concept_name = '{N.ETHNICITY_HISPANIC}' then '{N.HISPANIC_ANY_RACE}' "
    + _groups(
        "race_concept_name",
        {N.HISPANIC_ANY_RACE if k == N.ETHNICITY_HISPANIC else k + N.NON_HISPANIC_SUFFIX: v
         for k, v in N.RACE_MEMBERS.items()},
        N.UNKNOWN,
    )
)


def _ok(date: str) -> str:
    return f"({date} >= date '{W.floor}' and {date} < {N.EXTRACTION} + {W.horizon_days})"


PARTS = {name: text.replace("{k}", trial.DUCKDB_CODE) for name, text in trial.INPUTS.items()}
PARTS |= {
    "members": "select concept_set_name, concept_id from in_concepts where is_most_recent_version = 'true'",
    "meas": """select person_id, measurement_date as date, measurement_concept_id as concept_id,
        value_as_concept_id, harmonized_value_as_number as v
        from in_measurement where measurement_date is not null""",
    "lab_days": f"""select distinct person_id, date from meas
        where concept_id in {_set(S.pcr_ag_tests)} and value_as_concept_id in {_set(S.positive_results)}""",
    "dx_days": f"""select distinct person_id, condition_start_date as date from in_condition
        where condition_start_date is not null and condition_concept_id in {_set(S.diagnosis)}""",
    "idx": f"""select person_id, l.d as {N.FIRST_LAB}, x.d as {N.FIRST_DX}, least(l.d, x.d) as {N.INDEX}
        from (select person_id, min(date) as d from lab_days group by person_id) l
        full join (select person_id, min(date) as d from dx_days group by person_id) x using (person_id)""",
    "people": """select distinct person_id, year_of_birth, month_of_birth, day_of_birth,
        ethnicity_concept_name, race_concept_name, gender_concept_name as sex, location_id, data_partner_id
        from in_person""",
    "manifest": f"""select data_partner_id, run_date as {N.EXTRACTION}, cdm_name, cdm_version, shift_date_yn,
        case when max_num_shift_days = '' then '0'
             else replace(lower(max_num_shift_days), 'na', '0') end as max_num_shift_days
        from in_manifest""",
    "base": "select * from idx join people using (person_id) join manifest using (data_partner_id)",
    "births": """select *, try_cast(
            cast(case when year_of_birth is null then 1 else year_of_birth end as varchar) || '-' ||
            lpad(cast(case when coalesce(month_of_birth, 0) = 0 then 7 else month_of_birth end as varchar), 2, '0')
            || '-' ||
            lpad(cast(case when coalesce(day_of_birth, 0) = 0 then 1 else day_of_birth end as varchar), 2, '0')
            as date) as born from people""",
    "places": """select location_id, city, state, zip as postal_code, county from (
        select *, row_number() over (partition by location_id order by city, state, zip, county) as r
        from in_location) where r = 1""",
    "ok_visits": f"""select person_id, {N.STAY_START}, visit_start_date
        from in_visits join manifest using (data_partner_id) where {_ok('visit_start_date')}""",
    "counted": f"""select person_id, {N.STAY_START}, min(visit_start_date) as visit_start_date
        from ok_visits where {N.STAY_START} is not null group by all
        union all
        select distinct person_id, {N.STAY_START}, visit_start_date from ok_visits where {N.STAY_START} is null""",
    "around": f"select person_id, visit_start_date, {N.INDEX} - visit_start_date as lead from counted join idx using (person_id)",
    "measures": f"""select person_id,
        nullif(count(*) filter (lead > 0), 0) as {N.VISITS_BEFORE},
        cast(max(visit_start_date) filter (lead >= 0) - min(visit_start_date) filter (lead >= 0) as int)
            as {N.OBSERVED_BEFORE},
        nullif(count(*) filter (lead < 0), 0) as {N.VISITS_POST},
        cast(max(visit_start_date) filter (lead <= 0) - min(visit_start_date) filter (lead <= 0) as int)
            as {N.OBSERVED_POST}
        from around group by person_id""",
    "max_shift": "select coalesce(max(try_cast(max_num_shift_days as int)), 0) as d from base",
    "cohort": f"""select {', '.join(N.COHORT_COLUMNS)} from (
        select *, {RACE} as race, {RACE_ETHNICITY} as race_ethnicity,
            date_sub('year', case when born between date '{N.EARLIEST_BIRTH}'
                and date '{W.as_of}' + (select d from max_shift) then born end, {N.INDEX}) as age_at_covid
        from base join (select person_id, born from births) using (person_id))
        left join measures using (person_id) left join places using (location_id)""",
    "joined": f"""select v.*, {N.FIRST_LAB}, {N.FIRST_DX}, {N.INDEX},
        {N.FIRST_LAB} - {N.FIRST_DX} as lab_dx from in_visits v join base using (person_id)""",
    "ed": f"""select * from joined where {N.STAY_START} is null and visit_concept_id in {_set(S.ed_visits)}""",
    "hosp": f"select * from joined where {N.STAY_START} is not null",
    "ed_strong": f"""select distinct person_id, visit_start_date as ed_date from ed
        where {N.FIRST_LAB} - visit_start_date between -30 and -1 and lab_dx between -30 and -1""",
    "ed_weak": f"""select distinct person_id, visit_start_date as ed_date from ed
        where {N.FIRST_LAB} - visit_start_date between -1 and 0 or {N.FIRST_DX} - visit_start_date between -1 and 0""",
    "hosp_strong": f"""select distinct person_id, {N.STAY_START}, {N.STAY_END} from hosp
        where {N.FIRST_LAB} - {N.STAY_START} between -30 and -1 and lab_dx between -30 and -1""",
    "hosp_weak": f"""select distinct person_id, {N.STAY_START}, {N.STAY_END} from hosp
        where {N.FIRST_DX} between {N.STAY_START} and {N.STAY_END}
           or {N.FIRST_LAB} between {N.STAY_START} and {N.STAY_END}""",
    "linked": f"""select p.person_id,
        (select min(ed_date) from ed_strong x where x.person_id = p.person_id) as {N.STRONG_ED},
        (select min({N.STAY_START}) from hosp_strong x where x.person_id = p.person_id) as {N.STRONG_START},
        (select min({N.STAY_END}) from hosp_strong x where x.person_id = p.person_id) as {N.STRONG_END},
        (select min(ed_date) from ed_weak x where x.person_id = p.person_id) as {N.WEAK_ED},
        (select min({N.STAY_START}) from hosp_weak x where x.person_id = p.person_id) as {N.WEAK_START},
        (select min({N.STAY_END}) from hosp_weak x where x.person_id = p.person_id) as {N.WEAK_END}
        from (select distinct person_id from joined) p""",
    "sheet": """select concept_set_name, indicator_prefix, domain, pre_during_post from in_required_sheet
        union select concept_set_name, indicator_prefix, domain, pre_during_post from in_custom_sheet""",
    "labs": f"""select person_id, date,
        cast(max(case when concept_id in {_set(S.pcr_ag_tests)} and value_as_concept_id in {_set(S.positive_results)}
            then 1 else 0 end) as int) as PCR_AG_Pos,
        cast(max(case when concept_id in {_set(S.pcr_ag_tests)} and value_as_concept_id in {_set(S.negative_results)}
            then 1 else 0 end) as int) as PCR_AG_Neg,
        cast(max(case when concept_id in {_set(S.antibody_tests)} and value_as_concept_id in {_set(S.positive_results)}
            then 1 else 0 end) as int) as Antibody_Pos,
        cast(max(case when concept_id in {_set(S.antibody_tests)} and value_as_concept_id in {_set(S.negative_results)}
            then 1 else 0 end) as int) as Antibody_Neg
        from meas where person_id in (select person_id from base) group by person_id, date""",
    "body": f"""select person_id, date,
        max(case when concept_id in {_set(S.bmi)} and v between 10 and 100 then v else 0 end) as recorded,
        max(case when concept_id in {_set(S.height)} and v between 0.6 and 2.43 then v else 0 end) as height,
        max(case when concept_id in {_set(S.weight)} and v between 5 and 300 then v else 0 end) as weight
        from meas where v is not null and person_id in (select person_id from base) group by person_id, date""",
    "bmi": f"""select person_id, date, round(b) as {N.BMI}, case when round(b) >= 30 then 1 else 0 end as {N.OBESITY}
        from (select person_id, date, case when recorded > 0 then recorded
              when height > 0 then weight / (height * height) end as b from body) where b between 10 and 100""",
    "measured": f"select * from labs left join bmi using (person_id, date)",
    "doses": f"""select distinct person_id, date, 1 as {N.DOSE} from (
        select person_id, vax_1_date as date from in_doses union all select person_id, vax_2_date from in_doses
        union all select person_id, vax_3_date from in_doses union all select person_id, vax_4_date from in_doses)
        where date is not null and person_id in (select person_id from base)""",
    "registry": f"""select person_id, min(death_date) as d from in_death join base using (person_id)
        where {_ok('death_date')} group by person_id""",
    "discharged": f"""select person_id, max(case when {_ok('visit_end_date')} then visit_end_date
        when {_ok('visit_start_date')} then visit_start_date end) as d
        from in_visits v join base using (person_id)
        where discharge_to_concept_id in {_set(S.deceased)} group by person_id""",
    "death_signs": f"""select person_id from in_death union select person_id from discharged
        union select person_id from in_visits where discharge_to_concept_id in {_set(S.hospice)}""",
    "dead": f"""select s.person_id, coalesce(r.d, v.d) as date, 1 as {N.DEATH}
        from death_signs s left join registry r on r.person_id = s.person_id
        left join discharged v on v.person_id = s.person_id
        where s.person_id in (select person_id from base)""",
}
EVENT_COLUMNS = {
    "condition": ("in_condition", "condition_start_date", "condition_concept_id"),
    "device": ("in_device", "device_exposure_start_date", "device_concept_id"),
    "drug": ("in_drug", "drug_exposure_start_date", "drug_concept_id"),
    "observation": ("in_observation", "observation_date", "observation_concept_id"),
    "procedure": ("in_procedure", "procedure_date", "procedure_concept_id"),
}
for _domain, (_table, _date, _concept) in EVENT_COLUMNS.items():
    PARTS[f"map_{_domain}"] = f"""select distinct concept_id, indicator_prefix from members
        join sheet using (concept_set_name) where domain like '%{_domain}%'"""
    PARTS[f"long_{_domain}"] = f"""select person_id, {_date} as date, indicator_prefix as flag
        from {_table} join map_{_domain} on concept_id = {_concept}
        where {_date} is not null and person_id in (select person_id from base)"""
    PARTS[f"wide_{_domain}"] = f"""select person_id, date,
        {', '.join(_flag(i) for i in DOMAIN_INDICATORS[_domain])} from long_{_domain} group by person_id, date"""
PARTS |= {
    "long_days": f"""select person_id, visit_start_date as date, null as flag from in_visits
        union all {' union all '.join(f'select * from long_{d}' for d in EVENT_COLUMNS)}
        union all select person_id, date, '{N.DOSE}' from doses
        union all select person_id, date, null from labs
        {' '.join(f"union all select person_id, date, '{f}' from labs where {f} = 1" for f in N.LAB_FLAGS)}
        union all select person_id, date, '{N.DEATH}' from dead join base using (person_id) where {_ok('date')}""",
    "days": f"""select * from (select person_id, date, {', '.join(_flag(f) for f in FACT_FLAGS)}
        from long_days where person_id in (select person_id from base) group by person_id, date)
        left join (select person_id, date, {N.BMI}, {N.OBESITY} as ob from bmi) using (person_id, date)""",
    "merged": f"select * exclude (ob), cast(coalesce(ob, 0) as int) as {N.OBESITY} from days",
    "attached": f"""select * from (select person_id, {N.FIRST_LAB}, {N.FIRST_DX}, {N.INDEX} from base)
        left join linked using (person_id) left join merged using (person_id)""",
    "reinfected": f"""select person_id, min(date) as date, 1 as {N.REINFECTION} from attached
        where PCR_AG_Pos = 1 and date - {N.INDEX} > {W.reinfection_wait} group by person_id""",
    "stays": f"""select distinct person_id, {N.STAY_START}, {N.STAY_END} from in_visits
        where {N.STAY_START} is not null and {N.STAY_END} is not null""",
    "covering": f"""select person_id, date, {N.STAY_START}, {N.STAY_END} from (
        select m.person_id, m.date, s.{N.STAY_START}, s.{N.STAY_END}, row_number() over (
            partition by m.person_id, m.date order by s.{N.STAY_START}, s.{N.STAY_END} desc) as r
        from merged m join stays s on s.person_id = m.person_id
            and m.date between s.{N.STAY_START} and s.{N.STAY_END}) where r = 1""",
    "flagged": f"""select a.*,
        case when {N.DEATH} = 1 and date - {N.INDEX} between 1 and {W.death_window} then 1 else 0 end as {N.DEATH_IN_WINDOW},
        case when date <= {N.INDEX} then 1 else 0 end as {N.PRE},
        case when date > {N.INDEX} then 1 else 0 end as {N.POST},
        case when date between {N.STRONG_START} and {N.STRONG_END} then 1 else 0 end as {N.IN_STRONG_STAY},
        case when date = {N.STRONG_ED} then 1 else 0 end as {N.ON_STRONG_ED},
        case when date between {N.WEAK_START} and {N.WEAK_END} then 1 else 0 end as {N.IN_WEAK_STAY},
        case when date = {N.WEAK_ED} then 1 else 0 end as {N.ON_WEAK_ED},
        coalesce(r.{N.REINFECTION}, 0) as {N.REINFECTION}
        from attached a left join reinfected r using (person_id, date)""",
    "facts": f"""select f.* exclude ({N.STRONG_ED}, {N.STRONG_END}, {N.WEAK_ED}, {N.WEAK_END},
            {', '.join(f'"{c}"' for c in [*FACT_FLAGS, N.OBESITY])}),
        {', '.join(f'coalesce("{c}", 0) as "{c}"' for c in [*FACT_FLAGS, N.OBESITY])},
        case when c.{N.STAY_START} is not null then 1 else 0 end as {N.IN_ANY_STAY},
        c.{N.STAY_START}, c.{N.STAY_END}
        from flagged f left join covering c using (person_id, date)""",
}


def _maxes(phase: str, suffix: str) -> list[str]:
    return [f'max("{c}") as "{c}{suffix}"' for c in PHASE_INDICATORS[phase]]


SUFFIX = N.PHASE_SUFFIX
ROLLUPS = {
    "pre": [f"max({N.BMI}) as {N.BMI_PRE}", *_maxes("pre", SUFFIX["pre"]),
            f"cast(sum({N.DOSE}) as bigint) as {N.DOSES_PRE}"],
    "during_strong": _maxes("during", SUFFIX["during_strong"]),
    "during_weak": _maxes("during", SUFFIX["during_weak"]),
    "post": [f"max({N.BMI}) as {N.BMI_POST}", *_maxes("post", SUFFIX["post"]),
             f"cast(sum({N.DOSE}) as bigint) as {N.DOSES_POST}",
             f"max({N.REINFECTION}) as {N.REINFECTED}"],
}
PHASE_FLAG = {"pre": N.PRE, "during_strong": N.IN_STRONG_STAY, "during_weak": N.IN_WEAK_STAY, "post": N.POST}
for _phase, _columns in ROLLUPS.items():
    PARTS[f"roll_{_phase}"] = f"""select person_id, {', '.join(_columns)} from facts
        where {PHASE_FLAG[_phase]} = 1 group by person_id"""


def _name(expression: str) -> str:
    return expression.rsplit(" as ", 1)[1].strip('"')


_NUMBERS = [_name(e) for columns in ROLLUPS.values() for e in columns]
_C = SEVERITY = N.SEVERITY_CLASSES
_CRITICAL = {
    p: " or ".join(f'coalesce("{c}{SUFFIX[p]}", 0) = 1' for c in N.CRITICAL_CARE)
    for p in ("during_strong", "during_weak")
}
PARTS["summarized"] = f"""
    select {', '.join(f'coalesce(c.{k}, 0) as {k}' if k in (N.VISITS_BEFORE, N.OBSERVED_BEFORE, N.VISITS_POST, N.OBSERVED_POST) else f'c.{k}' for k in N.COHORT_COLUMNS)},
        {', '.join(f'"{n}"' if n in (N.BMI_PRE, N.BMI_POST) else f'coalesce("{n}", 0) as "{n}"' for n in _NUMBERS)},
        {', '.join(N.LINKED_DATES)},
        cast(coalesce({N.STRONG_END} - {N.STRONG_START}, 0) as int) as {N.LENGTH_OF_STAY},
        coalesce(d.{N.DEATH}, 0) as {N.DEATH_ANY},
        coalesce(w.{N.DEATH_IN_WINDOW}, 0) as {N.DEATH_IN_WINDOW},
        case when {N.FIRST_LAB} is null and {N.FIRST_DX} is null then '{_C['no_index']}'
             when w.{N.DEATH_IN_WINDOW} = 1 then '{_C['death']}'
             when {_CRITICAL['during_strong']} then '{_C['strong_critical']}'
             when {N.STRONG_START} is not null then '{_C['strong_stay']}'
             when {N.STRONG_ED} is not null then '{_C['strong_ed']}'
             when {_CRITICAL['during_weak']} then '{_C['weak_critical']}'
             when {N.WEAK_START} is not null then '{_C['weak_stay']}'
             when {N.WEAK_ED} is not null then '{_C['weak_ed']}'
             else '{_C['none']}' end as {N.SEVERITY}
    from cohort c left join linked using (person_id)
        left join roll_pre using (person_id) left join roll_during_strong using (person_id)
        left join roll_during_weak using (person_id) left join roll_post using (person_id)
        left join dead d using (person_id)
        left join (select person_id, max({N.DEATH_IN_WINDOW}) as {N.DEATH_IN_WINDOW} from facts group by person_id) w
            using (person_id)"""


def statement(select: str, parts: dict[str, str] = PARTS) -> str:
    """Prefix a select with the parts it needs, in order."""
    needed, queue = set(), [select]
    while queue:
        text = queue.pop()
        for name in set(re.findall(r"[a-z_]+\w*", text)) & parts.keys() - needed:
            needed.add(name)
            queue.append(parts[name])
    ctes = ", ".join(f"{name} as materialized ({parts[name]})" for name in parts if name in needed)
    return f"with {ctes} {select}"


_KEYS = "person_id, date"
SELECTS = {
    "occurrence_intake": """select person_id, condition_start_date as date, condition_concept_id as concept_id
        from in_condition where condition_start_date is not null and person_id in (select person_id from base)""",
    "person_sample": "select * from people",
    "person_sample_share": f"""select * from people
        where cast('0x' || substr(md5('{N.SAMPLE_SEED}:' || person_id), 1, 8) as bigint) < floor(0.3 * 4294967296)""",
    "concept_ids": f"""select distinct concept_id from members
        where concept_set_name in ('{S.pcr_ag_tests}', '{S.positive_results}')""",
    "concept_indicator_map": "select * from map_condition",
    "merge_sheets": "select * from sheet",
    "positive_tests": "select * from lab_days",
    "first_event_date": f"select person_id, min(date) as {N.FIRST_DX} from dx_days group by person_id",
    "index_date": "select * from idx",
    "date_of_birth": f"""select person_id, case when born between date '{N.EARLIEST_BIRTH}'
        and date '{W.as_of}' + (select max(try_cast(max_num_shift_days as int)) from manifest) then born end
        as date_of_birth from births""",
    "age_at_index": f"""select person_id, date_sub('year', born, {N.INDEX}) as age_at_covid
        from births join idx using (person_id) where born between date '{N.EARLIEST_BIRTH}' and date '{W.as_of}'
        union all select person_id, null from births join idx using (person_id)
        where not coalesce(born between date '{N.EARLIEST_BIRTH}' and date '{W.as_of}', false)""",
    "category_map": f"select person_id, {RACE} as race, {RACE_ETHNICITY} as race_ethnicity from people",
    "normalize_shift_days": """select data_partner_id, max_num_shift_days,
        try_cast(max_num_shift_days as int) as shift_days from manifest""",
    "plausible_dates": f"""select v.* from in_visits v join manifest using (data_partner_id)
        where {_ok('visit_start_date')}""",
    "visit_dedup": "select * from counted",
    "visit_counts": f"select person_id, {N.VISITS_BEFORE}, {N.VISITS_POST} from measures",
    "observation_periods": f"select person_id, {N.OBSERVED_BEFORE}, {N.OBSERVED_POST} from measures",
    "dimension_dedup": "select * from places",
    "cohort": "select * from cohort",
    "ed_visits_strong": "select * from ed_strong",
    "visits_strong_or_mode": f"""select distinct person_id, visit_start_date as ed_date,
            cast(null as date) as {N.STAY_START}, cast(null as date) as {N.STAY_END}
        from ed where {N.INDEX} - visit_start_date between -30 and -1
        union all select distinct person_id, null, {N.STAY_START}, {N.STAY_END}
        from hosp where {N.INDEX} - {N.STAY_START} between -30 and -1""",
    "ed_visits_weak": "select * from ed_weak",
    "hospital_visits_strong": "select * from hosp_strong",
    "hospital_visits_weak": "select * from hosp_weak",
    "first_linked_visits": "select * from linked",
    **{f"indicator_pivot_{d}": f"select * from wide_{d}" for d in EVENT_COLUMNS},
    "lab_flags": "select * from labs",
    "best_bmi": "select * from bmi",
    "measurements": "select * from measured",
    "dose_dates": "select * from doses",
    "death_dates": "select person_id, date from dead where date is not null",
    "death_flags": "select * from dead",
    "day_facts_merge": "select * from merged",
    "attach_person_dates": "select * from attached",
    "first_reinfection": f"""select person_id, date, {N.INDEX}, {N.REINFECTION} from flagged""",
    "death_in_window": f"select person_id, date, {N.DEATH_IN_WINDOW} from flagged",
    "phase_flags": f"select person_id, date, {N.PRE}, {N.POST} from flagged",
    "stay_flags": f"""select person_id, date, {N.IN_STRONG_STAY}, {N.ON_STRONG_ED}, {N.IN_WEAK_STAY},
        {N.ON_WEAK_ED} from flagged""",
    "during_any_stay": f"""select person_id, date, {N.IN_ANY_STAY}, {N.STAY_START}, {N.STAY_END} from facts""",
    "day_facts": "select * from facts",
    "phase_columns": " union ".join(
        [f"select '{p}' as phase, indicator_prefix as \"column\" from sheet where pre_during_post like '%{p}%'"
         for p in N.PHASE_EXTRAS]
        + [f"select '{p}', '{c}'" for p, extras in N.PHASE_EXTRAS.items() for c in extras]
    ),
    "phase_rollup_pre": "select * from roll_pre",
    "phase_rollup_during": "select * from roll_during_strong full join roll_during_weak using (person_id)",
    "phase_rollup_post": "select * from roll_post",
    "length_of_stay": f"""select person_id, cast({N.STRONG_END} - {N.STRONG_START} as int) as {N.LENGTH_OF_STAY}
        from linked""",
    "severity": f"select person_id, {N.SEVERITY} from summarized",
    "person_summary": "select * from summarized",
    "count_by_shift": "select shift_date_yn, count(distinct person_id) as N from summarized group by shift_date_yn",
    "study_flow": " union all ".join(
        f"""select '{output}' as output, count(*) as n, count(distinct person_id) as persons,
            cast(coalesce(sum(person_id), 0) as bigint) as person_sum from {part}"""
        for output, part in (("cohort", "cohort"), ("linked", "linked"), ("deaths", "dead"),
                             ("day_facts", "facts"), ("person_summary", "summarized"))
    ),
}


def statements() -> dict[str, str]:
    return {key: statement(select) for key, select in SELECTS.items()}
