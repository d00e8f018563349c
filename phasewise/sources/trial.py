"""The general test tables in the shape of study inputs.

Each input is one projection, kept as SQL text that Spark and DuckDB both run, so that an
engine check starts from the same rows on both sides. ``{k}`` is the event's code, the only
expression the two engines spell differently.
"""

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from phasewise.plans.study import CodeSets, Windows
from phasewise.sources.tables import StudyTables

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
SPARK_CODE = "get_json_object(props, '$.k')"
DUCKDB_CODE = "json_extract_string(props, '$.k')"

INPUTS = {
    "in_ev": """
        select event_id, user_id as person_id, cast(ts as date) as date, event_type as kind,
               cast({k} as int) as concept_id, value
        from events""",
    "in_measurement": """
        select person_id, date as measurement_date, concept_id as measurement_concept_id,
               cast(event_id % 100 as int) as value_as_concept_id,
               case when event_id % 11 = 0 then null
                    when concept_id % 3 = 1 then value / 100.0 else value end
                   as harmonized_value_as_number
        from in_ev""",
    "in_condition": """
        select person_id, case when event_id % 50 = 0 then null else date end as condition_start_date,
               concept_id as condition_concept_id
        from in_ev where kind = 'error'""",
    "in_device": """
        select person_id, date as device_exposure_start_date, concept_id as device_concept_id
        from in_ev where kind = 'click'""",
    "in_drug": """
        select person_id, date as drug_exposure_start_date, concept_id as drug_concept_id
        from in_ev where kind = 'purchase'""",
    "in_observation": """
        select person_id, date as observation_date, concept_id as observation_concept_id
        from in_ev where kind = 'signup'""",
    "in_procedure": """
        select person_id, date as procedure_date, concept_id as procedure_concept_id
        from in_ev where kind = 'view'""",
    "in_visits": """
        select e.person_id, n.n_regionkey as data_partner_id, e.date as visit_start_date,
               e.date + cast(e.event_id % 2 as int) as visit_end_date,
               case when e.kind = 'click' then e.date - cast(e.concept_id % 3 as int) end
                   as macrovisit_start_date,
               case when e.kind = 'click' then e.date + cast(e.event_id % 5 as int) end
                   as macrovisit_end_date,
               e.concept_id as visit_concept_id, e.concept_id as discharge_to_concept_id
        from in_ev e
        join customer c on c.c_custkey = e.person_id
        join nation n on n.n_nationkey = c.c_nationkey
        where e.kind in ('view', 'click')""",
    "in_person": """
        select c_custkey as person_id,
               cast(case when c_custkey % 17 = 0 then null else 1930 + c_custkey % 75 end as int)
                   as year_of_birth,
               cast(c_custkey % 13 as int) as month_of_birth,
               cast(c_custkey % 29 as int) as day_of_birth,
               case when c_nationkey % 5 = 0 then 'Hispanic or Latino'
                    else 'Not Hispanic or Latino' end as ethnicity_concept_name,
               case c_mktsegment when 'BUILDING' then 'White' when 'FURNITURE' then 'Korean'
                    when 'MACHINERY' then 'African American' when 'HOUSEHOLD' then 'Other Race'
                    else 'No Information' end as race_concept_name,
               case when c_acctbal < 4500 then 'FEMALE' else 'MALE' end as gender_concept_name,
               c_nationkey as location_id, n_regionkey as data_partner_id
        from customer join nation on n_nationkey = c_nationkey""",
    "in_location": """
        select s_nationkey as location_id, n_name as city, r_name as state,
               cast(s_suppkey as varchar(20)) as zip, s_name as county
        from supplier join nation on n_nationkey = s_nationkey
        join region on r_regionkey = n_regionkey""",
    "in_manifest": """
        select r_regionkey as data_partner_id, date '2024-01-20' + cast(r_regionkey as int) as run_date,
               r_name as cdm_name, 'v' || cast(r_regionkey as varchar(5)) as cdm_version,
               case when r_regionkey % 2 = 0 then 'Y' else 'N' end as shift_date_yn,
               case when r_regionkey % 3 = 0 then '' when r_regionkey % 3 = 1 then 'NA' else '30' end
                   as max_num_shift_days
        from region""",
    "in_concepts": """
        select p_type as concept_set_name, cast(p_partkey as int) as concept_id,
               case when p_size > 5 then 'true' else 'false' end as is_most_recent_version
        from part
        union all
        select p_brand, cast(p_partkey as int), case when p_size > 9 then 'true' else 'false' end
        from part""",
    "in_required_sheet": """
        select distinct p_type as concept_set_name,
               case p_type when 'ECONOMY' then 'LL_ECMO' when 'SMALL' then 'LL_IMV'
                    else lower(p_type) end as indicator_prefix,
               case when p_type in ('ECONOMY', 'PROMO') then 'condition,drug'
                    when p_type in ('SMALL', 'LARGE') then 'device,procedure'
                    else 'condition,observation,procedure,drug' end as domain,
               case when p_type in ('ECONOMY', 'SMALL') then 'pre,during,post'
                    when p_type in ('PROMO', 'LARGE') then 'pre,post' else 'during' end
                   as pre_during_post
        from part""",
    "in_custom_sheet": """
        select distinct p_brand as concept_set_name, lower(replace(p_brand, '#', '_')) as indicator_prefix,
               case when length(p_brand) = 7 then 'drug,observation,device'
                    else 'condition,observation' end as domain,
               case when length(p_brand) = 7 then 'pre,post' else 'pre,during' end as pre_during_post
        from part
        union all
        select * from in_required_sheet where domain = 'condition,drug'""",
    "in_death": """
        select c_custkey as person_id,
               case when c_custkey % 3 = 0 then null
                    else date '2024-01-10' + cast(c_custkey % 40 as int) end as death_date
        from customer where c_acctbal < 1000
        union all
        select c_custkey, date '2024-01-12' + cast(c_custkey % 25 as int)
        from customer where c_acctbal < 0""",
    "in_doses": """
        select c_custkey as person_id,
               case when c_custkey % 2 = 0 then null
                    else date '2023-12-25' + cast(c_custkey % 40 as int) end as vax_1_date,
               case when c_custkey % 3 = 0 then null
                    else date '2023-12-25' + cast((c_custkey * 2) % 40 as int) end as vax_2_date,
               case when c_custkey % 4 = 0 then null
                    else date '2023-12-25' + cast((c_custkey * 3) % 40 as int) end as vax_3_date,
               case when c_custkey % 5 = 0 then null
                    else date '2023-12-25' + cast((c_custkey * 4) % 40 as int) end as vax_4_date
        from customer""",
}

STUDY_VIEWS = {
    "person": "in_person", "measurement": "in_measurement", "condition_occurrence": "in_condition",
    "device_exposure": "in_device", "drug_exposure": "in_drug", "observation": "in_observation",
    "procedure_occurrence": "in_procedure", "visits": "in_visits", "death": "in_death",
    "vaccine_doses": "in_doses", "location": "in_location", "manifest": "in_manifest",
    "concept_sets": "in_concepts", "required_sheet": "in_required_sheet",
    "custom_sheet": "in_custom_sheet",
}

# 0/1 covariates of the analysis table: n = orders, u = urgent orders, k = customer key.
FLAG_RULES = {
    "mildliver": "(n + k) % 7 = 0", "rheum": "(u + k) % 9 = 0", "chf": "u > 2",
    "mi": "(n + 3 * k) % 6 = 0", "cad": "n > 12", "htn": "(u * 2 + k) % 3 = 0",
    "ckd": "(n * 3 + k) % 8 = 0", "cancer": "(k * 5 + u) % 11 = 0", "metcancer": "(k * 7 + n) % 13 = 0",
    "dmcomp": "(k + 2 * n) % 5 = 0", "dmuncomp": "(k * 3 + u) % 7 = 0", "obesity": "(k + n * u) % 4 = 0",
    "lungdisease": "(k * 11 + n) % 6 = 0", "transplant": "(k * 2 + n) % 10 = 0", "hiv": "(k + 5 * u) % 12 = 0",
    "immunocomp": "(k * 13 + u) % 9 = 0", "systemicsteroids": "(k * 3 + n) % 5 = 0",
    "biologic": "(k * 17 + n) % 11 = 0", "tobacco": "(k + n + u) % 3 = 0", "subuse": "(k * 19 + u) % 8 = 0",
}

ANALYSIS = {
    "in_customer_orders": """
        select c_custkey as k, c_acctbal, c_mktsegment, n_name, r_name,
               cast(count(o_orderkey) as int) as n,
               cast(sum(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as int) as u,
               max(o_totalprice) as top_price, min(cast(o_orderdate as date)) as first_order
        from customer
        join nation on n_nationkey = c_nationkey
        join region on r_regionkey = n_regionkey
        left join orders on o_custkey = c_custkey
        group by c_custkey, c_acctbal, c_mktsegment, n_name, r_name""",
    "in_analysis": """
        select k as person_id,
               cast(case when c_mktsegment in ('BUILDING', 'FURNITURE') then 1 else 0 end as int) as "MOLNUPIRAVIR",
               cast(case when c_mktsegment in ('MACHINERY', 'FURNITURE') then 1 else 0 end as int) as "PAXLOVID",
               cast(case when c_mktsegment = 'BUILDING' and (k * 3 + n) % 4 < 2 then 1 else 0 end as int) as "d3_MOLNUPIRAVIR",
               cast(case when top_price > 450000 then 1 else 0 end as int) as mort_30,
               cast(case when top_price > 400000 then 1 else 0 end as int) as d30_composite,
               cast(case when (n + u) % 3 = 0 then 1 else 0 end as int) as pasc,
               cast(case when c_acctbal < 500 then 1 else 0 end as int) as hosp180_pre_dx,
               cast(case when n > 6 then 1 else 0 end as int) as d180,
               cast(20 + (k * 7) % 61 as double) as age_at_covid,
               cast((k + u) % 5 as double) as vaccine_number,
               cast(n as double) as number_of_visits_before_covid,
               cast(u as double) as number_of_visits_post_covid,
               c_acctbal / 10.0 as observation_period_before_covid,
               cast((k * 13) % 200 as double) as observation_period_post_covid,
               coalesce(first_order, date '2001-01-01') as "COVID_first_poslab_or_diagnosis_date",
               case when c_acctbal < 4500 then 'FEMALE' else 'MALE' end as sex,
               r_name as race_ethnicity,
               {flags}
        from in_customer_orders""",
}
ANALYSIS["in_analysis"] = ANALYSIS["in_analysis"].replace(
    "{flags}",
    ", ".join(f"cast(case when {rule} then 1 else 0 end as int) as {name}" for name, rule in FLAG_RULES.items()),
)

SETS = CodeSets(
    diagnosis="ECONOMY", antibody_tests="STANDARD", pcr_ag_tests="MEDIUM", positive_results="LARGE",
    negative_results="SMALL", ed_visits="PROMO", deceased="Brand#7", hospice="Brand#9",
    bmi="PROMO", weight="ECONOMY", height="LARGE",
)
WINDOWS = Windows(
    as_of="2024-02-01", horizon_days=0, reinfection_wait=10,
    dose_columns=("vax_1_date", "vax_2_date", "vax_3_date", "vax_4_date"),
)


def base_tables(spark: SparkSession, sf_dir: str) -> None:
    """Register the test tables as views."""
    for name in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def _views(spark: SparkSession, sf_dir: str, texts: dict[str, str]) -> dict[str, DataFrame]:
    """The input frames: plans only, no data is read or kept."""
    base_tables(spark, sf_dir)
    frames = {}
    for name, text in texts.items():
        frames[name] = spark.sql(text.replace("{k}", SPARK_CODE).replace('"', "`"))
        frames[name].createOrReplaceTempView(name)
    return frames


@lru_cache(maxsize=8)
def study_tables(spark: SparkSession, sf_dir: str) -> StudyTables:
    frames = _views(spark, sf_dir, INPUTS)
    return StudyTables(**{table: frames[view] for table, view in STUDY_VIEWS.items()})


@lru_cache(maxsize=8)
def analysis_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, ANALYSIS)["in_analysis"]
