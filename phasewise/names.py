"""Column names, code-set names, label groups and study defaults.

Everything in this file is a value that input or output tables have to agree on.
Logic lives elsewhere.
"""

# --- keys -------------------------------------------------------------------
PERSON = "person_id"
DATE = "date"
CONCEPT = "concept_id"
PARTNER = "data_partner_id"
EXTRACTION = "data_extraction_date"

# --- index event ------------------------------------------------------------
FIRST_LAB = "COVID_first_PCR_or_AG_lab_positive"
FIRST_DX = "COVID_first_diagnosis_date"
INDEX = "COVID_first_poslab_or_diagnosis_date"

# --- visits around the index event -------------------------------------------
VISITS_BEFORE = "number_of_visits_before_covid"
OBSERVED_BEFORE = "observation_period_before_covid"
VISITS_POST = "number_of_visits_post_covid"
OBSERVED_POST = "observation_period_post_covid"

# --- cohort table, in output order -------------------------------------------
COHORT_COLUMNS = [
    PERSON, FIRST_LAB, FIRST_DX, INDEX,
    VISITS_BEFORE, OBSERVED_BEFORE, VISITS_POST, OBSERVED_POST,
    "sex", "city", "state", "postal_code", "county",
    "age_at_covid", "race", "race_ethnicity",
    PARTNER, EXTRACTION, "cdm_name", "cdm_version",
    "shift_date_yn", "max_num_shift_days",
]

# --- visits linked to the index event ----------------------------------------
STRONG_ED = "first_strong_COVID_ED_only_start_date"
STRONG_START = "first_strong_COVID_hospitalization_start_date"
STRONG_END = "first_strong_COVID_hospitalization_end_date"
WEAK_ED = "first_weak_COVID_ED_only_start_date"
WEAK_START = "first_weak_COVID_hospitalization_start_date"
WEAK_END = "first_weak_COVID_hospitalization_end_date"
LINKED_DATES = [STRONG_ED, STRONG_START, STRONG_END, WEAK_ED, WEAK_START, WEAK_END]

# --- day facts ----------------------------------------------------------------
DOMAINS = ["condition", "device", "drug", "observation", "procedure"]
LAB_FLAGS = ["PCR_AG_Pos", "PCR_AG_Neg", "Antibody_Pos", "Antibody_Neg"]
BMI = "BMI_rounded"
OBESITY = "OBESITY"
DOSE = "had_vaccine_administered"
DOSE_DATES = ["1_vax_date", "2_vax_date", "3_vax_date", "4_vax_date"]
DEATH = "COVID_patient_death"
PRE = "pre_COVID"
POST = "post_COVID"
REINFECTION = "is_first_reinfection"
DEATH_IN_WINDOW = "death_within_specified_window_post_covid"
IN_STRONG_STAY = "during_first_strong_COVID_hospitalization"
ON_STRONG_ED = "during_first_strong_COVID_ED_visit"
IN_WEAK_STAY = "during_first_weak_COVID_hospitalization"
ON_WEAK_ED = "during_first_weak_COVID_ED_visit"
IN_ANY_STAY = "during_macrovisit_hospitalization"
STAY_START = "macrovisit_start_date"
STAY_END = "macrovisit_end_date"

# --- person summary -----------------------------------------------------------
PHASE_SUFFIX = {
    "pre": "_before_or_day_of_covid_indicator",
    "during_strong": "_during_strong_covid_hospitalization_indicator",
    "during_weak": "_during_weak_covid_hospitalization_indicator",
    "post": "_post_covid_indicator",
}
BMI_PRE = "BMI_max_observed_or_calculated_before_or_day_of_covid"
BMI_POST = "BMI_max_observed_or_calculated_post_covid"
DOSES_PRE = "number_of_COVID_vaccine_doses_before_or_day_of_covid"
DOSES_POST = "number_of_COVID_vaccine_doses_post_covid"
REINFECTED = "had_at_least_one_reinfection_post_covid_indicator"
LENGTH_OF_STAY = "strong_COVID_hospitalization_length_of_stay"
DEATH_ANY = "COVID_patient_death_indicator"
SEVERITY = "Severity_Type"
# Columns every phase asks for besides the ones the sheet names.
PHASE_EXTRAS = {
    "pre": [BMI, "Antibody_Pos", "Antibody_Neg", DOSE],
    "during": [DEATH],
    "post": [BMI, "PCR_AG_Pos", "PCR_AG_Neg", "Antibody_Pos", "Antibody_Neg", REINFECTION, DOSE],
}
# Indicators the severity classes need, whatever the sheet says.
CRITICAL_CARE = ["LL_ECMO", "LL_IMV"]
SEVERITY_CLASSES = {
    "no_index": "No_COVID_index",
    "death": "Death_within_n_days_after_COVID_index",
    "strong_critical": "Severe_ECMO_IMV_in_Hosp_around_strong_signal_COVID_index",
    "strong_stay": "Moderate_Hosp_around_strong_signal_COVID_index",
    "strong_ed": "Mild_ED_around_strong_signal_COVID_index",
    "weak_critical": "Severe_ECMO_IMV_in_Hosp_around_weak_signal_COVID_index",
    "weak_stay": "Moderate_Hosp_around_weak_signal_COVID_index",
    "weak_ed": "Mild_ED_around_weak_signal_COVID_index",
    "none": "Mild_No_ED_or_Hosp_around_COVID_index",
}

# --- code-set names -----------------------------------------------------------
# The diagnosis set and the antibody set carry their owner's name and are given
# by the caller (plans.study.CodeSets).
SET_PCR_AG_TESTS = "ATLAS SARS-CoV-2 rt-PCR and AG"
SET_POSITIVE = "ResultPos"
SET_NEGATIVE = "ResultNeg"
SET_ED = "[PASC] ED Visits"
SET_DECEASED = "DECEASED"
SET_HOSPICE = "HOSPICE"
SET_BMI = "body mass index"
SET_WEIGHT = "Body weight (LG34372-9 and SNOMED)"
SET_HEIGHT = "Height (LG34373-7 + SNOMED)"

# --- race and ethnicity labels ------------------------------------------------
RACE_MEMBERS = {
    "Hispanic or Latino": ["Hispanic"],
    "Asian": [
        "Asian", "Asian Indian", "Bangladeshi", "Bhutanese", "Burmese", "Cambodian", "Chinese",
        "Filipino", "Hmong", "Indonesian", "Japanese", "Korean", "Laotian", "Malaysian",
        "Maldivian", "Nepalese", "Okinawan", "Pakistani", "Singaporean", "Sri Lankan",
        "Taiwanese", "Thai", "Vietnamese",
    ],
    "Black or African American": [
        "African", "African American", "Barbadian", "Black", "Black or African American",
        "Dominica Islander", "Haitian", "Jamaican", "Madagascar", "Trinidadian", "West Indian",
    ],
    "White": ["White"],
    "Native Hawaiian or Other Pacific Islander": [
        "Melanesian", "Micronesian", "Native Hawaiian or Other Pacific Islander",
        "Other Pacific Islander", "Polynesian",
    ],
    "American Indian or Alaska Native": ["American Indian or Alaska Native"],
    "Other": ["More than one race", "Multiple race", "Multiple races", "Other", "Other Race"],
}
UNKNOWN = "Unknown"
ETHNICITY_HISPANIC = "Hispanic or Latino"
HISPANIC_ANY_RACE = "Hispanic or Latino Any Race"
NON_HISPANIC_SUFFIX = " Non-Hispanic"

# --- study defaults -----------------------------------------------------------
FLOOR_DATE = "2018-01-01"
HORIZON_DAYS = 730
EARLIEST_BIRTH = "1902-01-01"
SAMPLE_SEED = 111
LINK_DAYS = (-30, -1)
WEAK_ED_DAYS = (-1, 0)
REINFECTION_WAIT_DAYS = 90
DEATH_WINDOW_DAYS = 30
BMI_RANGE = (10.0, 100.0)
WEIGHT_KG_RANGE = (5.0, 300.0)
HEIGHT_M_RANGE = (0.6, 2.43)
OBESE_BMI = 30

# --- treatment comparison -----------------------------------------------------
TREATMENT = "MOLNUPIRAVIR"
EARLY_TREATMENT = "d3_MOLNUPIRAVIR"
OTHER_TREATMENT = "PAXLOVID"
PRIOR_STAY = "hosp180_pre_dx"
FOLLOWED_UP = "d180"
OUTCOMES = ["mort_30", "d30_composite"]
LONG_TERM_OUTCOME = "pasc"
# Further covariates of the adjusted outcome models.
ADJUSTED_FOR = ["age_at_covid"]
SCORE_CATEGORICAL = ["sex", "race_ethnicity"]
SCORE_NUMERIC_BASE = [
    "age_at_covid", "mildliver", "cad", "chf", "mi", "htn", "cancer", "metcancer", "ckd",
    "dmuncomp", "dmcomp", "obesity", "hiv", "lungdisease", "immunocomp", "systemicsteroids",
    "biologic", "tobacco", "vaccine_number",
]
SCORE_NUMERIC = SCORE_NUMERIC_BASE + [VISITS_BEFORE, OBSERVED_BEFORE]
TABLE_CATEGORICAL = [
    "sex", "race_ethnicity", "mildliver", "rheum", "chf", "mi", "cad", "htn", "ckd", "cancer",
    "metcancer", "dmcomp", "dmuncomp", "obesity", "lungdisease", "transplant", "hiv",
    "immunocomp", "systemicsteroids", "biologic", "tobacco", "subuse",
]
TABLE_NUMERIC = [
    "age_at_covid", INDEX, "vaccine_number",
    VISITS_BEFORE, VISITS_POST, OBSERVED_BEFORE, OBSERVED_POST,
]
BALANCE_NUMERIC = ["age_at_covid", "vaccine_number"]
BALANCE_CATEGORICAL = [
    "sex", "race_ethnicity", "mildliver", "cad", "chf", "mi", "htn", "cancer", "metcancer",
    "ckd", "dmuncomp", "dmcomp", "obesity", "hiv", "lungdisease", "immunocomp", "tobacco",
]
BALANCE_THRESHOLD = 0.1
TRIM_QUANTILES = (0.01, 0.99)
EARLY_TRIM_QUANTILES = (0.05, 0.95)
