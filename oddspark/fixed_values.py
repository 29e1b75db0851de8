"""Lists, patterns and constants that results depend on.

Everything here is data. The values are given by the report format, by the statistics or by
the scoring rules, so they are spelled out plainly and never computed.
"""

# Raw tables of one quarter.
RAW_TABLES = ["DEMO", "DRUG", "REAC", "OUTC", "RPSR", "THER", "INDI"]

# The raw tables that the cohort and the background read.
DETAIL_TABLES = ["demo", "drug", "reac", "outc", "indi"]

# Roles counted as suspect (primary, secondary).
SUSPECT_ROLES = ["PS", "SS"]

# Outcome codes that make a report serious.
SERIOUS_OUTCOMES = ["DE", "LT", "HO", "DS", "CA"]

# Patterns removed from a product name, in this order (Java syntax, Unicode classes).
NAME_PARENTHESES = r"\([^)]*\)"
NAME_DOSAGE = r"(?U)\d+(\.\d+)?\s*(mg|mcg|g|ml|units?|iu|%)\b"
# The formulation words start with one of the letters named first, which spares most positions.
NAME_FORMULATION = (
    r"(?U)(?=[itcsopxe])"
    r"\b(?:injection|inj|tablet|tab|capsule|cap|solution|sol|suspension|susp|"
    r"cream|ointment|patch|xr|er|sr|cr)\b"
)
NAME_SPACES = r"(?U)\s+"

# Years per age unit. Factors, not divisors, so that last digits agree.
YEARS_PER_UNIT = {
    "DEC": 10.0,
    "YR": 1.0,
    "MON": 1 / 12,
    "WK": 1 / 52,
    "DY": 1 / 365,
    "HR": 1 / 8760,
}

# Signal criteria.
EMA_MIN_PRR = 2.0
EMA_MIN_CHI2 = 4.0
EMA_MIN_CASES = 3
Z_95 = 1.96

# The target drug class (active ingredient, brand names, indication class).
CLASS_DICTIONARY = [
    ("semaglutide", ["ozempic", "wegovy", "rybelsus"], "both"),
    ("liraglutide", ["victoza", "saxenda"], "both"),
    ("tirzepatide", ["mounjaro", "zepbound"], "both"),
    ("dulaglutide", ["trulicity"], "diabetes"),
    ("exenatide", ["byetta", "bydureon"], "diabetes"),
    ("lixisenatide", ["adlyxin", "lyxumia", "soliqua"], "diabetes"),
]

# Columns of the published tables, parents before children.
PUBLISHED_TABLES = {
    "glp1_drugs": ["active_ingredient", "brand_names", "indication_class"],
    "reports": [
        "primaryid", "caseid", "caseversion", "event_dt", "fda_dt", "age", "age_unit", "sex",
        "reporter_country", "occur_country", "reporter_type", "serious", "faers_quarter",
    ],
    "drugs": [
        "primaryid", "drug_seq", "role_cod", "drugname", "prod_ai", "route", "dose_amt",
        "dose_unit", "is_glp1",
    ],
    "reactions": ["primaryid", "pt", "drug_rec_act"],
    "outcomes": ["primaryid", "outc_cod"],
    "indications": ["primaryid", "indi_drug_seq", "indi_pt"],
    "glp1_signals": [
        "drug_key", "event_pt", "a", "b", "c", "d", "prr", "prr_chi2", "ror", "ror_ci_low",
        "ror_ci_high", "ic", "ic_ci_low", "is_signal_ema", "is_signal_bcpnn",
    ],
    "pt_embeddings": ["pt", "embedding"],
}

# Tools accepted for each expected tool of an answer rule.
TOOL_ALIASES = {
    "semantic_event_search": ["semantic_event_search", "semantic_search"],
    "detect_signals": ["detect_signals", "get_open_signals"],
    "query_cohort_events": ["query_cohort_events", "check_subgroup"],
    "compare_drugs": ["compare_drugs"],
    "check_signal": [
        "semantic_event_search", "detect_signals", "query_cohort_events", "compare_drugs",
    ],
    "handle_invalid_drug": [],
    "handle_absurd_event": [],
}

# Accepted spellings per event term (lower case, English and Spanish).
TERM_SYNONYMS = {
    "injection site": [
        "injection site", "sitio de inyección", "sitio inyección", "reacción en el sitio",
    ],
    "incorrect dose administered": [
        "incorrect dose administered", "dosis incorrecta", "dosis incorrecta administrada",
    ],
    "impaired gastric emptying": [
        "impaired gastric emptying", "vaciamiento gástrico", "vaciado gástrico",
    ],
    "optic ischaemic neuropathy": [
        "optic ischaemic neuropathy", "optic ischemic neuropathy", "neuropatía óptica isquémica",
        "naion",
    ],
    "ischaemic optic neuropathy": [
        "ischaemic optic neuropathy", "ischemic optic neuropathy", "neuropatía óptica isquémica",
        "naion",
    ],
    "optic nerve infarction": ["optic nerve infarction", "infarto del nervio óptico"],
    "hepatic function abnormal": [
        "hepatic function abnormal", "función hepática anormal", "funcion hepatica",
    ],
    "pancreatitis": ["pancreatitis"],
    "pancreatitis acute": ["pancreatitis acute", "pancreatitis aguda"],
    "gastroparesis": [
        "gastroparesis", "gastroparesia", "vaciamiento gástrico", "impaired gastric emptying",
    ],
    "gastric emptying impaired": [
        "gastric emptying impaired", "impaired gastric emptying", "vaciamiento gástrico",
    ],
    "gastric hypomotility": ["gastric hypomotility", "hipomotilidad gástrica", "hipomotilidad"],
    "suicidal ideation": ["suicidal ideation", "ideación suicida", "ideacion suicida"],
    "suicide attempt": ["suicide attempt", "intento de suicidio"],
    "aspiration pneumonia": [
        "aspiration pneumonia", "neumonía por aspiración", "neumonia por aspiracion",
    ],
    "gastric aspiration": [
        "gastric aspiration", "aspiración gástrica", "aspiración pulmonar", "aspiration",
    ],
    "nausea": ["nausea", "náusea", "náuseas"],
    "vomiting": ["vomiting", "vómito", "vomito"],
    "diarrhoea": ["diarrhoea", "diarrhea", "diarrea"],
    "dyspepsia": ["dyspepsia", "dispepsia"],
    "rhabdomyolysis": ["rhabdomyolysis", "rabdomiólisis", "rabdomiolisis"],
    "blood creatine phosphokinase increased": [
        "creatine phosphokinase", "creatina quinasa", "cpk",
    ],
    "death": [
        "death", "muerte", "muertes", "fallecimiento", "óbito", "mortalidad", "mortal", "fatal",
        "letalidad", "letal", "outcome fatal", "resultado fatal", "desenlace fatal",
    ],
    "geriatric subpopulation": [
        "≥65", ">= 65", ">65", "mayores de 65", "adultos mayores", "geriátric", "ancian",
    ],
    "pregnancy": ["pregnancy", "embaraz"],
}

# Phrases that turn a forbidden claim into a denial, and the context width.
NEGATION_PHRASES = [
    "no causa", "sin causa", "no causalidad", "sin causalidad", "no establece", "no implica",
    "no demuestra", "no confirma", "causalidad no", "does not cause", "not cause",
]
NEGATION_WIDTH = 30

# Phrases that count as naming a limitation.
LIMITATION_TERMS = [
    "asociación", "association", "no causalidad", "not causation", "subnotificación",
    "underreporting", "sesgo", "bias", "limitación", "limitation", "no permite",
    "no se puede establecer",
]

# Fixed value: a case count quoted in an answer, such as "n = 12" (Java syntax).
CASE_COUNT_PATTERN = r"(?U)n\s*=\s*\d+"

# Fixed value: the category whose answers may decline to quote evidence.
EDGE_CATEGORY = "edge_case"

# Signals known from the literature (id, drug, event terms, source, year).
KNOWN_SIGNALS = [
    ("k01", "semaglutide", ["Optic ischaemic neuropathy"], "JAMA Ophthalmol. 2024", 2024),
    ("k02", "semaglutide", ["Impaired gastric emptying", "Gastroparesis"],
     "JAMA. 2023;330(18):1795-1797", 2023),
    ("k03", "liraglutide", ["Impaired gastric emptying", "Gastroparesis"],
     "JAMA. 2023;330(18):1795-1797", 2023),
    ("k04", "tirzepatide", ["Impaired gastric emptying"], "FDA prescribing information", 2023),
    ("k05", "semaglutide", ["Pancreatitis", "Pancreatitis acute"],
     "FDA prescribing information", 2023),
    ("k06", "liraglutide", ["Pancreatitis", "Pancreatitis acute"],
     "FDA prescribing information", 2023),
    ("k07", "semaglutide", ["Cholelithiasis", "Cholecystitis"],
     "JAMA Intern Med. 2022;182(5):513-519", 2022),
    ("k08", "liraglutide", ["Cholelithiasis", "Cholecystitis"],
     "JAMA Intern Med. 2022;182(5):513-519", 2022),
    ("k09", "semaglutide", ["Suicidal ideation"], "EMA signal review 2023", 2023),
    ("k10", "tirzepatide", ["Injection site pain", "Injection site erythema"],
     "N Engl J Med. 2021;385:503-515", 2021),
    ("k11", "semaglutide", ["Ileus"], "FDA label update, September 2023", 2023),
]

# The embedding width and the largest batch an encoder is given.
EMBEDDING_DIM = 1024
ENCODER_BATCH = 128

#: Text that is a number, spaces around it allowed.
PLAIN_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
