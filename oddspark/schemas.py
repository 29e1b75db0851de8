"""Schemas of the cohort, background and evaluation tables."""

from pyspark.sql import types as T

REPORTS = T.StructType([
    T.StructField("primaryid", T.LongType()),
    T.StructField("caseid", T.LongType()),
    T.StructField("caseversion", T.IntegerType()),
    T.StructField("event_dt", T.DateType()),
    T.StructField("fda_dt", T.DateType()),
    T.StructField("age", T.DoubleType()),
    T.StructField("age_unit", T.StringType()),
    T.StructField("sex", T.StringType()),
    T.StructField("reporter_country", T.StringType()),
    T.StructField("occur_country", T.StringType()),
    T.StructField("reporter_type", T.StringType()),
    T.StructField("serious", T.BooleanType()),
    T.StructField("faers_quarter", T.StringType()),
])

DICTIONARY = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("active_ingredient", T.StringType()),
    T.StructField("brand_names", T.ArrayType(T.StringType())),
    T.StructField("indication_class", T.StringType()),
])

SIGNALS = T.StructType([
    T.StructField("drug_key", T.StringType()),
    T.StructField("event_pt", T.StringType()),
    T.StructField("a", T.LongType()),
    T.StructField("b", T.LongType()),
    T.StructField("c", T.LongType()),
    T.StructField("d", T.LongType()),
    T.StructField("prr", T.DoubleType()),
    T.StructField("prr_chi2", T.DoubleType()),
    T.StructField("ror", T.DoubleType()),
    T.StructField("ror_ci_low", T.DoubleType()),
    T.StructField("ror_ci_high", T.DoubleType()),
    T.StructField("ic", T.DoubleType()),
    T.StructField("ic_ci_low", T.DoubleType()),
    T.StructField("is_signal_ema", T.BooleanType()),
    T.StructField("is_signal_bcpnn", T.BooleanType()),
])

GRID = T.StructType([
    T.StructField("drug_pos", T.IntegerType()),
    T.StructField("drug_key", T.StringType()),
    T.StructField("event_pos", T.IntegerType()),
    T.StructField("event_pt", T.StringType()),
])

DRUG_KEYS = T.StructType([T.StructField("drug_key", T.StringType())])

QUERY_VECTORS = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType())),
])

EMBEDDINGS = T.StructType([
    T.StructField("pt", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

KNOWN_SIGNALS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("drug", T.StringType()),
    T.StructField("event_pts", T.ArrayType(T.StringType())),
    T.StructField("literature_source", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("notes", T.StringType()),
])

ANSWER_RULES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("expected_tool", T.StringType()),
    T.StructField("must_mention_pts", T.ArrayType(T.StringType())),
    T.StructField("expected_signals", T.ArrayType(T.StringType())),
    T.StructField("forbidden_claims", T.ArrayType(T.StringType())),
    T.StructField("notes", T.StringType()),
])

ANSWERS = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("tool_calls", T.ArrayType(T.StructType([
        T.StructField("turn", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("arguments", T.StringType()),
        T.StructField("output_preview", T.StringType()),
    ]))),
    T.StructField("final_answer", T.StringType()),
    T.StructField("n_turns", T.IntegerType()),
    T.StructField("stop_reason", T.StringType()),
    T.StructField("error", T.StringType()),
])
