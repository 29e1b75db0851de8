"""Scoring of free-text answers against rules."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddspark import fixed_values as V
from oddspark.functions.text import (
    accepted_tools,
    any_term,
    forbidden_claims_in,
    mentioned_terms,
    ratio_or_one,
    regex_citation,
    terms_without,
)

SCORES = [
    "id", "category", "tool_ok", "called_tools", "expected_tool", "pt_coverage", "mentioned_pts",
    "missing_pts", "no_forbidden", "forbidden_violations", "has_n_citation", "has_limitation",
    "n_turns", "error",
]


def score_answers(
    answers: DataFrame,
    rules: DataFrame,
    on: str = "question",
    strict_tools: bool = False,
    synonyms: dict[str, list[str]] = V.TERM_SYNONYMS,
    negations: list[str] = V.NEGATION_PHRASES,
    limitations: list[str] = V.LIMITATION_TERMS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per answer: tool routing, coverage, forbidden claims, citation, limitation.

    The answer is lower-cased once. An unknown or empty expected tool is always right, and edge
    cases need no tool, no citation and no limitation.
    """
    wanted = rules.select(
        on, "id", "category", "expected_tool", "must_mention_pts", "forbidden_claims"
    )
    no_terms = F.array().cast("array<string>")
    edge = F.col("category") == V.EDGE_CATEGORY
    accepted = F.col("_accepted")
    routed = (F.size(accepted) == 0) | F.coalesce(
        F.arrays_overlap("called_tools", accepted), F.lit(False))
    return (
        answers.join(wanted, on)
        .withColumns({
            "_answer": F.lower(F.coalesce("final_answer", F.lit(""))),
            "_must": F.coalesce("must_mention_pts", no_terms),
            "_forbidden": F.coalesce("forbidden_claims", no_terms),
            "expected_tool": F.coalesce("expected_tool", F.lit("")),
            "called_tools": F.coalesce(F.array_distinct("tool_calls.name"), no_terms),
            "_accepted": accepted_tools(F.col("expected_tool"), strict_tools),
        })
        .withColumns({
            "mentioned_pts": mentioned_terms(F.col("_must"), F.col("_answer"), synonyms),
            "forbidden_violations": forbidden_claims_in(
                F.col("_forbidden"), F.col("_answer"), negations
            ),
        })
        .withColumns({
            "tool_ok": edge | routed,
            "pt_coverage": ratio_or_one(F.col("mentioned_pts"), F.col("_must")),
            "missing_pts": terms_without(F.col("_must"), F.col("mentioned_pts")),
            "no_forbidden": F.size("forbidden_violations") == 0,
            "has_n_citation": edge | regex_citation(F.col("_answer")),
            "has_limitation": edge | any_term(F.col("_answer"), limitations),
        })
        .select(*keep, *SCORES)
    )


def summarize_answers(scores: DataFrame) -> DataFrame:
    """Rates over all answers, one row. The failing ids are ``failed_answers``."""
    def rate(name: str):
        return F.avg(F.col(name).cast("double"))

    return scores.agg(
        F.count(F.lit(1)).alias("total_questions"),
        rate("tool_ok").alias("tool_accuracy"),
        rate("pt_coverage").alias("avg_pt_coverage"),
        rate("no_forbidden").alias("no_forbidden_rate"),
        rate("has_n_citation").alias("n_citation_rate"),
        rate("has_limitation").alias("limitation_rate"),
        rate("n_turns").alias("avg_turns"),
        F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("n_errors"),
    )


def failed_answers(scores: DataFrame) -> DataFrame:
    """Ids of the answers that ended in an error, as rows and not as one list."""
    return scores.filter(F.coalesce(F.col("error"), F.lit("")) != "").select("id", "error")
