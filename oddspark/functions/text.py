"""Checks on free-text answers, as expressions over one lower-cased answer column."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from oddspark import fixed_values as V


def _string_map(table: dict[str, list[str]]) -> Column:
    entries = []
    for key, values in table.items():
        entries.append(F.lit(key))
        entries.append(F.array(*[F.lit(v) for v in values]).cast("array<string>"))
    return F.create_map(*entries)


def any_term(text: Column, terms: list[str]) -> Column:
    """Whether any of the phrases occurs in the text."""
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda term: F.contains(text, term))


def synonym_match(term: Column, text: Column, synonyms: dict[str, list[str]]) -> Column:
    """Whether the term or one of its accepted spellings occurs in the lower-cased text."""
    key = F.lower(term)
    spellings = F.array(key)
    if synonyms:
        spellings = F.coalesce(F.try_element_at(_string_map(synonyms), key), spellings)
    return F.exists(spellings, lambda spelling: F.contains(text, spelling))


def mentioned_terms(terms: Column, text: Column, synonyms: dict[str, list[str]]) -> Column:
    """Those terms that the text mentions, in order."""
    return F.filter(terms, lambda term: synonym_match(term, text, synonyms))


def terms_without(terms: Column, removed: Column) -> Column:
    """Those terms that are not in ``removed``, in order, repeats kept."""
    return F.filter(terms, lambda term: ~F.array_contains(removed, term))


def ratio_or_one(part: Column, whole: Column) -> Column:
    """size(part) / size(whole); 1.0 when nothing was asked for."""
    return F.when(F.size(whole) > 0, F.size(part) / F.size(whole)).otherwise(1.0)


def regex_citation(text: Column) -> Column:
    """Whether a case count such as ``n = 12`` is quoted."""
    return text.rlike(V.CASE_COUNT_PATTERN)


def claim_without_negation(
    claim: Column, text: Column, negations: list[str], width: int = V.NEGATION_WIDTH
) -> Column:
    """Whether a whole-word occurrence of the claim has no negation phrase near it.

    Splitting at the claim leaves the gaps between occurrences. The text before occurrence i is
    the gaps up to i joined again by the claim, and the text after it the later ones; the context
    is the claim with at most ``width`` characters of either. As the claim has a character at
    least, ``width + 1`` gaps on a side hold all of the context.
    """
    phrase = F.lower(claim)
    quoted = F.concat(F.lit("(?U)\\b\\Q"), phrase, F.lit("\\E\\b"))

    def joined(gaps: Column, start: Column, length: Column) -> Column:
        return F.call_function("array_join", F.slice(gaps, start, length), phrase)

    def stands(gaps: Column, i: Column) -> Column:
        first = F.greatest(i - width, F.lit(1))
        before = F.right(joined(gaps, first, i - first + 1), F.lit(width))
        after = F.left(joined(gaps, i + 1, F.lit(width + 1)), F.lit(width))
        return ~any_term(F.concat(before, phrase, after), negations)

    def in_gaps(gaps: Column) -> Column:
        occurrences = F.when(F.size(gaps) > 1, F.sequence(F.lit(1), F.size(gaps) - 1))
        return F.exists(occurrences, lambda i: stands(gaps, i))

    # One-element array: the split text is bound once and not split again per occurrence.
    return F.coalesce(F.exists(F.array(F.split(text, quoted, -1)), in_gaps), F.lit(False))


def forbidden_claims_in(claims: Column, text: Column, negations: list[str]) -> Column:
    """The claims that the text makes without denying them, in order."""
    return F.filter(claims, lambda claim: claim_without_negation(claim, text, negations))


def accepted_tools(expected_tool: Column, strict: bool = False) -> Column:
    """The tools that satisfy an expected one; empty when any tool does.

    By default only the table's own keys are resolved. ``strict`` also resolves a name that
    appears among the accepted ones.
    """
    aliases = dict(V.TOOL_ALIASES)
    if strict:
        for names in V.TOOL_ALIASES.values():
            for name in names:
                aliases.setdefault(name, names)
    found = F.try_element_at(_string_map(aliases), F.coalesce(expected_tool, F.lit("")))
    return F.coalesce(found, F.array().cast("array<string>"))
