"""Planning of free-text questions: signed terms, facets, task and temporal mode, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrain.functions import fixed
from evigrain.functions.text import SPACE, col, fold, forms_of, lexical_forms, signed_tokens, term_list, words

_SPLIT = f"(?i)[{SPACE}]+(?:and|e)[{SPACE}]+|[,;]"


def _negative(t: Column) -> Column:
    return F.startswith(t, F.lit("-")) & (F.length(t) > 1)


def positives(c: Column | str) -> Column:
    """Terms that are asked for, in order, without stop words; a repeated one stays."""
    kept = F.filter(signed_tokens(c), lambda t: ~_negative(t))
    return F.filter(F.flatten(F.transform(kept, term_list)), lambda t: ~F.array_contains(words(fixed.STOPWORDS), t))


def negatives(c: Column | str) -> Column:
    """Forms of the terms marked with a leading minus, sorted."""
    marked = F.filter(signed_tokens(c), _negative)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(marked, lambda t: lexical_forms(F.substr(t, F.lit(2)))))))


def facets(c: Column | str) -> Column:
    """Up to eight lists of terms that the question asks for side by side.

    A command before the first colon is dropped if it holds a noise word. Parts between and, e, commas and semicolons
    are facets, without stop and noise words; empty and repeated ones are dropped. Where none is left, all positive
    terms stand for one, else all terms.
    """
    c = F.coalesce(col(c), F.lit(""))
    at = F.instr(c, ":")
    command = (at > 0) & F.arrays_overlap(term_list(F.substring(c, F.lit(1), at - 1)), words(fixed.NOISE))
    body = F.when(command, F.substring(c, at + 1, F.length(c))).otherwise(c)
    drop = words([*fixed.STOPWORDS, *fixed.NOISE])
    found = F.array_distinct(F.filter(F.transform(F.split(body, _SPLIT), lambda s: F.array_except(term_list(s), drop)), lambda f: F.size(f) > 0))
    positive = positives(c)
    bare = F.filter(positive, lambda t: ~F.array_contains(words(fixed.NOISE), t))
    instead = F.when(F.size(bare) > 0, bare).when(F.size(positive) > 0, positive).otherwise(term_list(c))
    return F.slice(F.when(F.size(found) > 0, found).otherwise(F.array(instead)), 1, fixed.MAX_FACETS)


def task(c: Column | str) -> Column:
    terms = term_list(c)
    has = lambda w: F.arrays_overlap(terms, words(w))
    return (
        F.when(has(fixed.TASK_CODE), "code")
        .when(has(fixed.TASK_DECISION) | F.contains(fold(F.coalesce(col(c), F.lit(""))), F.lit(fixed.TASK_DECISION_PHRASE)), "decision")
        .when(has(fixed.TASK_TEMPORAL), "temporal")
        .otherwise("docs")
    )


def temporal_mode(c: Column | str) -> Column:
    """current, or historical where only words of history are used."""
    terms = term_list(c)
    return F.when(F.arrays_overlap(terms, words(fixed.CURRENT_WORDS)), "current").when(F.arrays_overlap(terms, words(fixed.HISTORICAL_WORDS)), "historical").otherwise("current")


def plan(questions: DataFrame, query: str = "query") -> DataFrame:
    """``questions`` with task, temporal_mode, positives, negatives, facets, query_terms and facet_count.

    Null queries are planned as empty ones, which have one empty facet.
    """
    named = questions.withColumn("facets", facets(query))
    terms = F.array_distinct(F.flatten(F.transform("facets", forms_of)))
    return named.select(
        *[c for c in questions.columns if c not in ("facets", "task", "temporal_mode", "positives", "negatives", "query_terms", "facet_count")],
        task(query).alias("task"), temporal_mode(query).alias("temporal_mode"), positives(query).alias("positives"), negatives(query).alias("negatives"),
        "facets", terms.alias("query_terms"), F.size("facets").alias("facet_count"),
    )


def facet_rows(planned: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, facet_id, tokens, facet, forms, core_forms): one row per facet, numbered from 1."""
    each = planned.select(key, F.posexplode("facets").alias("p", "tokens"))
    return each.select(
        key, (F.col("p") + 1).alias("facet_id"), "tokens", F.array_join("tokens", " ").alias("facet"), forms_of("tokens").alias("forms"),
        F.when(F.size("tokens") > 0, forms_of(F.slice("tokens", 1, 1))).otherwise(F.array().cast("array<string>")).alias("core_forms"),
    )

