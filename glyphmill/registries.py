"""Names by which tokenizers, evaluators and report artifacts are asked for."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from .operators.codec import TRAINERS

log = logging.getLogger(__name__)

TOKENIZERS = tuple(TRAINERS)
#: Evaluators, and the queries that make up each.
EVALUATORS: dict[str, tuple[str, ...]] = {
    "perplexity": ("perplexity", "oov_rate", "compression_ratio", "confidence"),
    "words": ("benchmark_scores", "first_content_word"),
    "last_word": ("last_word_benchmark",),
    "canary": ("canary_by_group", "canary_match", "canary_budget"),
    "minimal_pairs": ("minimal_pair_accuracy",),
    "external": ("distinct_n", "repeat_n", "trim_repeats", "repetition_penalty", "external_ppl"),
    "speed": ("speed_mad",),
}
ARTIFACTS: dict[str, tuple[str, ...]] = {
    "training_summary": ("training_summary", "training_steps"),
    "training_curves": ("metric_series", "progress_bands", "axis_band"),
    "learning_rate": ("lr_schedule",),
    "token_lengths": ("token_len_hist_text", "token_len_hist_vocab", "len_dist_normalized"),
    "cross_tables": ("cross_perplexity", "cross_rollup"),
    "significance": ("metric_samples", "bootstrap_ci", "paired_bootstrap", "significance_flag", "language_summary"),
}
ALIASES = {"technical_metrics": "learning_rate"}


def chosen(spec: str | None, known: Iterable[str], aliases: dict[str, str] | None = None) -> tuple[list[str], list[str]]:
    """Known and unknown names of a comma list, each once, in the order asked for; case does not matter, nothing and all mean every one."""
    names = list(known)
    asked = [x.strip() for x in (spec or "").split(",") if x.strip()]
    if not asked or [x.lower() for x in asked] == ["all"]:
        return names, []
    by_case = {n.lower(): n for n in names} | {a.lower(): n for a, n in (aliases or {}).items()}
    found = dict.fromkeys(by_case.get(x.lower(), x) for x in asked)
    return [n for n in found if n in names], [n for n in found if n not in names]


def run(spark: SparkSession, sf_dir: str, spec: str | None, groups: dict[str, tuple[str, ...]], sink: Callable[[str, DataFrame], None]) -> tuple[list[str], dict[str, str]]:
    """Hands each query of the chosen groups to the sink. A group that fails does not stop the next ones: done, and failed with why."""
    from .plans import registry

    queries = registry.queries()
    names, unknown = chosen(spec, groups, ALIASES)
    for n in unknown:
        log.warning("nothing is called %s", n)
    done, failed = [], {}
    for n in names:
        try:
            for q in groups[n]:
                sink(q, queries[q](spark, sf_dir))
            done.append(n)
        except Exception as e:  # one group's failure is its own
            failed[n] = str(e)
    return done, failed
