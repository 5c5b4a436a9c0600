from clusterlens.rules import catalog, core  # noqa: F401  (registers the rules)
from clusterlens.rules.integrity import validate_results
from clusterlens.rules.registry import REGISTRY, Rule, rule
from clusterlens.rules.runner import (
    coverage,
    finding_texts,
    findings,
    metric_names,
    run_all,
    run_catalog,
    run_rule,
)

__all__ = [
    "REGISTRY",
    "Rule",
    "catalog",
    "core",
    "coverage",
    "finding_texts",
    "findings",
    "metric_names",
    "rule",
    "run_all",
    "run_catalog",
    "run_rule",
    "validate_results",
]
