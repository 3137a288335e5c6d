"""Operators: plain functions from DataFrames to DataFrames."""

from plumbspark.operators.patterns import classify_by_table, match_globs, match_line_patterns
from plumbspark.operators.rewrite import Rewrite, append_if_absent, rewrite_lines
from plumbspark.operators.rules import (
    Rule,
    ScopeRule,
    applicable,
    check_rules,
    classify,
    evaluate_rules,
    verdict,
)
from plumbspark.operators.scan import manifest_items, match_lines, select_paths
from plumbspark.operators.scripts import run_edit_scripts
from plumbspark.operators.select import latest_matching
from plumbspark.operators.state import (
    apply_override_state,
    diff_by_buckets,
    diff_snapshots,
    merge_override_states,
    missing_items,
    override_state,
    plan_missing,
    require_known,
    resolve_overrides,
    unknown_values,
)

__all__ = [
    "Rewrite",
    "Rule",
    "ScopeRule",
    "append_if_absent",
    "applicable",
    "apply_override_state",
    "check_rules",
    "classify",
    "classify_by_table",
    "diff_by_buckets",
    "diff_snapshots",
    "evaluate_rules",
    "latest_matching",
    "manifest_items",
    "match_globs",
    "match_line_patterns",
    "match_lines",
    "merge_override_states",
    "missing_items",
    "override_state",
    "plan_missing",
    "require_known",
    "resolve_overrides",
    "rewrite_lines",
    "run_edit_scripts",
    "select_paths",
    "unknown_values",
    "verdict",
]
