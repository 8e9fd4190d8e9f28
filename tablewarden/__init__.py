"""Data-quality checks, repairs, fault planting and scoring as Spark jobs."""

from .operators.contaminate import Fault, FaultRule, contaminate, register_contamination_rule
from .operators.repair import apply_fixes, propose
from .operators.review import cell_status, episode_replay, review_flags, step_feedback, suite_summary
from .operators.rules import Rule, build_check, register_check, run_rules
from .operators.score import episode_summary, rule_quality, score_steps
from .plans.builtin import register_suite  # importing it registers the suites that come with the library
from .plans.suites import ColumnSpec, Suite, get_suite, list_suites, suite_from_config
from .sources import attach_clean_values, cell_value, read_submissions, read_table, with_row_id, write_table

__all__ = [
    "ColumnSpec", "Fault", "FaultRule", "Rule", "Suite", "apply_fixes", "attach_clean_values", "build_check",
    "cell_status", "cell_value", "contaminate", "episode_replay", "episode_summary", "get_suite", "list_suites",
    "propose", "read_submissions", "read_table", "register_check", "register_contamination_rule", "register_suite",
    "review_flags", "rule_quality", "run_rules", "score_steps", "step_feedback", "suite_from_config", "suite_summary",
    "with_row_id", "write_table",
]
