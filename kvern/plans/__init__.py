from kvern.plans.metrics import plan_metrics, plan_nodes
from kvern.plans.report import FORMATTERS, RENDERERS, PhaseReport, sweep_table, to_json
from kvern.plans.runner import run_join, sweep
from kvern.plans.timing import NoTimer, PhaseTimer, Stopwatch

__all__ = ["FORMATTERS", "NoTimer", "PhaseReport", "PhaseTimer", "RENDERERS", "Stopwatch", "plan_metrics", "plan_nodes", "run_join", "sweep", "sweep_table", "to_json"]
