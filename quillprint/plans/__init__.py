"""End-to-end jobs."""

from quillprint.plans.inspecting import inspect_data, inspect_predictions
from quillprint.plans.reporting import compare_models, evaluate_csv, evaluate_predictions, report
from quillprint.plans.scoring import score_all
from quillprint.plans.training import train

__all__ = [
    "compare_models",
    "evaluate_csv",
    "evaluate_predictions",
    "inspect_data",
    "inspect_predictions",
    "report",
    "score_all",
    "train",
]
