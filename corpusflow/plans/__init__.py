"""Query plans: fixtures + library operators, each with an oracle."""

import importlib

PLAN_MODULES = (
    "catalog_plans", "band_plans", "outcome_plans", "commit_plans", "corpus_plans",
    "token_plans", "memory_plans", "routing_plans", "eval_plans", "stream_plans",
)


def load_all():
    for m in PLAN_MODULES:
        try:
            importlib.import_module(f"corpusflow.plans.{m}")
        except ModuleNotFoundError as e:  # module not written yet
            if e.name != f"corpusflow.plans.{m}":
                raise
