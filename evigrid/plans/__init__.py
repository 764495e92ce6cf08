"""The registered queries, by subject."""
import importlib

MODULES = ("records", "screening", "analytics", "statistics", "metrics", "texts", "graphs", "claims", "datasets", "streams", "reviews", "reviewers", "scalars", "passages", "filesets", "agreement", "finalization", "citing", "reflists", "access", "labelled")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
