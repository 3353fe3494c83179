"""tidemill: data preparation, quality and loading as Spark DataFrame plans."""

from tidemill.plans.runner import make_step, run_steps

__all__ = ["make_step", "run_steps"]
