"""From a request to a plan: names, verdicts, and the lowering to a DataFrame."""
