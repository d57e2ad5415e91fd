"""Plans as graphs, and statistics of a run."""

from shardflow.plans.inspect import dot, interrupt, observed

__all__ = ["dot", "interrupt", "observed"]
