"""Live channels on Structured Streaming."""

from shardflow.streaming.channels import fan_in, receive, run_to_end, sorted_batches

__all__ = ["fan_in", "receive", "run_to_end", "sorted_batches"]
