"""shardlens: placement and fleet analytics for sharded storage services on Spark."""
