"""Email-threat analytics on Spark: scoring funnel, corpus preparation, evaluation and roll-ups as DataFrame transforms."""
