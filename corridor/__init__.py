"""Trajectory, time-series and relational analytics expressed as Spark DataFrame plans."""
