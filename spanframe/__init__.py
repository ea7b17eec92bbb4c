"""Timelines, intervals, evidence fusion and evaluation as Spark DataFrame operators."""
