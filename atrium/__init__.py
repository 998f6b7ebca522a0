"""Batch and streaming analytics over indoor venues, written as Spark DataFrame operators."""
