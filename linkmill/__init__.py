"""Spark jobs for building, linking and evaluating entity-linking corpora."""
