"""Declarative aggregation over nested JSON and XML documents, compiled to Spark DataFrame plans."""
