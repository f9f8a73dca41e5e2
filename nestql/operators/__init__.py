"""Operators: predicates, element filters, aggregate operations, explosion."""
