"""Queries over the driver's tables, each with its SQL where SQL can express it."""

from . import q_data, q_elements

QUERIES: dict = q_elements.QUERIES | q_data.QUERIES
SQL: dict = q_elements.SQL | q_data.SQL
