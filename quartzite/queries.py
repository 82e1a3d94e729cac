"""All queries over the driver's tables, with the SQL that checks each."""

from . import queries_active, queries_books, queries_cuts, queries_dynamics, queries_models, queries_more, queries_recipes, queries_similarity, queries_sweeps
from .queries_panel import FULL, ORACLE, QUERIES, industry_panel, signal_panel

__all__ = ["FULL", "ORACLE", "QUERIES", "industry_panel", "queries_active", "queries_books", "queries_cuts", "queries_dynamics", "queries_models", "queries_more", "queries_recipes", "queries_similarity", "queries_sweeps", "signal_panel"]
