"""All queries of the panel library by name, and their SQL."""

from __future__ import annotations

from panelweave.plans import factor_queries, indicator_queries, layer_queries, panel_queries, portfolio_queries, report_queries, score_queries, setup_queries, strategy_queries, validation_queries

MODULES = (factor_queries, indicator_queries, layer_queries, panel_queries, portfolio_queries, report_queries, score_queries, setup_queries, strategy_queries, validation_queries)
QUERIES = {name: run for m in MODULES for name, run in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
