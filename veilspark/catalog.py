"""Registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from .plans import attack_queries, corpus_queries, file_queries, guess_queries, model_queries, more_queries, other_queries, word_queries

QUERIES = corpus_queries.QUERIES | attack_queries.QUERIES | model_queries.QUERIES | other_queries.QUERIES | more_queries.QUERIES | guess_queries.QUERIES | word_queries.QUERIES | file_queries.QUERIES
SQL = corpus_queries.SQL | attack_queries.SQL | model_queries.SQL | other_queries.SQL | more_queries.SQL | guess_queries.SQL | word_queries.SQL | file_queries.SQL
