"""Queries, by area; importing a module registers its queries."""

from loomtext.plans import analysis_queries, corpus_queries, file_queries, knowledge_queries, model_queries, more_queries, task_queries, text_queries  # noqa: F401
