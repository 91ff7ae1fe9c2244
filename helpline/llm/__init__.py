"""Training-data operators (documents, conversations, embeddings) as Spark jobs.

Nothing else in the library imports this sub-package. Each module holds one
operator; ``queries`` registers the thin queries that apply them to the tables.
"""
