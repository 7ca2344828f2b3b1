"""Training-data operators on documents, conversations and embeddings.

Nothing else in the library imports this subpackage. Every operator takes a DataFrame and
column names, selects only the columns it needs (so extra or clashing columns never matter) and
returns a DataFrame of its real output; ``queries`` derives the digest columns from those.
"""
