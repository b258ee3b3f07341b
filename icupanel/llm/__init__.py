"""Training-data operators: mixing, sharding, filtering and deduplicating documents.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to a DataFrame; `icupanel.llm.queries` binds them to the test tables.
"""
