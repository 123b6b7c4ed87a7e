"""Training-data operators: ten large-corpus operations and their queries.

Nothing outside this subpackage imports it; the entry module adds its
queries only when it is present.
"""
