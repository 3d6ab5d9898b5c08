"""Training-data operators: corpus mixing, extraction, filtering, de-duplication.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
when it is there.
"""
