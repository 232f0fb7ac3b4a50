"""Training-data operators: thirteen corpus operators and their registered queries (``queries.py``).

Nothing outside this folder imports it; the entry module adds its queries only when it is present.
"""
