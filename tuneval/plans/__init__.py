"""Composed evaluation jobs and the query catalogue (Spark + DuckDB oracle).

Importing the package registers every query module with ``catalog``.
"""

from . import catalog  # noqa: F401
from . import q_data, q_json, q_text, q_judge, q_analysis, q_tokens, q_io, q_files  # noqa: F401,E402
