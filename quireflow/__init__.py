"""quireflow: Spark jobs for producing very many long documents at once.

Every operator takes DataFrames (or Columns) and returns a DataFrame (or a
Column) and runs no action of its own; the caller decides when to execute.
"""

__version__ = "0.1.0"
