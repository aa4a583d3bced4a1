"""Feedback analytics on Spark: message, reply and reaction events in, weekly summaries out.

Every operator takes and returns DataFrames or Columns, so the pieces compose
into one logical plan that Catalyst and AQE optimise as a whole.
"""

__version__ = "0.1.0"
