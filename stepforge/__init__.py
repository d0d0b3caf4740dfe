"""stepforge: Spark-first analytics for agent trajectories and training data.

Layout
  sources/    readers, validators, sinks, incremental merges
  functions/  Column-level building blocks (identifiers, text folding, calls)
  operators/  DataFrame -> DataFrame operators
  plans/      named queries over the tables and their independent SQL twins
  streaming/  the Structured Streaming form of the scoring pipeline
  llm/        training-data operators; nothing outside it imports it
"""

__version__ = "0.1.0"
