"""tracesift: trace analytics and anomaly-driven span sampling on Apache Spark.

Everything here builds lazy DataFrame plans; the only eager steps are model
fitting (which must see data) and explicit sinks.
"""

__version__ = "0.1.0"
