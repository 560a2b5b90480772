"""corvid: Spark-native corpus, expert-routing and chat-log analytics.

Every public operator is a ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, windows, joins and aggregations.  Python runs inside
tasks only where Spark has no equivalent (strict JSON parsing, user
tokenizers / models), always through Arrow-batched pandas functions.
"""

__version__ = "0.1.0"
