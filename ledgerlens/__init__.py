"""ledgerlens — Spark-native financial risk and retrieval analytics.

Every operator is a function ``DataFrame(s), params -> DataFrame`` built from
the DataFrame API, Spark SQL functions and MLlib.  ``ledgerlens.plans.registry``
wires them into named queries over the test tables.
"""

__version__ = "0.1.0"
