"""halcyon — a Spark-native claims analytics engine.

Every operator is a function ``f(df, ...) -> DataFrame`` (usable with
``df.transform``) or a ``Column`` expression builder.  Fitted state is a small
DataFrame or a Spark ML model; nothing data-sized passes through the driver.
"""

__version__ = "0.1.0"
