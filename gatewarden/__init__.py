"""Identity-governance analytics on Apache Spark.

Every operator is a DataFrame -> DataFrame function over the canonical
identity tables (see ``gatewarden.schemas``); time always arrives as an
explicit ``as_of`` value.
"""
