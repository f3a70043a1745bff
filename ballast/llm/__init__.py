"""Operators for building language-model training data on Spark.

Each module holds one operator with its own general interface; ``registry``
turns them into the registered ``opN_<name>`` queries. Nothing outside this
package imports it.
"""
