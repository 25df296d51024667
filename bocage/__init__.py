"""Bocage: a Spark-first analytics engine for place and registry data.

Every operator is a function from DataFrame to DataFrame.  Subpackages:

``functions``  Column builders (text, geometry, numbers, codes)
``operators``  relational operators built from them
``sources``    typed readers and versioned sinks
``plans``      named queries with the ANSI SQL each one must equal
``streaming``  Structured Streaming counterparts
``llm``        training-data operators; nothing else imports it
"""
