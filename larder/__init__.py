"""larder: a PySpark-native engine for curating picture and text data sets.

Every operator is a function from DataFrames to a DataFrame with keyword
parameters.  ``larder.operators``, ``larder.functions``, ``larder.sources``,
``larder.streaming`` and ``larder.plans`` are the general part; ``larder.llm``
holds the training-data operators and can be left out.
"""
