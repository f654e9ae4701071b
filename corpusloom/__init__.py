"""A PySpark-native engine for preparing text and code corpora: lazy DataFrame -> DataFrame operators."""
