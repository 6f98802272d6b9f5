"""PySpark-native text transforms, evaluation statistics and relational operators."""
