"""A Spark-native engine for finding, classifying and pseudonymising personal data in text."""
