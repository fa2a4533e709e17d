"""querysift: a PySpark-native engine that diagnoses logs of executed SQL."""
