"""tessera: a PySpark-native engine for company-disclosure analytics and training-data preparation."""
