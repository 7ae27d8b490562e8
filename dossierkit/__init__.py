"""dossierkit: a PySpark-native engine for document archives."""

__version__ = "0.1.0"
