"""codeledger: a PySpark-native engine for evidence about code and other structured text."""

__version__ = "0.1.0"
