"""A PySpark-native engine that builds, cleans and analyses corpora of web pages."""

__version__ = "0.1.0"
