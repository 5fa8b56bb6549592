"""Spark jobs that check bibliographic citations against publication records."""
