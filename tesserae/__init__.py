"""Spark-native corpus analytics: audits, conversation mixes, sampling, preference pairs and reports."""
