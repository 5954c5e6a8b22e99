"""Spark-native curation, validation and scoring of assessment items and training chats."""
