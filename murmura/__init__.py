"""Conversation knowledge and analytics as Spark jobs."""
