"""Conversation-relevance scoring and text-dataset preparation on Spark."""
