"""Conversation-memory analytics and corpus operators on PySpark."""
