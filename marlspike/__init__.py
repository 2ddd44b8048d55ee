"""Marlspike: document retrieval and corpus preparation on Spark."""
