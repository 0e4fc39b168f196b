"""Operators over papers, topics, questions and answers."""
