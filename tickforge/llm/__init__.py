"""Operators that prepare text, chats and vectors for model training."""
