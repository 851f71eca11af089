"""Operators for training text: language, quality, tokens, scores, overlaps, copies and chats.

Nothing outside this folder imports it; ``queries`` registers one query per operator.
"""
