"""Operators that prepare transcripts and documents as training data.

Nothing outside this package imports it; it may be deleted as a whole.
"""
