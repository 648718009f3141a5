"""Operators for building language-model training corpora.

Nothing outside this folder imports it; deleting the folder leaves the rest of the library whole.
"""
