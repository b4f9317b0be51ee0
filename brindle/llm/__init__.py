"""Training-data operators: formatting, filtering, deduplication, tokenisation.

Nothing outside this subpackage imports it, except the guarded entry file.
"""
