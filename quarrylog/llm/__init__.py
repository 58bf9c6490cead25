"""Training-data operators: near-duplicates, repeats, scoring, mixing and tokenization.

Nothing outside this package imports it.  Every operator has a general
function in its own module; ``queries.py`` holds the thin contract queries.
"""
