"""Training-data operators: extraction, tokenizing, scoring, dedup, filtering, mixing.

Nothing outside this subpackage imports it; remove the folder and the rest of
the engine still works.
"""
