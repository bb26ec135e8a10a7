"""Training-data operators: chat formatting, similarity joins, exact search,
token files, packing, toxicity, language-model scoring, SentencePiece
encoding, document fingerprints and personal data.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` registers
its queries only where it can be imported.
"""
