"""Per-document functions: tokenizer, tree builder, selectors, serializers, encodings. No Spark here."""
