"""Rule representation, dialects and lowering to Spark columns."""
