"""Source text to rows: one scanner a language, run over files in batches."""
