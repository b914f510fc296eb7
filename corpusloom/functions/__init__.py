"""Column functions: cleaning, filtering, quality, conversation metrics, tokenizer."""
