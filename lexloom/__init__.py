"""lexloom: subword-tokenizer training and text-corpus analytics on Spark DataFrames."""
