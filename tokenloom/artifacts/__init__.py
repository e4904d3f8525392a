"""Loading of tokenizer artifacts on the driver."""
