"""Column functions: normalizers, pre-tokenizers, post-processing and decoders as expressions."""
