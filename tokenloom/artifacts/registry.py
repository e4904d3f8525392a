"""Names of byte-rank encodings: patterns, special tokens, and the models that use them."""

from __future__ import annotations

from tokenloom.spec import TokenizerNotSupported

#: Split patterns (fixed values of the formats).
PATTERNS = {
    "cl100k": r"'(?i:[sdmt]|ll|ve|re)|(?>[^\r\n\p{L}\p{N}]?)(?>\p{L}+)|(?>\p{N}{1,3})| ?(?>[^\s\p{L}\p{N}]+)(?>[\r\n]*)|(?>\s+)$|\s*[\r\n]|\s+(?!\S)|\s",
    "p50k": r"'(?:[sdmt]|ll|ve|re)| ?(?>\p{L}+)| ?(?>\p{N}+)| ?(?>[^\s\p{L}\p{N}]+)|(?>\s+)$|\s+(?!\S)|\s",
    "o200k": r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+",
}

#: Encodings: pattern and special tokens (fixed values).
ENCODINGS = {
    "gpt2": ("p50k", {"<|endoftext|>": 50256}),
    "r50k_base": ("p50k", {"<|endoftext|>": 50256}),
    "p50k_base": ("p50k", {"<|endoftext|>": 50256}),
    "p50k_edit": ("p50k", {"<|endoftext|>": 50256, "<|fim_prefix|>": 50281, "<|fim_middle|>": 50282, "<|fim_suffix|>": 50283}),
    "cl100k_base": ("cl100k", {"<|endoftext|>": 100257, "<|fim_prefix|>": 100258, "<|fim_middle|>": 100259, "<|fim_suffix|>": 100260, "<|endofprompt|>": 100276}),
    "o200k_base": ("o200k", {"<|endoftext|>": 199999, "<|endofprompt|>": 200018}),
    "o200k_harmony": (
        "o200k",
        {
            "<|startoftext|>": 199998,
            "<|endoftext|>": 199999,
            "<|reserved_200000|>": 200000,
            "<|reserved_200001|>": 200001,
            "<|return|>": 200002,
            "<|constrain|>": 200003,
            "<|reserved_200004|>": 200004,
            "<|channel|>": 200005,
            "<|start|>": 200006,
            "<|end|>": 200007,
            "<|message|>": 200008,
            "<|reserved_200009|>": 200009,
            "<|reserved_200010|>": 200010,
            "<|reserved_200011|>": 200011,
            "<|call|>": 200012,
            "<|reserved_200013|>": 200013,
            "<|reserved_200014|>": 200014,
            "<|reserved_200015|>": 200015,
            "<|reserved_200016|>": 200016,
            "<|reserved_200017|>": 200017,
            "<|endofprompt|>": 200018,
        },
    ),
}

#: Models and their encodings (fixed values).
MODELS = {
    "o1": "o200k_base",
    "o3": "o200k_base",
    "o4-mini": "o200k_base",
    "gpt-5": "o200k_base",
    "gpt-4.1": "o200k_base",
    "gpt-4o": "o200k_base",
    "gpt-4": "cl100k_base",
    "gpt-3.5-turbo": "cl100k_base",
    "gpt-3.5": "cl100k_base",
    "gpt-3.5-turbo-16k": "cl100k_base",
    "gpt-35": "cl100k_base",
    "gpt-35-turbo": "cl100k_base",
    "gpt-35-turbo-16k": "cl100k_base",
    "davinci-002": "cl100k_base",
    "babbage-002": "cl100k_base",
    "text-embedding-ada-002": "cl100k_base",
    "text-embedding-3-small": "cl100k_base",
    "text-embedding-3-large": "cl100k_base",
    "text-davinci-003": "p50k_base",
    "text-davinci-002": "p50k_base",
    "text-davinci-001": "r50k_base",
    "text-curie-001": "r50k_base",
    "text-babbage-001": "r50k_base",
    "text-ada-001": "r50k_base",
    "davinci": "r50k_base",
    "curie": "r50k_base",
    "babbage": "r50k_base",
    "ada": "r50k_base",
    "code-davinci-002": "p50k_base",
    "code-davinci-001": "p50k_base",
    "code-cushman-002": "p50k_base",
    "code-cushman-001": "p50k_base",
    "davinci-codex": "p50k_base",
    "cushman-codex": "p50k_base",
    "text-davinci-edit-001": "p50k_edit",
    "code-davinci-edit-001": "p50k_edit",
    "text-similarity-davinci-001": "r50k_base",
    "text-similarity-curie-001": "r50k_base",
    "text-similarity-babbage-001": "r50k_base",
    "text-similarity-ada-001": "r50k_base",
    "text-search-davinci-doc-001": "r50k_base",
    "text-search-curie-doc-001": "r50k_base",
    "text-search-babbage-doc-001": "r50k_base",
    "text-search-ada-doc-001": "r50k_base",
    "code-search-babbage-code-001": "r50k_base",
    "code-search-ada-code-001": "r50k_base",
    "gpt2": "gpt2",
    "gpt-2": "gpt2",
    "phi-4": "cl100k_base",
}
#: Beginnings of model names, in the order in which they are tried (fixed values).
PREFIXES = [
    ("o1-", "o200k_base"),
    ("o3-", "o200k_base"),
    ("o4-mini-", "o200k_base"),
    ("gpt-5-", "o200k_base"),
    ("gpt-4.1-", "o200k_base"),
    ("gpt-4.5-", "o200k_base"),
    ("gpt-4o-", "o200k_base"),
    ("chatgpt-4o-", "o200k_base"),
    ("gpt-4-", "cl100k_base"),
    ("gpt-3.5-", "cl100k_base"),
    ("gpt-35-", "cl100k_base"),
    ("gpt-oss-", "o200k_harmony"),
    ("ft:gpt-4o", "o200k_base"),
    ("ft:gpt-4", "cl100k_base"),
    ("ft:gpt-3.5-turbo", "cl100k_base"),
    ("ft:davinci-002", "cl100k_base"),
    ("ft:babbage-002", "cl100k_base"),
]


def resolve(name: str | None) -> tuple[str, str, dict[str, int]]:
    """(encoding, pattern, special tokens) of an encoding's or model's name; case is ignored."""
    if not name or not name.strip():
        raise TokenizerNotSupported("a byte-rank encoding or model name is needed", "Tiktoken")
    low = name.lower()
    found = low if low in ENCODINGS else MODELS.get(low) or next((e for p, e in PREFIXES if low.startswith(p)), None)
    if found is None:
        raise TokenizerNotSupported(f"unknown encoding or model {name!r}; encodings: {', '.join(ENCODINGS)}", "Tiktoken")
    pattern, specials = ENCODINGS[found]
    return found, PATTERNS[pattern], specials
