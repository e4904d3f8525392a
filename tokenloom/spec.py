"""Types of the engine: options, the parsed tokenizer, encodings and errors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import types as T

BACKENDS = ("WordPiece", "Bpe", "Tiktoken", "SentencePieceBpe", "SentencePieceUnigram", "Unknown")


class TokenizerNotSupported(NotImplementedError):
    """A tokenizer, model or encoding that the engine can't run."""

    def __init__(self, message: str, backend: str = "Unknown"):
        super().__init__(message)
        self.backend = backend


class PaddingMode(Enum):
    NONE = "none"
    LONGEST = "longest"
    MAX_LENGTH = "max_length"


class TruncationMode(Enum):
    NONE = "none"
    ONLY_FIRST = "only_first"
    ONLY_SECOND = "only_second"
    LONGEST_FIRST = "longest_first"


class Side(Enum):
    LEFT = "left"
    RIGHT = "right"


@dataclass(frozen=True)
class Truncation:
    max_length: int
    strategy: str = "longest_first"
    direction: str = "right"
    stride: int = 0


@dataclass(frozen=True)
class Padding:
    strategy: str | None = None
    direction: str = "right"
    length: int | None = None
    pad_id: int = 0
    pad_type_id: int = 0
    pad_token: str = "[PAD]"
    pad_to_multiple_of: int = 0


@dataclass(frozen=True)
class EncodeOptions:
    add_special_tokens: bool = True
    max_length: int | None = None
    truncation: TruncationMode = TruncationMode.NONE
    truncation_side: Side = Side.RIGHT
    padding: PaddingMode = PaddingMode.NONE
    padding_side: Side = Side.RIGHT


@dataclass(frozen=True)
class AddedToken:
    id: int
    content: str
    single_word: bool = False
    lstrip: bool = False
    rstrip: bool = False
    normalized: bool = True
    special: bool = False


@dataclass(frozen=True)
class WordPieceOptions:
    unk_token: str = "[UNK]"
    prefix: str = "##"
    max_input_chars: int = 100
    lowercase: bool = True
    basic_tokenization: bool = True
    clean_up: bool = True
    cls_token: str = "[CLS]"
    sep_token: str = "[SEP]"
    pad_token: str = "[PAD]"
    mask_token: str = "[MASK]"


@dataclass(frozen=True)
class BpeOptions:
    unk_token: str | None = None
    prefix: str = ""
    suffix: str = ""
    byte_level: bool = False
    add_prefix_space: bool = False
    use_regex: bool = True
    #: Whether text is cut at white space when it isn't byte-level; without a pre-tokenizer
    #: in tokenizer.json a whole text is one segment.
    split_whitespace: bool = True


@dataclass(frozen=True)
class TokenizerSpec:
    """A tokenizer as loaded: what the engine compiles to expressions and one kernel. In place
    of a component's JSON there may be a function of the user's own on columns (for the
    post-processor a PostProcessor)."""

    backend: str
    model: object
    normalizer: dict | Callable | None = None
    pre_tokenizer: dict | Callable | None = None
    post_processor: dict | object | None = None
    decoder: dict | Callable | None = None
    added_tokens: tuple[AddedToken, ...] = ()
    truncation: Truncation | None = None
    padding: Padding | None = None
    special_ids: dict[str, int] = field(default_factory=dict)

    def with_(self, **changes) -> TokenizerSpec:
        """A copy with other components: specs never change in place."""
        return replace(self, **changes)


OFFSET = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_INTS = T.ArrayType(T.IntegerType(), True)
_FLAT = [
    T.StructField("ids", _INTS),
    T.StructField("tokens", T.ArrayType(T.StringType(), True)),
    T.StructField("type_ids", _INTS),
    T.StructField("words", T.ArrayType(T.IntegerType(), True)),
    T.StructField("offsets", T.ArrayType(OFFSET, True)),
    T.StructField("special_tokens_mask", _INTS),
    T.StructField("attention_mask", _INTS),
]
#: An encoding without overflow; overflow windows are encodings of this type.
WINDOW = T.StructType(_FLAT)
ENCODING = T.StructType([*_FLAT, T.StructField("overflowing", T.ArrayType(WINDOW)), T.StructField("sequence_ranges", T.MapType(T.IntegerType(), OFFSET))])
#: What kernels return of a text.
PIECES = T.StructType([T.StructField("ids", _INTS), T.StructField("tokens", T.ArrayType(T.StringType(), True)), T.StructField("offsets", T.ArrayType(OFFSET, True)), T.StructField("words", T.ArrayType(T.IntegerType(), True))])
