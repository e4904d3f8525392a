"""A reader of SentencePiece model files: the few protobuf fields that encoding needs."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

#: Piece types and model types of the public schema (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE, WORD, CHAR = range(1, 5)
TYPE_NAMES = {NORMAL: "NORMAL", UNKNOWN: "UNKNOWN", CONTROL: "CONTROL", USER_DEFINED: "USER_DEFINED", UNUSED: "UNUSED", BYTE: "BYTE"}


@dataclass(frozen=True)
class Piece:
    id: int
    text: str
    score: float
    type: int


@dataclass(frozen=True)
class PieceModel:
    pieces: tuple[Piece, ...]
    model_type: int = UNIGRAM
    whitespace_as_suffix: bool = False
    byte_fallback: bool = False
    unk_id: int = 0
    unk_piece: str = "<unk>"
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        out |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return out, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed 32-bit and 64-bit values as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"unsupported wire type {kind}")
            if at + size > len(data):
                raise ValueError("truncated message")
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def parse_piece_model(data: bytes) -> PieceModel:
    pieces, more = [], {}
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
            pieces.append(Piece(len(pieces), own.get(1, b"").decode(), score, own.get(3, NORMAL)))
        elif number == 2:
            spec = dict(fields(value))
            more |= {"model_type": spec.get(3, UNIGRAM), "whitespace_as_suffix": bool(spec.get(24, 0)), "byte_fallback": bool(spec.get(35, 0)), "unk_id": spec.get(40, 0), "unk_piece": spec.get(45, b"<unk>").decode()}
        elif number == 3:
            spec = dict(fields(value))
            more |= {"charsmap": spec.get(2, b""), "add_dummy_prefix": bool(spec.get(3, 1)), "remove_extra_whitespaces": bool(spec.get(4, 1)), "escape_whitespaces": bool(spec.get(5, 1))}
    return PieceModel(tuple(pieces), **more)


def read_piece_model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return parse_piece_model(f.read())
