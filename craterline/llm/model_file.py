"""The parts of a SentencePiece model file that the operators need, read from its protobuf wire format."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import public_tokenizers

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: The marker of a blank (fixed value).
BLANK = "▁"
#: Kinds of pieces (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Model kinds (fixed values of the format).
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    """Pieces (text, score, kind) in the order of their ids, and how texts are normalised."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    normalizer: str = ""
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @property
    def unknown_id(self) -> int:
        return next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)

    def crosses_words(self) -> bool:
        """Whether a piece has a blank marker behind another character, so that words can't be taken one by one."""
        return any(kind in (NORMAL, USER_DEFINED) and BLANK in text.lstrip(BLANK) for text, _, kind in self.pieces)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def _fields(data: bytes):
    """(number, value) of each field of a message; nested messages and strings as bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at:at + size], at + size
        else:
            raise ValueError(f"wire type {wire} does not occur in a model file")
        yield tag >> 3, value


def read_model(path: str = MODEL) -> Model:
    """Read a ``.model`` file. Field numbers are those of the public format."""
    with open(path, "rb") as file:
        data = file.read()
    model = Model()
    for number, value in _fields(data):
        if number == 1:  # a piece
            piece = dict(_fields(value))
            model.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
        elif number == 2:  # how it was trained
            for inner, v in _fields(value):
                if inner == 3:
                    model.kind = v
                elif inner == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:  # the normaliser
            for inner, v in _fields(value):
                if inner == 1:
                    model.normalizer = v.decode()
                elif inner == 2:
                    model.charsmap = v
                elif inner == 3:
                    model.add_dummy_prefix = bool(v)
                elif inner == 4:
                    model.remove_extra_whitespaces = bool(v)
                elif inner == 5:
                    model.escape_whitespaces = bool(v)
    return model
