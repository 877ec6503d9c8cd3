"""Byte-level byte-pair encoding by the tokenizers library, text by text, with a word memo.

The library splits a text into pre-tokens before it merges, and no pre-token
reaches over a place where white space follows other characters, or where a
run of letters and digits meets a run of ASCII punctuation.  Texts are cut
at such places only; each distinct piece is encoded once and kept.  A new piece of
ASCII and Latin letters is cut into its pre-tokens, and the library's model merges
each of these once; most pieces are one pre-token.  Any other piece is encoded by
the library as it is.  Texts with a special string, and tokenizers with another
set-up, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

# Unicode white space; letters and digits up to Latin Extended-B; ASCII punctuation without the
# apostrophe, which contractions bind.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ALNUM = "A-Za-z0-9\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_PUNCT = re.escape('!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')
_PIECES = re.compile(
    f"[{_WHITE}]*(?:[{_ALNUM}]+(?=[{_PUNCT}{_WHITE}]|\\Z)|[{_PUNCT}]+(?=[{_ALNUM}{_WHITE}]|\\Z)|[^{_WHITE}]+)|[{_WHITE}]+")
# the pre-tokens of the byte-level set-up, for ASCII and the letters up to Latin Extended-B
_LATIN = "\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_KNOWN = re.compile(f"[\0-\x7f{_LATIN}]*")
_TOKENS = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z{_LATIN}]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9{_LATIN}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def _alphabet() -> dict[int, str]:
    """The characters of the byte-level alphabet: printable bytes are themselves, all others follow 255 in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


_ALPHABET = _alphabet()
_SPACE = _ALPHABET[32]
#: Pieces and pre-tokens kept in a worker, but for those of one text; the memo starts anew beyond, results stay the same.
MEMO_SIZE = 500_000


def tokenizer_file(name: str) -> str:
    """A path as it is, or the place of a file of the installed public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Memo(dict):
    """Ids of pieces and of the pre-tokens of pieces that hold several, by the library's ``encode`` or its model's ``merge``."""

    def __init__(self, encode, code, merge):
        super().__init__()
        self.encode, self.code, self.merge = encode, code, merge

    def whole(self, text: str) -> bytes:
        return array(self.code, self.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ascii_only = piece.isascii()
        if self.merge is None or not (ascii_only or _KNOWN.fullmatch(piece)):
            out = self.whole(piece)
        elif len(tokens := _TOKENS.findall(piece)) > 1:
            out = b"".join(map(self.__getitem__, tokens))  # a pre-token by itself is one pre-token
        else:
            if ascii_only and piece.isprintable():
                letters = piece.replace(" ", _SPACE)
            else:
                letters = piece.encode("utf-8").decode("latin-1").translate(_ALPHABET)
            out = array(self.code, [t.id for t in self.merge(letters)]).tobytes()
        self[piece] = out
        return out


class Encoder:
    """``encode(text)`` gives the ids as bytes of little-endian unsigned numbers of ``dtype``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_padding()
        library.no_truncation()
        with open(path, encoding="utf-8") as file:
            setup = json.load(file)
        pre = setup.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in setup.get("added_tokens", [])]
        self.divisible = (
            setup.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and not any(re.search(r"\s", s) for s in self.special)
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in setup.get("added_tokens", []))
        )
        code = "H" if library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.dtype = "<u2" if code == "H" else "<u4"
        model = setup.get("model") or {}
        plain = self.divisible and model.get("type") == "BPE" and not model.get("dropout") and not any(
            model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        self.memo = _Memo(library.encode, code, library.model.tokenize if plain else None)

    def encode(self, text: str) -> bytes:
        memo = self.memo
        if not self.divisible or any(s in text for s in self.special):
            return memo.whole(text)
        if len(memo) > MEMO_SIZE:
            memo.clear()
        return b"".join(map(memo.__getitem__, _PIECES.findall(text)))

    def forget(self) -> None:
        """Free the memo; a worker that Spark keeps for other tasks would hold it until it ends."""
        self.memo.clear()


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    path = tokenizer_file(name)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
