"""Byte-level BPE ids of whole texts, fast enough for a corpus.

The vocabulary file is that of the `tokenizers` library; ids equal those of its encode with
add_special_tokens=False, which finds the strings of added tokens in a text first: each is one id and
parts the text around it. A blank before a character
that is no white space always starts a new pre-token, so a text falls into chunks at such blanks
whose ids do not depend on each other, and a chunk seen before costs one dictionary lookup.
"""

from __future__ import annotations

import array
import base64
import json
import re

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of chunks, ids and their entries (about ENTRY bytes each) that one worker remembers of a kind of chunk, and as many
#: again of those before, which come back when they are met.
REMEMBERED, ENTRY = 40 << 20, 200
_CONTROL = b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
#: UTF-8 starts of white space beyond ASCII (some also start other characters: those texts take the plain way).
_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a tokenizers JSON or a tiktoken file."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    special = {x["content"] for x in said.get("added_tokens", [])}
    back = _byte_of()
    return {bytes(back[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in special}


def added(path: str) -> dict[str, int]:
    """Strings that are one id wherever they stand; a tiktoken file has none."""
    if path.endswith(".tiktoken"):
        return {}
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f).get("added_tokens", [])}


class _Chunks(dict):
    def __init__(self, encode, lead: str):
        self.encode, self.lead, self.held, self.before = encode, lead, 0, {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.before.pop(chunk, None)
        if found is None:
            found = array.array("I", self.encode(self.lead + chunk)).tobytes()
        size = ENTRY + 4 * len(chunk) + len(found)  # a character takes 4 bytes at most
        if self.held + size > REMEMBERED:
            self.before = self.copy()
            self.clear()
            self.held = 0
        if size <= REMEMBERED:
            self[chunk] = found
            self.held += size
        return found


class Encoder:
    """encode(text, its UTF-8) gives the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import tiktoken

        self._plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={}).encode_ordinary
        self._inner, self._head = _Chunks(self._plain, " "), _Chunks(self._plain, "")
        self._added = {name: array.array("I", [i]).tobytes() for name, i in added(path).items()}
        self._parted = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")")

    def encode(self, text: str, raw: bytes) -> bytes:
        if any(name in text for name in self._added):
            return b"".join(self._added[part] if n % 2 else self._ordinary(part, part.encode()) for n, part in enumerate(self._parted.split(text)) if part)
        return self._ordinary(text, raw)

    def _ordinary(self, text: str, raw: bytes) -> bytes:
        if (
            b"  " in raw
            or b" \n" in raw
            or raw.endswith(b" ")
            or len(raw.translate(None, _CONTROL)) != len(raw)
            or (len(text) != len(raw) and any(w in raw for w in _WIDE))
        ):
            return array.array("I", self._plain(text)).tobytes()
        head, *rest = text.split(" ")
        return self._head[head] + b"".join(map(self._inner.__getitem__, rest))
