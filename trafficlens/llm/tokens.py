"""Token ids of whole texts by a public byte-level BPE vocabulary, with a bounded cache of space-separated pieces."""

from __future__ import annotations

import json
import re
from array import array
from functools import cache

import public_tokenizers
import tiktoken

#: Pieces kept by a worker, some 100 MB; further ones are encoded each time they occur.
CACHE = 400_000


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_pieces(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """The pieces of a byte-level BPE file as bytes, and its added tokens as text, with their ids.  In the file, printable
    bytes stand for themselves and the others for 256 and what follows."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    added = whole.get("added_tokens", [])
    if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that take in what is around them")
    special = {t["content"]: t["id"] for t in added}
    return {bytes(byte_of[c] for c in name): i for name, i in whole["model"]["vocab"].items() if name not in special}, special


class Encoder:
    """Text -> little-endian unsigned 16-bit ids, those of the `tokenizers` library: the file's added tokens (such as an
    end of text) are cut out first wherever their text occurs, and what lies between them is encoded by itself.

    The pre-tokeniser attaches one space to what follows and never joins across it, so the pieces between single spaces
    are encoded on their own; texts with a run of spaces are encoded at once.  Pieces are merged in the order of their
    ids, as in the files that this reads.
    """

    def __init__(self, path: str):
        ranks, self.special = byte_pieces(path)
        if max([*ranks.values(), *self.special.values()]) >= 1 << 16:
            raise ValueError("ids over 16 bits")
        self.bpe = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if self.special else None
        self.known: dict[str, bytes] = {}

    def _new(self, text: str) -> bytes:
        return array("H", self.bpe.encode_ordinary(text)).tobytes()

    def _with_special(self, text: str) -> bytes:
        parts = [p for p in self.cut.split(text) if p]
        return b"".join(self.special[p].to_bytes(2, "little") if p in self.special else self._plain([p])[0] for p in parts)

    def _plain(self, texts: list[str]) -> list[bytes]:
        split = [None if "  " in t else t.split(" ") for t in texts]
        some = [u for u in split if u is not None]
        for u in some:
            u[0] = "\0" + u[0]  # the first piece has no space before it
        unseen = set().union(*some).difference(self.known)
        self.known.update((p, self._new(p[1:] if p[:1] == "\0" else " " + p)) for p in unseen)
        get = self.known.__getitem__
        out = [self._new(t) if u is None else b"".join(map(get, u)) for t, u in zip(texts, split, strict=True)]
        if len(self.known) > CACHE:
            for p in unseen:
                del self.known[p]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        held = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        out = self._plain(["" if i in held else t for i, t in enumerate(texts)])
        for i in held:
            out[i] = self._with_special(texts[i])
        return out


@cache
def encoder(path: str | None = None) -> Encoder:
    """Without a path the default vocabulary, found where this runs."""
    return Encoder(path or default_path())
