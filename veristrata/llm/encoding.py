"""Token ids of whole texts under a public byte-level BPE tokenizer, with a bounded cache.

The tokenizer file is read with ``tokenizers``. Chunks that are not in the cache are merged by
``tiktoken`` with that file's vocabulary as ranks (several times faster, the same ids; the
tests hold both against each other over whole tables, and loading checks a probe). Texts that hold
a special token's string, such as <|endoftext|>, are left to ``tokenizers``, which gives it its id.

No token of this pattern runs from a non-space character over a single space: it either ends
before the space or starts with it. A text whose chunks between spaces neither are empty nor
have white space at their ends can hence be cut before every space, and its ids are those of
the chunks. Other texts are encoded whole.
"""

from __future__ import annotations

import numpy as np

#: Entries a worker's cache takes; once it is full new chunks are encoded each time, so memory is bounded.
CACHE_ENTRIES = 200_000
#: Chunks longer than this are encoded but not cached.
CACHED_CHARS = 64
_PROBE = "It's 42 naïve cafés,  two\n\nlines … ça! "

_loaded: dict[str, "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """ids(texts): for each text its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.reference = Tokenizer.from_file(path)
        self.special = [t.content for t in self.reference.get_added_tokens_decoder().values()]
        byte_of = _byte_of_char()
        ranks = {}
        for token, rank in self.reference.get_vocab(with_added_tokens=False).items():
            if all(c in byte_of for c in token) and token not in self.special:
                ranks[bytes(byte_of[c] for c in token)] = rank
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        if self.fast.encode_ordinary(_PROBE) != self.reference.encode(_PROBE, add_special_tokens=False).ids:
            raise ValueError(f"{path} isn't a byte-level BPE of the public pattern")
        self.cache: dict[str, bytes] = {}  # what follows a space -> ids of the space and it

    def whole(self, text: str) -> bytes:
        return np.asarray(self.fast.encode_ordinary(text), dtype="<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        odd = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        if odd:
            plain = iter(self.ids([t for i, t in enumerate(texts) if i not in odd]))
            return [np.asarray(self.reference.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() if i in odd else next(plain) for i, t in enumerate(texts)]
        cache = self.cache
        cut = [t.split(" ") for t in texts]
        need: set[str] = set()
        for p in cut:
            need.update(p[1:])
        need.difference_update(cache)
        extra: dict[str, bytes] = {}
        unsafe: set[str] = set()
        for p in need:
            if not p or p[0].isspace() or p[-1].isspace():
                unsafe.add(p)
            else:
                room = len(p) <= CACHED_CHARS and len(cache) < CACHE_ENTRIES
                (cache if room else extra)[p] = self.whole(" " + p)
        out = []
        for t, p in zip(texts, cut):
            if len(p) == 1 or not p[0] or p[0][-1].isspace() or (unsafe and not unsafe.isdisjoint(p[1:])):
                out.append(self.whole(t))
            elif extra:
                out.append(self.whole(p[0]) + b"".join([extra[x] if x in extra else cache[x] for x in p[1:]]))
            else:
                out.append(self.whole(p[0]) + b"".join(map(cache.__getitem__, p[1:])))
        return out


def encoder(path: str) -> Encoder:
    """One encoder a worker process and tokenizer file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
