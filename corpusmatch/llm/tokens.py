"""Token ids of whole texts, by a tokenizer file that every machine has."""

from __future__ import annotations

import functools
import json

import numpy as np
import tokenizers

from corpusmatch.functions.worker import once_per_worker

# A byte-level vocabulary never merges this byte with another, so it keeps joined pieces apart.
_MARK = "\x00"
# Texts with white space other than blanks and line ends are not cut into pieces (U+180E was white space once).
_OTHER = [chr(c) for c in range(1 << 16) if chr(c) not in " \n" and chr(c).isspace()] + [_MARK, "\u180e"]
# Pieces whose ids a worker keeps, some 200 bytes each.
CACHED = 1_000_000
_DOCS_AT_ONCE = 500


def _odd(text: str) -> bool:
    """Whether white space is beside white space, at an end, or other than blanks and line ends."""
    blanks = text.replace("\n", " ")
    return "  " in blanks or blanks[:1] == " " or blanks[-1:] == " " or any(c in text for c in _OTHER)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """``encode`` gives the little-endian ids of each text as bytes, ``dtype`` wide.

    The ids are those of the library's plain call, ``encode(text, add_special_tokens=False)``: the string of an added
    token in a text is that token. Where the tokenizer is byte-level with its usual word pattern, a text is cut
    before single blanks and line ends, where no token can cross; ids of a piece are kept and each new piece is
    encoded once, many in one call. Other tokenizers, and texts with any other white space or with the string of
    an added token, are encoded whole.
    """

    def __init__(self, path: str, cached: int = CACHED):
        self.cached = cached
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.model = tokenizers.Tokenizer.from_file(path)
        self.added = [x["content"] for x in spec.get("added_tokens") or ()]
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        before = spec.get("pre_tokenizer") or {}
        mark = self.model.encode(_MARK, add_special_tokens=False).ids
        stands_alone = all("Ā" not in "".join(m) for m in spec["model"].get("merges", ()))
        self.by_piece = (
            before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not spec.get("normalizer")
            and spec["model"].get("type", "BPE") == "BPE"
            and len(mark) == 1
            and stands_alone
        )
        self.mark = mark[0] if mark else None
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), _DOCS_AT_ONCE):
            out += self._some(texts[at : at + _DOCS_AT_ONCE])
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _some(self, texts: list[str]) -> list[bytes]:
        odd = [not self.by_piece or not x or _odd(x) or any(a in x for a in self.added) for x in texts]
        whole = iter(self._whole([x for x, o in zip(texts, odd) if o]))
        if len(self.cache) > self.cached:
            self.cache.clear()
        get = self.cache.get
        # a leading line end gives the first piece a form that does not depend on its place
        cut = [None if o else ("\n" + x).replace("\n", " \n").split(" ")[1:] for x, o in zip(texts, odd)]
        ids = [None if pieces is None else list(map(get, pieces)) for pieces in cut]
        open_ = [
            (row, i, pieces[i])
            for pieces, row in zip(cut, ids)
            if row is not None and None in row
            for i, x in enumerate(row)
            if x is None
        ]
        self._learn(list({piece for _, _, piece in open_}))
        for row, i, piece in open_:
            row[i] = self.cache[piece]
        first = len(self._newline)
        return [next(whole) if row is None else b"".join(row)[first:] for row in ids]

    @functools.cached_property
    def _newline(self) -> bytes:
        return self._whole(["\n"])[0]

    def _learn(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 2000):
            some = pieces[at : at + 2000]
            joined = "".join(f"{p if p[:1] == chr(10) else ' ' + p}{_MARK}" for p in some)
            ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
            ends, raw, width, start = np.flatnonzero(ids == self.mark).tolist(), ids.tobytes(), ids.itemsize, 0
            for piece, end in zip(some, ends, strict=True):
                self.cache[piece] = raw[start * width : end * width]
                start = end + 1


def encoder(path: str, cached: int = CACHED) -> Encoder:
    """One per Python worker; it stays there with its cache."""
    return once_per_worker(("encoder", path, cached), lambda: Encoder(path, cached))
