"""Exact tokenizer ids by memoised chunks.

A text is cut only where the tokenizer itself never joins two sides: its ids are then the
ids of its chunks one after another, and each distinct chunk is encoded by the library once
per memo.  Which cuts are safe follows from the tokenizer's own description:

* ``words``: a normaliser that folds ``\\s+`` to a space and lower-cases, and a pre-tokenizer that
  drops white space.  Safe at each space and line feed, which have no ids of their own.
* ``spaced``: byte-level pieces with no normaliser, whose pieces start at a space.  Safe
  before a space that a non-space follows, and on both sides of a lone line feed.  Texts with
  other white space next to those are encoded whole.
* anything else, sentencepiece models included: texts are encoded whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from array import array

import numpy as np

_SPACED_UNSAFE = re.compile(r"[ \n](?:\s|\Z)")

# Words of Latin-1 letters, which both kinds of tokenizer take as they are (lower case only, where
# the normaliser lower-cases), and a run of marks after them: one piece each, whatever stands around.
_MARKS = "([.,!?;:#$%&*|]*)"
_PIECES = {"words": re.compile("([a-zß-öø-ÿ]+)" + _MARKS).fullmatch, "spaced": re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)" + _MARKS).fullmatch}

# The byte-level alphabet: visible Latin-1 characters stand for their byte, the others for 256 onwards.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_ALPHABET = {b: 256 + i for i, b in enumerate(_HIDDEN)}


def _latin(text: str) -> bool:
    """All characters below 256, where lower() and composition go character by character."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def chunk_mode(path: str) -> str:
    if not path.endswith(".json"):
        return "whole"
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", ())):
        return "whole"
    if spec.get("post_processor") or spec.get("truncation") or spec.get("padding"):
        return "whole"
    norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if norm is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True):
        return "spaced"
    steps = [(n.get("type"), (n.get("pattern") or {}).get("Regex")) for n in (norm or {}).get("normalizers", [norm or {}])]
    first = (pre.get("pretokenizers") or [pre])[0]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and not re.search(r"\\s(?!\\)| ", (first.get("pattern") or {}).get("Regex", " "))
    # texts are lower-cased before they are cut, so a tokenizer that keeps capitals is not of this mode
    if drops and ("Replace", r"\s+") in steps and "Lowercase" in {k for k, _ in steps} <= {"NFC", "Replace", "Lowercase"}:
        return "words"
    return "whole"


class _Memo(dict):
    """ids of chunks; a chunk it lacks comes from the generation before or is encoded now."""

    def __init__(self, fresh, older: dict[str, bytes]):
        super().__init__({"": b""})
        self.fresh, self.older = fresh, older

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.fresh(chunk)
        self[chunk] = ids
        return ids


class Encoder:
    """ids of whole texts.  The memo has two generations of ``most`` chunks; a full one takes the older's place."""

    def __init__(self, path: str, most: int = 300_000, most_chars: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.mode, self.most, self.most_chars = chunk_mode(path), most, most_chars
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._whole = lambda texts: self.model.encode(texts, num_threads=1)
            size = self.model.get_piece_size()
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self._whole = lambda texts: [e.ids for e in self.model.encode_batch(texts, add_special_tokens=False)]
            self._piece = self.model.model.tokenize
            size = self.model.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self._pieces = _PIECES.get(self.mode)
        self.memo = _Memo(self._chunk, {})

    def _chunk(self, chunk: str) -> bytes:
        if found := self._pieces(chunk):
            word, marks = found.groups()
            if marks:
                return self.memo[word] + self.memo[marks]
            byte_level = chunk.replace(" ", "Ġ") if chunk.isascii() else chunk.encode().decode("latin-1").translate(_ALPHABET)
            return array(self.dtype.char, [t.id for t in self._piece(byte_level)]).tobytes()
        return array(self.dtype.char, self.model.encode(chunk, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of ``dtype``."""
        out: list[bytes] = []
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= self.most_chars):
                chars += len(texts[hi])
                hi += 1
            out += self._some(texts[lo:hi])
            lo = hi
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        if self.mode == "whole":
            return [np.array(i, self.dtype).tobytes() for i in self._whole(texts)]
        if len(self.memo) > self.most:
            self.memo.older = {}
            self.memo = _Memo(self._chunk, self.memo)
        get = self.memo.__getitem__
        if self.mode == "words":
            return [b"".join(map(get, (t.lower() if "<|" not in t and _latin(t) else t).replace("\n", " ").split(" "))) for t in texts]
        out = []
        for t in texts:
            if "\x00" in t or _SPACED_UNSAFE.search(t):
                out.append(np.array(self._whole([t])[0], self.dtype).tobytes())
            else:
                # "\x00" parts the chunks; each keeps the space before it, and a line feed is its own
                out.append(b"".join(map(get, t.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00"))))
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and file; its memo lasts over tasks."""
    return Encoder(path)
