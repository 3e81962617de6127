"""Byte-level BPE ids of whole texts."""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import os
import re

import numpy as np

_CODECS: dict[str, object] = {}


def ranks_of(lines: bytes) -> dict[bytes, int]:
    """The content of a .tiktoken file as ranks."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}


def codec(rank_lines: bytes, pattern: str):
    """The worker's encoder of these ranks: about 1 MB, fixed, sent with each task and built once per Python worker."""
    import tiktoken

    key = hashlib.blake2b(rank_lines + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(rank_lines), special_tokens={})
    return _CODECS[key]


def ids_of(encoder, text: str | None) -> np.ndarray:
    """Ids of a whole text; strings of special tokens are ordinary text, null counts as empty."""
    return encoder.encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, np.uint32)


#: Chunks of text, and their characters, that a tokenizer's cache holds before it starts anew.
HELD, HELD_CHARS = 1 << 20, 1 << 26
#: Chunks that are encoded as one text, an added token between them.
JOINED = 512

#: Unicode's white space, as a class of a pattern.
WHITE = r" \t-\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space and what follows it: every match of the byte-level pre-tokenizer ends before white space that follows other characters.
CHUNK = re.compile(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Characters that not all libraries take for white space.
UNSURE = "\x1c\x1d\x1e\x1f\x85"


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for; `new` are those since it was last emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class ByTokenizer:
    """Ids by the tokenizers library. Each distinct chunk of text is encoded once while it is remembered, at most HELD chunks.

    Where the JSON's pre-tokenizer is the byte-level one with its own pattern and nothing else changes texts, no token crosses the
    edges of chunks, so a text's ids are those of its chunks. New chunks are encoded many at a time, with an added token between
    them: the library cuts texts at these before anything else. With any other JSON, and for texts with added tokens or
    characters of UNSURE, whole texts are encoded.
    """

    def __init__(self, tokenizer_json: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # it works in the task's own thread
        self.built, spec = Tokenizer.from_buffer(tokenizer_json), json.loads(tokenizer_json)
        before = spec.get("pre_tokenizer") or {}
        changes = spec.get("normalizer") or spec.get("truncation") or spec.get("padding") or spec["model"].get("dropout")
        self.by_chunk = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not changes
        added = spec.get("added_tokens") or ()
        self.added = [a["content"] for a in added]
        self.between = next((a for a in added if a["special"] and not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"])), None)
        self._forget()

    def _forget(self) -> None:
        self.known = Numbers()
        self.chars, self.flat, self.starts = 0, np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.built.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks' ids one after another, and how many each has."""
        if not self.between:
            each = self._encode(chunks)
            return np.array(list(itertools.chain.from_iterable(each)), np.uint32), np.array([len(x) for x in each], np.int64)
        mark = self.between["content"]
        joined = [mark.join([*chunks[k : k + JOINED], ""]) for k in range(0, len(chunks), JOINED)]
        ids = np.concatenate([np.array(x, np.uint32) for x in self._encode(joined)])
        ends = np.flatnonzero(ids == self.between["id"])
        return ids[ids != self.between["id"]], np.diff(ends, prepend=-1) - 1

    def _learn(self) -> None:
        """Ids of the chunks that were numbered since."""
        new, self.known.new = self.known.new, []
        if new:
            flat, sizes = self._encode_chunks(new)
            self.chars += sum(map(len, new))
            self.flat = np.concatenate([self.flat, flat])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; added tokens of the JSON are recognised inside them, null counts as empty."""
        texts = [t or "" for t in texts]
        out: list = [None] * len(texts)
        cut = [k for k, t in enumerate(texts) if self.by_chunk and not any(x in t for x in (*self.added, *UNSURE))]
        whole = sorted(set(range(len(texts))) - set(cut))
        for k, ids in zip(whole, self._encode([texts[k] for k in whole]), strict=True):
            out[k] = np.array(ids, np.uint32)
        if len(self.known) > HELD or self.chars > HELD_CHARS:
            self._forget()
        chunks = [CHUNK.findall(texts[k]) for k in cut]
        together = list(itertools.chain.from_iterable(chunks))
        at = np.fromiter(map(self.known.__getitem__, together), np.int64, len(together))
        self._learn()
        sizes = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(sizes.sum())]
        edges = np.concatenate([np.zeros(1, np.int64), ends])[np.cumsum([len(c) for c in chunks], dtype=np.int64)]
        for k, part in zip(cut, np.split(ids, edges[:-1]) if cut else (), strict=True):
            out[k] = part
        return out


def tokenizer(tokenizer_json: bytes) -> ByTokenizer:
    """The worker's tokenizer of this JSON, built once per Python worker."""
    key = hashlib.blake2b(tokenizer_json).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = ByTokenizer(tokenizer_json)
    return _CODECS[key]


def public_tokenizer() -> dict[str, object]:
    """The public vocabulary as a tokenizer of its JSON, as keyword argument of packing."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return {"tokenizer_json": f.read()}


def public_codec() -> dict[str, object]:
    """The public vocabulary that the registered queries use, as keyword arguments of the operators."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {"rank_lines": f.read(), "pattern": public_tokenizers.PATTERN}
