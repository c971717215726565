"""Token ids of a published vocabulary file, one encoder for each Python worker."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: The published split pattern of byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White-space characters in a row from which on tokenizers is used: the other core's time grows with their square.
RUN = 256


def _byte_letters() -> dict[str, int]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from a list of texts to a list of id sequences, without special tokens added.

    `path` is a tokenizers JSON file. A plain byte-level BPE file, whose ids are its merge ranks, is
    run by tiktoken's faster core from the same file; a text that holds one of the file's added
    tokens or `RUN` white-space characters in a row, of which a million break that core, and any
    other kind of file, goes through tokenizers. Both give the same ids.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)

    def plain(texts: list[str]) -> list:
        return [x.ids for x in _tokenizer(path).encode_batch(texts, add_special_tokens=False)]

    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    vocab = model.get("vocab", {})
    simple = model.get("type") == "BPE" and before == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": before.get("trim_offsets"), "use_regex": True}
    simple &= not any(spec.get(k) for k in ("normalizer", "truncation", "padding")) and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    simple = simple and all(vocab.get("".join(m)) == 256 + k for k, m in enumerate(merges)) and len(vocab) == 256 + len(merges)
    if not simple:
        return plain
    import tiktoken

    letters = _byte_letters()
    fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks={bytes(letters[x] for x in word): id for word, id in vocab.items()}, special_tokens={})
    added = [t["content"] for t in spec.get("added_tokens", [])]
    holds = re.compile("|".join(map(re.escape, added))) if added else None
    blank = re.compile(rf"\s{{{RUN}}}")

    def mixed(texts: list[str]) -> list:
        return [plain([t])[0] if holds and holds.search(t) or len(t) >= RUN and blank.search(t) else fast.encode_ordinary(t) for t in texts]

    return mixed


def document_ids(texts: list[str | None], path: str, end: int = 0) -> list[np.ndarray]:
    """The ids of each text, null as empty, followed by the id `end`."""
    return [np.array([*x, end], np.uint32) for x in encoder(path)([t or "" for t in texts])]
