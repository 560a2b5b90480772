"""Byte-level BPE files: vocabulary, merges, special strings and the pre-token split.

A tokenizer file is read once on the driver, as text of a checked size, and broadcast;
executors need no copy of it.
"""
from __future__ import annotations

import json
from functools import cached_property

import regex

# Fixed value: the public split pattern of byte-level BPE vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Largest tokenizer file that is broadcast.
MAX_FILE_BYTES = 64 << 20


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def load(path: str | None) -> str:
    with open(path or default_path(), encoding="utf-8") as f:
        text = f.read(MAX_FILE_BYTES + 1)
    if len(text) > MAX_FILE_BYTES:
        raise ValueError(f"{path}: larger than {MAX_FILE_BYTES} characters")
    return text


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the
    next free one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE tokenizer file (``.json``)."""

    def __init__(self, text: str):
        self.spec = json.loads(text)
        model, pre = self.spec["model"], self.spec.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError("a byte-level BPE file without prefix blanks is needed")
        if self.spec.get("normalizer"):
            raise ValueError("a file without normalizer is needed")
        self.ids: dict[str, int] = model["vocab"]
        self.merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in self.spec.get("added_tokens", [])}
        self.split = regex.compile(SPLIT).findall

    @cached_property
    def special_split(self):
        names = sorted(self.special, key=len, reverse=True)
        return regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order; a special string inside the text is one piece of its own."""
        if self.special and any(s in text for s in self.special):
            out: list[str] = []
            for part in self.special_split.split(text):
                out += [part] if part in self.special else self.split(part)
            return out
        return self.split(text)
