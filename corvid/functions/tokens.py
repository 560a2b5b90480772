"""Token ids, label masks and padding as Column expressions.

The built-in encoder is a *hashed-vocabulary* word-piece encoder: text is cut
into pieces by one regular expression (special tokens stay whole), and each
piece maps to ``md5(piece) mod base_vocab``.  It needs no vocabulary table,
so nothing is broadcast and nothing grows with the data; a real tokenizer is
plugged in through :func:`corvid.functions.udfs.tokenizer_udf`.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chat import ASSISTANT_MARKER, ENDOFTEXT, IM_END, IM_START

IGNORE_INDEX = -100

# Piece pattern of the built-in encoder: special tokens, words with one blank
# before them, runs of blanks, single other characters.  No character is lost.
PIECE_PATTERN = r"<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>| ?[\p{L}\p{N}_]+| +|[^\p{L}\p{N}_ ]"


@dataclass(frozen=True)
class HashVocab:
    """Vocabulary layout of the built-in encoder.

    Ordinary pieces hash into ``[0, base_vocab)``; special tokens sit just
    above it and the full tokenizer length may be larger still (the label
    clamp uses the full length so special ids survive).
    Fixed values: Qwen2.5 layout — 151643 base ids, <|endoftext|> 151643,
    <|im_start|> 151644, <|im_end|> 151645, full length 151665.
    """
    base_vocab: int = 151643
    endoftext_id: int = 151643
    im_start_id: int = 151644
    im_end_id: int = 151645
    full_length: int = 151665

    @property
    def pad_id(self) -> int:
        return self.im_end_id          # pad = eos when the tokenizer has none

    @property
    def eos_id(self) -> int:
        return self.im_end_id


DEFAULT_VOCAB = HashVocab()


def piece_id(p: Column, vocab: HashVocab = DEFAULT_VOCAB) -> Column:
    h = F.conv(F.substring(F.md5(p), 1, 8), 16, 10).cast("bigint") % F.lit(vocab.base_vocab)
    return (F.when(p == IM_START, vocab.im_start_id)
            .when(p == IM_END, vocab.im_end_id)
            .when(p == ENDOFTEXT, vocab.endoftext_id)
            .otherwise(h)).cast("int")


def pieces_of(text: Column) -> Column:
    """The pieces of a text, in order."""
    return F.regexp_extract_all(text, F.lit(PIECE_PATTERN), 0)


def encode(text: Column, vocab: HashVocab = DEFAULT_VOCAB) -> Column:
    """Text -> ARRAY<INT> with the built-in hashed encoder (P3, untruncated)."""
    return F.transform(pieces_of(text), lambda p: piece_id(p, vocab))


def encode_py(text: str, vocab: HashVocab = DEFAULT_VOCAB) -> list[int]:
    """Driver-side encoding of a short constant (e.g. the assistant marker).

    Same rule as :func:`encode`; used so constants are literals in the plan
    instead of being re-encoded inside every lambda call.
    """
    import hashlib

    import regex

    special = {"<|im_start|>": vocab.im_start_id, "<|im_end|>": vocab.im_end_id,
               "<|endoftext|>": vocab.endoftext_id}
    out = []
    for p in regex.findall(PIECE_PATTERN, text):
        out.append(special[p] if p in special else int(hashlib.md5(p.encode()).hexdigest()[:8], 16) % vocab.base_vocab)
    return out


@dataclass(frozen=True)
class Encoder:
    """All that the corpus build needs of one tokenizer: the ids of a text, the ids of the
    assistant marker, the full vocabulary length (bound of the label clamp), the pad id."""
    ids: Callable[[Column], Column]
    marker_ids: tuple[int, ...]
    full_length: int
    pad_id: int

    @property
    def marker(self) -> Column:
        return F.array(*[F.lit(i) for i in self.marker_ids])


def hash_encoder(vocab: HashVocab = DEFAULT_VOCAB) -> Encoder:
    """The built-in encoder."""
    return Encoder(lambda text: encode(text, vocab), tuple(encode_py(ASSISTANT_MARKER, vocab)), vocab.full_length, vocab.pad_id)


def encode_literal(text: str, vocab: HashVocab = DEFAULT_VOCAB) -> Column:
    return F.array(*[F.lit(i) for i in encode_py(text, vocab)])


def marker_position(ids: Column, marker: Column) -> Column:
    """1-based start of the first occurrence of ``marker`` inside ``ids`` (NULL if absent).

    ``sequence(1, 0)`` is ``[1, 0]`` in Spark, so short arrays are guarded first.
    """
    k = F.size(marker)
    n = F.size(ids)
    first = F.try_element_at(marker, F.lit(1))
    hits = F.filter(F.sequence(F.lit(1), n - k + 1),
                    lambda i: (F.try_element_at(ids, i) == first) & (F.slice(ids, i, k) == marker))
    return F.when((k > 0) & (n >= k), F.try_element_at(hits, F.lit(1)))


def assistant_labels(ids: Column, marker: Column | None = None,
                     vocab: HashVocab = DEFAULT_VOCAB) -> Column:
    """P5: -100 up to and including the first assistant marker, ids after it.

    Everything after the first marker is a label, later user turns included;
    no marker -> every position is -100.
    """
    if marker is None:
        marker = encode_literal(ASSISTANT_MARKER, vocab)
    pos = marker_position(ids, marker)
    n = F.size(ids)
    start = F.least(pos + F.size(marker) - 1, n)          # number of masked positions
    # no lambda refers to ``pos``: the search runs once per row, not once per element
    return F.when(pos.isNull(), F.array_repeat(F.lit(IGNORE_INDEX), n)).otherwise(
        F.concat(F.array_repeat(F.lit(IGNORE_INDEX), start), F.slice(ids, start + 1, n - start)))


def clamp_labels(labels: Column, vocab_size: int | Column) -> Column:
    """Labels outside ``[0, vocab_size)`` other than -100 become -100."""
    v = F.lit(vocab_size) if isinstance(vocab_size, int) else vocab_size
    return F.transform(labels, lambda l: F.when((l == IGNORE_INDEX) | ((l >= 0) & (l < v)), l)
                       .otherwise(F.lit(IGNORE_INDEX)))


def has_label(labels: Column) -> Column:
    """At least one label is not -100."""
    return F.exists(labels, lambda l: l != IGNORE_INDEX)


def n_label_tokens(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda l: l != IGNORE_INDEX))


def pad_right(arr: Column, target_len: Column, value) -> Column:
    fill = F.array_repeat(F.lit(value), F.greatest(target_len - F.size(arr), F.lit(0)))
    return F.concat(arr, fill)


def pad_left(arr: Column, target_len: Column, value) -> Column:
    fill = F.array_repeat(F.lit(value), F.greatest(target_len - F.size(arr), F.lit(0)))
    return F.concat(fill, arr)


def round_up(n: Column, multiple: int) -> Column:
    return (F.ceil(n / F.lit(multiple)) * F.lit(multiple)).cast("int")
