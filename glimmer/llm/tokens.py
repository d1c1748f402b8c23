"""Operator 9, token counts: offset-mapped attribution; and the tokenizer that operators 9 and 10 share.

A whole text is encoded once, with the public byte-level BPE. Its vocabulary comes in two forms, for the library
`tokenizers` and as ranks for `tiktoken`, with the same ids; texts of Latin letters, where both
split alike (tests compare them), are encoded by the faster one, all others by `tokenizers`. Every id stands for a
fixed number of bytes, so that the ids alone give each token's span of bytes and, with the text, of characters.
The string of an added token of the file (`<|endoftext|>`) has that token's id wherever it stands in a text, as the
library does by default; such texts are left to `tokenizers`.

Tokens' character spans are then joined to sections (the lines of a text, or any spans the caller gives) as
intervals. A token that crosses a boundary is allocated by an explicit rule:
"start" (the default): to the section that holds its first character; "end": the one that holds its last;
"longest": the one that holds most of its characters, the earlier on a tie.

A section's characters run from its start up to the next section's start; a line's newline belongs to the line
it ends. Several byte-level tokens may share one character; each is placed by that character.

Defined results: a null or empty text has no tokens and one empty section; repeated rows are counted each on
their own; an empty table gives no rows; a null id is kept; other columns are left out.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm import shared

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
RULES = ("start", "end", "longest")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def files(path: str | None, ranks_path: str | None) -> tuple[str, str | None]:
    """The files given, or else the public ones."""
    return (path, ranks_path) if path else (tokenizer_path(TOKENIZER), tokenizer_path(RANKS))


@dataclass(frozen=True)
class Encoded:
    """ids of several texts' tokens; edges[i]:edges[i + 1] are those of text i."""

    ids: np.ndarray
    edges: np.ndarray


class Encoder:
    """Encodes whole texts as the file says, without tokens that its post-processor would add."""

    def __init__(self, path: str, ranks_path: str | None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        #: What only `tokenizers` encodes: letters beyond Latin, and strings of added tokens.
        self.other = re.compile("|".join(["[^\\x00-\\u024F]", *map(re.escape, added.values())]))
        self.quick = None
        if ranks_path:
            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # in byte-level BPE a letter of a token is a byte
            self.n_bytes[i] = len(added[i].encode()) if i in added else len(token)

    def encode(self, texts: list[str]) -> Encoded:
        out: list = [None] * len(texts)
        slow = []
        for i, text in enumerate(texts):
            if self.quick is None or self.other.search(text):
                slow.append(i)
            else:
                out[i] = self.quick.encode_to_numpy(text, disallowed_special=())
        if slow:
            for i, got in zip(slow, self.tokenizer.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)):
                out[i] = np.array(got.ids, np.uint32)
        edges = np.cumsum([0, *map(len, out)])
        return Encoded(np.concatenate([np.zeros(0, np.uint32), *out]), edges)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the past-last character of each token of a text."""
        last = np.cumsum(self.n_bytes[ids])
        data = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        return character[last - self.n_bytes[ids]], character[last - 1] + 1


_LIVE: dict[tuple, Encoder] = {}


def encoder_for(path: str, ranks_path: str | None) -> Encoder:
    """One encoder for a Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, ranks_path) not in _LIVE:
        _LIVE[path, ranks_path] = Encoder(path, ranks_path)
    return _LIVE[path, ranks_path]


def line_starts(text: str) -> np.ndarray:
    """Where each line begins; a newline ends its line, and nothing begins after the last character."""
    at = [0]
    i = text.find("\n")
    while i >= 0 and i + 1 < len(text):
        at.append(i + 1)
        i = text.find("\n", i + 1)
    return np.array(at, np.int64)


def attributed(starts: np.ndarray, first: np.ndarray, past: np.ndarray, rule: str) -> np.ndarray:
    """The section (by ascending starts) of each token."""
    a = np.searchsorted(starts, first, "right") - 1
    if rule == "start":
        return a
    b = np.searchsorted(starts, np.maximum(past - 1, first), "right") - 1
    if rule == "end":
        return b
    out = a.copy()
    for i in np.flatnonzero(a != b):
        cuts = np.r_[first[i], starts[a[i] + 1 : b[i] + 1], past[i]]
        out[i] = a[i] + int(np.argmax(np.diff(cuts)))
    return out


def _counted(path: str, ranks_path: str | None, rule: str, sections: Callable[[str], np.ndarray]):
    names = ["id", "section", "start_char", "n_chars", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path, ranks_path)
        for batch in batches:
            for part in shared.portions(batch, "text", 1 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                row, number, begin, chars, tokens, crossing = [], [], [], [], [], []
                got = encoder.encode(texts)
                for i, text in enumerate(texts):
                    starts, own = sections(text), got.ids[got.edges[i] : got.edges[i + 1]]
                    first, past = encoder.spans(text, own)
                    own = attributed(starts, first, past, rule)
                    crosses = np.searchsorted(starts, np.maximum(past - 1, first), "right") - 1 > np.searchsorted(starts, first, "right") - 1
                    row.append(np.full(len(starts), i))
                    number.append(np.arange(len(starts)))
                    begin.append(starts)
                    chars.append(np.diff(np.r_[starts, len(text)]))
                    tokens.append(np.bincount(own, minlength=len(starts)))
                    crossing.append(np.bincount(own[crosses], minlength=len(starts)))
                whole = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (row, number, begin, chars, tokens, crossing)]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(whole[0])), *map(pa.array, whole[1:])], names)

    return run


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, ranks_path: str | None = None, rule: str = "start", sections: Callable[[str], np.ndarray] = line_starts) -> DataFrame:
    """(id, section, start_char, n_chars, n_tokens, n_crossing) for every section of every text.

    path and ranks_path: the tokenizer's files; with neither the public ones, with path alone no ranks are used.
    n_crossing: tokens of the section that hold characters of a later one as well.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path, ranks_path = files(path, ranks_path)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    done = rows.mapInArrow(_counted(path, ranks_path, rule, sections), f"id {kind}, section bigint, start_char bigint, n_chars bigint, n_tokens bigint, n_crossing bigint")
    return done.withColumnRenamed("id", id_col)
