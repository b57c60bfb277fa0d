"""Token ids of whole texts for operators whose own work begins after encoding.

A worker encodes with the tiktoken library, whose tables are made from the tokenizer's file; texts that this
library can't take (special tokens' strings, very long runs of white space) go through this package's own encoder.
"""

from __future__ import annotations

import re
from array import array

import tiktoken
from pyspark import SparkContext

from foliant.llm import bpe

#: White space that this library's pattern can't step back over.
LONG_SPACE = re.compile(r"\s{5000}")


class TextIds:
    """Texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, merges: bpe.Merges) -> None:
        self.merges, self._own = merges, None
        ranks = {raw: i for i, raw in enumerate(merges.bytes_of) if raw and i not in set(merges.special.values())}
        self.library = tiktoken.Encoding("ids", pat_str=bpe.PIECES.pattern, mergeable_ranks=ranks, special_tokens={})

    def own(self) -> bpe.Encoder:
        if self._own is None:
            self._own = bpe.Encoder(self.merges)
        return self._own

    def encode(self, texts: list[str]) -> list[bytes]:
        special, plain, out = tuple(self.merges.special), self.library.encode_ordinary, []
        for t in texts:
            odd = len(t) > 5000 and LONG_SPACE.search(t) or any(s in t for s in special)
            out.append(self.own().encode([t])[0] if odd else array("I", plain(t)).tobytes())
        return out


class Shared:
    """The tokenizer's tables as a broadcast (their size is the tokenizer file's)."""

    def __init__(self, context: SparkContext, tokenizer: str | None = None) -> None:
        merges = bpe.Merges(bpe.read_spec(tokenizer))
        # Library and file agree if merging by the lowest id is merging by the lowest rank.
        if array("I").itemsize != 4 or any(a >= b for a, b in zip(merges.merged.tolist(), merges.merged.tolist()[1:], strict=False)):
            raise ValueError("the tokenizer's merges are not in the order of their ids")
        self.broadcast, self.n_ids = context.broadcast(merges), len(merges.bytes_of)


_made: list = []


def worker_ids(shared: Shared) -> TextIds:
    """This worker's encoder; the last one is kept."""
    merges = shared.broadcast.value
    if not _made or _made[0].merges is not merges:
        _made[:] = [TextIds(merges)]
    return _made[0]


def forget_ids() -> None:
    """Free this worker's encoder, in a stage that needs none."""
    _made.clear()
