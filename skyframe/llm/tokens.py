"""Exact encoding of texts with a public byte-level BPE, by way of a bounded cache of chunks.

The vocabulary's pre-tokenizer starts a new piece at every single space between
two visible characters, and merges never cross pieces.  So the ids of a text
are the ids of its space-led chunks in order, and a chunk that recurs is
encoded once.  Texts in which a space meets other white space are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from ._common import process_cache

#: Chunks held for each worker process (some 40 bytes each, in Arrow arrays); others are encoded again in each batch.
CACHE = 600_000
#: Chunks that are encoded as one running text.
CHUNKS = 4096
#: How a byte-level vocabulary writes a space byte.
BYTE_SPACE = "\u0120"
#: Bytes of text that go through the encoder at once.
BATCH = 4 << 20

#: A space that meets white space, or white space other than the space and the line feed: such a text is encoded whole.
_UNUSUAL = r"  | \n|\n |[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer_json(path: str) -> str:
    """The tokenizer file's content, so that executors need no such file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _lists(ids: list[np.ndarray], ends: np.ndarray | None = None) -> pa.ListArray:
    """Lists of ids: each array a list, or the one array cut at ``ends``."""
    if ends is None:
        ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([np.empty(0, "<u4"), *ids]).view("<i4")))


class Encoder:
    """Encodes lists of texts; special tokens' strings in a text are ordinary text."""

    def __init__(self, json: str):
        self.tokenizer = Tokenizer.from_str(json)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.leads = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.leads[[i for token, i in vocabulary.items() if token.startswith(BYTE_SPACE)]] = True
        self.words = pa.array([], pa.string())
        self.ids = pa.array([], pa.list_(pa.int32()))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: pa.Array) -> list[pa.Array]:
        """The ids of space-led chunks, given without the space: encoded as running text, cut before each token that starts with one."""
        out = []
        for at in range(0, len(chunks), CHUNKS):
            own = chunks.slice(at, CHUNKS)
            running = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), " ")
            (ids,) = self._whole([" " + running[0].as_py()])
            cuts = np.flatnonzero(self.leads[ids])
            out.append(_lists([ids], np.append(cuts, len(ids))) if len(cuts) == len(own) else _lists(self._whole([" " + x for x in own.to_pylist()])))  # else: pieces don't start at spaces
        return out

    def _looked_up(self, chunks: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
        """Lists of ids, and which of them each of distinct chunks has; from the cache where it has them."""
        found = pc.index_in(chunks, value_set=self.words)
        lacking = pc.is_null(found)
        new = chunks.filter(lacking)
        fresh = self._chunks(new)
        of = found.fill_null(0).to_numpy().astype(np.int64)
        of[lacking.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
        known = [self.ids, *fresh]
        if len(new) and len(self.words) < CACHE:
            kept = pa.array(np.flatnonzero(pc.less_equal(pc.utf8_length(new), 32).to_numpy(zero_copy_only=False))[: CACHE - len(self.words)])
            self.words = pa.concat_arrays([self.words, new.take(kept)])
            self.ids = pa.concat_arrays([self.ids, pa.concat_arrays(fresh).take(kept)])
        return known, of

    def _pieces(self, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
        """Of texts: the ids of pieces, which piece each place has, and where each text's places start.

        A text's first place is what comes before its first space, or all of
        an unusual text; the others are chunks.
        """
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _UNUSUAL)
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.dictionary_encode()
        heads = lists.values.take(pa.array(starts[:-1])).to_pylist()
        if pc.any(odd).as_py():
            heads = [t if o else h for t, o, h in zip(texts.to_pylist(), odd.to_pylist(), heads, strict=True)]
        known, of = self._looked_up(words.dictionary)
        places = of[words.indices.to_numpy()]
        places[starts[:-1]] = sum(map(len, known)) + np.arange(len(heads))
        return pa.concat_arrays([*known, _lists(self._whole(heads))]), places, starts

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has; a null has none."""
        if not len(texts):
            return np.empty(0, np.int64)
        ids, places, starts = self._pieces(texts)
        return np.add.reduceat(np.diff(ids.offsets.to_numpy()).astype(np.int64)[places], starts[:-1])

    def encode(self, texts: pa.Array, end: int | None = None) -> pa.ListArray:
        """The ids of each text, followed by ``end`` if given; a null has none of its own."""
        if not len(texts):
            return pa.array([], pa.list_(pa.int32()))
        ids, places, starts = self._pieces(texts)
        if end is not None:
            places = np.insert(places, starts[1:], len(ids))
            starts = starts + np.arange(len(starts))
            ids = pa.concat_arrays([ids, pa.array([[end]], ids.type)])
        size = np.diff(ids.offsets.to_numpy())
        flat = ids.take(pa.array(places)).flatten()
        ends = np.concatenate(([0], np.cumsum(size[places])))[starts]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)


def text_slices(texts: pa.Array):
    """(start, slice): runs of texts of at most about ``BATCH`` bytes together."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        done = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, done + BATCH, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def encoder(json: str) -> Encoder:
    """This worker process's encoder for a tokenizer file's content."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
    held = process_cache()
    if held.get("tokenizer_json") != json:
        held["tokenizer_json"], held["encoder"] = json, Encoder(json)
    return held["encoder"]
