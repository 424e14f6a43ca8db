"""Token ids of whole texts, with every distinct chunk between white space encoded once.

The vocabulary drops white space and never joins text across it, nor letters with the
stop or comma after them, so the ids of a text are those of its chunks in order. It
also lower-cases, so a word of letters needs only its lower-case form to be encoded. A
worker remembers the chunks it has met, up to ``MEMO`` of them, and starts afresh
beyond that.
"""

import json
import os
import re

import numpy as np

from querylume.llm.common import remembers

MEMO = 1_500_000
CHUNK = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+(?=[ \n.,]|\Z)|[^ \t\n\r\f\v]+")
JOINED = 500
_ENCODERS = {}


class ChunkEncoder:
    """Encodes texts with a vocabulary file of the ``tokenizers`` library, as its
    ``encode(text, add_special_tokens=False)`` does."""

    def __init__(self, path, dtype="<u2", special_as_text=False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = special_as_text
        self.dtype = np.dtype(dtype)
        if self.model.get_vocab_size() > np.iinfo(self.dtype).max + 1:
            raise ValueError(f"ids of {path} do not fit {dtype}")
        self.memo = {}
        # Which ids end a word, if the vocabulary marks them.
        mark = json.loads(self.model.to_str())["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        for piece, i in self.model.get_vocab().items():
            self.ends[i] = bool(mark) and piece.endswith(mark)

    def encode(self, texts):
        """The ids of each text as little-endian bytes; null is an empty text."""
        remembers(self)
        split = [CHUNK.findall(t) if t else () for t in texts]
        get = self.memo.get
        found = [list(map(get, words)) for words in split]
        gaps = [
            [i for i, ids in enumerate(row) if ids is None] if None in row else () for row in found]
        new = {words[i] for words, row in zip(split, gaps) for i in row}
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
        self._learn(new)
        for words, row, ids in zip(split, gaps, found):
            for i in row:
                ids[i] = self.memo[words[i]]
        return list(map(b"".join, found))

    def _learn(self, chunks):
        memo, words, other = self.memo, {}, []
        for chunk in chunks:
            if chunk.isalpha():
                words[chunk] = chunk.lower() if chunk.isascii() else chunk
            else:
                other.append(chunk)
        self._ask(other)
        self._ask_words([w for w in set(words.values()) if w not in memo])
        memo.update((chunk, memo[word]) for chunk, word in words.items())

    def _ask(self, chunks):
        found = self.model.encode_batch_fast(chunks, add_special_tokens=False)
        for chunk, got in zip(chunks, found):
            self.memo[chunk] = np.array(got.ids, dtype=self.dtype).tobytes()

    def _ask_words(self, words):
        """Words of letters only: many in one text, cut where a word ends."""
        for at in range(0, len(words), JOINED):
            some = words[at:at + JOINED]
            got = self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0]
            ids = np.array(got.ids, dtype=self.dtype)
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
            if len(stops) != len(some):
                self._ask(some)
                continue
            data = ids.tobytes()
            self.memo.update(zip(some, map(data.__getitem__, map(slice, [0, *stops], stops))))


def encoder(path, dtype="<u2", special_as_text=False):
    """One encoder per worker and vocabulary."""
    key = (path, dtype, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(*key)
    return _ENCODERS[key]
