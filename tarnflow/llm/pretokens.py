"""Encoding by distinct white-space pre-tokens.

The vocabulary's pre-tokenizer never lets a piece cross white space, so the ids of a text
are the ids of its white-space separated chunks, one after the other; it also parts letters from the
punctuation behind them and ignores case. Each worker process keeps what it has encoded, so a distinct
pre-token is encoded once and later looked up. Only ASCII white space splits; rarer white space
stays inside a chunk and is left to the library.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from .common import kept, tokenizer_path

#: Pre-tokens of up to LONGEST bytes that a worker process remembers; beyond it the memory starts anew. Results don't depend on it.
REMEMBERED, LONGEST = 1_500_000, 64
PUNCTUATION = b"!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"
#: Words that are handed to the library as one text.
TOGETHER = 50
#: Bytes of text whose chunks are looked up at once.
BLOCK = 4_000_000


def chunks_of(text: bytes) -> list[bytes]:
    """White-space separated chunks; lower-cased unless a special token could be inside, or marks that letters compose with.

    The library composes first, and what a capital composes to may differ from what its small letter does.
    """
    return (text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()).split()


def _letters(text: str) -> bool:
    """Whether the library surely takes `text` for one run of letters: it composes and lower-cases before it looks.

    Letters of later scripts are left out, as releases of Unicode differ about them.
    """
    return text.isalpha() and max(text) < "\u0530" and unicodedata.normalize("NFC", text).lower().isalpha()


class ChunkEncoder:
    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path(tokenizer))
        self.library.no_truncation()
        self.library.no_padding()
        self.ids: dict[bytes, bytes] = {}
        self.passing: list[bytes] = []

    def _words(self, words: list[bytes]):
        """Words of letters only with their ids: each is one pre-token, so many go into one text."""
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            e = self.library.encode(b" ".join(part).decode(), add_special_tokens=False)
            ids, of = np.asarray(e.ids, dtype="<u4"), np.asarray(e.word_ids, dtype=np.int64)
            cuts = np.searchsorted(of, np.arange(len(part) + 1)).tolist()
            if cuts[-1] != len(ids) or of[-1] != len(part) - 1:  # not one pre-token each after all
                for w in part:
                    yield w, np.asarray(self.library.encode(w.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
                continue
            raw = ids.tobytes()
            for k, w in enumerate(part):
                yield w, raw[4 * cuts[k] : 4 * cuts[k + 1]]

    def learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """A table with the ids of each chunk as little-endian unsigned 32-bit integers; it holds until the next call."""
        known = self.ids
        for c in self.passing:
            known.pop(c, None)
        if len(known) > REMEMBERED:
            known.clear()
        new = list(chunks.difference(known))
        self.passing = [c for c in new if len(c) > LONGEST]
        # lists side by side instead of tuples, which the collector would walk over again and again
        apart: list[bytes] = []
        cores: list[bytes] = []
        tails: list[bytes] = []
        words: set[bytes] = set()
        other: set[bytes] = set()
        for c, core in zip(new, [c.rstrip(PUNCTUATION) for c in new], strict=True):
            if not core.isalpha() and not _letters(core.decode("utf-8", "replace")):  # not ASCII letters, nor others
                other.add(c)
                continue
            words.add(core)
            if len(core) < len(c):
                apart.append(c)
                cores.append(core)
                tails.append(c[len(core) :])
        known.update(self._words(list(words.difference(known))))
        other.update(tails)
        rest = list(other.difference(known))
        for at in range(0, len(rest), 1000):
            part = rest[at : at + 1000]
            for c, e in zip(part, self.library.encode_batch_fast([c.decode("utf-8", "replace") for c in part], add_special_tokens=False), strict=True):
                known[c] = np.asarray(e.ids, dtype="<u4").tobytes()
        for c, core, tail in zip(apart, cores, tails, strict=True):
            known[c] = known[core] + known[tail]
        return known


def encoder(tokenizer: str) -> ChunkEncoder:
    """This process's encoder for a tokenizer file."""
    return kept(f"tokenizer {tokenizer}", lambda: ChunkEncoder(tokenizer))


def encoded(texts, tokenizer: str):
    """Id bytes of each text (null: none), in blocks of BLOCK bytes of text so that memory stays bounded."""
    own = encoder(tokenizer)
    block: list[list[bytes]] = []
    held = 0

    def flush():
        ids = own.learn(set().union(*block)) if block else {}
        for chunks in block:
            yield b"".join(map(ids.__getitem__, chunks))

    for text in texts:
        block.append(chunks_of(text or b""))
        held += len(text or b"")
        if held > BLOCK:
            yield from flush()
            block, held = [], 0
    yield from flush()
