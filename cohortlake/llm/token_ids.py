"""Token ids of whole texts by the tokenizers library, part by part with a memory.

Both public vocabularies split a text at white space before any merge, so that the
ids of a text are the ids of its parts in a row. A Python worker encodes a part it has
not met yet by the library, many in one call, and remembers the bytes of its ids.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Sequence

import numpy as np

from cohortlake.llm.common import worker_cache
from cohortlake.llm.textarrays import runs

# Remembered parts, about 120 MB; beyond it, and between tasks, only short ones,
# which are the frequent ones, stay.
MEMORY_PARTS = 600_000
SHORT_CHARS = 8
# Longer parts, whole texts among them, are not remembered.
PART_CHARS = 64
CALL_PARTS = 1000
CALL_CHARS = 2_000_000


def _classes() -> bytes:
    """For each Latin-1 character: letter or digit, white space, comma or full stop, or other."""
    kinds = []
    for number in range(256):
        char = chr(number)
        kinds.append("M" if char in ",." else "L" if char.isalnum() else "S" if char.isspace() else "P")
    return "".join(kinds).encode()


class TextEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    ``spaces_count`` tells whether white space is part of the tokens (byte-level
    vocabularies) or only separates words. Where it counts, a text is cut before
    single blanks and line feeds alone; one with other, doubled or outer white
    space is encoded as a whole.
    """

    def __init__(self, path: str, spaces_count: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaces_count = spaces_count
        self.memory: dict[str, bytes] = {}
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(names.values()) + 1, dtype=bool)
        for name, number in names.items():
            self.edge[number] = name.startswith("Ġ") if spaces_count else name.endswith("</w>")
        self.classes = _classes()

    def _whole(self, texts: Sequence[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(list(texts), add_special_tokens=False)
        return [np.asarray(one.ids, dtype="<u4").tobytes() for one in found]

    def _together(self, parts: list[str]) -> list[bytes]:
        """Parts of which each has its one edge token: many in a call, then cut at the edges."""
        glue = "" if self.spaces_count else " "
        calls = [parts[i : i + CALL_PARTS] for i in range(0, len(parts), CALL_PARTS)]
        out: list[bytes] = []
        encoded = self.tokenizer.encode_batch_fast([glue.join(call) for call in calls], add_special_tokens=False)
        for call, one in zip(calls, encoded, strict=True):
            ids = np.asarray(one.ids, dtype="<u4")
            edges = np.flatnonzero(self.edge[ids]) + (0 if self.spaces_count else 1)
            if len(edges) != len(call):
                out.extend(self._whole(call))
                continue
            cuts = (np.append(edges, len(ids)) if self.spaces_count else np.insert(edges, 0, 0)) * 4
            raw = ids.tobytes()
            out.extend([raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
        return out

    def _parts(self, text: str) -> list[str]:
        if self.spaces_count:
            words = text.split()
            gaps = text.count(" ") + text.count("\n")
            if len(words) != gaps + 1 or len("".join(words)) != len(text) - gaps or "\x00" in text:
                return [text]
        try:
            kinds = text.encode("latin-1").translate(self.classes)
        except UnicodeEncodeError:
            kinds = b"PM"
        else:
            if not self.spaces_count:
                # no letter of these changes but by itself, so it may be done for all at once
                text = text.lower()
        # a mark behind a letter or digit begins a part
        apart = b"PM" not in kinds and b"MM" not in kinds
        if self.spaces_count:
            if apart and b"SM" not in kinds:
                text = text.replace(",", "\x00,").replace(".", "\x00.")
            return text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")
        if apart:
            text = text.replace(",", " ,").replace(".", " .")
        return text.replace("\n", " ").split(" ")

    def _learn(self, fresh: set[str]) -> dict[str, bytes]:
        """Put new parts into the memory; returns those too long for it."""
        memory = self.memory
        if self.spaces_count:
            plain = [part for part in fresh if part[1:].isalpha() and part[0] == " " and len(part) <= PART_CHARS]
        else:
            plain = [part for part in fresh if part.isalpha() and len(part) <= PART_CHARS]
        memory.update(zip(plain, self._together(plain), strict=True))
        single = list(fresh.difference(plain))
        passing: dict[str, bytes] = {}
        for part, ids in zip(single, self._whole(single), strict=True):
            (memory if len(part) <= PART_CHARS else passing)[part] = ids
        return passing

    def forget(self) -> None:
        """Keep short parts only."""
        self.memory = {part: ids for part, ids in self.memory.items() if len(part) <= SHORT_CHARS}

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The bytes of the ids of each text."""
        # the memory holds nothing that refers to anything else: no cycles to look for
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: Sequence[str]) -> list[bytes]:
        out: list[bytes] = []
        for _, some in runs(texts, CALL_CHARS):
            split = [self._parts(text) for text in some]
            if len(self.memory) > MEMORY_PARTS:
                self.forget()
            passing = self._learn(set().union(*split).difference(self.memory))
            if passing:
                known = self.memory
                out.extend([b"".join([known[p] if p in known else passing[p] for p in parts]) for parts in split])
            else:
                look = self.memory.__getitem__
                out.extend([b"".join(map(look, parts)) for parts in split])
        return out


def text_encoder(path: str, spaces_count: bool) -> TextEncoder:
    """The worker's encoder for a vocabulary."""
    cache, name = worker_cache(), f"encoder {spaces_count} {path}"
    if name not in cache:
        cache[name] = TextEncoder(path, spaces_count)
    return cache[name]
