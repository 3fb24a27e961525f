"""Token ids of whole texts by the tokenizers library, with a memory of pieces.

Normaliser and splitter of these vocabularies never look across white space, so a
text is encoded piece by piece between blanks; each distinct piece is encoded once
and then looked up.
"""

from __future__ import annotations

import itertools
import os
import struct

import numpy as np

REMEMBERED = 250_000  # pieces per worker process, beside those of one call; only speed and memory depend on it
RESTING = 50_000  # and while a worker waits for its next task

# Byte-level vocabularies write each byte as one letter: printable ones as themselves, the rest from U+0100 on.
_printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _printable)}


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [t.content for t in special]
        self.mark = self.special[-1] if self.special else None
        self.mark_id = self.tokenizer.token_to_id(self.mark) if self.mark else None
        # Lower-casing first is safe only where the vocabulary does it too.
        self.lower = self._same("Ab É", "ab é")
        # A run of letters is one word for the model: no normaliser, no splitter.
        probe = ["the", "tionreheer", "q", "bleandthwhoreshti", "éêçaßü", "queñoçtionå"]
        self.direct = self.lower and all(
            _pack([t.id for t in self.tokenizer.model.tokenize(w.encode().decode("latin-1").translate(_BYTE_LETTERS))])
            == self._plain(w) for w in probe)
        self.memory: dict[str, bytes] = {"": b""}
        self.again: set[str] = set()

    def _same(self, a: str, b: str) -> bool:
        return self._plain(a) == self._plain(b)

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def pieces(self, text: str) -> list[str]:
        if self.lower:
            try:  # no combining mark and no context-dependent letter below U+0100
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [self.pieces(text) for text in texts]
        wanted = set().union(*split)
        memory = self.memory
        self.again.update(wanted.intersection(memory))
        if len(memory) > REMEMBERED:  # pieces met in several calls stay, those met once go
            keep = self.again if len(self.again) <= REMEMBERED // 2 else wanted.intersection(memory)
            memory = self.memory = {p: memory[p] for p in keep}
            self.again = set()
        missing = wanted.difference(memory)
        if missing:
            self._learn(missing)
        get = memory.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def rest(self) -> None:
        """Between tasks only pieces met in several calls are held: workers stay while other stages run."""
        if len(self.memory) > RESTING:
            self.memory = {p: self.memory[p] for p in itertools.islice(self.again.intersection(self.memory), RESTING)}
            self.again = set()

    def _learn(self, missing: set[str]) -> None:
        memory, ends, alone = self.memory, {}, set()
        for piece in missing:
            # A letter or digit before a closing stop or comma: the splitter cuts there.
            if len(piece) > 1 and piece[-1] in ".," and piece[-2].isalnum() and piece[-2].isascii():
                ends[piece] = piece[:-1]
                alone.add(piece[:-1])
                alone.add(piece[-1])
            else:
                alone.add(piece)
        plain, model = [], self.tokenizer.model
        for p in alone.difference(memory):
            if self.direct and p.isalpha() and p.islower() and max(p) < "\u0100":
                if not p.isascii():
                    p_bytes = p.encode().decode("latin-1").translate(_BYTE_LETTERS)
                    memory[p] = _pack([t.id for t in model.tokenize(p_bytes)])
                else:
                    memory[p] = _pack([t.id for t in model.tokenize(p)])
            elif self.mark is None or "<" in p or not p.strip():
                memory[p] = self._plain(p)
            else:
                plain.append(p)
        runs = [plain[i:i + 500] for i in range(0, len(plain), 500)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([self.mark.join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id) * 4
            raw = ids.tobytes()
            if len(cuts) != len(run) - 1:
                for p in run:
                    memory[p] = self._plain(p)
                continue
            begin = 0
            for p, end in zip(run, [*cuts.tolist(), len(raw)]):
                memory[p] = raw[begin:end]
                begin = end + 4
        for piece, stem in ends.items():
            memory[piece] = memory[stem] + memory[piece[-1]]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
