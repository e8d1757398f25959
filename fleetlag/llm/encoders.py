"""Token ids of the public vocabularies, by libraries that run inside tasks; tables are read on the workers once per process."""

import json
from itertools import count

import public_tokenizers
import sentencepiece
import tiktoken

from fleetlag.llm.op4_bpe import byte_letters

#: Fixed value: how a byte-fallback piece is written, and the letter that stands for a space.
BYTE_PIECE, SPACE_LETTER = "<0x%02X>", "▁"
_KNOWN: dict[tuple, object] = {}


class ByteBpe:
    """A byte-level BPE file of the tokenizers library. Its merges are applied by rank, and a rank is the made token's
    place among the ids, so the file's tokens serve as ranks; a file where the two orders differ is refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of_letter = {c: b for b, c in byte_letters().items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {token: i for token, i in spec["model"]["vocab"].items() if token not in special}
        made = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError(f"{path}: merges are not in the order of the ids they make")
        ranks = {bytes(of_letter[c] for c in token): i for token, i in ids.items()}
        self.bytes = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in special.items()}
        self.size = max(self.bytes) + 1
        self._special = set(special)
        self._library = tiktoken.Encoding("table", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def plain(self, text: str) -> list[int]:
        """Ids of a text in which strings of special tokens are ordinary text."""
        return self._library.encode_ordinary(text)

    def encode(self, text: str) -> list[int]:
        """Ids of a text in which strings of special tokens become those tokens."""
        if any(s in text for s in self._special):
            return self._library.encode(text, allowed_special=self._special)
        return self._library.encode_ordinary(text)


class Pieces:
    """A sentencepiece file."""

    def __init__(self, path: str):
        self._library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self._library.get_piece_size()
        fallback = {BYTE_PIECE % b: bytes([b]) for b in range(256)}
        pieces = map(self._library.id_to_piece, range(self.size))
        self.bytes = {i: fallback.get(p) or p.replace(SPACE_LETTER, " ").encode() for i, p in zip(count(), pieces)}

    def encode(self, text: str) -> list[int]:
        return self._library.encode(text, num_threads=1)


def _once(kind, path: str):
    if (kind, path) not in _KNOWN:
        _KNOWN[kind, path] = kind(path)
    return _KNOWN[kind, path]


def byte_bpe(path: str) -> ByteBpe:
    return _once(ByteBpe, path)


def pieces(path: str) -> Pieces:
    return _once(Pieces, path)
