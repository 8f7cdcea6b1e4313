"""Token ids by the tokenizers library, with a bounded memo of what chunks of text encode to.

The two BPE vocabularies cut a text at white space, and letters from punctuation, before any merge; so a text's
ids are those of its chunks in order: words, the marks after them, and what else stands between spaces. Each
distinct chunk is encoded once per worker by the library. Texts in which that could fail
(special-token strings, unusual spaces, control characters or scripts) are encoded whole.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np

from timberline.llm.common import for_worker

#: Chunks in one generation of a worker's memo; when it is full, it becomes the old generation.
MEMO_CHUNKS = 400_000
#: Longer chunks are encoded each time rather than held.
MEMO_CHUNK_CHARS = 64
#: Chunks that the library gets at once, joined by the separator.
JOINED = 20_000

#: Characters whose role as white space, or in normalisation across a chunk's edge, could differ between libraries:
#: all but printable ASCII, tab, newline, carriage return, letters of Latin, Greek and Cyrillic, and common punctuation.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-ʯͰ-҂Ҋ-ԯ‐-‧‰-⁞₠-₿]")
#: The bytes of Latin-1 that are not unusual, for a quick test of most texts.
_PLAIN = bytes(c for c in range(256) if not _UNUSUAL.match(chr(c)))
#: White space that is not a single space or newline between other characters.
_UNEVEN = ("  ", "\n\n", " \n", "\n ", "\t", "\r")
_LETTERS = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: A mark between a letter and a space is a token by itself.
_MARK = re.compile(rf"[.,;:!?](?<={_LETTERS.pattern[:-1]}.)(?=[ \n]|\Z)")
#: A key that is letters, with or without the sign that no space precedes them.
_WORD = re.compile(f"(\r?)({_LETTERS.pattern})")
#: Keys of chunks with no space before them begin with this.
_BARE = "\r"


def _byte_letters() -> str:
    """The letter by which a byte-level vocabulary writes each byte: printable bytes as they are, the others from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in kept else next(others)) for b in range(256))


_BYTE_LETTERS = _byte_letters()


class ChunkEncoder:
    """Encodes texts with the tokenizer in ``path``; ``special`` strings in a text keep their special ids."""

    def __init__(self, path: str, memo_chunks: int = MEMO_CHUNKS):
        import os

        self.memo_chunks = memo_chunks

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        # With a byte-level BPE a space belongs to the word after it; with word ends white space vanishes.
        self.keeps_space = len(self._plain("a  b")) > len(self._plain("a b"))
        self.uneven = re.compile(r" ?[^ \t\n\r]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+").findall
        self.separator, self.separator_id = ("\n", self._plain("\n")[0]) if self.keeps_space else self._rare()
        self.lowers = self._plain("A") == self._plain("a")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _rare(self) -> tuple[str, int]:
        """A symbol that is a token by itself, between spaces; chunks that hold it are encoded alone."""
        for code in range(0x2190, 0x2800):
            mark = chr(code)
            ids = self._plain(f"a {mark} a")
            if unicodedata.category(mark)[0] == "S" and unicodedata.normalize("NFC", mark) == mark and len(ids) == 3:
                return f" {mark} ", ids[1]
        raise ValueError("no symbol is a single token")

    def _keys(self, text: str) -> list[str] | None:
        """The text's chunks by their memo keys; None if it must be encoded whole."""
        try:
            plain, latin = not text.encode("latin-1").translate(None, _PLAIN), True
        except UnicodeEncodeError:
            plain, latin = not _UNUSUAL.search(text), False
        if not plain or any(s in text for s in self.special):
            return None
        if not self.keeps_space:
            return _MARK.sub(r" \g<0>", text.lower() if self.lowers and latin else text).split()
        if text[-1:] in (" ", "\n") or any(s in text for s in _UNEVEN):
            return [c[1:] if c[0] == " " and len(c) > 1 and c[1] not in " \t\n\r" else _BARE + c for c in self.uneven(text)]
        # A space belongs to the chunk after it, whose key leaves it out; a newline is a chunk by itself.
        keys = _MARK.sub(" \r\\g<0>", text).replace("\n", " \n \r").split(" ")
        if keys[0]:
            keys[0] = _BARE + keys[0]
        else:
            del keys[0]
        return keys

    def _form(self, key: str) -> str:
        """The text of a key."""
        if not self.keeps_space:
            return key
        return key[1:] if key[0] == _BARE else key if key[0] == "\n" else " " + key

    def _joined(self, keys: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each key with what the library makes of its text; the texts go to the library joined to long ones."""
        joinable = []
        for key in keys:
            form = self._form(key)
            if (self.separator.strip() or "\n") in form or form.isspace():
                yield key, self._bytes(self._plain(form))
            else:
                joinable.append(key)
        for at in range(0, len(joinable), JOINED):
            part = joinable[at : at + JOINED]
            ids = np.array(self._plain(self.separator.join(["", *map(self._form, part), ""])), self.dtype)
            cuts = np.flatnonzero(ids == self.separator_id)
            if len(cuts) == len(part) + 1:
                raw, size = ids.tobytes(), self.dtype.itemsize
                edges = (cuts * size).tolist()
                yield from ((c, raw[a + size : b]) for c, a, b in zip(part, edges, edges[1:], strict=False))
            else:
                yield from ((c, self._bytes(self._plain(self._form(c)))) for c in part)

    def _learn(self, missing: set[str]) -> None:
        """Puts the ids of all the keys into the young generation; words go to the library's model itself."""
        young, old = self.young, self.old
        if old:
            again = missing & old.keys()
            young.update((c, old[c]) for c in again)
            missing = missing - again
        word_of, tokenize, code, others = _WORD.fullmatch, self.model.tokenize, self.code, []
        space = _BYTE_LETTERS[32] if self.keeps_space else ""
        for key in missing:
            if m := word_of(key):
                bare, word = m.groups()
                word = word.lower() if self.lowers else word
                word = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
                young[key] = array(code, [t.id for t in tokenize(word if bare else space + word)]).tobytes()
            else:
                others.append(key)
        young.update(self._joined(others))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as an array of ``dtype``."""
        if len(self.young) > self.memo_chunks:
            self.old, self.young = self.young, {}
        keys = [self._keys(t) for t in texts]
        wanted = set().union(*(k for k in keys if k))
        missing = wanted.difference(self.young)
        if missing:
            self._learn(missing)
        ids_of, dtype = self.young.__getitem__, self.dtype
        out = [np.array(self._plain(t), dtype) if k is None else np.frombuffer(b"".join(map(ids_of, k)), dtype) for t, k in zip(texts, keys, strict=True)]
        for c in missing:
            if len(c) > MEMO_CHUNK_CHARS:
                del self.young[c]
        return out


def encoder(path: str, memo_chunks: int = MEMO_CHUNKS) -> ChunkEncoder:
    """This worker's encoder for a tokenizer file.

    Encoding makes many short-lived lists and no cycles, so the worker collects garbage less often from here on.
    """
    gc.set_threshold(200_000)
    return for_worker(("tokens", path), lambda: ChunkEncoder(path, memo_chunks))
