"""BPE with public vocabularies: forced-boundary splitting.

A pair of bytes that occurs inside no vocabulary token can never be merged, so the text may be cut
there and the fragments encoded independently. Tokens of these vocabularies hold white space at most
as their first byte, which makes word gaps forced cuts; further cuts inside a word come from a table
of pairs that is read off the vocabulary. Fragments recur, so a bounded table keeps their ids.

Chunks with characters above U+00FF go through the tokenizers library itself, so normalisation and
character classes of rare scripts are always its own.
"""
from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame

from pickwise.llm.common import MAX_CACHE, text_map

END = b"\xff"  # stands for the end-of-word mark; never occurs in UTF-8
_ODD = re.compile(r"[\x1c-\x1f]")
# white space as the tokenizers' patterns see it (fixed values)
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_SOLID_GAP = re.compile(r"(?<=\S) (?=\S)")
_TWO_SPACES = re.compile(r"\s\s")


def byte_chars() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: character -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A tokenizer file: ids, special strings, pairs that occur inside tokens, and fragment encoding."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.suffix = model.get("end_of_word_suffix") or ""
        chars, vocab = byte_chars(), model["vocab"]

        def raw(token: str) -> bytes:
            if self.suffix and token.endswith(self.suffix):
                return bytes(chars[c] for c in token[: -len(self.suffix)]) + END
            return bytes(chars[c] for c in token)

        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        ids = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        ids = [vocab[t] for t in ids]
        if any(x >= y for x, y in zip(ids, ids[1:])):
            raise ValueError("ids must follow the order of merges")
        ranks = {raw(t): i for t, i in vocab.items() if t not in self.special}  # a lower id merges first
        for b in range(256):
            ranks.setdefault(bytes([b]), len(self.text_of) + 1 + b)
        self.inside = {pair for b in ranks for pair in zip(b, b[1:])}
        self.one = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def encode_piece(self, word: bytes) -> list[int]:
        """Ids of one pre-token (with its end mark, if the vocabulary has one), cut at every pair no token holds."""
        inside = self.inside
        if inside.issuperset(zip(word, word[1:])):
            return self.one(word)
        cuts = [i for i in range(1, len(word)) if (word[i - 1], word[i]) not in inside]
        return [r for a, b in zip([0, *cuts], [*cuts, len(word)]) for r in self.one(word[a:b])]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _latin(chunk: str) -> bool:
    return chunk.isascii() or max(chunk) < "Ā"


# Pre-token patterns of the two vocabularies, for characters below U+0100 (fixed values).
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
WORD_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\t-\r \x85\xa0{_L}{_N}]+")
BYTE_PATTERN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\t-\r \x85\xa0{_L}{_N}]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+")


class Known(dict):
    """Codes by chunk. A solid word with one mark behind it is put together from two entries and not stored."""

    def __init__(self, chunk, join):
        super().__init__()
        self.chunk, self.join, self.marks, self.before = chunk, join, {}, {}

    def __missing__(self, key):
        last = key[-1:]
        stem = key[:-1]
        if last.isascii() and last > " " and stem.isalpha() and not last.isalpha() and _latin(stem):
            mark = self.marks.get(last)
            if mark is None:
                mark = self.marks[last] = self.chunk(last, "")
            return self.join(self[stem], mark)
        e = self.before.get(key)
        self[key] = e = self.chunk(key) if e is None else e
        return e

    def trim(self):
        """Bound the table; the entries of before stay one more round."""
        if len(self) > MAX_CACHE:
            self.before = dict(self)
            self.clear()


class WordBpe:
    """Lower-casing vocabulary with word ends: white space is dropped, so chunks stand alone."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.digits = [str(i) for i in range(max(self.v.text_of) + 1)]
        self.known = Known(self.chunk, lambda a, b: (a[0] + " " + b[0], a[1] + " " + b[1]))

    def chunk(self, chunk: str, _blank: str = "") -> tuple[str, str]:
        v = self.v
        if not _latin(chunk):
            ids = v.library.encode(chunk, add_special_tokens=False).ids
        elif chunk.isalpha():
            ids = v.encode_piece(chunk.lower().encode() + END)
        else:
            ids = [i for p in WORD_PATTERN.findall(chunk.lower()) for i in v.encode_piece(p.encode() + END)]
        digits, text_of = self.digits, v.text_of
        if len(ids) == 1:
            return digits[ids[0]], text_of[ids[0]]
        return " ".join([digits[i] for i in ids]), " ".join([text_of[i] for i in ids])

    def _parts(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        return text.split() if _ODD.search(text) is None else [c for c in _SPACE.split(text) if c]

    def encode(self, text: str | None) -> tuple[str, str]:
        """Decimal ids joined by a space, and the decoded text."""
        text = text or ""
        v, known = self.v, self.known
        if v.special_cut and "<|" in text:
            out = []
            for k, part in enumerate(v.special_cut.split(text)):
                if k % 2:
                    out.append((str(v.special[part]), part))
                else:
                    out += [self.chunk(c) for c in self._parts(part)]
        else:
            out = [known[c] for c in self._parts(text)]
            known.trim()
        return " ".join([e[0] for e in out]), " ".join([e[1] for e in out])


class ByteBpe:
    """Byte-level vocabulary: a gap of one white-space character between solid ones is a forced cut."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.known = Known(self.chunk, bytes.__add__)
        self.line_end = _packed(self.v.one(b"\n"))

    def chunk(self, key: str, blank: str = " ") -> bytes:
        """Ids of a blank and the key; a key that begins with a line end has that instead of the blank."""
        if key[:1] == "\n":
            return self.line_end + self._direct(key[1:], "")
        return self._direct(key, blank)

    def _direct(self, key: str, blank: str) -> bytes:
        v = self.v
        if key.isalpha() and _latin(key):
            ids = v.one((blank + key).encode())
        elif _latin(key) and _ODD.search(key) is None:
            ids = [i for p in BYTE_PATTERN.findall(blank + key) for i in v.one(p.encode())]
        else:
            ids = v.library.encode(blank + key, add_special_tokens=False).ids
        return _packed(ids)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if "<|" in text and self.v.special_cut and self.v.special_cut.search(text):
            return b"".join(_packed([self.v.special[p]]) if k % 2 else self._plain(p)
                            for k, p in enumerate(self.v.special_cut.split(text)) if p)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        known = self.known
        if _TWO_SPACES.search(text) is None:  # lines, then blanks; the line end before the first line is taken off again
            keys = ("\n" + text).replace("\n", " \n").split(" ")
            out = b"".join([known[c] for c in keys[1:]])[len(self.line_end):]
        else:
            keys = _SOLID_GAP.split(text)
            out = self._direct(keys[0], "") + b"".join([known[c] for c in keys[1:]])
        known.trim()
        return out


def _packed(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


@lru_cache(maxsize=4)
def coder(kind: str, path: str):
    """One coder per worker process, with its table of known chunks."""
    return {"word": WordBpe, "byte": ByteBpe}[kind](path)


def bpe_codes(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): ids as an int array and the text that decoding them gives, for every row.

    Null text counts as empty; rows that repeat give repeated rows; other columns are left out.
    """
    def rows(text):
        ids, decoded = coder("word", path).encode(text)
        yield ([int(i) for i in ids.split()], decoded)

    return text_map(docs, "ids array<int>, decoded string", rows, id_col, text_col)


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) by the same coder, without moving the ids out of the worker."""
    from hashlib import sha256

    def rows(text):
        ids, decoded = coder("word", path).encode(text)
        yield ids.count(" ") + 1 if ids else 0, sha256(ids.encode()).hexdigest(), sha256(decoded.encode()).hexdigest()

    return text_map(docs, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", rows, id_col, text_col)
