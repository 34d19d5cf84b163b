"""Token ids of whole texts by way of pieces between blanks, each of which is encoded once and remembered.

A single space or line feed between two other characters always ends a pre-token of the byte-level pattern (the
space goes to the next one), so a text may be cut there and its pieces encoded alone. Texts with any other blanks
are cut only at single spaces between non-blanks. Ids are held as little-endian 16-bit values, so that a text's
ids are the joined bytes of its pieces.

Many texts are cut and joined together in Arrow, where each distinct piece of theirs is looked up once.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Pieces that a Python worker remembers at most: about 20 MB of plain texts and, if there are any, 100 MB of others. It has no effect on results.
REMEMBERED = 500_000
#: Bytes of text whose pieces are looked up together.
TOGETHER_BYTES = 1 << 23
#: Pieces that are given to the library in one string.
TOGETHER = 5_000


def plain(text: str) -> bool:
    """Whether no character but spaces and line feeds is blank (other blanks are not printable), and each stands alone between two others."""
    return text.replace("\n", "").isprintable() and not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n")


def cut(text: str) -> list[str]:
    """Pieces of a text: the first as it is; one that starts with a line feed as it is; before any other stands a space."""
    if plain(text):
        return text.replace("\n", " \n").split(" ")
    first, *rest = _SINGLE_SPACE.split(text)
    return [first, *rest]


class Pieces(dict):
    """piece -> ids as bytes; encode maps a string to its ids as bytes, encode_all strings without blanks, each behind a space or line feed, to theirs.

    The dictionary serves texts that are not plain; pieces of plain texts are remembered in Arrow, without a Python object for each.
    """

    def __init__(self, encode: Callable[[str], bytes], most: int = REMEMBERED, encode_all: Callable[[list[str]], pa.Array] | None = None):
        self.encode, self.most = encode, most
        self.encode_all = encode_all or (lambda pieces: pa.array(map(encode, pieces), pa.large_binary()))
        self.pieces, self.their_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.uses = np.zeros(0, np.int64)

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece if piece[0] == "\n" else " " + piece)
        if len(self) < self.most:
            self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = cut(text)
        head = self.encode(first) if first else b""
        return head + b"".join(map(self.__getitem__, rest)) if rest else head

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """ids() of each text. Each distinct piece of the plain ones among them is looked up once."""
        out = [b""] * len(texts)
        at = []
        for i, t in enumerate(texts):
            if t and plain(t):
                at.append(i)
            elif t:
                out[i] = self.ids(t)
        if at:
            # a first piece is marked by a character that no plain text holds
            lists = pc.split_pattern(pa.array(["\0" + texts[i].replace("\n", " \n") for i in at], pa.large_string()), " ")
            words = lists.flatten().dictionary_encode()
            counts = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            joined = self._looked_up(words.dictionary, counts).take(words.indices)
            body = memoryview(joined.buffers()[2] or b"")
            bounds = np.frombuffer(joined.buffers()[1], np.int64)[lists.offsets.to_numpy()].tolist()
            for i, a, b in zip(at, bounds, bounds[1:], strict=False):
                out[i] = bytes(body[a:b])
        return out

    def _looked_up(self, pieces: pa.Array, counts: np.ndarray) -> pa.Array:
        """Ids of distinct pieces that occur so often; new ones are remembered, and if that makes too many, the half of most uses stays."""
        found = pc.index_in(pieces, value_set=self.pieces)
        hit = found.is_valid().to_numpy(zero_copy_only=False)
        self.uses[found.drop_null().to_numpy()] += counts[hit]
        first = pc.starts_with(pieces, "\0").to_numpy(zero_copy_only=False)
        firsts, news = np.flatnonzero(first), np.flatnonzero(~hit & ~first)
        new = pieces.take(pa.array(news))
        new_ids = self.encode_all([p if p[0] == "\n" else " " + p for p in _strings(new)])
        first_ids = pa.array([self.encode(p[1:]) for p in pieces.take(pa.array(firsts)).to_pylist()], pa.large_binary())
        place = np.empty(len(pieces), np.int64)
        place[hit] = found.drop_null().to_numpy()
        place[news] = len(self.pieces) + np.arange(len(news))
        place[firsts] = len(self.pieces) + len(news) + np.arange(len(firsts))
        ids = pa.concat_arrays([self.their_ids, new_ids, first_ids])
        self.pieces, self.their_ids = pa.concat_arrays([self.pieces, new]), ids[: len(ids) - len(firsts)]
        self.uses = np.concatenate([self.uses, counts[news]])
        if len(self.uses) > self.most:
            stay = pa.array(np.sort(np.argpartition(-self.uses, self.most // 2)[: self.most // 2]))
            self.pieces, self.their_ids, self.uses = self.pieces.take(stay), self.their_ids.take(stay), self.uses[stay.to_numpy()] // 2
        return ids.take(pa.array(place))


def _strings(words: pa.Array) -> list[str]:
    """Strings that hold no space, as a list; in one piece, as single ones take Arrow a while."""
    if not len(words):
        return []
    _, ends, body = pc.binary_join_element_wise(words, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())).buffers()
    return str(memoryview(body)[: np.frombuffer(ends, np.int64)[len(words)]], "utf-8").split(" ")[:-1]


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letter[b] for b in range(256)]


def library_pieces(path: str) -> Pieces:
    """Pieces encoded by the tokenizers library, one for each Python worker and file.

    A piece that holds an added token goes to the whole tokenizer; any other to the library's pre-tokenizer and BPE
    model, which give the same ids without building offsets. Plain words need no pre-tokenizer.
    """
    held = _libraries.get(path)
    if held is None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        pre_tokens, merged = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize

        letters = dict(enumerate(byte_letters()))

        def spelled(s: str) -> str:
            """The vocabulary's letters for the bytes of s."""
            return s.encode().decode("latin-1").translate(letters)

        def encode(s: str) -> bytes:
            word = s.rstrip(punctuation)
            if word[1:].isalpha() and word[0] == " " and max(word) < "\u0250":
                # a space and Latin letters are one pre-token, ASCII marks after them another
                ids = [t.id for t in merged(spelled(word))]
                if len(word) < len(s) and not any(a in s for a in added):
                    ids += [t.id for t in merged(s[len(word) :])]
                elif len(word) < len(s):
                    ids = tokenizer.encode(s, add_special_tokens=False).ids
            elif any(a in s for a in added):
                ids = tokenizer.encode(s, add_special_tokens=False).ids
            else:
                ids = [t.id for w, _ in pre_tokens(s) for t in merged(w)]
            return array("H", ids).tobytes()

        # a piece without inner blanks starts where the letter of a space or line feed does, which only blanks are spelled with
        blanks = letters[ord(" ")], letters[ord("\n")]
        starts = np.zeros(1 << 16, bool)
        for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
            starts[i] = token[0] in blanks

        def encode_all(pieces: list[str]) -> pa.Array:
            parts, sizes = [b""], []
            for i in range(0, len(pieces), TOGETHER):
                some = pieces[i : i + TOGETHER]
                ids = np.array(tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u2")
                at = np.flatnonzero(starts[ids])
                if len(at) == len(some):
                    parts.append(ids.tobytes())
                    sizes.append(2 * np.diff(at, append=len(ids)))
                else:  # a vocabulary with other tokens
                    single = [encode(p) for p in some]
                    parts += single
                    sizes.append(np.array([len(x) for x in single], np.int64))
            ends = np.concatenate([[0], *sizes]).cumsum().astype(np.int64)
            return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(parts))])

        held = _libraries[path] = Pieces(encode, encode_all=encode_all)
    return held


_libraries: dict[str, Pieces] = {}


def default_vocabulary() -> str:
    """The public 50k byte-level vocabulary; any other path may be passed to the operators."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
