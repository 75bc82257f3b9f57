"""BPE encoding and decoding by prefix-sharing trie traversal.

Texts are cut into words by the tokenizer's pattern. The new distinct words of a batch go
into a trie; a depth-first walk gives each node (a prefix of some word) the last token of
that prefix's encoding. A token t is that last token if it ends the prefix and may follow the
last token of what stands before it; by uniqueness of BPE encodings there is one such t. The
tokens that end a prefix are found by an automaton over all tokens, longest first, whose
state is carried along the walk. Prefixes that words share are so encoded once, and a word's
ids come from following last tokens back from its node.

Result for each document: doc_id, n_tokens, ids_sha256, decoded_sha256. Null text counts
as empty (0 tokens, digests of the empty string); repeated rows give repeated rows; null
doc_id stays null; other columns are ignored. Special-token strings in a text become
their ids, as the library does by default. A very long text is a batch of its own, and memory
follows it.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from driftloom.llm.arrowkit import no_gc, releasing, slices, small_batches

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Fixed value: the pattern that byte-level BPE vocabularies of this kind split text by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Letters, numbers and white space among Latin-1 characters.
LETTERS, NUMBERS, SPACE = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t-\r\x85\xa0"
#: The same pattern for texts of Latin-1 characters only, which are matched much faster.
LATIN_PATTERN = rf" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBERS}]+| ?[^{SPACE}{LETTERS}{NUMBERS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Words that a worker remembers.
MOST_WORDS = 600_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, reversed."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    """Tokens are numbered by rank here: single bytes first, then merges in order."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        raw = lambda s: bytes(letters[c] for c in s)
        single = {letters[c]: i for c, i in vocab.items() if len(c) == 1 and c in letters}
        self.bytes_of = [bytes([b]) for b in range(256)]
        self.id_of = [single.get(b, -1) for b in range(256)]
        self.rank = {bytes([b]): b for b in range(256)}
        self.left, self.right = list(range(256)), list(range(256))
        self.pair: dict[tuple[int, int], int] = {}
        for merge in merges:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y = self.rank[raw(a)], self.rank[raw(b)]
            whole = self.bytes_of[x] + self.bytes_of[y]
            t = self.rank.get(whole)
            if t is None:
                t = self.rank[whole] = len(self.bytes_of)
                self.bytes_of.append(whole)
                self.id_of.append(vocab[a + b])
                self.left.append(x)
                self.right.append(y)
            self.pair.setdefault((x, y), t)
        self.size_of = [len(b) for b in self.bytes_of]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.decode_of = {i: self.bytes_of[r] for r, i in enumerate(self.id_of) if i >= 0} | {i: s.encode() for s, i in self.special.items()}
        self.words_of = regex.compile(PATTERN).findall
        self.latin_words_of = re.compile(LATIN_PATTERN).findall
        # ids (little-endian 32 bits each) and decoded bytes of words
        self.ids_of_word: dict[str, bytes] = {}
        self.out_of_word: dict[str, bytes] = {}
        self.follows: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        # the automaton: states are beginnings of tokens, the empty one first
        self.begins: list[bytes] = [b""]
        self.state: dict[bytes, int] = {b"": 0}
        for token in self.bytes_of:
            for i in range(len(token), 0, -1):
                if token[:i] in self.state:
                    break
                self.state[token[:i]] = len(self.begins)
                self.begins.append(token[:i])
        self.moves: dict[int, int] = {}
        self.longest: dict[int, int] = {}
        self.shorter: dict[int, int] = {}

    def suffix_token(self, text: bytes) -> int:
        """The longest token that ends a text, which has a byte at least."""
        return next(t for i in range(len(text)) if (t := self.rank.get(text[i:])) is not None)

    def move(self, at: int, byte: int) -> int:
        """State after one more byte: the longest beginning of a token that ends what was read."""
        text = self.begins[at] + bytes([byte])
        to = self.moves[at << 8 | byte] = next(self.state[text[i:]] for i in range(len(text)) if text[i:] in self.state)
        if to not in self.longest:
            t = self.longest[to] = self.suffix_token(self.begins[to])
            while t not in self.shorter and self.size_of[t] > 1:
                t = self.shorter.setdefault(t, self.suffix_token(self.bytes_of[t][1:]))
        return to

    def may_follow(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of a and b gives just these two tokens.

        Undoes the latest merge on either side of the border again and again; if two
        tokens that meet there would have been merged before that, the pair can't stand.
        """
        x, y, limit, good = a, b, len(self.bytes_of), True
        while True:
            joined = self.pair.get((x, y))
            if joined is not None and joined < limit:
                good = False
                break
            # the token made later is taken apart first; single bytes stay
            if x >= 256 and (x > y or y < 256):
                limit, x = x, self.right[x]
            elif y >= 256:
                limit, y = y + 1, self.left[y]
            else:
                break
        if len(self.follows) > 1_000_000:
            self.follows.clear()
        self.follows[a << 32 | b] = good
        return good

    def stands_alone(self, t: int) -> bool:
        """Whether a token's bytes encode to that token."""
        if t < 256:
            return True
        if t not in self.whole:
            parts = list(self.bytes_of[t])
            while len(parts) > 1:
                best = min(((self.pair.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:]))))
                if best[0] == 1 << 60:
                    break
                # every place of the best pair, from the left
                two, i, out = (parts[best[1]], parts[best[1] + 1]), 0, []
                while i < len(parts):
                    if i + 1 < len(parts) and (parts[i], parts[i + 1]) == two:
                        out.append(best[0])
                        i += 2
                    else:
                        out.append(parts[i])
                        i += 1
                parts = out
            self.whole[t] = parts == [t]
        return self.whole[t]

    def encode_words(self, words: set[bytes]) -> dict[bytes, list[int]]:
        """Ranks of each word, by one depth-first walk over the trie of all of them.

        The trie is held as its words in sorted order, each with the length of the prefix
        that it shares with the one before: the order of a depth-first walk. last has the
        last token of each prefix on the path from the root; going to the next word cuts it
        back to the node where their paths part.
        """
        out: dict[bytes, list[int]] = {}
        follows, moves, longest, shorter, size_of = self.follows.get, self.moves.get, self.longest, self.shorter, self.size_of
        last: list[int] = []
        states = [0]
        before = b""
        for word in sorted(words):
            n, k = len(word), 0
            m = min(len(before), n)
            if before[:m] == word[:m]:
                k = m
            else:
                while before[k] == word[k]:
                    k += 1
            del last[k:], states[k + 1 :]
            at = states[-1]
            for i in range(k, n):
                to = moves(at << 8 | word[i])
                at = self.move(at, word[i]) if to is None else to
                states.append(at)
                t = longest[at]
                while True:
                    j = i - size_of[t]
                    if j < 0:
                        good = self.stands_alone(t)
                    else:
                        good = follows(last[j] << 32 | t)
                        if good is None:
                            good = self.may_follow(last[j], t)
                    if good:
                        break
                    t = shorter[t]
                last.append(t)
            tokens = []
            while n:
                t = last[n - 1]
                tokens.append(t)
                n -= size_of[t]
            tokens.reverse()
            out[word] = tokens
            before = word
        return out

    def learn(self, words: set[str]) -> None:
        """Remembers words: ids as little-endian 32-bit integers, and their decoded bytes."""
        id_of, decoded = self.id_of, self.decode_of
        for raw, tokens in self.encode_words({w.encode() for w in words}).items():
            ids = [id_of[t] for t in tokens]
            word = raw.decode()
            self.ids_of_word[word] = array("I", ids).tobytes()
            self.out_of_word[word] = b"".join([decoded[i] for i in ids])

    def cut(self, text: str) -> list[str]:
        """Words by the pattern."""
        try:
            if not text.isascii():
                text.encode("latin-1")
        except UnicodeEncodeError:
            return self.words_of(text)
        return self.latin_words_of(text)

    def pieces(self, text: str) -> list[tuple[list[str], int | None]]:
        """Words of each stretch between special tokens, and the special token after it."""
        out, begin = [], 0
        for m in self.at_special.finditer(text) if self.at_special and any(s in text for s in self.special) else ():
            out.append((self.cut(text[begin : m.start()]), self.special[m[0]]))
            begin = m.end()
        out.append((self.cut(text[begin:] if begin else text), None))
        return out

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids and decoded bytes of each text."""
        cut = [self.pieces(t) for t in texts]
        words: set[str] = set()
        for text in cut:
            for ws, _ in text:
                words.update(ws)
        new = words - self.ids_of_word.keys()
        if len(self.ids_of_word) + len(new) > MOST_WORDS:
            self.ids_of_word.clear()
            self.out_of_word.clear()
            new = words
        self.learn(new)
        ids_of, out_of = self.ids_of_word.__getitem__, self.out_of_word.__getitem__
        for text in cut:
            ids, out = [], []
            for ws, special in text:
                ids += map(ids_of, ws)
                out += map(out_of, ws)
                if special is not None:
                    ids.append(special.to_bytes(4, "little"))
                    out.append(self.decode_of[special])
            yield b"".join(ids), b"".join(out)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> TrieBpe:
    return TrieBpe(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row per document; see above. path: a byte-level BPE file of the tokenizers library, there on every machine."""

    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in slices(batches, "text", 8 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            with no_gc():
                rows = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(out.decode("utf-8", "replace").encode()).hexdigest()) for ids, out in bpe.encode_batch(texts)]
            n, a, b = zip(*rows, strict=True)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(releasing(work), SCHEMA)
