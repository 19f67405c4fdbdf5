"""SentencePiece encoding and decoding by Viterbi over distinct words in a trie, with forward states shared along prefixes."""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom import scratch
from factloom.llm.word_cache import TwoGenerations, trimmed
from factloom.llm.words import slices

#: Words in each of the two generations, and pairs of pieces, that a worker keeps during a task.
WORDS, PAIRS = 150_000, 400_000
MARK = "▁"


class Pieces:
    """Encoder and decoder for a sentencepiece file of merges; ids are those of the library.

    Spaces become marks and a text that isn't empty gets one in front, as the file's normalizer does. No piece holds
    a mark after another character, so a text falls into words, each a run of marks and what follows up to the next.

    The best path of a word is the one that the merges leave. A sequence of pieces is that path exactly if each piece
    and each two neighbours are what the merges leave of their own characters, so the path of a prefix is the path of
    a shorter prefix and one more piece, and the forward state of a prefix is its last piece: a Viterbi search whose
    transition score is zero for such neighbours and minus infinity for others. A character that no piece spells
    becomes its UTF-8 bytes; no merge crosses it.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.bytes_of = [b""] * n
        self.byte_ids = [model.unk_id()] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[piece] = model.get_score(i)
                self.id_of[piece] = i
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece crosses a word mark; words can't be encoded apart")
        self.ids = {piece: i.to_bytes(4, "little") for piece, i in self.id_of.items()}
        self.ends, self.lefts, self.pairs = ahocorasick.Automaton(), [], 0
        for piece, ids in self.ids.items():
            self.lefts.append({})
            self.ends.add_word(piece, (len(piece) - 1, piece, ids, self.lefts[-1]))
        self.ends.make_automaton()
        self.steps: dict[str, tuple] = {}
        # no piece holds a letter beside a character that is neither a letter nor in ``near``: words fall into parts there
        both = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        letters = "".join(sorted({c for p in self.score for c in p if c.isalpha()}))
        near = "".join(sorted({c for x in both for c in x if any(y in letters for y in x)}.difference(letters)))
        apart = f"[^{re.escape(letters + near)}]"
        self.split = re.compile(f"(?<=[{re.escape(letters)}])(?={apart})|(?<={apart})(?=[{re.escape(letters)}])").split if letters else lambda word: [word]
        self.parts = TwoGenerations(self.encode_parts, WORDS)
        self.words = TwoGenerations(self.encode_words, WORDS)

    def forget(self) -> None:
        """Free what was kept between batches; called at the end of a task, because an idle worker lives on."""
        self._forget_pairs()
        self.steps.clear()
        self.words.forget()
        self.parts.forget()

    def merged(self, text: str, trace: list | None = None) -> list[str]:
        """Pieces that the merges leave of a text: the best scored neighbours first, the leftmost of equals.

        ``trace`` gets the score of each merge and the first and last piece after it.
        """
        n, score = len(text), self.score
        parts: list[str | None] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score[x], k, x) for k in range(n - 1) if (x := text[k : k + 2]) in score]
        heapq.heapify(heap)
        last = n - 1
        while heap:
            low, k, made = heapq.heappop(heap)
            left = parts[k]
            m = after[k]
            if left is None or m >= n or left + parts[m] != made:
                continue
            parts[k], parts[m] = made, None
            after[k] = q = after[m]
            if q < n:
                before[q] = k
                if (x := made + parts[q]) in score:
                    heapq.heappush(heap, (-score[x], k, x))
            else:
                last = k
            if (b := before[k]) >= 0 and (x := parts[b] + made) in score:
                heapq.heappush(heap, (-score[x], b, x))
            if trace is not None:
                trace.append((-low, parts[0], parts[last]))
        return [p for p in parts if p is not None]

    def _own(self, piece: str) -> tuple:
        """Whether the merges make the piece of its characters, and their scores with the first and last piece before each."""
        known = self.steps.get(piece)
        if known is None:
            trace: list = []
            whole = self.merged(piece, trace) == [piece]
            scores = [s for s, _, _ in trace] + [-math.inf]
            known = self.steps[piece] = whole, scores, [piece[0], *(f for _, f, _ in trace)], [piece[-1], *(x for _, _, x in trace)]
            if len(self.steps) > 4 * len(self.score):  # characters that no piece holds
                self.steps = {}
        return known

    def _joins(self, left: str, right: str, lefts: dict[str, bool]) -> bool:
        """Whether ``right`` can follow ``left`` on a best path; ``lefts`` holds the answers for ``right``."""
        if self.pairs >= PAIRS:
            self._forget_pairs()
        self.pairs += 1
        known = lefts[left] = self._apart(left, right)
        return known

    def _forget_pairs(self) -> None:
        for lefts in self.lefts:
            lefts.clear()
        self.pairs = 0

    def _apart(self, left: str, right: str) -> bool:
        """Whether the merges of both, in order of score, never meet a better one across."""
        whole, r_scores, firsts, _ = self._own(right)
        if not whole or not left:
            return whole
        _, l_scores, _, lasts = self._own(left)
        i = j = 0
        score = self.score.get
        while True:
            a, b = l_scores[i], r_scores[j]
            across = score(lasts[i] + firsts[j])
            if across is not None and across > a and across >= b:
                return False
            if a == b == -math.inf:
                return True
            if a >= b:
                i += 1
            else:
                j += 1

    def _bytes(self, piece: str) -> bytes:
        return self.ids.get(piece) or b"".join(self.byte_ids[b].to_bytes(4, "little") for b in piece.encode("utf-8", "replace"))

    def encode_words(self, words: Iterable[str]) -> list[bytes]:
        """Ids of each marked word, little-endian, in the order asked for: those of its parts, one after the other."""
        cut = list(map(self.split, words))
        get = self.parts.fill({p for parts in cut for p in parts}).__getitem__
        return [get(parts[0]) if len(parts) == 1 else b"".join(map(get, parts)) for parts in cut]

    def encode_parts(self, words: Iterable[str]) -> list[bytes]:
        """Ids of each part of a word that merges can't leave, in the order asked for.

        The distinct parts are taken in sorted order, which is a depth-first walk of their trie: the stack holds the
        last piece of each prefix of the current one, and each starts from the prefix that it shares with the one
        before. The pieces that end at each place come from an automaton, the longest first. Those with more than one
        mark are merged directly: pieces of marks alone have equal scores, for which the rule of neighbours doesn't hold.
        """
        words = list(words)
        found: dict[str, bytes] = {}
        stack, coded = [""], [b""]
        ends, before, put, add = self.ends.iter, "", stack.append, coded.append
        for word in sorted(set(words)):
            if word[1:2] == MARK:
                found[word] = b"".join(map(self._bytes, self.merged(word)))
                continue
            at = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                at += 1
            del stack[at + 1 :], coded[at + 1 :]
            for end, (ahead, piece, ids, lefts) in ends(word):
                if end < at:
                    continue
                while at < end:  # characters that no piece holds
                    put(word[at])
                    add(coded[at] + self._bytes(word[at]))
                    at += 1
                left = stack[end - ahead]
                known = lefts.get(left)
                if known is None:
                    known = self._joins(left, piece, lefts)
                if known:
                    put(piece)
                    add(coded[end - ahead] + ids)
                    at += 1
            for c in word[at:]:
                put(c)
                add(coded[-1] + self._bytes(c))
            before = word
            found[word] = coded[-1]
        return [found[w] for w in words]

    @staticmethod
    def marked(text: str) -> list[str]:
        """The marked words of a text in order; joined they are the normalised text."""
        if not text:
            return []
        parts = text.split(" ")
        if "" not in parts and MARK not in text:
            return [MARK + p for p in parts]
        out, marks = [], ""
        for p in parts:  # runs of spaces, and marks that the text itself holds
            marks += MARK
            if p:
                at = 0
                whole = marks + p
                for k in range(1, len(whole)):
                    if whole[k] == MARK and whole[k - 1] != MARK:
                        out.append(whole[at:k])
                        at = k
                tail = whole[at:]
                if tail.strip(MARK):
                    out.append(tail)
                    marks = ""
                else:
                    marks = tail
        return [*out, marks] if marks else out

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.marked(t) for t in texts]
        get = self.words.fill({w for words in cut for w in words}).__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def decode(self, ids: bytes) -> str:
        """Text of little-endian ids: bytes are joined, marks become spaces, and the mark in front goes."""
        text = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """doc_id, ids (array of int), n_tokens of each whole text of ``docs(doc_id, text)``; with ``decode`` the text too.

    A null or empty text has no ids. Every row comes back, repeated ones too; other columns are ignored. Decoding
    gives the text back, with U+2581 as a space (the library does the same). Distinct words are encoded once for each
    batch of rows and stay in a bounded cache of the worker; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in trimmed(batches, model.forget):
            for part in slices(batch):
                coded = model.encode([t or "" for t in part.column("text").to_pylist()])
                size = np.array([len(c) // 4 for c in coded], dtype=np.int64)
                flat = np.frombuffer(b"".join(coded), dtype="<i4")
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
                columns, names = [part.column("doc_id"), ids, pa.array(size)], ["doc_id", "ids", "n_tokens"]
                if decode:
                    columns.append(pa.array([model.decode(c) for c in coded], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    scratch.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long" + ", decoded string" * decode)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and whether decoding the ids
    gives the text back, for each whole text; a null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in trimmed(batches, model.forget):
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                coded = model.encode(texts)
                same = [model.decode(c) == t.replace(MARK, " ") for c, t in zip(coded, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(map(zlib.crc32, coded), pa.int64()), pa.array(same, pa.bool_())],
                    ["doc_id", "n_tokens", "ids_crc32", "round_trip"],
                )

    scratch.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
