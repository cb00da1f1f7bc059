"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

A text is cut into marked words: every word takes the blanks before it (the first one gets the model's
extra blank). No piece has a blank behind another character, so words are encoded by themselves. The
distinct words of a batch are sorted; in that order they are a depth-first walk through their trie, and
the forward states of the prefix that a word shares with the one before it are kept.

Forward state: for every prefix the best score and the piece that ends there. In a unigram model every
piece may follow every other. In a merge (BPE) model a piece may follow another only if merging both
together yields just these two, and a prefix has exactly one such path: that of the merges. Characters
outside the vocabulary become byte pieces. In a merge model an automaton of the pieces (Aho-Corasick) gives
those that end at a character; its state is kept by prefix, too.

Decoding joins the pieces' bytes and takes the extra blank away; it gives back every text exactly. (The
mark U+2581 itself, if it occurs in a text, is encoded as bytes; otherwise it would decode as a blank.)

Defined results: null and empty text have no pieces; null ids decode to an empty text; control pieces
decode to nothing; rows are kept as they are and as often as they come; an input column named like a
result column, in upper or lower case, is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.textkernel import slices
from gaugeworks.llm.workspace import bounded_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words of up to 64 characters, neighbouring pairs of pieces and steps of the automaton that a worker remembers. Beyond, it
#: keeps the words of the latest slice only, forgets all pairs, and takes no further steps.
REMEMBERED, FOLLOWED, STEPS = 80_000, 170_000, 60_000


_ONE = (1,)


class Pieces:
    """Vocabulary of a model file, with blanks in place of the mark."""

    def __init__(self, path: str, merges: bool = True):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.merges = merges
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte = [0] * 256
        self.bytes: list[bytes] = []
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte[int(piece[3:5], 16)] = k
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k):
                self.bytes.append(b"")
            elif model.is_unknown(k):
                self.bytes.append(" ⁇ ".encode())
            else:
                text = piece.replace("▁", " ")
                self.ids[text], self.score[text] = k, model.get_score(k)
                self.bytes.append(text.encode())
        self.unknown = min(self.score.values()) - 10.0
        self.start = len(self.bytes)
        ends: dict[str, set[int]] = {}
        for text in self.ids:
            ends.setdefault(text[-2:], {1}).add(len(text))
        #: Sizes of the pieces that end in two characters, the largest first.
        self.sizes = {end: tuple(sorted(n, reverse=True)) for end, n in ends.items()}
        self.root = self._automaton()
        self.room = STEPS
        self.follows: dict[int | tuple, bool] = {}
        self.words: dict[str, bytes] = {}

    def _automaton(self) -> dict:
        """Root of an Aho-Corasick automaton of the pieces: what has been read, as far as a piece may begin with it.

        A state leads by character to the next one; at 0 it has (size, id) of all pieces of two or more characters
        that end here, the largest first, at 1 the state of its longest proper suffix.
        """
        root: dict = {0: (), 1: None}
        ends: dict[int, tuple[int, int]] = {}
        for text, k in self.ids.items():
            at = root
            for c in text:
                at = at.setdefault(c, {})
            if len(text) > 1:
                ends[id(at)] = (len(text), k)
        todo = [(root, c, at) for c, at in root.items() if isinstance(c, str)]
        for before, c, at in todo:  # shorter prefixes come first
            suffix = before[1]
            while suffix is not None and c not in suffix:
                suffix = suffix[1]
            at[1] = root if suffix is None else suffix[c]
            own = ends.get(id(at))
            at[0] = (own, *at[1][0]) if own else at[1][0]
            todo += [(at, d, below) for d, below in at.items() if isinstance(d, str)]
        return root

    def _step(self, at: dict, c: str) -> dict:
        """The next state where no piece goes on with c; remembered while there is room."""
        suffix = at
        while suffix is not None and c not in suffix:
            suffix = suffix[1]
        to = self.root if suffix is None else suffix[c]
        if self.room:
            self.room -= 1
            at[c] = to
        return to

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: always the pair with the best score, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, top = -1, -np.inf
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1], -np.inf)
                if score > top:
                    best, top = k, score
            if best < 0:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def may_follow(self, left: str, right: str) -> bool:
        return self.merged(left + right) == ([left, right] if left else [right])

    def encode_sorted(self, words: list[str]) -> list[bytes]:
        """Ids (as int32 bytes) of sorted distinct words, walking their trie depth first."""
        out, before = [], ""
        # By prefix length: the id and size of the piece that ends there (-1: a character without one), the score so far, the automaton's state.
        last, size, total, state = [self.start], [0], [0.0], [self.root]
        advance = self._merged_states if self.merges else self._best_states
        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], size[shared + 1 :], total[shared + 1 :], state[shared + 1 :]
            advance(word, shared + 1, last, size, total, state)
            path, i = [], len(word)
            while i:
                path.append(last[i])
                if last[i] < 0:
                    path[-1:] = [self.byte[b] for b in reversed(word[i - 1].encode())]
                i -= size[i]
            path.reverse()
            out.append(array("i", path).tobytes())
            before = word
        return out

    def _merged_states(self, word: str, start: int, last: list[int], size: list[int], total: list[float], state: list[dict]) -> None:
        """Forward states of the prefixes from `start` on, in a merge model: the one piece that may end there.

        One character is what remains when no longer piece may follow what is before it.
        """
        follows, at = self.follows, state[start - 1]
        for i, c in enumerate(word[start - 1 :], start):
            at = at.get(c) or self._step(at, c)
            state.append(at)
            for n, k in at[0]:
                left = last[i - n]
                pair = left << 20 | k if left >= 0 else (word[i - n - 1], k)
                good = follows.get(pair)
                if good is None:
                    j = i - n
                    if len(follows) > FOLLOWED:
                        follows.clear()
                    good = follows[pair] = self.may_follow(word[j - size[j] : j], word[j:i])
                if good:
                    last.append(k)
                    size.append(n)
                    break
            else:
                last.append(self.ids.get(c, -1))
                size.append(1)

    def _best_states(self, word: str, start: int, last: list[int], size: list[int], total: list[float], state: list[dict]) -> None:
        """Forward states of the prefixes from `start` on, in a unigram model: the best sum of scores."""
        for i in range(start, len(word) + 1):
            arcs = []
            for n in self.sizes.get(word[max(i - 2, 0) : i], _ONE):
                piece = word[max(i - n, 0) : i]
                k = self.ids.get(piece, -1)
                if n == 1 or n <= i and k >= 0:
                    arcs.append((total[i - n] + self.score.get(piece, self.unknown), n, k))
            score, n, k = max(arcs)
            last.append(k)
            size.append(n)
            total.append(score)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; those that are not remembered are encoded together, sorted."""
        known = self.words
        new = sorted(w for w in words if w not in known)
        fresh = dict(zip(new, self.encode_sorted(new)))
        out = [known[w] if w in known else fresh[w] for w in words]
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            known.update((w, x) for w, x in zip(words, out) if len(w) <= 64)
        else:
            known.update((w, x) for w, x in fresh.items() if len(w) <= 64)
        return out


@lru_cache(maxsize=4)
def pieces(path: str, merges: bool = True) -> Pieces:
    """One vocabulary per worker process and model."""
    return Pieces(path, merges)


_WORD = re.compile(" +[^ ]*")


def marked_words(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows without their first blank, and each row's first word."""
    col = col.cast(pa.large_string()).fill_null("")
    split = pc.split_pattern(col, " ")
    odd = np.flatnonzero(pc.match_substring_regex(col, "^$|^ |  | $").to_numpy(zero_copy_only=False))
    if not len(odd):
        return split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    # Rows with runs of blanks, blanks at an end or no text: their words carry the further blanks.
    own = {int(k): [w[1:] for w in _WORD.findall(" " + t)] if t else [] for k, t in zip(odd, col.take(pa.array(odd)).to_pylist())}
    size = np.diff(split.offsets.to_numpy())
    parts, done = [], 0
    for k in odd:
        parts += [split.slice(done, k - done).flatten(), pa.array(own[int(k)], pa.large_string())]
        size[k] = len(own[int(k)])
        done = k + 1
    parts.append(split.slice(done).flatten())
    return pa.concat_arrays(parts), np.concatenate([[0], np.cumsum(size)])


def encode_column(col: pa.Array, vocab: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one behind the other, and the row offsets."""
    words, first = marked_words(col)
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy()
    ids = vocab.encode_words([" " + w for w in coded.dictionary.to_pylist()])
    size = np.array([len(x) // 4 for x in ids], np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    flat = np.frombuffer(b"".join(ids), np.int32)
    each = size[code] if len(code) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(each)])
    at = np.arange(ends[-1]) - np.repeat(ends[:-1], each) + np.repeat(start[code] if len(code) else each, each)
    return flat[at], ends[first]


def decode_ids(ids, vocab: Pieces) -> str:
    text = b"".join(vocab.bytes[k] for k in ids if 0 <= k < len(vocab.bytes)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encoded(docs: DataFrame, path: str = MODEL, merges: bool = True) -> DataFrame:
    """docs with the array column `ids` and its length `n_tokens`.

    Only the text goes to Python, in slices of bounded bytes; all other columns stay where they are.
    """

    def run(col: pa.Array) -> pa.Array:
        vocab, parts = pieces(path, merges), [pa.array([], pa.list_(pa.int32()))]
        for lo, n in slices(col, len(col), 2 << 20):
            ids, off = encode_column(col.slice(lo, n), vocab)
            parts.append(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids)))
        pa.default_memory_pool().release_unused()
        return pa.concat_arrays(parts)

    bounded_batches(docs.sparkSession)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("ids", "n_tokens")]
    ids = F.arrow_udf(run, "array<int>")(F.col("text").cast("string"))
    return docs.select(*kept, ids.alias("ids")).withColumn("n_tokens", F.size("ids").cast("long"))


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """rows with the column `decoded`: the text that `ids` stand for."""

    def run(lists: pa.Array) -> pa.Array:
        vocab = pieces(path)
        table = np.frombuffer(b"".join(vocab.bytes), np.uint8)
        ends = np.concatenate([[0], np.cumsum([len(b) for b in vocab.bytes])])
        parts = [pa.array([], pa.string())]
        for lo in range(0, len(lists), 256):
            part = lists.slice(lo, 256)
            ids = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.diff(ends)[ids] if len(ids) else ids
            to = np.concatenate([[0], np.cumsum(size)])
            at = np.arange(to[-1]) - np.repeat(to[:-1], size) + np.repeat(ends[ids] if len(ids) else size, size)
            data = table[at].tobytes()
            per_row = np.concatenate([[0], np.cumsum([len(x) if x is not None else 0 for x in part])])
            text = [data[a:b].decode("utf-8", "replace") for a, b in zip(to[per_row[:-1]], to[per_row[1:]])]
            parts.append(pa.array([t[1:] if t.startswith(" ") else t for t in text], pa.string()))
        pa.default_memory_pool().release_unused()
        return pa.concat_arrays(parts)

    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() != "decoded"]
    return rows.select(*kept, F.arrow_udf(run, "string")(F.expr("filter(ids, k -> k >= 0)")).alias("decoded"))
