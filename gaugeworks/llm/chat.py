"""Chat formatting by token-level assembly.

A turn becomes token ids: a reserved id that opens it and names the role, the ids of its text, and a
reserved id that closes it. Role and text are encoded by themselves, so no content can produce a
reserved id and no token crosses a segment. Segment lengths are summed up (inside a turn and over a
conversation) to place the loss mask, which covers the text of assistant turns and nothing else.

The template can also be rendered as text. For that, control strings that occur in a text are
escaped by one more backslash in front of them; `unescape` takes one away. As every occurrence gets
exactly one, texts that already have backslashes there come back as they were.

A conversation is kept as rows, one per turn with its first token's position, because a single
conversation may be longer than a row should be.

Defined results: null text or role is empty text or role; turns are ordered by turn (null first),
then role, then text, so repeated rows are repeated turns; null conv_id is one conversation; roles
other than system, user and assistant are kept by name; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The published split pattern of the byte-level vocabulary.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Reserved ids follow the vocabulary's last one in this order.
CONTROLS = ("### System: ", "### User: ", "### Assistant: ", "### Other: ", "</role>", "</turn>\n")
ROLES = ("system", "user", "assistant")
FIRST_RESERVED = 50257
OTHER, ROLE_END, TURN_END = (FIRST_RESERVED + k for k in (3, 4, 5))
_CONTROL = "|".join(re.escape(c.rstrip("\n")) for c in CONTROLS)
_PLAIN = re.compile(f"(\\\\*(?:{_CONTROL}))")
_ESCAPED = re.compile(f"\\\\(\\\\*(?:{_CONTROL}))")


def escape(text: str) -> str:
    return _PLAIN.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@lru_cache(maxsize=4)
def encoder(ranks_path: str):
    """The byte-level tokenizer of a ranks file; one per worker process."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def assemble(role: str, text: str, enc) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of one turn."""
    body = enc.encode_ordinary(escape(text))
    if role in ROLES:
        segments = [[FIRST_RESERVED + ROLES.index(role)], body, [TURN_END]]
        trained = [False, role == "assistant", False]
    else:
        segments = [[OTHER], enc.encode_ordinary(escape(role)), [ROLE_END], body, [TURN_END]]
        trained = [False] * 5
    ends = np.cumsum([len(s) for s in segments])
    edge = np.zeros(ends[-1] + 1, np.int32)
    for at, size, on in zip(ends, map(len, segments), trained):
        if on and size:
            edge[at - size] += 1
            edge[at] -= 1
    ids = np.concatenate([np.asarray(s, np.int32) for s in segments])
    return ids, np.cumsum(edge[:-1]) > 0


def formatted(conversations: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """(conv_id, turn, first_token, ids, loss_mask): one row per turn, positions within the conversation."""

    def run(batches):
        enc = encoder(ranks_path)
        for batch in batches:
            turns = [assemble(r or "", t or "", enc) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            off = pa.array(np.concatenate([[0], np.cumsum([len(i) for i, _ in turns])]).astype(np.int32))
            ids = np.concatenate([i for i, _ in turns]) if turns else np.zeros(0, np.int32)
            mask = np.concatenate([m for _, m in turns]) if turns else np.zeros(0, bool)
            lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in (ids, mask)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(4), *lists], names=["conv_id", "turn", "place", "ids", "loss_mask"]
            )

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("place", F.concat_ws("\n", "role", F.sha2("text", 256)))
    out = rows.mapInArrow(run, "conv_id long, turn long, place string, ids array<int>, loss_mask array<boolean>")
    before = W.partitionBy("conv_id").orderBy("turn", "place").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.size("ids").cast("long")).over(before), F.lit(0).cast("long"))
    return out.withColumn("first_token", start).select("conv_id", "turn", "first_token", "ids", "loss_mask")


def _read_turn(ids: np.ndarray, mask: np.ndarray, enc) -> tuple[str, str, str | None, int]:
    """Role, text, trained text (None: nothing trained) and rendered length of one turn's ids."""
    head = int(ids[0])
    decode = lambda x: enc.decode_bytes(x.tolist()).decode()
    chars = len(CONTROLS[head - FIRST_RESERVED]) + len(CONTROLS[TURN_END - FIRST_RESERVED])
    at = 1
    if head == OTHER:
        at = int(np.flatnonzero(ids == ROLE_END)[0])
        role = decode(ids[1:at])
        chars += len(role) + len(CONTROLS[ROLE_END - FIRST_RESERVED])
        role, at = unescape(role), at + 1
    else:
        role = ROLES[head - FIRST_RESERVED]
    body = decode(ids[at:-1])
    trained = unescape(decode(ids[mask])) if mask.any() or role == "assistant" else None
    return role, unescape(body), trained, chars + len(body)


def read_back(rows: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """Per conversation, from ids and masks alone: digests of its turns and of what is trained on.

    Turns are decoded where they lie. Only the digest, which is sequential by its nature, takes a
    conversation's turns through one task, in order and one at a time.
    """

    def turns(batches):
        enc = encoder(ranks_path)
        for batch in batches:
            got = [
                _read_turn(i.values.to_numpy(), m.values.to_numpy(zero_copy_only=False), enc)
                for i, m in zip(batch.column(2), batch.column(3))
            ]
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *cols], names=["conv_id", "first_token", "role", "text", "trained", "chars"]
            )

    def digests(batches):
        at = None
        for batch in batches:
            done = []
            for conv, role, text, trained, chars in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if at is None or at[0] != conv:
                    if at is not None:
                        done.append(at)
                    at = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at[1] += 1
                at[2].update(f"{role}\n{text}\n".encode())
                if trained is not None:
                    at[3] += len(trained)
                    at[4].update(trained.encode())
                at[5] += chars
            yield packed(done)
        if at is not None:
            yield packed([at])

    def packed(done):
        cols = [[d[k].hexdigest() if k in (2, 4) else d[k] for d in done] for k in range(6)]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, kinds)],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    read = rows.select("conv_id", "first_token", "ids", "loss_mask").mapInArrow(
        turns, "conv_id long, first_token long, role string, text string, trained string, chars long"
    )
    return (
        read.repartition("conv_id").sortWithinPartitions("conv_id", "first_token")
        .mapInArrow(digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    )
