"""Chat formatting by token-level assembly.

Each turn is ``<s>`` role, ``[INST]`` (or ``[/INST]`` for the trained role), text, ``</s>``.
Roles and texts are encoded separately, one row at a time, and reserved ids beyond the
vocabulary are spliced between them, so content can never produce a control id. In the
written-out form, a control string inside content gets one more backslash after its first
character, which reading back removes: ``<s>`` becomes ``<\\s>`` and ``<\\s>`` becomes
``<\\\\s>``. The loss mask covers the ids of trained texts; segment borders are prefix sums
of segment lengths.

Rows of a conversation are ordered by turn, then role, then text (nulls first), so ties and
repeated rows have one result: each is a turn of its own. Null or empty roles and texts
are empty strings; rows without a conversation id form one conversation without an id.
Extra columns are ignored; an empty table gives an empty result. Turns are encoded before
the shuffle, so a very long conversation only costs the joining of its ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import Codec

#: Control strings in the order of their reserved ids, which start behind the vocabulary.
CONTROLS = ("<s>", "[INST]", "[/INST]", "</s>")
START, PROMPT, REPLY, END = range(4)
_ADD = re.compile(r"(<)(\\*/?s>)|(\[)(\\*/?INST\])")
_DROP = re.compile(r"(<)\\(\\*/?s>)|(\[)\\(\\*/?INST\])")


def escape(text: str) -> str:
    """Content in which no control string occurs any more; `unescape` restores it exactly."""
    return _ADD.sub(lambda m: f"{m[1] or m[3]}\\{m[2] or m[4]}", text)


def unescape(text: str) -> str:
    return _DROP.sub(lambda m: f"{m[1] or m[3]}{m[2] or m[4]}", text)


def assemble(segments: list[np.ndarray], kinds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids end to end and their loss mask; kinds: 1 for segments under the loss.

    The mask is the running sum of +1 and -1 at the borders of trained segments, which
    lie at prefix sums of the segment lengths.
    """
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    edge = np.concatenate([[0], np.cumsum(sizes)])
    step = np.zeros(edge[-1] + 1, np.int64)
    trained = np.flatnonzero(np.asarray(kinds, bool))
    np.add.at(step, edge[trained], 1)
    np.add.at(step, edge[trained + 1], -1)
    ids = np.concatenate(segments) if segments else np.zeros(0, np.int32)
    return ids, np.cumsum(step[:-1]) > 0


def format_conversations(turns: DataFrame, codec: Codec, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, ids (array of int), loss (array of boolean)."""
    shared = turns.sparkSession.sparkContext.broadcast(codec)
    first = max(codec.bytes_of) + 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                cols = []
                for k in (2, 3):
                    ids = [c.encode(escape(t)) if t else [] for t in part.column(k).to_pylist()]
                    edge = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(edge, pa.array(np.fromiter(chain.from_iterable(ids), np.int32, edge[-1]))))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(4)] + cols, ["conv_id", "turn", "role", "text", "role_ids", "text_ids"])

    def pieces(conv) -> Iterator[tuple[np.ndarray, int]]:
        for role, role_ids, text_ids in conv:
            trained = role == trained_role
            yield np.array([first + START], np.int32), 0
            yield role_ids, 0
            yield np.array([first + (REPLY if trained else PROMPT)], np.int32), 0
            yield text_ids, int(trained)
            yield np.array([first + END], np.int32), 0

    def finish(conv_id, conv):
        ids, loss = assemble(*map(list, zip(*pieces(conv))))
        return conv_id, ids, loss

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by conversation; one conversation is open at a time."""
        done, held, now, conv = [], 0, None, []
        for batch in batches:
            ids, roles = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            r, t = batch.column(2), batch.column(3)
            for i, conv_id in enumerate(ids):
                if conv and conv_id != now:
                    done.append(finish(now, conv))
                    held, conv = held + len(done[-1][1]), []
                    if held > 500_000:
                        yield table(done)
                        done, held = [], 0
                now = conv_id
                conv.append((roles[i], r[i].values.to_numpy(), t[i].values.to_numpy()))
        if conv:
            done.append(finish(now, conv))
        if done:
            yield table(done)

    def table(done) -> pa.RecordBatch:
        edge = np.cumsum([0, *(len(x[1]) for x in done)]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(edge, pa.array(np.concatenate([x[k] for x in done]))) for k in (1, 2)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), *lists], ["conv_id", "ids", "loss"])

    rows = turns.select("conv_id", "turn", "role", "text")
    encoded = rows.mapInArrow(encode, "conv_id long, turn long, role string, text string, role_ids array<int>, text_ids array<int>")
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "role_ids", "text_ids").mapInArrow(join, "conv_id long, ids array<int>, loss array<boolean>")


def read_back(formatted: DataFrame, codec: Codec) -> DataFrame:
    """Digests read from formatted conversations alone.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars
    and loss_sha256 (all text under the loss mask), formatted_chars (control strings included).
    """
    shared = formatted.sparkSession.sparkContext.broadcast(codec)
    first = max(codec.bytes_of) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            out = []
            for k, conv_id in enumerate(batch.column(0).to_pylist()):
                ids = batch.column(1)[k].values.to_numpy()
                loss = batch.column(2)[k].values.to_numpy(zero_copy_only=False)
                turns, trained = hashlib.sha256(), hashlib.sha256()
                marks = np.flatnonzero(ids >= first)
                n = loss_chars = chars = 0
                for a, b, e in marks.reshape(-1, 3):
                    if ids[a] != first + START or ids[e] != first + END:
                        raise ValueError("a turn isn't closed")
                    role, text = (c.decode(ids[i + 1 : j].tolist()).decode() for i, j in ((a, b), (b, e)))
                    chars += len(role) + len(text) + sum(len(CONTROLS[ids[i] - first]) for i in (a, b, e))
                    plain = unescape(text)
                    turns.update(f"{unescape(role)}\n{plain}\n".encode())
                    covered = loss[b + 1 : e]
                    if covered.any():
                        part = plain if covered.all() else unescape(c.decode(ids[b + 1 : e][covered].tolist()).decode())
                        trained.update(part.encode())
                        loss_chars += len(part)
                    n += 1
                out.append((conv_id, n, turns.hexdigest(), loss_chars, trained.hexdigest(), chars))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 6, kinds)], names)

    return formatted.select("conv_id", "ids", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(turns: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose texts are made of control strings."""
    probe = turns.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
