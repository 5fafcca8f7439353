"""Chat formatting with loss masks that are aligned to token offsets.

A conversation is rendered as ``<s>[INST]role[/INST]text</s>`` for each turn, encoded once with offsets, and each token
is marked for the loss if it overlaps an assistant's text. The four marks are single tokens of their own, so a token
never reaches from a mark into a text and tokens of different turns do not depend on each other. Marks that occur
inside a role or a text are escaped: a backslash goes after their first character, and a backslash becomes two;
``unescape`` undoes both.

Rows are dealt by conversation and sorted by turn; a task streams over them and gives a conversation in segments of
whole turns, so memory is bounded by a turn and ``segment_chars``, not by a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, shuffle_partitions

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
START, HEAD, BODY, END = MARKS = ("<s>", "[INST]", "[/INST]", "</s>")

_ESCAPED = re.compile("|".join([r"\\", *map(re.escape, MARKS)]))
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
_UNESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of the turns, and the sorted spans of the assistant's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{HEAD}{escape(role)}{BODY}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def mask_tokens(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token, given by sorted offsets ``(start, end)``, overlaps a span: two binary searches a span."""
    mask = np.zeros(len(offsets) + 1, dtype=np.int64)
    full = [(a, b) for a, b in spans if b > a]
    if full and len(offsets):
        first = np.searchsorted(offsets[:, 1], [a for a, _ in full], side="right")
        last = np.searchsorted(offsets[:, 0], [b for _, b in full], side="left")
        np.add.at(mask, first, 1)
        np.add.at(mask, last, -1)
    return np.cumsum(mask)[:-1] > 0


def masked_spans(offsets: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs of the text under the mask, from the tokens alone."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return [(int(offsets[a, 0]), int(offsets[b - 1, 1])) for a, b in zip(edges[::2], edges[1::2])]


def load_tokenizer(model: str):
    """A byte-level tokenizer from its JSON, with the marks as tokens of their own and offsets that keep white space."""
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_str(model)
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
    tokenizer.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in MARKS])
    return tokenizer


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    *,
    tokenizer_path: str = TOKENIZER,
    segment_chars: int = 1 << 20,
) -> DataFrame:
    """Rendered and encoded conversations: ``(conv_id, segment, n_turns, formatted, token_ids, token_starts, token_ends,
    loss_mask)``.

    A conversation is one row, or several numbered segments of whole turns if its text is longer than ``segment_chars``;
    offsets are code points within the segment's text. Rows go by turn (null first), then role, then text; repeated rows
    are turns of their own. A null role or text is empty. Rows with a null conversation form one conversation. An empty
    table gives no rows. Other columns are not read. Segments of a conversation lie in one partition, in order.
    """
    spark = turns.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())  # the size of a vocabulary, whatever the input
    source = only(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    schema = T.StructType(
        [T.StructField("conv_id", source.schema["conv_id"].dataType)]
        + T._parse_datatype_string(
            "segment long, n_turns long, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"
        ).fields
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(model.value)
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        rows: list[tuple] = []

        def segment(conv, number, some) -> tuple:
            formatted, spans = render(some)
            encoded = tokenizer.encode(formatted, add_special_tokens=False)
            offsets = np.array(encoded.offsets, dtype=np.int64).reshape(-1, 2)
            mask = mask_tokens(offsets, spans)
            return conv, number, len(some), formatted, encoded.ids, offsets[:, 0], offsets[:, 1], mask

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
            rows.clear()
            return batch

        conv, number, some, size, waiting, begun = None, 0, [], 0, 0, False
        for batch in batches:
            for c, r, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                r, t = r or "", t or ""
                if begun and (c != conv or size > segment_chars):
                    rows.append(segment(conv, number, some))
                    waiting += size
                    number, some, size = (number + 1 if c == conv else 0), [], 0
                    if waiting > 1 << 22:
                        yield out()
                        waiting = 0
                conv, begun = c, True
                some.append((r, t))
                size += len(r) + len(t)
        if begun:
            rows.append(segment(conv, number, some))
            yield out()

    dealt = source.repartition(shuffle_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """What ``format_conversations``' result says of each conversation, from its text, tokens and mask alone: ``(conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``. Segments are digested as they stream by."""
    schema = T.StructType(
        [formatted.schema["conv_id"]]
        + T._parse_datatype_string("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        state: list | None = None

        def out(rows: list) -> pa.RecordBatch:
            digests = [(c, n, t.hexdigest(), k, s.hexdigest(), m) for c, n, t, k, s, m in rows]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*digests), arrow)], schema=arrow)

        for batch in batches:
            done = []
            for row in range(len(batch)):
                conv, number, _, text, _, starts, ends, mask = (batch.column(i)[row] for i in range(8))
                if number.as_py() == 0:
                    if state:
                        done.append(state)
                    state = [conv.as_py(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = text.as_py()
                for role, said in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                offsets = np.stack([starts.values.to_numpy(), ends.values.to_numpy()], axis=1).astype(np.int64)
                under = np.array(mask.values.to_numpy(zero_copy_only=False), dtype=bool)
                for a, b in masked_spans(offsets, under):
                    said = unescape(text[a:b])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            if done:
                yield out(done)
        if state:
            yield out([state])

    return formatted.mapInArrow(run, schema)
