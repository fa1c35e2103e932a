"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: `### role:`, a line break, the text, `</turn>`, a line break. The control strings, and
the backslash that escapes them, are escaped inside texts and roles, so the rendering can be read back. It is
encoded once, with offsets; the sorted spans of assistant texts are intersected with the sorted token spans by binary
search. A token bears loss where its characters meet an assistant text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from veldoc.llm.common import small_batches

_TEXT = re.compile(r"\\|###|</turn>")
_TEXT_BACK = re.compile(r"\\(\\|###|</turn>)")
_ROLE = re.compile(r"[\\:\n]|###|</turn>")
_ROLE_BACK = re.compile(r"\\(n|[\\:]|###|</turn>)")
_TURN = re.compile(r"### ((?:[^\\\n:]+|\\n|\\.)*):\n((?:[^\\<]+|<(?!/turn>)|\\\\|\\###|\\</turn>)*)</turn>\n", re.S)


def escape(text: str) -> str:
    return _TEXT.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _TEXT_BACK.sub(r"\1", text)


def _escape_role(role: str) -> str:
    return _ROLE.sub(lambda m: "\\n" if m[0] == "\n" else "\\" + m[0], role)


def _unescape_role(role: str) -> str:
    return _ROLE_BACK.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendering, and where in it the texts of assistants stand."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {_escape_role(role)}:\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</turn>\n"]
        at += len(head) + len(body) + 8
    return "".join(parts), spans


def parse(rendered: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendering."""
    out, at = [], 0
    while m := _TURN.match(rendered, at):
        out.append((_unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(rendered):
        raise ValueError(f"no turn at character {at}")
    return out


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    found.no_truncation()
    found.no_padding()
    return found


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token (start, end) meets a span. Starts and ends of tokens ascend, as those of spans do."""
    mask = np.zeros(len(offsets), bool)
    if len(offsets) and spans:
        first = np.searchsorted(offsets[:, 1], [a for a, _ in spans], "right")
        last = np.searchsorted(offsets[:, 0], [b for _, b in spans], "left")
        for (a, b), i, j in zip(spans, first, last):
            if b > a:
                mask[i:j] = True
    return mask


def loss_text(rendered: str, offsets: np.ndarray, mask: np.ndarray, spans: list[tuple[int, int]]) -> list[str]:
    """What the mask covers of each span, unescaped: tokens cut to the span, characters that several tokens share once."""
    out = []
    for a, b in spans:
        i, j = np.searchsorted(offsets[:, 1], a, "right"), np.searchsorted(offsets[:, 0], b, "left")
        if j <= i:
            out.append("")
            continue
        low, high, used = np.maximum(offsets[i:j, 0], a), np.minimum(offsets[i:j, 1], b), mask[i:j]
        reach = np.maximum.accumulate(np.where(used, high, a))  # how far the tokens so far have come
        low = np.maximum(low, np.concatenate([[a], reach[:-1]]))
        used = used & (high > low)
        low, high = low[used], high[used]
        cuts = np.flatnonzero(low[1:] != high[:-1]) + 1  # pieces that follow each other are one
        pieces = zip(low[np.concatenate([[0], cuts])].tolist(), high[np.concatenate([cuts - 1, [-1]])].tolist()) if len(low) else ()
        out.append(unescape("".join([rendered[x:y] for x, y in pieces])))
    return out


def format_chats(df: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, token_ids, token_starts, token_ends, loss, span_starts, span_ends): one row for each conversation.

    Turns go by number, null ones first, then role and text; repeated rows stay. A null role or text is empty. A null
    conversation id is a conversation of its own. A conversation is one training example and so is made whole in one task;
    conversations are spread by id. Only the four columns named are read.
    """
    small_batches(df.sparkSession)
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = df.groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    chats = chats.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _tokenizer(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                made = [render(list(zip(r, t))) for r, t in zip(part.column("roles").to_pylist(), part.column("texts").to_pylist())]
                found = model.encode_batch([m[0] for m in made], add_special_tokens=False)
                sizes = [len(e) for e in found]
                places = [np.fromiter(chain.from_iterable(e.offsets), np.int32, 2 * n).reshape(-1, 2) for e, n in zip(found, sizes)]
                masks = [loss_mask(p, spans) for p, (_, spans) in zip(places, made)]
                ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.int32, sum(sizes))
                flat = np.concatenate(places)
                tokens = [pa.array(ids), pa.array(flat[:, 0]), pa.array(flat[:, 1]), pa.array(np.concatenate(masks))]
                spans = [pa.array([x[k] for _, s in made for x in s], pa.int32()) for k in (0, 1)]
                ends = [pa.array(np.cumsum([0, *n]), pa.int32()) for n in (sizes, [len(s) for _, s in made])]
                lists = [pa.ListArray.from_arrays(ends[0], x) for x in tokens] + [pa.ListArray.from_arrays(ends[1], x) for x in spans]
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array([m[0] for m in made], pa.string()), *lists], ["conv_id", "formatted", "token_ids", "token_starts", "token_ends", "loss", "span_starts", "span_ends"])

    schema = "conv_id long, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss array<boolean>, span_starts array<int>, span_ends array<int>"
    return chats.mapInArrow(encode, schema)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, read back from the output, of each conversation of `conversations` and of conversation -7. Null roles and
    texts count as empty, rows without a conversation id as one conversation, repeated rows as turns."""
    import public_tokenizers

    own = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], own.schema)
    chats = format_chats(own.union(extra), public_tokenizers.path("byte_bpe_50k.json"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            out = []
            for conv, text, starts, ends, mask, a, z in zip(b["conv_id"], b["formatted"], b["token_starts"], b["token_ends"], b["loss"], b["span_starts"], b["span_ends"]):
                turns = parse(text)
                loss = "".join(loss_text(text, np.stack([starts, ends], axis=1), mask, list(zip(a.tolist(), z.tolist()))))
                out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return chats.mapInPandas(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
