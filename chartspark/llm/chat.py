"""Chat formatting on token level: segments encoded apart, reserved ids spliced in, masks by prefix sums.

Reserved ids lie behind the vocabulary, so no text can produce them. Each stands for a control string of the template. A
control string that occurs in a text gets an escape sign after its first character, and the sign itself is doubled, so the
formatted text holds control strings only where the template put them and unescaping restores every text.

Turns are encoded where they are. Each conversation is then ordered within one partition and streamed through: positions and
mask are running sums, so memory does not grow with a conversation's length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspark.llm import arrays

# fixed values: the control strings
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>")
ESCAPE = "\\"

#: For each role what opens and closes its turns; any other role is named inside the turn.
TEMPLATE = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n\n"),
    "user": ("<s>[INST] ", " [/INST]"),
    "assistant": (" ", " </s>"),
}
OTHER = ("<<ROLE>>", "<</ROLE>> ", "\n")
#: Strings of the reserved ids, in the order of their numbers.
RESERVED = (*(s for pair in TEMPLATE.values() for s in pair), *OTHER)
LOSS_ROLE = "assistant"

_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))) + "|" + re.escape(ESCAPE))
_ESCAPED = re.compile(re.escape(ESCAPE) + "(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class _Codec:
    """The tokenizer and the numbers of the reserved ids."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.base = max(self.tokenizer.get_vocab().values()) + 1
        self.opens = {role: self.base + 2 * i for i, role in enumerate(TEMPLATE)}
        self.closes = {role: number + 1 for role, number in self.opens.items()}
        self.named, self.name_ends, self.other_ends = (self.base + 2 * len(TEMPLATE) + i for i in range(3))
        self.roles = {number: role for role, number in self.opens.items()}

    def turns(self, roles: list[str], texts: list[str]) -> list[np.ndarray]:
        """Ids of each turn: opening id, content, closing id."""
        found = self.tokenizer.encode_batch_fast([escape(t) for t in texts], add_special_tokens=False)
        out = []
        for role, content in zip(roles, found):
            if role in self.opens:
                out.append(np.array([self.opens[role], *content.ids, self.closes[role]], np.int64))
            else:
                name = self.tokenizer.encode(escape(role), add_special_tokens=False).ids
                out.append(np.array([self.named, *name, self.name_ends, *content.ids, self.other_ends], np.int64))
        return out

    def mask(self, ids: np.ndarray) -> np.ndarray:
        """1 between an opening and a closing id of the loss role: a running sum of openings before and closings up to each place."""
        opened = np.cumsum(ids == self.opens[LOSS_ROLE]) - (ids == self.opens[LOSS_ROLE])
        return opened - np.cumsum(ids == self.closes[LOSS_ROLE])

    def text(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)

    def formatted(self, ids: np.ndarray) -> str:
        """The turn as the template writes it."""
        places = np.flatnonzero(ids >= self.base).tolist()
        out, start = [], 0
        for p in places:
            out += [self.text(ids[start:p]) if p > start else "", RESERVED[ids[p] - self.base]]
            start = p + 1
        return "".join(out)

    def read(self, ids: np.ndarray) -> tuple[str, str]:
        """(role, text) of a turn."""
        if ids[0] in self.roles:
            return self.roles[ids[0]], unescape(self.text(ids[1:-1]))
        end = int(np.flatnonzero(ids == self.name_ends)[0])
        return unescape(self.text(ids[1:end])), unescape(self.text(ids[end + 1 : -1]))


def _codec(path: str) -> _Codec:
    cache = arrays.worker_cache("tokens")
    if ("chat", path) not in cache:
        cache["chat", path] = _Codec(path)
    return cache["chat", path]


def format_turns(
    turns: DataFrame, tokenizer: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per turn: conv_id, place (number in its conversation), start (ids of the conversation before it), ids, mask.

    Rows of a conversation lie in one partition, in order. Turns follow their turn number, null first; ties follow role and
    text, and repeated rows are turns each. Null role and text count as empty; rows without conv_id form one conversation.
    Other columns are ignored.
    """
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "body"))])
    kind = turns.schema[conv_id].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer)
        for batch in batches:
            ids = codec.turns(batch.column("role").to_pylist(), batch.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, arrays.lists(ids, pa.int64())], names=[*batch.schema.names, "ids"])

    ordered = rows.mapInArrow(encoded, f"conv_id {kind}, turn {turns.schema[turn].dataType.simpleString()}, role string, body string, ids array<bigint>")
    ordered = ordered.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "body").select("conv_id", "ids")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer)
        last, place, start = object(), 0, 0
        for batch in batches:
            places, starts, masks = [], [], []
            for conv, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = ids.values.to_numpy()
                if conv != last:
                    last, place, start = conv, 0, 0
                places.append(place)
                starts.append(start)
                masks.append(codec.mask(own))
                place, start = place + 1, start + len(own)
            columns = [batch.column(0), pa.array(places, pa.int64()), pa.array(starts, pa.int64()), batch.column(1), arrays.lists(masks, pa.int8())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "place", "start", "ids", "mask"])

    return ordered.mapInArrow(placed, f"conv_id {kind}, place bigint, start bigint, ids array<bigint>, mask array<tinyint>")


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """One row per conversation from its ids and masks: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Needs the rows as format_turns leaves them, or as files written from it: they are put in order again within partitions.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    rows = formatted.select("conv_id", "place", "ids", "mask").repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "place")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer)
        last, state, out = object(), None, []
        for batch in batches:
            for conv, ids, mask in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if state is None or conv != last:
                    if state is not None:
                        out.append(state)
                    last, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                own = ids.values.to_numpy()
                role, text = codec.read(own)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                under = own[mask.values.to_numpy().astype(bool)]
                loss = unescape(codec.text(under)) if len(under) else ""
                state[3] += len(loss)
                state[4].update(loss.encode("utf-8", "surrogatepass"))
                state[5] += len(codec.formatted(own))
            if len(out) > 1000:
                yield _digest_rows(out, batch.schema.field(0).type)
                out = []
        if state is not None:
            yield _digest_rows([*out, state], batch.schema.field(0).type)

    return rows.mapInArrow(digests, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _digest_rows(states: list[list], kind: pa.DataType) -> pa.RecordBatch:
    done = [[c, n, t.hexdigest(), k, l.hexdigest(), f] for c, n, t, k, l, f in states]
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names=names)
