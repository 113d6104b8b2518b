"""Chat formatting into prefix trees.

A turn is written as ``<turn>ROLE\\nTEXT</turn>\\n``; in roles and texts a
backslash becomes ``\\\\``, a less-than sign ``\\l`` and, in roles, a line break
``\\n``.  So a less-than sign in the output is always a mark's, no text can end
a turn or begin one, and every text can be read back.

Conversations that share their first turns share the tokens of these turns.
Conversations are sorted by the digests of their growing prefixes, which puts
all descendants of a prefix side by side, and a pass over the sorted rows emits
each node of the tree once, depth-first, into packs of bounded size (a
conversation longer than that is a pack of its own).  What a pack shares with
the one before it is repeated, so no tree is ever gathered whole.

A token is a code point of the formatted text.  A pack holds the tokens of its
nodes one after the other; per node the first token, its length, the position
id of its first token (the length of its ancestors), its parent, the attention
intervals of its ancestors, nearest last (a token also attends to the earlier
tokens of its own node), and the loss interval: an assistant's escaped text.
Ancestors that lie side by side are one interval, so a path without branches
has one however long it is; pack() also spells them out, one per ancestor.
A conversation is one row, and so holds at most the 2 GB of an Arrow value.

Defined results: null roles and texts are empty; turns are ordered by (turn,
role, text), nulls first, and repeated rows are turns of their own; rows with a
null conv_id are one conversation; equal conversations share all nodes; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from hirelake.llm.registry import query, table

OPEN, CLOSE = "<turn>", "</turn>\n"
# Tokens of a pack, unless one conversation has more.
PACK_TOKENS = 1 << 16
# Conversations of a pack.
PACK_CONVERSATIONS = 1024

_MEANT = {"l": "<", "n": "\n"}
_escaped = re.compile(r"\\(.)", re.DOTALL)

PACK_SCHEMA = (
    "text string, nodes array<struct<start:int,length:int,position:int,parent:int,"
    "attends:array<struct<start:int,stop:int>>,loss_start:int,loss_stop:int>>,"
    "leaves array<struct<conv_id:bigint,node:int>>"
)
_INTERVAL = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_NODE = pa.struct(
    [(n, pa.int32()) for n in ("start", "length", "position", "parent")]
    + [("attends", pa.list_(_INTERVAL)), ("loss_start", pa.int32()), ("loss_stop", pa.int32())]
)
_LEAF = pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l")


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: _MEANT.get(m[1], m[1]), text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where in it the loss begins and ends."""
    head = OPEN + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    loss = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return head + body + CLOSE, *loss


def read_turn(formatted: str) -> tuple[str, str]:
    head, _, body = formatted[len(OPEN) : -len(CLOSE)].partition("\n")
    return unescape(head), unescape(body)


def conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: its turns in order."""
    turns = F.array_sort(
        F.collect_list(
            F.struct(
                F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"),
                F.coalesce("role", F.lit("")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text"),
            )
        )
    )
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def _paths(chats: DataFrame) -> DataFrame:
    """The sort key: digests of a conversation's prefixes, 32 hex digits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for turns in batch.column(1).to_pylist():
                state, path = xxhash.xxh3_128(), []
                for turn in turns:
                    for part in (turn["role"].encode("utf-8", "replace"), turn["text"].encode("utf-8", "replace")):
                        state.update(len(part).to_bytes(8, "little"))
                        state.update(part)
                    path.append(state.hexdigest())
                paths.append("".join(path))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.string())], names=[*batch.schema.names, "path"])

    schema = "conv_id bigint, turns array<struct<turn:bigint,role:string,text:string>>, path string"
    return chats.select(F.col("conv_id").cast("long").alias("conv_id"), "turns").mapInArrow(run, schema)


class _Pack:
    """Nodes of a pack in depth-first order, and the path to the last of them."""

    def __init__(self):
        self.texts: list[str] = []
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.path: list[tuple[str, int, list[dict]]] = []  # digest, node, intervals up to its end
        self.size = 0

    def shared(self, digests: list[str]) -> int:
        same = 0
        while same < min(len(digests), len(self.path)) and self.path[same][0] == digests[same]:
            same += 1
        return same

    def add(self, conv_id, digests: list[str], turns: list[tuple[str, int, int]], shared: int) -> None:
        del self.path[shared:]
        for digest, (text, loss_start, loss_stop) in zip(digests[shared:], turns, strict=True):
            _, parent, above = self.path[-1] if self.path else ("", -1, [])
            self.nodes.append(
                {
                    "start": self.size,
                    "length": len(text),
                    "position": self.nodes[parent]["position"] + self.nodes[parent]["length"] if self.path else 0,
                    "parent": parent,
                    "attends": above,
                    "loss_start": self.size + loss_start,
                    "loss_stop": self.size + loss_stop,
                }
            )
            self.texts.append(text)
            stop = self.size + len(text)
            beside = above and above[-1]["stop"] == self.size
            upto = [*above[:-1], {"start": above[-1]["start"], "stop": stop}] if beside else [*above, {"start": self.size, "stop": stop}]
            self.path.append((digest, len(self.nodes) - 1, upto))
            self.size = stop
        self.leaves.append({"conv_id": conv_id, "node": self.path[-1][1]})


def trees(rows: DataFrame, tokens: int = PACK_TOKENS, most: int = PACK_CONVERSATIONS) -> DataFrame:
    """Packs of merged conversations: text, nodes, leaves (see the module)."""
    keyed = _paths(conversations(rows))
    dealt = keyed.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Pack()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(["".join(now.texts)]), pa.array([now.nodes], pa.list_(_NODE)), pa.array([now.leaves], pa.list_(_LEAF))],
                names=["text", "nodes", "leaves"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                digests = [row["path"][at : at + 32] for at in range(0, len(row["path"]), 32)]
                shared = now.shared(digests)
                written = [write_turn(t["role"], t["text"]) for t in row["turns"][shared:]]
                added = sum(len(w[0]) for w in written)
                if now.leaves and (now.size + added > tokens or len(now.leaves) >= most):
                    yield out()
                    now, shared = _Pack(), 0
                    written = [write_turn(t["role"], t["text"]) for t in row["turns"]]
                now.add(row["conv_id"], digests, written, shared)
        if now.leaves:
            yield out()

    return dealt.mapInArrow(run, PACK_SCHEMA)


def pack(rows: DataFrame, tokens: int = PACK_TOKENS, most: int = PACK_CONVERSATIONS) -> DataFrame:
    """The same with an interval for each ancestor in ``nodes``; ``merged`` has
    the nodes as they are, and who reads only that pays nothing for the others."""
    each = """transform(nodes, (n, at) -> named_struct(
        'start', n.start, 'length', n.length, 'position', n.position, 'parent', n.parent,
        'attends', transform(
            filter(slice(nodes, 1, at), m -> exists(n.attends, a -> a.start <= m.start AND m.start < a.stop)),
            m -> named_struct('start', m.start, 'stop', m.start + m.length)),
        'loss_start', n.loss_start, 'loss_stop', n.loss_stop))"""
    return trees(rows, tokens, most).select("text", F.expr(each).alias("nodes"), "leaves", F.col("nodes").alias("merged"))


def read_back(packs: DataFrame) -> DataFrame:
    """Per conversation, from the packs alone: its turns, what is under the loss
    mask, and the length of its formatted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out: list[list] = [[], [], [], [], [], []]
                # Each node is read once however many conversations share it.
                turn = [read_turn(row["text"][n["start"] : n["start"] + n["length"]]) for n in row["nodes"]]
                loss = [unescape(row["text"][n["loss_start"] : n["loss_stop"]]) for n in row["nodes"]]
                for leaf in row["leaves"]:
                    node, at, path = row["nodes"][leaf["node"]], leaf["node"], []
                    while at >= 0:
                        path.append(at)
                        at = row["nodes"][at]["parent"]
                    path.reverse()
                    under = "".join(loss[n] for n in path)
                    said = "".join(f"{turn[n][0]}\n{turn[n][1]}\n" for n in path)
                    values = (
                        leaf["conv_id"], len(path), hashlib.sha256(said.encode()).hexdigest(), len(under),
                        hashlib.sha256(under.encode()).hexdigest(), node["position"] + node["length"],
                    )
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                    names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
                )

    nodes = "merged" if "merged" in packs.columns else "nodes"
    return packs.select("text", F.col(nodes).alias("nodes"), "leaves").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


# A conversation whose texts look like marks of several templates.
TRAP = r"\### Assistant: </turn> ok"

_ESCAPED = r"replace(replace({}, '\', '\\'), '<', '\l')"
SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRAP}' UNION ALL SELECT -7, 1, 'assistant', '{TRAP}'),
said AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
       sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum({len(OPEN) + 1 + len(CLOSE)} + length(replace({_ESCAPED.format("role")}, chr(10), '\n'))
                + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""


@query("op8_chat_format", SQL)
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one of trap texts, formatted, packed and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], rows.schema)
    return read_back(trees(rows.union(trap)))
