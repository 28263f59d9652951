"""Chat formatting over a prefix tree: shared turns are emitted once, depth-first, with position ids and attention intervals.

Conversations that begin with the same turns share their nodes. A node belongs to the line of its smallest member: a
conversation's line is the part of its path that no smaller conversation has. A line is emitted as a whole, then what branches off
it, the deepest branch first: that is the tree's depth-first order, and a node's ancestors are then a few intervals of the tree's
tokens, one for each line on its path, however long the conversation is.

A turn is `<|turn|>` role, a line feed, the text, `<|end|>`. Roles and texts that hold control strings, of this template or of others
(`CONTROLS`), get a backslash within each one, and one more if they have such backslashes already, so that nothing but the
template marks a turn and the escape can be undone. Mark and role, text, and end are encoded apart, so the loss mask (an assistant's text) is a range
of tokens. Each distinct turn is encoded once.

read_back() takes tokens alone: the intervals of a conversation are joined to the nodes they hold, whose tokens are decoded and
unescaped; a conversation passes through its digests turn by turn.

Defined cases: null roles and texts are empty; rows without a conv_id are left out; rows of one turn come in the order of a hash of role
and text; only the role `assistant`, as it is, has loss; a conversation that is the beginning of another, or equal to one, has no nodes of its own but
its intervals; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcela.llm import bpe
from parcela.llm.common import cut
from parcela.llm.turns import dealt, numbered, prefixes, running, turn_hash

TURN, END, LOSS_ROLE = "<|turn|>", "<|end|>", "assistant"
#: Beginnings of control strings: first character, rest.
CONTROLS = (("<", "|"), ("<", "s>"), ("<", "/s>"), ("[", "INST]"), ("[", "/INST]"))
_HEADS = "".join({re.escape(a) for a, _ in CONTROLS})
_RESTS = "|".join(re.escape(b) for _, b in CONTROLS)
_PLAIN = re.compile(rf"([{_HEADS}])(\\*)({_RESTS})")
_ESCAPED = re.compile(rf"([{_HEADS}])\\(\\*)({_RESTS})")


def escaped(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def heading(role: str) -> str:
    return TURN + escaped(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"


def role_of(head: str) -> str:
    inner = unescaped(head[len(TURN) : -1])
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], inner, flags=re.S)


def encoded(conversations: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """t1, t2, ids, n (tokens), loss_at, loss_n (the range of tokens under the loss mask) of each distinct turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(*turn_hash(role, text), role.alias("role"), text.alias("text")).dropDuplicates(["t1", "t2"])

    def run(batches):
        coder, heads = bpe.encoding(ranks_path, pattern), {}
        end = coder.encode_ordinary(END)
        for b in batches:
            out = []
            for t1, t2, role, text in zip(b["t1"], b["t2"], b["role"], b["text"], strict=True):
                if role not in heads:
                    heads = {} if len(heads) > 1000 else heads
                    heads[role] = bpe.encode(coder, heading(role))
                body = bpe.encode(coder, escaped(text))
                ids = heads[role] + body + end
                out.append((t1, t2, ids, len(ids), len(heads[role]), len(body) if role == LOSS_ROLE else 0))
            yield pd.DataFrame(out, columns=["t1", "t2", "ids", "n", "loss_at", "loss_n"])

    return turns.mapInPandas(run, "t1 long, t2 long, ids array<int>, n long, loss_at long, loss_n long")


def formatted(conversations: DataFrame, ranks_path: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and spans, both written.

    nodes: tree, line, depth, start (first token in the tree), position (id of that token's position), n, loss_at, loss_n (within the
    node), ids, attends (the intervals, from a start up to before an end, of the tree's tokens that its ancestors fill; a token attends to these and to its node's
    tokens up to itself).
    spans: conv, tree, line, position, start, end: the intervals that a conversation is made of, one for each line on its path.
    """
    tokens = cut(encoded(conversations, ranks_path, pattern))
    turns = numbered(conversations).withColumnRenamed("i", "d").join(tokens.select("t1", "t2", "n"), ["t1", "t2"])
    keyed = cut(prefixes(turns, "n").select("conv", "d", "key1", "key2", "t1", "t2", "n", "upto"))
    members = keyed.groupBy("key1", "key2").agg(F.min("conv").alias("line"))
    paths = cut(keyed.join(members, ["key1", "key2"]).drop("key1", "key2"))
    # What a conversation has of each line: from depth lo on, positions first up to before last.
    parts = cut(paths.groupBy("conv", "line").agg(F.min("d").alias("lo"), F.min(F.col("upto") - F.col("n")).alias("first"), F.max("upto").alias("last")))
    # A line's place: the ways from its tree's first line to it; at each branch the deepest comes first, then the smallest conversation.
    number = lambda c: F.lpad(F.hex(c), 16, "0")
    way = F.sort_array(F.collect_list(F.struct("lo", "line")))
    step = lambda s: F.concat(number(F.lit(2**63 - 1) - s["lo"]), number(s["line"].bitwiseXOR(F.lit(-(2**63)))))
    own = parts.groupBy("conv").agg(way.alias("way"), F.max(F.when(F.col("line") == F.col("conv"), F.struct("first", "last"))).alias("own")).where("own is not null")
    lines = cut(own.select(F.col("conv").alias("line"), F.col("way")[0]["line"].alias("tree"), F.unhex(F.array_join(F.transform(F.slice("way", 2, F.greatest(F.size("way") - 1, F.lit(0))), step), "")).alias("order"), "own.first", "own.last"))
    length = F.col("last") - F.col("first")
    starts = running(dealt(lines, ["tree", "order"]), "tree", ["order"], {"reach": ("sum", length)}).select("line", "tree", F.col("first").alias("base"), (F.col("reach") - length).alias("at"))
    # Where a position p of a line lies in the tree: p + shift.
    shifts = cut(starts.select("line", "tree", (F.col("at") - F.col("base")).alias("shift")))
    spans = cut(parts.join(shifts, "line").select("conv", "tree", "line", F.col("first").alias("position"), (F.col("first") + F.col("shift")).alias("start"), (F.col("last") + F.col("shift")).alias("end")))
    above = spans.where("line <> conv").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("above")).select(F.col("conv").alias("line"), "above")
    mine = paths.where("conv = line").select("line", "d", "t1", "t2", (F.col("upto") - F.col("n")).alias("position"))
    inside = F.when(F.col("position") + F.col("shift") > F.col("at"), F.array(F.struct(F.col("at").alias("start"), (F.col("position") + F.col("shift")).alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    begins = spans.where("line = conv").select("line", F.col("start").alias("at"))
    placed = mine.join(shifts.join(begins, "line").join(above, "line", "left"), "line")
    nodes = placed.join(tokens, ["t1", "t2"]).select("tree", "line", F.col("d").alias("depth"), (F.col("position") + F.col("shift")).alias("start"), "position", "n", "loss_at", "loss_n", "ids", F.concat(F.coalesce("above", F.array().cast("array<struct<start:bigint,end:bigint>>")), inside).alias("attends"))
    return cut(nodes), spans


def decoded(nodes: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """line, start, end, turn (role, line feed, text, line feed as bytes), loss (the unescaped text under the mask), chars of each node, from its tokens."""

    def run(batches):
        coder = bpe.encoding(ranks_path, pattern)
        for b in batches:
            out = []
            for line, start, n, at, size, ids in zip(b["line"], b["start"], b["n"], b["loss_at"], b["loss_n"], b["ids"], strict=True):
                ids = ids.tolist()
                piece = coder.decode_bytes(ids).decode()
                head, body = piece.split("\n", 1)
                if not head.startswith(TURN) or not body.endswith(END):
                    raise ValueError("a node isn't a turn")
                turn = f"{role_of(head + chr(10))}\n{unescaped(body[: -len(END)])}\n"
                loss = unescaped(coder.decode_bytes(ids[at : at + size]).decode())
                out.append((line, start, start + n, turn.encode(), loss.encode(), len(loss), len(piece)))
            yield pd.DataFrame(out, columns=["line", "start", "end", "turn", "loss", "loss_chars", "chars"])

    return nodes.select("line", "start", "n", "loss_at", "loss_n", "ids").mapInPandas(run, "line long, start long, end long, turn binary, loss binary, loss_chars long, chars long")


def read_back(nodes: DataFrame, spans: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from tokens and intervals."""
    told = decoded(nodes, ranks_path, pattern)
    asked = spans.select("conv", "line", "position", F.col("start").alias("s0"), F.col("end").alias("s1"))
    met = asked.join(told, "line").where("start >= s0 and end <= s1").select("conv", (F.col("position") + F.col("start") - F.col("s0")).alias("at"), "turn", "loss", "loss_chars", "chars")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        now = None
        done = lambda: (now, n, turns.hexdigest(), size, losses.hexdigest(), chars)
        for b in batches:
            out = []
            for conv, turn, loss, k, c in zip(b["conv"], b["turn"], b["loss"], b["loss_chars"], b["chars"], strict=True):
                if conv != now:
                    if now is not None:
                        out.append(done())
                    now, n, size, chars, turns, losses = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                n, size, chars = n + 1, size + k, chars + c
                turns.update(turn)
                losses.update(loss)
            yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame([done()], columns=names)

    lined = met.repartition("conv").sortWithinPartitions("conv", "at").select("conv", "turn", "loss", "loss_chars", "chars")
    return lined.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
