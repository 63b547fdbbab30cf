"""Chat formatting over a prefix tree of conversations.

Template: ``### <role>:`` newline, the text, `` </turn>`` newline. Inside roles and texts
a backslash comes before every backslash and before each control string, so the marks of
the template can always be told from text, and the original comes back exactly.

Prefix tree: a node is a sequence of initial turns (named by a chained 128-bit digest).
Conversations that share initial turns share nodes. Every node is owned by the smallest
conversation that reaches it, children come in order of their owners, and nodes are
emitted once, depth first. Ownership makes each conversation's own nodes one unbranched
stretch (a chain), emitted without a gap, so a node's ancestors are few intervals: one
per chain on its path.

Outputs of ``build``:
* ``nodes``: owner, depth, role, formatted, emit_start/emit_stop (place in the emitted
  stream, in characters), position (characters before it on its own path: its first
  position id), ancestors (intervals of the stream it may attend to besides itself),
  loss_start/loss_stop (mask inside formatted; equal if the turn carries no loss).
* ``paths``: per conversation and depth, the owner of its node there.

The stream offsets come from a range sort and per-partition totals (one number per
partition on the driver), so no tree has to fit one task.

Results: turns are ordered by turn, then role, then text (null turns first); null role or
text reads as empty; rows repeated in full are turns of their own. Rows with a null
conversation id form one conversation. An empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import re
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlens.llm.common import arrow_map, stored

HEAD, STOP = "### ", " </turn>\n"
LOSS_ROLE = "assistant"
_FORMATTED = re.compile(r"### ((?:\\[\s\S]|[^\\\n])*?):\n((?:\\[\s\S]|[^\\])*?) </turn>\n")
_ESCAPED = re.compile(r"\\([\s\S])")


def escape(text: str) -> str:
    return re.sub(r"\\|###|</turn>", lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    """As texts, and colons and line ends too, which close the role."""
    return re.sub(r"\\|###|</turn>|:|\n", lambda m: "\\" + m[0], role)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted, start and stop of the text in it)."""
    head, body = f"{HEAD}{escape_role(role)}:\n", escape(text)
    return head + body + STOP, len(head), len(head) + len(body)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation; raises if it is not one."""
    out, at = [], 0
    for m in _FORMATTED.finditer(formatted):
        if m.start() != at:
            raise ValueError("text outside turns")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text outside turns")
    return out


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text under fixed types, whatever else the table holds."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _streams(batches, columns):
    """Rows of sorted Arrow batches one after another; a conversation may go on in the next batch."""
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns))


def _chunked(rows, names, kinds, size=2000):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def _numbered(turns: DataFrame) -> DataFrame:
    """Each turn with its depth, node name, formatted text and position."""
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", "depth", "node", "role", "formatted", "loss_start", "loss_stop", "position"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()]

    def run(batches):
        def rows():
            now, depth, node, position, first = None, 0, b"", 0, True
            for conv, role, text in _streams(batches, ("conv_id", "role", "text")):
                if first or conv != now:
                    now, depth, node, position, first = conv, 0, b"", 0, False
                own = f"{len(role)}:{role}{text}".encode()
                node = hashlib.blake2b(node + own, digest_size=16).digest()
                formatted, i, j = format_turn(role, text)
                yield conv, depth, node, role, formatted, i, j if role == LOSS_ROLE else i, position
                depth += 1
                position += len(formatted)

        yield from _chunked(rows(), names, kinds)

    return arrow_map(ordered, run, "conv_id long, depth int, node binary, role string, formatted string, "
                                   "loss_start int, loss_stop int, position long")


def _stream_places(chains: DataFrame) -> DataFrame:
    """(owner, emit_start) of every chain in depth-first order; ``chains``: owner, route, size."""
    ordered = stored(arrow_map(
        chains.repartitionByRange("route").sortWithinPartitions("route"), _with_part,
        "owner long, size long, part int, before long"), "chains")
    totals = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.max(F.col("before") + F.col("size")).alias("n")).collect()}
    parts = sorted(totals)                  # one row per partition
    bases = ordered.sparkSession.createDataFrame(
        list(zip(parts, accumulate((totals[p] for p in parts[:-1]), initial=0))), "part int, base long")
    return ordered.join(F.broadcast(bases), "part").select("owner", (F.col("base") + F.col("before")).alias("emit_start"))


def _with_part(batches):
    part, before = TaskContext.get().partitionId(), 0
    for b in batches:
        size = b.column("size").to_pylist()
        place = []
        for n in size:
            place.append(before)
            before += n
        yield pa.RecordBatch.from_arrays([b.column("owner"), b.column("size"), pa.array([part] * len(size), pa.int32()),
                                          pa.array(place, pa.int64())], names=["owner", "size", "part", "before"])


def build(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(nodes, paths)`` of the prefix tree; see the module text."""
    turns = stored(_numbered(turns_of(conversations)), "turns")
    key = F.coalesce("conv_id", F.lit((1 << 63) - 1))
    light = turns.select(key.alias("conv"), "depth", "node", "position", F.char_length("formatted").alias("chars"))
    # Stored, so that a node of very many conversations meets it in a join whose partitions can be split.
    owners = stored(light.groupBy("node").agg(F.min("conv").alias("owner")), "owners")
    paths = stored(light.join(owners, "node"), "paths")

    # Chains on the way to every conversation's own nodes: (where it starts, owner), from the root on.
    # Kept per conversation as its distinct owners: bounded by its own number of turns.
    steps = (paths.groupBy("conv", "owner").agg(F.min("depth").alias("depth"), F.min("position").alias("position"),
                                                F.sum("chars").alias("chars"))
             .groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "owner", "position", "chars"))).alias("steps")))
    # Depth-first order: a route that leaves a chain later comes first, then the smaller owner.
    route = F.transform("steps", lambda s: F.struct((-s["depth"]).alias("left_at"), s["owner"].alias("owner")))
    mine = steps.where(F.element_at("steps", -1)["owner"] == F.col("conv"))
    chains = mine.select(F.col("conv").alias("owner"), route.alias("route"), F.element_at("steps", -1)["chars"].alias("size"))
    places = stored(_stream_places(chains), "places")

    above = (mine.select(F.col("conv").alias("owner"), F.posexplode("steps").alias("k", "s"))
             .select("owner", "k", F.col("s.owner").alias("on"), F.col("s.chars").alias("chars"))
             .join(places.withColumnRenamed("owner", "on"), "on")
             .groupBy("owner").agg(F.sort_array(F.collect_list(F.struct(
                 "k", "emit_start", (F.col("emit_start") + F.col("chars")).alias("emit_stop")))).alias("way")))
    chain = (mine.select(F.col("conv").alias("owner"), F.element_at("steps", -1)["position"].alias("chain_position"))
             .join(above, "owner"))
    own_start = F.element_at("way", -1)["emit_start"]
    upper = F.transform(F.slice("way", F.lit(1), F.size("way") - 1), lambda w: F.struct(w["emit_start"].alias("start"), w["emit_stop"].alias("stop")))
    emit = own_start + F.col("position") - F.col("chain_position")
    own = F.when(F.col("position") > F.col("chain_position"), F.array(F.struct(own_start.alias("start"), emit.alias("stop"))))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    owned = (turns.withColumn("owner", key)
             .join(paths.where("conv = owner").select(F.col("conv").alias("owner"), "depth"), ["owner", "depth"]))
    nodes = owned.join(chain, "owner").select(
        "owner", "depth", "role", "formatted", emit.alias("emit_start"),
        (emit + F.char_length("formatted")).alias("emit_stop"), "position",
        F.concat(upper, F.coalesce(own, none)).alias("ancestors"), "loss_start", "loss_stop")
    return stored(nodes, "nodes"), paths.select(F.nullif("conv", F.lit((1 << 63) - 1)).alias("conv_id"), "depth", "owner")


def read_back(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Conversations from the emitted nodes: turns, digest of the turns, loss text, formatted length."""
    rows = (paths.join(nodes.select(F.col("owner"), "depth", "formatted", "loss_start", "loss_stop"), ["owner", "depth"])
            .repartition("conv_id").sortWithinPartitions("conv_id", "depth"))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        def rows():
            now, state = None, None
            for conv, formatted, i, j in _streams(batches, ("conv_id", "formatted", "loss_start", "loss_stop")):
                if state is None or conv != now:
                    if state:
                        yield now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse_turns(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                loss = unescape(formatted[i:j])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(formatted)
            if state:
                yield now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        yield from _chunked(rows(), names, kinds)

    return arrow_map(rows, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                "loss_sha256 string, formatted_chars long")
