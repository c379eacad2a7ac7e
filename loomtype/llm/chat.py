"""Chat formatting into prefix trees: turns that conversations share at their beginning are emitted once."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved, small_batches
from .textbytes import runs
from .tokencounts import byte_alphabet
from .wordcache import WordIds

BEGIN, END = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    """Put a backslash into every ``<|`` so that no control string is left; longer forms get one more."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


@dataclass
class PrefixTrees:
    """``nodes``: a row for each distinct sequence of initial turns. ``turns``: where each conversation's turns are.

    A tree is all that begins with one first turn; its stream holds its nodes depth first. A node has its place there
    (``start``, ``stop``), the position id of its first token, the intervals of the stream that its tokens attend to
    besides their own predecessors in the node (its ancestors), its token ids (little-endian unsigned 32-bit) and the
    part of them that bears loss.
    """

    nodes: DataFrame
    turns: DataFrame


#: A chain of turns is known by two polynomials of its turns' digests modulo this prime, which parts of it compose.
PRIME = 2**61 - 1
BASES = (0x1B873593CC9E2D51 % PRIME, 0x0E6546B64B2AE3D1 % PRIME)


def turn_digest(role: str, text: str) -> tuple[int, int]:
    one = hashlib.md5(role.encode("utf-8", "surrogatepass")).digest() + hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
    whole = hashlib.md5(one).digest()
    return int.from_bytes(whole[:8], "little") % PRIME, int.from_bytes(whole[8:], "little") % PRIME


def node_name(a: int, b: int) -> str:
    return f"{a:016x}{b:016x}"


LAID = "conv_id long, role string, text string, part int, local long, a long, b long, before_a long, before_b long, root string"
PLACES = "conv_id long, depth long, node string, parent string, tree string"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number sorted rows within their conversations, as far as this task holds them, and chain their digests."""
    part = TaskContext.get().partitionId()
    current: object = ()
    local, a, b, root = 0, 0, 0, ""
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if conv != current:
                current, local, a, b = conv, 0, 0, 0
            one, two = turn_digest(role, text)
            before = a, b
            a, b = (a * BASES[0] + one) % PRIME, (b * BASES[1] + two) % PRIME
            if not local:
                root = node_name(a, b)
            for column, value in zip(out, (local, a, b, *before, root)):
                column.append(value)
            local += 1
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("role"), batch.column("text"), pa.array([part] * batch.num_rows, pa.int32()),
             *(pa.array(c, pa.int64()) for c in out[:5]), pa.array(out[5], pa.string())], [f.split()[0] for f in LAID.split(", ")])


def _bases(laid: DataFrame) -> dict[int, tuple[object, int, int, int, str]]:
    """What precedes a task's first conversation: {part: (conv_id, turns, a, b, root)}, two rows a task at most."""
    ends = laid.groupBy("conv_id", "part").agg(F.max_by(F.struct("local", "a", "b", "root"), "local").alias("e"))
    several = ends.withColumn("n", F.count("*").over(Window.partitionBy("conv_id"))).where("n > 1").orderBy("conv_id", "part")
    out: dict[int, tuple[object, int, int, int, str]] = {}
    last: tuple[object, int, int, int, str] | None = None
    for r in several.select("conv_id", "part", "e.*").collect():
        n = r["local"] + 1
        if last is None or last[0] != r["conv_id"]:
            last = (r["conv_id"], n, r["a"], r["b"], r["root"])
            continue
        out[r["part"]] = last
        a, b = (last[2] * pow(BASES[0], n, PRIME) + r["a"]) % PRIME, (last[3] * pow(BASES[1], n, PRIME) + r["b"]) % PRIME
        last = (r["conv_id"], last[1] + n, a, b, last[4])
    return out


def _places(bases: dict, batch: pa.RecordBatch) -> list[pa.Array]:
    """``PLACES`` of a batch of numbered rows."""
    out: list[list] = [[], [], [], []]
    columns = (batch.column(c).to_pylist() for c in ("conv_id", "part", "local", "a", "b", "before_a", "before_b", "root"))
    for conv, part, local, a, b, before_a, before_b, root in zip(*columns):
        base = bases.get(part)
        depth = local
        if base is not None and base[0] == conv:
            depth, root = local + base[1], base[4]
            up, up_b = pow(BASES[0], local, PRIME), pow(BASES[1], local, PRIME)
            before_a, before_b = (base[2] * up + before_a) % PRIME, (base[3] * up_b + before_b) % PRIME
            a, b = (base[2] * up * BASES[0] + a) % PRIME, (base[3] * up_b * BASES[1] + b) % PRIME
        for column, value in zip(out, (depth, node_name(a, b), node_name(before_a, before_b) if depth else None, root)):
            column.append(value)
    return [batch.column("conv_id"), pa.array(out[0], pa.int64()), *(pa.array(c, pa.string()) for c in out[1:])]


NODE = ("node string, parent string, tree string, depth long, role string, ids binary, n_tokens long, loss_from long, loss_to long, "
        "first_conv long, weight long")


def prefix_trees(conversations: DataFrame, tokenizer_path: str, loss_role: str = "assistant", parts: int | None = None) -> PrefixTrees:
    """Merge conversations that share initial turns.

    Every turn is formatted as begin mark, role, line end, text, end mark, line end; control strings inside texts
    are escaped reversibly. A node's identity is a digest of its chain of turns, which composes, so a conversation of
    any length is numbered and chained in several range partitions (``parts``: their number). A first turn that a
    third of all conversations share is one node after a partial aggregation.

    The order is depth first, at every node the child with most conversations first. So the path of such children is
    one run of the stream, and a path from the root leaves such runs at most log2(conversations) times: that bounds a
    node's sort key and its list of ancestor intervals, however long conversations are. Rows are range-partitioned and
    sorted by the key, and a node's start is its partition's start in the tree plus a running sum.

    Rows of a conversation are ordered by turn (null first), then role, then text; null roles and texts are empty;
    repeated rows are turns of their own; rows without a conversation id form one conversation with a null id; an
    empty table gives no nodes; other columns are dropped, whatever their names.
    """
    small_batches(conversations.sparkSession)
    base = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64)]
    ranged = base.repartitionByRange(parts, *order) if parts else base.repartitionByRange(*order)
    laid = saved(ranged.sortWithinPartitions(*order, "role", "text").select("conv_id", "role", "text").mapInArrow(_numbered, LAID))
    bases = _bases(laid)
    names = [f.split()[0] for f in PLACES.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(_places(bases, batch), names)

    def place_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*_places(bases, batch), batch.column("role"), batch.column("text")], [*names, "role", "text"])

    rows = saved(laid.drop("role", "text").mapInArrow(place, PLACES))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer_path)
        for whole in batches:
            for batch, texts in runs(whole, "text"):
                roles = batch.column("role").to_pylist()
                coded = words.encode([x for role, text in zip(roles, texts) for x in (f"{BEGIN}{escape_role(role)}\n", escape(text), f"{END}\n")])
                ids = [np.concatenate(coded[i : i + 3]) for i in range(0, len(coded), 3)]
                head = np.array([len(coded[i]) for i in range(0, len(coded), 3)], np.int64)
                body = np.array([len(coded[i + 1]) for i in range(0, len(coded), 3)], np.int64)
                body *= np.array([r == loss_role for r in roles], bool)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("node", "parent", "tree", "depth", "role")),
                     pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array(head), pa.array(head + body), batch.column("first_conv"), batch.column("weight")], [f.split()[0] for f in NODE.split(", ")])

    distinct = laid.mapInArrow(place_texts, PLACES + ", role string, text string").groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("parent", "tree", "depth", "role", "text")], F.min("conv_id").alias("first_conv"), F.count("*").alias("weight"))
    nodes = saved(distinct.mapInArrow(encode, NODE))

    heavy = nodes.where("depth > 0").groupBy("parent").agg(F.max(F.struct("weight", "node"))["node"].alias("heavy"))
    light = saved(nodes.where("depth > 0").select("node", "parent").join(heavy, "parent").where("node <> heavy").select("node", "parent"))
    left = saved(rows.select("conv_id", "depth", "node").join(light, "node"))
    steps = left.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("steps"))
    above = "filter(coalesce(steps, array()), x -> x.depth <= depth)"
    key = F.expr(f"concat(array_join(transform({above}, x -> concat('1', lpad(hex(4294967296 - x.depth), 9, '0'), x.node)), ''), '0', lpad(hex(depth), 9, '0'))")
    own = nodes["first_conv"].eqNullSafe(steps["conv_id"])
    keyed = nodes.join(steps, own, "left").withColumn("key", key).drop("conv_id", "steps", "weight")
    sorted_ = saved(keyed.repartitionByRange("tree", "key").withColumn("part", F.spark_partition_id()))
    sums = sorted_.groupBy("tree", "part").agg(F.sum("n_tokens").alias("n"))
    sums = sums.select("tree", "part", (F.sum("n").over(Window.partitionBy("tree").orderBy("part")) - F.col("n")).alias("base"))
    along = Window.partitionBy("tree", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    placed = sorted_.join(sums, ["tree", "part"]).withColumn("stop", F.col("base") + F.sum("n_tokens").over(along))
    placed = saved(placed.withColumn("start", F.col("stop") - F.col("n_tokens")).drop("base", "part", "key", "n_tokens"))

    spots = light.join(placed.select("node", F.col("start").alias("from")), "node").join(
        placed.select(F.col("node").alias("parent"), F.col("stop").alias("leave")), "parent").select("node", "from", "leave")
    jumps = left.select("conv_id", "depth", "node").join(spots, "node").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("depth", "from", "leave"))).alias("steps"))
    own = placed["first_conv"].eqNullSafe(jumps["conv_id"])
    attends = F.expr(f"filter(zip_with(concat(array(0L), transform({above}, x -> x.from)), concat(transform({above}, x -> x.leave), array(start)), "
                     "(x, y) -> named_struct('start', x, 'stop', y)), x -> x.stop > x.start)")
    full = placed.join(jumps, own, "left").withColumn("attends", attends).withColumn(
        "position", F.expr("aggregate(attends, 0L, (n, x) -> n + x.stop - x.start)"))
    turns = saved(rows.select("conv_id", "depth", "node").join(placed.select("node", "tree", "start"), "node"))
    discard(laid, rows, nodes, sorted_)
    return PrefixTrees(full.select("node", "tree", "start", "stop", "depth", "position", "attends", "role", "ids", "loss_from", "loss_to"), turns)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(trees: PrefixTrees, tokenizer_path: str) -> DataFrame:
    """Per conversation, from the emitted tokens alone: its turns' and its loss text's digests and lengths.

    A conversation's nodes stream by in order; each is decoded, its text is split at the marks, and escapes are undone.
    The digests are of whole conversations, so one conversation is read in one task, a node at a time.
    """
    nodes = trees.nodes.select("node", "ids", "loss_from", "loss_to")
    stream = trees.turns.select("conv_id", "depth", "node").join(nodes, "node").select("conv_id", "depth", "ids", "loss_from", "loss_to")
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "depth")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(tokenizer_path)
        turn = re.compile(re.escape(BEGIN) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)
        current: object = ()
        state: list = []

        def row() -> list:
            return [current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for batch in batches:
            done: list[list] = []
            for conv, raw, begin, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "loss_from", "loss_to"))):
                if conv != current:
                    if state:
                        done.append(row())
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.frombuffer(raw, "<u4").tolist()
                text, at = b"".join([table[i] for i in ids]).decode(), 0
                for m in turn.finditer(text):
                    if m.start() != at:
                        raise ValueError("formatted text outside of turns")
                    state[1].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                    state[0], at = state[0] + 1, m.end()
                if at != len(text):
                    raise ValueError("formatted text after the last turn")
                taught = unescape(b"".join([table[i] for i in ids[begin:end]]).decode())
                state[2] += len(taught)
                state[3].update(taught.encode())
                state[4] += len(text)
            yield _read_rows(done)
        if state:
            yield _read_rows([row()])

    return stream.mapInArrow(read, READ)


def _read_rows(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.string() if i in (2, 4) else pa.int64()) for i, c in enumerate(columns)], [f.split()[0] for f in READ.split(", ")])


def token_bytes(tokenizer_path: str) -> dict[int, bytes]:
    """The bytes that each token id stands for."""
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = json.load(file)
    alphabet = byte_alphabet()
    specials = {t["content"] for t in spec.get("added_tokens", [])}
    return {i: t.encode() if t in specials else bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items()}


def mark_test_rows(conversations: DataFrame, conv_id: int, text: str) -> DataFrame:
    """``conversations`` and one more, a user's and an assistant's turn that both say ``text``."""
    extra = conversations.sparkSession.createDataFrame(
        [(conv_id, 0, "user", text), (conv_id, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select(*[_typed(c, t) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))]).unionByName(extra)


def _typed(name: str, kind: str) -> Column:
    return F.col(name).cast(kind).alias(name)
