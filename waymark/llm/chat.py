"""Chat formatting by quotation linking.

Each message is parsed into lines with their quote level (the number of leading > marks). Quoted
lines, and quoted passages with their lines joined (so that wrapping does not matter), are
normalised and hashed, whatever their length; so are the lines and passages of each message's own
text. A quote belongs to the nearest earlier message of the conversation that says it; a message
answers the earlier message that its outermost quotes name with the most characters (of equals, the
latest), so a short line that many messages say yields to the passage it stands in. Quotes and the
line that introduces them are cut, and messages are ordered by thread: root message, then turn.

Roots are found by pointer jumping over the links, on tables. No step needs the messages of one
conversation in one task, so a conversation may hold a third of all rows.

Cases: null or empty texts have no lines and an empty body; rows with a null conv_id or turn are not
linked; rows that repeat (conv_id, turn) share their links; a passage of signs alone is compared as
it stands; quotes that match nothing are cut but
link nothing; a message without a linked quote is a root; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, table

_MARKS = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)")
_INTRO = re.compile(r"^(?:on\b.*\bwrote|.+\b(?:wrote|schrieb|a écrit|escribió))\s*:\s*$", re.I)
_SIGNS = re.compile(r"[\W_]+")
#: Turns that one task looks through at once for the nearest message that says a passage.
BLOCK = 1024
MAX_ROUNDS = 64
PARSED = "conv_id long, turn long, role string, body string, own array<binary>, quoted array<struct<level:int,hash:binary,n:int>>"


def normal(text: str) -> str:
    return _SIGNS.sub(" ", text.lower()).strip()


def _hash(text: str) -> tuple[bytes, int] | None:
    """The hash and the length of a passage; signs count only where there is nothing else."""
    text = normal(text) or " ".join(text.split())
    return (hashlib.md5(text.encode("utf-8", "surrogatepass")).digest(), len(text)) if text else None


def parse(text: str | None) -> tuple[str, list[bytes], list[tuple[int, bytes, int]]]:
    """The body without quotes, hashes of own lines and passages, (level, hash, length) of quoted ones."""
    passages: list[tuple[int, list[str]]] = []
    body: list[str] = []
    for line in (text or "").split("\n"):
        m = _MARKS.match(line)
        level = m[1].count(">") if m else 0
        rest = line[m.end() :] if m else line
        if level and body and _INTRO.match(body[-1].strip()):
            body.pop()
            if passages and passages[-1][0] == 0 and passages[-1][1]:
                passages[-1][1].pop()
        if not level:
            body.append(rest)
        if not rest.strip():
            passages.append((level, []))
        elif passages and passages[-1][0] == level:
            passages[-1][1].append(rest)
        else:
            passages.append((level, [rest]))
    own: set[bytes] = set()
    quoted: set[tuple[int, bytes, int]] = set()
    for level, lines in passages:
        for piece in {*lines, " ".join(lines)}:
            h = _hash(piece)
            if h and level:
                quoted.add((level, *h))
            elif h:
                own.add(h[0])
    return "\n".join(body).strip("\n"), sorted(own), sorted(quoted)


def parsed(messages: DataFrame) -> DataFrame:
    pair = pa.struct([("level", pa.int32()), ("hash", pa.binary()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse(t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.binary())),
                 pa.array([[{"level": x, "hash": h, "n": n} for x, h, n in g[2]] for g in got], pa.list_(pair))],
                names=["conv_id", "turn", "role", "body", "own", "quoted"],
            )

    return messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(run, PARSED)


def links(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, parent) from the parsed messages. The nearest message that says a quote is
    looked for in its block of turns, else in the last block before that has one; so no task needs
    all messages that say a common passage."""
    rows = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quotes = rows.select("conv_id", "turn", F.explode("quoted").alias("q")).groupBy("conv_id", "turn", "q.level", "q.hash").agg(F.sum("q.n").alias("n"))
    quotes = materialise(quotes)
    asked = materialise(quotes.select("conv_id", "hash").distinct())
    said = rows.select("conv_id", "turn", F.explode("own").alias("hash")).join(broadcast_if_small(asked), ["conv_id", "hash"], "left_semi").distinct()
    events = said.withColumn("said", F.col("turn")).unionByName(quotes, allowMissingColumns=True)
    events = materialise(events.withColumn("block", F.floor(F.col("turn") / BLOCK)))
    inside = Window.partitionBy("conv_id", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("conv_id", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = events.groupBy("conv_id", "hash", "block").agg(F.max("said").alias("top")).withColumn("before", F.max("top").over(ahead))
    near = events.withColumn("near", F.max("said").over(inside)).where("level IS NOT NULL")
    found = near.join(blocks, ["conv_id", "hash", "block"]).withColumn("parent", F.coalesce("near", "before")).where("parent IS NOT NULL")
    votes = found.groupBy("conv_id", "turn", "level", "parent").agg(F.sum("n").alias("n"))
    return votes.groupBy("conv_id", "turn").agg(F.max_by("parent", F.struct(-F.col("level"), F.col("n"), F.col("parent"))).alias("parent"))


def roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, root, depth) by pointer jumping: the distance doubles each round."""
    known = materialise(parents.select("conv_id", "turn", "parent", F.col("parent").alias("root"), F.lit(1).alias("depth")))
    for _ in range(MAX_ROUNDS):
        up = known.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("root").alias("r"), F.col("depth").alias("d"))
        step = known.join(up, (known["conv_id"] == up["c"]) & (known["root"] == up["t"]), "left").select(
            "conv_id", "turn", "parent", F.coalesce("r", "root").alias("root"),
            (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("r").isNotNull().alias("moved"),
        )
        step = materialise(step)
        known = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return known
    raise RuntimeError("links form a cycle")


def reply_order(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, body, n_quotes, parent_turn, root_turn, depth; in
    range partitions by conversation, thread and turn, each of them sorted."""
    rows = materialise(parsed(messages))
    tree = materialise(roots(links(rows)))
    tree = tree.select(F.col("conv_id").alias("__c"), F.col("turn").alias("__t"), F.col("parent").alias("parent_turn"), "root", "depth")
    out = rows.join(tree, (rows["conv_id"] == tree["__c"]) & (rows["turn"] == tree["__t"]), "left").select(
        "conv_id", "turn", "role", "body", F.size("quoted").cast("long").alias("n_quotes"), "parent_turn",
        F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
    order = ["conv_id", "root_turn", "turn"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(table(spark, sf_dir, "conversations"))
