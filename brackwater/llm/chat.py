"""Chat formatting by quotation linking.

Each message is split into what it says and what it quotes: a line's quote level is the number of
``>`` in front of it, and a quoted passage is a run of lines of one level. Passages and their
lines, with white space and case normalised, are hashed and joined to the message of the same
conversation that said them first. A single line links only if it has three words or more, so that a "thanks"
is no quotation of every other; a passage links at any length where it is all that a message says.
A message replies to the earlier message that most of its level-1 passages come from (the latest of
equals); deeper levels are quotes of quotes and count as links only. Messages are put in reply order:
threads by the turn of their first message, then by turn, so that every message follows the one it
replies to; quotes are left out.

Replies go from row to row, not from turn to turn: of several messages with one turn that said a passage,
the one whose text has the least MD5 is quoted, and only rows that reply belong to a thread. Parents are
followed to the thread's first message by pointer jumping. Places in a conversation
are counted in range partitions of the reply order and carried on top of their counts, so a
conversation may be of any length.

Defined results: a null text says and quotes nothing; a message of quotes only has empty content;
passages that nobody said before stay unlinked; messages with equal conversation and turn are
ordered by role, content and MD5 of the text and keep places and threads of their own, and those that are
equal in all of these give equal rows; rows with a null conv_id or turn are kept,
link to nothing and come first; texts of any length are parsed whole; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brackwater.llm.common import by_slices, partitions, stored, table

LINE_WORDS = 3  # a line of fewer is said too often to be a quotation
MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")


def normalised(text: str) -> int | None:
    """The hash of a passage whatever its white space and case; none for a blank one."""
    words = text.lower().split()
    return xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) - (1 << 63) if words else None


def parse(text: str | None) -> tuple[str, list[int], list[tuple[int, int, list[int]]]]:
    """What a message says, the hashes of what it says (whole and by line), and its passages as
    (level, hash of the whole, hashes of the lines)."""
    lines = []
    for line in (text or "").split("\n"):
        m = MARKS.match(line)
        lines.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    content = "\n".join(x for level, x in lines if not level).strip()
    long = lambda lines: {normalised(x) for x in lines if len(x.split()) >= LINE_WORDS}
    said = ({normalised(content)} | long(content.split("\n"))) - {None}
    passages = []
    for level, run in groupby(lines, key=lambda x: x[0]):
        own = [x for _, x in run]
        whole = normalised(" ".join(own))
        if level and whole is not None:
            passages.append((level, whole, sorted(long(own))))
    return content, sorted(said), passages


def parsed(messages: DataFrame) -> DataFrame:
    kinds = "conv_id long, turn long, role string, digest string, content string, said array<long>, passages array<struct<level:int,whole:long,lines:array<long>>>"
    arrow = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.struct([("level", pa.int32()), ("whole", pa.int64()), ("lines", pa.list_(pa.int64()))]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in by_slices()(b)):
            found = [parse(t) for t in batch.column(4).to_pylist()]
            cols = [[f[0] for f in found], [f[1] for f in found], [[{"level": a, "whole": b, "lines": c} for a, b, c in f[2]] for f in found]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c, k) for c, k in zip(cols, arrow, strict=True))], ["conv_id", "turn", "role", "digest", "content", "said", "passages"])

    chosen = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    return chosen.mapInArrow(run, kinds).withColumn("row", F.monotonically_increasing_id())


def links(messages: DataFrame) -> DataFrame:
    """(row, reply_to, parent, n_linked) of the messages with a linked passage; parent is the row of reply_to."""
    first = messages.select("conv_id", F.explode("said").alias("hash"), F.struct("turn", "digest", "row").alias("by")).groupBy("conv_id", "hash").agg(F.min("by").alias("origin"))
    quotes = messages.select("row", "conv_id", "turn", F.posexplode("passages").alias("place", "p"))
    hashes = quotes.select("row", "conv_id", "turn", "place", F.col("p.level").alias("level"), F.explode(F.array_union(F.array("p.whole"), F.col("p.lines"))).alias("hash"))
    found = hashes.join(first, ["conv_id", "hash"]).filter("origin.turn < turn")
    linked = found.groupBy("row").agg(F.countDistinct("place").alias("n_linked"))
    votes = found.filter("level = 1").groupBy("row", "origin").agg(F.countDistinct("place").alias("n"))
    best = votes.groupBy("row").agg(F.max(F.struct("n", "origin.turn", "origin.digest", "origin.row")).alias("b"))
    return linked.join(best.select("row", F.col("b.turn").alias("reply_to"), F.col("b.row").alias("parent")), "row", "left")


def thread_roots(replies: DataFrame) -> DataFrame:
    """(row, root) of the messages that reply; replies: (row, parent)."""
    up = stored(replies.select("row", F.col("parent").alias("root")), "chat-up")
    while True:
        above = up.select(F.col("row").alias("root"), F.col("root").alias("top"))
        joined = up.join(above, "root", "left")
        up = stored(joined.select("row", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "chat-up")
        if not up.filter("moved").limit(1).count():
            return up.select("row", "root")
        up = up.drop("moved")


def link_conversations(messages: DataFrame) -> DataFrame:
    """One row per message: what it says, what it replies to, and its place in reply order."""
    rows = stored(parsed(messages), "chat-parsed")
    found = stored(links(rows), "chat-links")
    roots = thread_roots(found.filter("parent is not null").select("row", "parent"))
    roots = roots.join(rows.select(F.col("row").alias("root"), F.col("turn").alias("thread")), "root").select("row", "thread")
    depth = F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0))
    all_ = rows.select("row", "conv_id", "turn", "role", "digest", "content", depth.alias("quote_depth"), F.size("passages").alias("n_quoted"))
    all_ = all_.join(found.select("row", "reply_to", F.col("n_linked").cast("int").alias("n_linked")), "row", "left").join(roots, "row", "left")
    all_ = all_.withColumn("thread", F.coalesce("thread", "turn")).fillna(0, ["n_linked"])
    order = ["thread", "turn", "role", "content", "digest", "row"]
    dealt = stored(all_.repartitionByRange(partitions(rows), "conv_id", *order).withColumn("part", F.spark_partition_id()), "chat-dealt")
    counts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    counts = counts.select(F.col("conv_id").alias("c"), F.col("part").alias("q"), (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("before"))
    placed = dealt.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)))
    placed = placed.join(counts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("q")))
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("content"))
    return placed.select("conv_id", (F.col("before") + F.col("place") - 1).alias("position"), "turn", "role", "content", chat.alias("chat"), "quote_depth", "n_quoted", "n_linked", "reply_to", "thread")


def op4_chat(spark, sf_dir: str) -> DataFrame:
    return link_conversations(table(spark, sf_dir, "conversations"))


#: The same by SQL: passages are compared as text, and parents are followed one at a time.
OP4_SQL = r"""WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS t, md5(coalesce(text, '')) AS digest FROM conversations),
l AS (SELECT id, conv_id, turn, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM m),
p AS (SELECT *, regexp_extract(line, '^[ \t]*(?:>[ \t]?)+') AS mark FROM l),
o AS (SELECT *, length(mark) - length(replace(mark, '>', '')) AS level, substr(line, length(mark) + 1) AS own FROM p),
g AS (SELECT *, i - row_number() OVER (PARTITION BY id, level ORDER BY i) AS run FROM o),
c AS (SELECT m.id, m.conv_id, m.turn, m.role, m.digest, trim(coalesce(string_agg(own, chr(10) ORDER BY i) FILTER (level = 0), ''), E' \t\n\r\f\v') AS content
 FROM m JOIN o USING (id) GROUP BY ALL),
said AS (SELECT id, true AS all_, content AS s FROM c UNION ALL SELECT id, false, own FROM o WHERE level = 0),
heard AS (SELECT id, all_, trim(regexp_replace(lower(s), '\s+', ' ', 'g')) AS h FROM said),
first AS (SELECT conv_id, h, arg_min(id, (turn, digest, id)) AS oid, min(turn) AS origin FROM heard JOIN m USING (id) WHERE h <> '' AND (all_ OR len(string_split(h, ' ')) >= 3) GROUP BY 1, 2),
whole AS (SELECT id, conv_id, turn, level, run, trim(regexp_replace(lower(string_agg(own, ' ' ORDER BY i)), '\s+', ' ', 'g')) AS h FROM g WHERE level > 0 GROUP BY ALL HAVING h <> ''),
sought AS (SELECT * FROM whole UNION SELECT * FROM (SELECT id, conv_id, turn, level, run, trim(regexp_replace(lower(own), '\s+', ' ', 'g')) AS h FROM g WHERE level > 0) WHERE len(string_split(h, ' ')) >= 3),
found AS (SELECT s.*, oid, origin FROM sought s JOIN first f ON f.conv_id = s.conv_id AND f.h = s.h AND origin < turn),
linked AS (SELECT id, count(DISTINCT (level, run))::INTEGER AS n_linked FROM found GROUP BY id),
votes AS (SELECT id, oid, origin, count(DISTINCT run) AS n FROM found WHERE level = 1 GROUP BY ALL),
parent AS (SELECT v.id, max(origin) AS reply_to, arg_max(v.oid, (n, origin, digest, v.oid)) AS pid FROM votes v JOIN m ON m.id = v.oid WHERE (v.id, v.n, v.origin) IN (SELECT id, max(n), arg_max(origin, (n, origin)) FROM votes GROUP BY id) GROUP BY v.id),
chain AS (SELECT id, pid AS root FROM parent UNION SELECT c.id, p.pid FROM chain c JOIN parent p ON p.id = c.root),
roots AS (SELECT c.id, min(m.turn) AS root FROM chain c JOIN m ON m.id = c.root GROUP BY 1),
q AS (SELECT id, max(level)::INTEGER AS depth, count(*)::INTEGER AS n FROM whole GROUP BY id),
a AS (SELECT c.*, coalesce(depth, 0)::INTEGER AS quote_depth, coalesce(q.n, 0)::INTEGER AS n_quoted, coalesce(n_linked, 0)::INTEGER AS n_linked, reply_to, coalesce(root, c.turn) AS thread
 FROM c LEFT JOIN q USING (id) LEFT JOIN linked USING (id) LEFT JOIN (SELECT id, reply_to FROM parent) USING (id) LEFT JOIN roots r USING (id))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY thread NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, content, digest, id) - 1 AS position, turn, role, content,
 '<|' || coalesce(role, '') || '|>' || chr(10) || content AS chat, quote_depth, n_quoted, n_linked, reply_to, thread FROM a"""
