"""Quotation linking: quote levels are parsed, normalised quoted passages hashed and joined to the messages they come
from, and conversations rebuilt in reply order without the quotes.

A line's level is the number of `>` marks before its text.  Consecutive lines of one level are a passage; a line above
a passage that ends in "wrote:" or the like (ATTRIBUTION) belongs to the quote.  Passages and the messages' own text
are normalised (A-Z lower-cased, white space single) and hashed whole and by line.  A passage is linked, inside its
conversation, to the earlier message with the most matching weight (whole text 4, line 1), the latest of equals.  The
message replies to the source of its first level-1 passage that is linked (else of any level); its thread is the message
that the chain of replies starts from, found by pointer doubling, and reply order is by thread, then turn.

Skew: a hash matches the latest earlier turn with it by a window over (conversation, hash), so a line met n times gives
n rows, not n*n; only conversations with quotes take part.

Edge cases: null or empty text is a message without quotes or own text; null conversation ids or turns keep their rows
but link with nothing; rows that repeat a conversation id and turn are told apart by content, and quotes may refer to
any of them; a quote of nothing known stays unlinked (counted in n_quotes, not in n_linked); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import _common as c

LEVEL = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
# How mail clients introduce a quotation, in the languages of the corpus.
ATTRIBUTION = re.compile(r"(?:wrote|writes|said|schrieb|schrieb am|a écrit|escribió)\s*:\s*$", re.I)
WHOLE, LINE = 4, 1
_UPPER = {x: x + 32 for x in range(65, 91)}


def normal(text: str) -> str:
    return " ".join(text.translate(_UPPER).split())


def digest(text: str) -> str:
    return hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """Own text without quotes, and the quoted passages as (level, text) in order."""
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    open_ = False
    for line in (text or "").split("\n"):
        m = LEVEL.match(line)
        if not m:
            own.append(line)
            open_ = False
            continue
        level = m[1].count(">")
        if not open_:
            while own and not own[-1].strip():
                own.pop()
            if own and ATTRIBUTION.search(own[-1]):
                own.pop()
        if not open_ or quotes[-1][0] != level:
            quotes.append((level, []))
        quotes[-1][1].append(line[m.end() :].rstrip("\r"))
        open_ = True
    return "\n".join(own).strip(), [(n, "\n".join(lines).strip()) for n, lines in quotes if any(x.strip() for x in lines)]


def keys(text: str) -> list[tuple[str, int]]:
    """Hashes of a passage with their weights: the whole and, if there are several, its lines."""
    lines = [x for x in map(normal, text.split("\n")) if x]
    if not lines:
        return []
    whole = " ".join(lines)
    return [(digest(whole), WHOLE), *((digest(x), LINE) for x in dict.fromkeys(lines) if x != whole)]


PARSED = "conv_id long, turn long, role string, own_text string, own array<string>, quotes array<struct<level:int, text:string, keys:array<struct<h:string, w:int>>>>"


def _parse(batches):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string()), ("keys", pa.list_(pa.struct([("h", pa.string()), ("w", pa.int32())])))]))]
    for b in batches:
        for lo, hi in c.slices(c.buffers(b["text"])[1]):
            own, heads, quotes = [], [], []
            for t in b["text"].slice(lo, hi - lo).to_pylist():
                mine, passages = parse(t)
                own.append(mine)
                heads.append([h for h, _ in keys(mine)])
                quotes.append([{"level": n, "text": q, "keys": [{"h": h, "w": w} for h, w in keys(q)]} for n, q in passages])
            cols = [b[k].slice(lo, hi - lo) for k in ("conv_id", "turn", "role")]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x, k) for x, k in zip((own, heads, quotes), kinds[3:]))], ["conv_id", "turn", "role", "own_text", "own", "quotes"])


def roots(replies: DataFrame) -> DataFrame:
    """conv_id, turn, root of messages that reply (conv_id, turn, reply_to): pointer doubling until nothing moves.
    Replies go to earlier turns, so there are no rings."""
    at = last = c.written(replies.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("root")), "roots")
    while True:
        up = at.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"))
        moved = c.written(at.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        c.discard(last)
        at, last = moved.drop("moved"), moved
        if moved.where("moved").isEmpty():
            return at


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, own_text, n_quotes, max_level, n_linked, reply_to, thread, sources (turn of each passage's
    source, null where unknown)."""
    rows = messages.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    parsed = c.written(rows.mapInArrow(_parse, PARSED).withColumn("message", F.monotonically_increasing_id()), "messages")
    quoting = parsed.where("size(quotes) > 0 and conv_id is not null and turn is not null")
    busy = quoting.select("conv_id").distinct()
    own = parsed.join(busy, "conv_id", "left_semi").where("turn is not null")
    # originals, and asked hashes, in turn order: the latest earlier original of a hash
    known = own.select("conv_id", F.explode("own").alias("h"), "turn").distinct()
    known = known.select("conv_id", "h", "turn", F.lit(None).cast("long").alias("message"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("int").alias("w"))
    asked = quoting.select("conv_id", "turn", "message", F.posexplode("quotes").alias("k", "q")).select("conv_id", "turn", "message", "k", F.explode("q.keys").alias("x"))
    asked = asked.select("conv_id", F.col("x.h").alias("h"), "turn", "message", "k", F.col("x.w").alias("w"))
    earlier = Window.partitionBy("conv_id", "h").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    seen = known.unionByName(asked).withColumn("source", F.max(F.when(F.col("message").isNull(), F.col("turn"))).over(earlier))
    votes = seen.where("message is not null and source is not null").groupBy("message", "k", "source").agg(F.sum("w").alias("votes"))
    best = votes.groupBy("message", "k").agg(F.max(F.struct("votes", "source")).alias("b")).select("message", "k", F.col("b.source").alias("source"))
    best = c.written(best, "sources")
    per = best.groupBy("message").agg(F.map_from_entries(F.collect_list(F.struct("k", "source"))).alias("found"))  # as many as a message has passages
    out = parsed.join(per, "message", "left")
    spots = F.transform(F.sequence(F.lit(0), F.size("quotes") - 1), lambda k: F.try_element_at("found", k))
    out = out.withColumn("sources", F.when(F.size("quotes") > 0, spots).otherwise(F.array().cast("array<bigint>")))
    known_at = F.filter(F.arrays_zip("quotes", "sources"), lambda z: z["sources"].isNotNull())
    out = out.withColumn("linked", F.when(F.size("quotes") > 0, F.transform(known_at, lambda z: F.struct(z["quotes"]["level"].alias("level"), z["sources"].alias("source")))).otherwise(F.array().cast("array<struct<level:int,source:bigint>>")))
    first = F.get(F.filter("linked", lambda z: z["level"] == 1), 0)["source"]
    out = out.withColumn("reply_to", F.coalesce(first, F.get("linked", 0)["source"]))
    out = c.written(out, "linked")
    top = roots(out.where("reply_to is not null").select("conv_id", "turn", "reply_to"))
    out = out.join(top, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "own_text", F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0)).cast("long").alias("max_level"),
        F.size("linked").cast("long").alias("n_linked"), "reply_to", F.coalesce("root", "turn").alias("thread"), "sources",
    )


def conversations(messages: DataFrame) -> DataFrame:
    """The linked messages, in range partitions and sorted by conversation, thread and turn: reply order."""
    order = ["conv_id", "thread", "turn"]
    return link(messages).repartitionByRange(c.shuffle_width(messages.sparkSession), *order).sortWithinPartitions(*order)
