"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, served at the rate of its target. A document is queued as packets of
at most ``PACKET`` words, and once more for a second pass (so it is taken ``PASSES`` times at most); only documents near
the edge of the budget are cut into packets, all others are sorted whole (``served``). A packet's virtual
finish time is the words of its source up to its end, divided by the target. Packets of all sources are range-sorted by
virtual finish time, and the order is truncated where the total budget is spent; the packet on that edge is taken in
part. What is kept of a source is the start of its queue, so the words kept of each source say what is taken of each
document. A source comes as near to its target as a packet.

No source is gathered in a task: words before a document in its queue, and before a packet in the whole order, are
range-partitioned running sums (``common.running_sum``).

Defined cases: null text has size 0 and is taken with 0 words; a null source is a source of its own, the last one.
Documents are shuffled by a hash of seed, id and text, so rows without an id are shuffled too; repeated rows and ids are
documents of their own, and rows alike in both are interchangeable, so reruns agree. Sources of size 0 have target 0. An
empty table gives an empty result. ``mix_sources`` doesn't read extra columns; ``mixed`` passes them through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import guard, n_words, running_sum, stage

WEIGHTS, SHARE, PASSES, SEED, PACKET = (5, 2, 1), 1.5, 2, 42, 25
WORD = "[^\\x20\\x09-\\x0D]+"


def water_level(sizes: DataFrame, budget: float, most: int) -> float:
    """The level l at which sum(min(most * size, l * weight)) is the budget, for rows (source_size, weight).

    Each round caps the sources that the level fills and shares what is left; the number of rounds is at most the
    number of distinct size/weight ratios, and each is one sum over the sources.
    """
    level = 0.0
    while True:
        full = F.col("source_size") * most <= F.lit(level) * F.col("weight")
        r = sizes.agg(
            F.sum(F.when(full, F.col("source_size") * most).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))
        ).first()
        if not r[1]:
            return level
        new = (budget - float(r[0] or 0)) / float(r[1])
        if new <= level:
            return level
        level = new


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = PASSES) -> tuple[DataFrame, int]:
    """(source, nth, source_size, weight, target) from rows (source, source_size), and the budget in words.

    Sources in the order of their code points (UTF-8 bytes), null last, weigh ``weights``, repeating.
    """
    sizes = stage(sizes, "sources")
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    one = sizes.withColumn("one", F.lit(1).cast("long")).withColumn("all", F.lit(0)).withColumn("last", F.col("source").isNull())
    ranked = running_sum(one, "all", ["last", "source"], "one", "nth").withColumn(
        "weight", F.element_at(cycle, (F.col("nth") % len(weights) + 1).cast("int"))
    )
    ranked = stage(ranked.select("source", "nth", "source_size", "weight"), "ranked")
    budget = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = water_level(ranked, budget, most)
    target = F.least((F.col("source_size") * most).cast("double"), F.col("weight") * F.lit(level))
    return stage(ranked.withColumn("target", target), "targets"), int(budget)


def served(queue: DataFrame, budget: int, most: int = PASSES, packet: int = PACKET) -> DataFrame:
    """(nth, served): the words kept of each source, from documents (nth, before, size, source_size, target).

    Packets are kept in the order of their virtual finish times until the budget is spent. To find where that is, whole
    documents are range-sorted by the finish times of their last packets; ``spent`` is what ends before. When a document
    ends, each source has one more document in progress at most. So a document is kept whole if the budget is not spent
    even with the longest document of each source; none of it is kept if it starts after documents that end have spent
    the budget. Only documents between are cut into packets, and these range-sorted, for what the whole ones leave.
    """
    passes = queue.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    begin = F.col("before") + F.col("source_size") * F.col("pass")
    turns = passes.select(
        "nth", begin.alias("begin"), "size", "target", (begin / F.col("target")).alias("start"), ((begin + F.col("size")) / F.col("target")).alias("finish"), F.lit(0).alias("all")
    )
    order = running_sum(turns, "all", ["finish", "nth", "begin"], "size", "spent")
    order = stage(order.select("nth", "begin", "size", "target", "start", "finish", (F.col("spent") + F.col("size")).alias("upto")), "order")
    longest = queue.groupBy("nth").agg(F.max("size").alias("size")).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    out = order.agg(F.min(F.when(F.col("upto") >= budget, F.col("finish")))).first()[0]
    whole = order.where(F.col("upto") + longest <= budget)
    left = budget - (whole.agg(F.sum("size")).first()[0] or 0)
    edge = order.where((F.col("upto") + longest > budget) & (F.col("start") <= F.lit(float("inf") if out is None else out)))
    packets = edge.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(packet).cast("long"))))
    first, size = F.col("begin") + F.col("at"), F.least(F.lit(packet), F.col("size") - F.col("at"))
    packets = packets.select("nth", first.alias("begin"), size.alias("words"), ((first + size) / F.col("target")).alias("finish"), F.lit(0).alias("all"))
    cut = running_sum(packets, "all", ["finish", "nth", "begin"], "words", "spent")
    kept = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.lit(left) - F.col("spent")))
    both = whole.select("nth", "size").union(cut.select("nth", kept))
    return both.groupBy("nth").agg(F.sum("size").alias("served"))


def _shuffle_key(seed: int, doc_id: Column, text: Column) -> Column:
    """Rows that are alike in it have the same id and text."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def _overlap(k: int) -> Column:
    """Words of the document's pass k that are among its source's served ones."""
    left = F.col("served") - F.col("before") - F.col("source_size") * k
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))


def _mix(sized: DataFrame, weights: tuple, share: float, most: int, packet: int) -> DataFrame:
    """Rows with _source, _shuffle and size, with source_size, target, before (words of the source before the row) and
    served (of the source)."""
    sized = stage(sized, "sized")
    totals, budget = targets(sized.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size")), weights, share, most)
    queue = running_sum(sized, "_source", ["_shuffle"], "size", "before")
    queue = queue.join(totals, queue["_source"].eqNullSafe(totals["source"]), "left").drop(totals["source"])
    kept = stage(served(queue.select("nth", "before", "size", "source_size", "target"), budget, most, packet), "served")
    return queue.join(kept, "nth", "left").withColumn("served", F.coalesce("served", F.lit(0).cast("long")))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    key = _shuffle_key(seed, F.col("doc_id"), F.col("text").cast("string"))
    return docs.withColumns({"_source": F.col("source").cast("string"), "size": n_words(F.col("text")), "_shuffle": key})


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = PASSES, seed: int = SEED, packet: int = PACKET) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document; taken counts repeats."""
    sized = _sized(docs.select("doc_id", "source", "text"), seed).select("doc_id", "_source", "_shuffle", "size")
    taken = _overlap(0)
    for k in range(1, most):
        taken = taken + _overlap(k)
    mix = _mix(sized, weights, share, most, packet)
    return mix.select("doc_id", F.col("_source").alias("source"), "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = PASSES, seed: int = SEED, packet: int = PACKET) -> DataFrame:
    """The mix itself, range-sorted by virtual finish time: docs' columns, then pass, words, finish, size and target
    (under names that end in ``_1`` and so on where they clash).

    A row for each time that words of a document are taken; where that is not all of them, its text is those first
    words with one space between, and n_chars, if there, its length.

    The queue is made of rows without texts. Texts are shuffled twice: to the place in the queue that their row has, and
    into the order of the mix. Rows that are alike in all columns are one there, with the number of them.
    """
    plain, _ = guard(docs, ("doc_id", "text", "source", "n_chars"))
    row = F.md5(F.to_json(F.struct(*[c for c in plain.columns if c != "text"])))
    sized = _sized(plain, seed).withColumnRenamed("size", "_size").withColumn("_row", row).where("_size > 0")
    key = ["_shuffle", "_row"]
    mix = _mix(sized.select("_source", *key, F.col("_size").alias("size")), weights, share, most, packet)
    same = [F.first(c).alias(c) for c in ("size", "source_size", "target", "served")]
    places = mix.groupBy(*key).agg(F.min("before").alias("first"), F.count("*").alias("alike"), *same)
    texts = sized.groupBy(*key).agg(*[F.first(c).alias(c) for c in plain.columns])
    rows = texts.join(places.hint("shuffle_hash"), key).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("alike") - 1)))
    rows = rows.withColumn("before", F.col("first") + F.col("_copy") * F.col("size"))
    passes = F.array(*[F.struct(F.lit(k).alias("pass"), _overlap(k).alias("words")) for k in range(most)])
    rows = rows.withColumn("_p", F.explode(passes)).where("_p.words > 0")
    words, size = F.col("_p.words"), F.col("size")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), words.cast("int")), " ")
    finish = (F.col("before") + F.col("source_size") * F.col("_p.pass") + size) / F.col("target")
    out = {c: F.col(c) for c in plain.columns} | {"text": F.when(words < size, part).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(words < size, F.length(part)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    have, own = {c.lower() for c in docs.columns}, []
    for name in ("pass", "words", "finish", "size", "target"):
        n, free = 0, name
        while free.lower() in have:
            n, free = n + 1, f"{name}_{n + 1}"
        own.append(free)
        have.add(free.lower())
    values = [F.col("_p.pass"), words, finish, size, F.col("target")]
    result = rows.select(*[x.alias(f"_c{i}") for i, x in enumerate([*out.values(), *values])]).toDF(*docs.columns, *own)
    order = [own[2], "source", "doc_id"]
    return result.repartitionByRange(*order).sortWithinPartitions(*order)
