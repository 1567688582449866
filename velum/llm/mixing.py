"""Mixing sources to target weights by pivotal dependent rounding.

A source that is to give ``r`` times its words gives each document ``floor(r)`` times and
has a fraction of a copy left to hand out. Two documents with open fractions settle by
moving words from one to the other until one of them is at no or a whole extra copy;
which way is drawn with the odds that keep each document's expectation. The words of a
source stay the same in every step, so however many documents take part, the outcome is
off its target by less than one document.

Steps run inside blocks of some 256 documents at most that share a prefix of their hash,
long documents first, so that what stays open in the end is seldom a long one.
What a block leaves open, one document at most, moves on to the block of the next shorter
prefix: a reduction tree per source, whose first level does nearly all the work. A large
source has more blocks, not larger ones."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.shared import Scratch, col, fraction, offsets

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_BITS = 8
WORD = r"[^\x20\x09-\x0D]+"
# Words that count as none when a fraction is taken for whole.
EPSILON = 1e-6


def _units(df: DataFrame, text: str, doc_id: str, source: str) -> DataFrame:
    """One row per distinct (identifier, source, text) with the number of such rows."""
    whole = F.coalesce(col(text), F.lit(""))
    return (
        df.select(
            col(doc_id).alias("doc_id"),
            col(source).alias("source"),
            F.regexp_count(whole, F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(whole).alias("mark"),
        )
        .groupBy("doc_id", "source", "size", "mark")
        .agg(F.count("*").alias("m"))
    )


def _ranked(sources: DataFrame) -> DataFrame:
    """``rank`` of each source by code point, from 0, null last: the place in its range
    of names plus the number of sources in the ranges before."""
    none = F.isnull("source").cast("int")
    spread = sources.withColumn("none", none).repartitionByRange("none", "source")
    rows = spread.sortWithinPartitions("none", "source").select(
        "*", F.monotonically_increasing_id().alias("at")
    )
    return rows.withColumns(
        {"part": F.shiftright("at", 33), "place": F.col("at").bitwiseAND((1 << 33) - 1)}
    ).drop("at", "none")


def source_targets(
    units: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0
) -> DataFrame:
    """``source, source_size, target, n``. All sizes together are shared by weight; a
    source takes ``most`` times its size at most and what it cannot take is shared again
    among the rest. Each round is one sum over the sources."""
    sums = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n")
    )
    ranked = scratch.keep(_ranked(sums), "ranked")
    offset = offsets(ranked.groupBy("part").agg(F.count("*").alias("k")), "part", "k")
    rank = F.col("offset") + F.col("place")
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")
    )
    table = scratch.keep(
        ranked.join(offset, "part").select(
            "source", "source_size", "n", weight.alias("weight"),
            (F.col("source_size") * F.lit(float(most))).alias("cap"),
        ),
        "weights",
    )
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, reached = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("cap")
        taken, weight_left, n_full = table.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
            F.sum(full.cast("long")),
        ).first()
        if not weight_left or n_full == reached:
            break
        level, reached = (total - taken) / weight_left, n_full
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    return table.select("source", "source_size", "n", target.alias("target"))


def _open_units(units: DataFrame, targets: DataFrame) -> DataFrame:
    """Units with their sure copies and the open fraction of one more."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # A group of equal rows is one unit: the whole part of what it owes is sure, and only
    # the rest takes part in the rounding.
    owed = F.col("m") * (F.col("rate") - F.floor("rate"))
    return (
        units.join(targets, units["source"].eqNullSafe(targets["source"]))
        .drop(targets["source"])
        .withColumn("rate", rate)
        .withColumn("owed", owed)
        .withColumns(
            {
                "sure": F.floor("rate") * F.col("m") + F.floor("owed"),
                "p": F.col("owed") - F.floor("owed"),
                "h": F.xxhash64("doc_id", "mark", "size"),
                "bits": F.greatest(F.lit(0), F.ceil(F.log2(F.col("n"))) - BLOCK_BITS).cast("int"),
            }
        )
        .drop("rate", "owed")
    )


def _settled(blocks: DataFrame, seed: int) -> DataFrame:
    """One pass of pivotal steps through each block: ``settled`` units with their extra
    copy, and ``open``, the unit that is left with a fraction, if any."""
    unit = "struct<rank:bigint,h:bigint,doc_id:{id},size:bigint,mark:bigint,p:double>".format(
        id=dict(blocks.dtypes)["doc_id"]
    )
    out = f"array<struct<unit:{unit},extra:int>>"
    walk = f"""aggregate(
        array_sort(units),
        named_struct('open', cast(null AS {unit}), 'done', cast(array() AS {out})),
        (acc, b) -> CASE
            WHEN acc.open IS NULL THEN named_struct('open', b, 'done', acc.done)
            ELSE {_step()} END)"""
    grouped = blocks.groupBy("source", "bits", "block").agg(
        F.collect_list(F.struct((-F.col("size")).alias("rank"), "h", "doc_id", "size", "mark", "p")).alias("units")
    )
    return grouped.select("source", "bits", F.expr(walk.replace("{seed}", str(seed))).alias("walk"))


def _step() -> str:
    """Unit ``b`` meets the open one, ``acc.open``. ``up`` words can go from ``b`` to the
    open unit, ``down`` words the other way."""
    up = "least(a.size * (1 - a.p), b.size * b.p)"
    down = "least(a.size * a.p, b.size * (1 - b.p))"
    draw = "shiftrightunsigned(xxhash64(a.h, b.h, {seed}), 11) / 9007199254740992D"
    moved = f"CASE WHEN {draw} * ({up} + {down}) < {down} THEN {up} ELSE -{down} END"

    def whole(p, size):
        return f"({p} * {size} < {EPSILON} OR (1 - {p}) * {size} < {EPSILON})"

    def unit(u, p):
        return (
            f"named_struct('rank', {u}.rank, 'h', {u}.h, 'doc_id', {u}.doc_id, 'size', {u}.size, "
            f"'mark', {u}.mark, 'p', {p})"
        )

    def done(u, p):
        return f"named_struct('unit', {unit(u, p)}, 'extra', cast(round({p}) AS int))"

    pa, pb = "(a.p + w / a.size)", "(b.p - w / b.size)"
    body = f"""CASE
        WHEN {whole(pa, 'a.size')} AND {whole(pb, 'b.size')}
            THEN named_struct('open', null, 'done', concat(acc.done, array({done('a', pa)}, {done('b', pb)})))
        WHEN {whole(pa, 'a.size')}
            THEN named_struct('open', {unit('b', pb)}, 'done', concat(acc.done, array({done('a', pa)})))
        ELSE named_struct('open', {unit('a', pa)}, 'done', concat(acc.done, array({done('b', pb)}))) END"""
    return f"transform(array(acc.open), a -> transform(array({moved}), w -> {body})[0])[0]"


def mixing_plan(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    most: float = 3.0,
    seed: int = 7,
) -> DataFrame:
    """``doc_id, source, size, mark, m, source_size, target, copies``: how often each
    distinct (identifier, source, text) is taken, over its ``m`` rows together."""
    scratch = Scratch(df.sparkSession)
    units = scratch.keep(_units(df, text, doc_id, source), "units")
    targets = scratch.keep(source_targets(units, scratch, weights, most), "targets")
    all_open = scratch.keep(_open_units(units, targets), "fractions")
    p, size = F.col("p"), F.col("size")
    fractional = (size > 0) & (p * size > EPSILON) & ((1 - p) * size > EPSILON)
    level = all_open.filter(fractional).select(
        "source", "bits", "h", "doc_id", "size", "mark", "p"
    )
    n_most = targets.agg(F.max("n")).first()[0] or 0
    bits, extras, step = max(0, ceil(log2(max(1, n_most))) - BLOCK_BITS), [], 0
    while True:
        # A shift by 64 would be none at all, so blocks of no bits are taken apart.
        block = F.when(F.col("bits") > 0, F.expr("shiftrightunsigned(h, 64 - bits)")).otherwise(0)
        walked = scratch.keep(_settled(level.withColumn("block", block), seed + step), f"level{step}")
        extras.append(
            walked.select("source", F.explode("walk.done").alias("d")).select(
                "source", "d.unit.doc_id", "d.unit.size", "d.unit.mark", "d.extra"
            )
        )
        left = walked.filter("walk.open IS NOT NULL").select("source", "bits", "walk.open.*")
        if bits == 0:
            # One unit a source is left; its own chance decides.
            last = fraction(F.col("h"), F.lit(seed)) < F.col("p")
            extras.append(left.select("source", "doc_id", "size", "mark", last.cast("int").alias("extra")))
            break
        level = left.withColumn("bits", F.greatest(F.lit(0), F.col("bits") - BLOCK_BITS))
        bits, step = max(0, bits - BLOCK_BITS), step + 1
    given = extras[0]
    for more in extras[1:]:
        given = given.unionByName(more)
    given = given.filter("extra = 1").select("doc_id", "source", "size", "mark", "extra")
    u = all_open.withColumn("whole", ~fractional & (size > 0)).alias("u")
    g = given.alias("g")
    keys = ("doc_id", "source", "size", "mark")
    same = [F.col(f"u.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    rounded = F.coalesce("g.extra", F.when(F.col("whole"), F.round("u.p")).otherwise(0))
    return u.join(g, same, "left").select(
        *[F.col(f"u.{k}") for k in keys],
        "u.m", "u.source_size", "u.target",
        (F.col("u.sure") + rounded).cast("long").alias("copies"),
    )


def mixed_sizes(df: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: one row per row of ``df`` with the
    words the mix takes from it, repeats counted.

    ``weights`` go to the sources by code point, null last, over and over; no document is
    taken more than ``most`` times (rounded up). Null texts are empty; an empty text and
    a source without words give nothing. Equal rows are told apart only by how much is
    taken. Results depend on the rows and ``seed`` alone."""
    plan = mixing_plan(df, **options).withColumn("each", F.expr("copies div m"))
    more = F.col("copies") - F.col("each") * F.col("m")
    # A group of equal rows unfolds in two steps, so that no array holds a large group.
    parts = plan.select(
        "*",
        F.explode(
            F.array(
                F.struct(more.alias("k"), (F.col("each") + 1).alias("times")),
                F.struct((F.col("m") - more).alias("k"), F.col("each").alias("times")),
            )
        ).alias("part"),
    ).filter("part.k > 0")
    return _repeated(parts, "part.k").select(
        "doc_id", "size", "source_size", "target",
        (F.col("part.times") * F.col("size")).alias("taken"),
    )


def _repeated(df: DataFrame, n: str, chunk: int = 4096) -> DataFrame:
    """Each row ``n`` times."""
    chunks = F.expr(f"sequence(1L, ({n} + {chunk - 1}) div {chunk})")
    size = F.expr(f"least({chunk}, {n} - ({chunk} * (_chunk - 1)))")
    return (
        df.withColumn("_chunk", F.explode(chunks))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), size.cast("int"))))
        .drop("_chunk", "_copy")
    )


def mix(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options
) -> DataFrame:
    """The mix itself: rows of ``df``, each as often as it is taken. Texts move once, to
    meet the plan; of equal rows one stands for all."""
    plan = mixing_plan(df, text, doc_id, source, **options).filter("copies > 0")
    plan = plan.select(
        F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("mark").alias("_m"),
        F.col("copies").alias("_copies"), F.col("m").alias("_rows"),
    )
    marked = df.withColumn("_mark", F.xxhash64(F.coalesce(col(text), F.lit(""))))
    met = marked.join(
        plan,
        col(doc_id).eqNullSafe(F.col("_d"))
        & col(source).eqNullSafe(F.col("_s"))
        & (F.col("_mark") == F.col("_m")),
    )
    names = [col(c) for c in df.columns]
    single = _repeated(met.filter("_rows = 1"), "_copies").select(*names)
    several = met.filter("_rows > 1")
    several = _repeated(several.dropDuplicates(["_d", "_s", "_m"]), "_copies").select(*names)
    return single.unionByName(several)
