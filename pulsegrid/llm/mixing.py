"""Mixing sources to target weights, in DataFrame and SQL functions only.

Every source's documents lie in blocks of a random permutation (ranges of a hash). A source is read
in whole epochs plus, in one more, its first blocks up to its target; the block in which the target
falls is filled greedily. A multivariate-hypergeometric splitting tree divides the exact numbers of
blocks taken from each source among the output shards: every node deals half of its blocks to each
child, source by source with hypergeometric draws. Shards then take disjoint runs of each source's
permuted blocks, and within a shard documents are shuffled by a hash. Where a block goes is looked up
by source and block, so no row carries anything that grows with the number of shards.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import drop, written

#: Fixed value: weights of the sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


@dataclass(frozen=True)
class MixParams:
    block_docs: int = 4096
    shard_words: int = 4_000_000
    seed: int = 17

    def __post_init__(self):
        if self.block_docs < 1 or self.shard_words < 1:
            raise ValueError("block_docs and shard_words must be positive")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """source, n_docs, source_size and target: weights share the sum of all sizes, a target stops at
    MAX_EPOCHS times its source's size, and the excess is shared anew by weight until none is above.

    That ends where target = least(level * weight, cap) for one level, found over the sources in the
    order in which their caps are reached.
    """
    totals = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(ordered) - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight.cast("long")).withColumn("cap", MAX_EPOCHS * F.col("source_size"))
    full = Window.partitionBy(F.lit(1))
    upto = full.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranked.select("*", F.sum("source_size").over(full).alias("_all"), F.sum("weight").over(full).alias("_weights"), F.sum("cap").over(upto).alias("_caps"), F.sum("weight").over(upto).alias("_used"))
    # With this source and all before it not capped, the level would be:
    level = (F.col("_all") - (F.col("_caps") - F.col("cap"))) / (F.col("_weights") - (F.col("_used") - F.col("weight")))
    open_level = F.min(F.when(level * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), level.alias("level")))).over(full)["level"]
    return summed.withColumn("_level", open_level).select("source", "n_docs", "source_size", F.coalesce(F.least(F.col("_level") * F.col("weight"), F.col("cap").cast("double")), F.lit(0.0)).alias("target"))


def hypergeometric(population: str, successes: str, draws: str, u: str) -> str:
    """SQL for a draw by inversion: probabilities are walked up from the mode, then down from it, by their
    ratios. What lies over 12 standard deviations away weighs less than a double resolves."""
    big, k, n = f"cast({population} as double)", f"cast({successes} as double)", f"cast({draws} as double)"
    low = f"greatest(0, {draws} + {successes} - {population})"
    high = f"least({draws}, {successes})"
    mode = f"greatest({low}, least({high}, cast(floor(({n} + 1) * ({k} + 1) / ({big} + 2)) as bigint)))"
    reach = f"cast(ceil(12 * sqrt(greatest(0d, {n} * ({k} / greatest({big}, 1)) * (1 - {k} / greatest({big}, 1)) * ({big} - {n}) / greatest({big} - 1, 1)))) + 8 as bigint)"
    ups = f"sequence({mode}, least({high}, {mode} + {reach}))"
    downs = f"filter(sequence(cast(0 as bigint), {mode} - greatest({low}, {mode} - {reach})), i -> i > 0)"
    up = f"({k} - x) * ({n} - x) / ((x + 1) * ({big} - {k} - {n} + x + 1))"
    down = f"({mode} - i + 1) * ({big} - {k} - {n} + {mode} - i + 1) / (({k} - ({mode} - i)) * ({n} - ({mode} - i)))"
    mass_up = f"aggregate({ups}, named_struct('p', 1d, 's', 0d), (a, x) -> named_struct('p', a.p * {up}, 's', a.s + a.p), a -> a.s)"
    mass_down = f"aggregate({downs}, named_struct('p', 1d, 's', 0d), (a, i) -> named_struct('p', a.p * {down}, 's', a.s + a.p * {down}), a -> a.s)"
    walk = f"""aggregate({ups}, named_struct('p', 1d, 'left', v, 'x', cast(null as bigint)),
        (a, x) -> named_struct('p', a.p * {up}, 'left', a.left - a.p, 'x', if(a.x is null and a.left < a.p, x, a.x)), a -> a)"""
    back = f"""aggregate({downs}, named_struct('p', 1d, 'left', w, 'x', cast(null as bigint)),
        (a, i) -> named_struct('p', a.p * {down}, 'left', a.left - a.p * {down}, 'x', if(a.x is null and a.left < a.p * {down}, {mode} - i, a.x)), a -> a.x)"""
    # transform over one element binds v and w, so that each is computed once
    return f"""transform(array({u} * ({mass_up} + {mass_down})), v -> transform(array({walk}), up -> coalesce(up.x, transform(array(up.left), w -> coalesce({back}, {mode}))[0]))[0])[0]"""


def splitting_tree(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """source_no, shard and blocks: quotas (source_no, blocks) split among 2 ** depth shards of equal size (within one block)."""
    node = quotas.agg(F.transform(F.sort_array(F.collect_list(F.struct("source_no", "blocks"))), lambda x: x["blocks"]).alias("q")).select(F.lit(0).cast("long").alias("node"), F.coalesce("q", F.array().cast("array<bigint>")).alias("q"))
    for level in range(depth):
        rest = "aggregate(q, 0L, (a, x) -> a + x)"
        half = f"(({rest}) + pmod(xxhash64({seed}, {level}, node), 2)) div 2"
        u = f"(shiftrightunsigned(xxhash64({seed}, {level}, node, size(s.got)), 11) / 9007199254740992d)"
        fold = f"""aggregate(q, named_struct('rest', {rest}, 'want', {half}, 'got', cast(array() as array<bigint>)),
            (s, x) -> transform(array({hypergeometric('s.rest', 'x', 's.want', u)}), d -> named_struct('rest', s.rest - x, 'want', s.want - d, 'got', concat(s.got, array(d))))[0], s -> s.got)"""
        node = node.select("node", "q", F.expr(fold).alias("left")).select("node", F.explode(F.expr("array(named_struct('node', 2 * node, 'q', left), named_struct('node', 2 * node + 1, 'q', zip_with(q, left, (a, b) -> a - b)))")).alias("c")).select("c.node", "c.q")
        if level == 6:
            node = node.repartition("node")
    return node.select(F.col("node").alias("shard"), F.posexplode("q").alias("source_no", "blocks"))


def _row_hash(id_col: str, text_col: str, source_col: str, seed: int) -> Column:
    """Place of a row in its source's permutation: rows of one id, source and text have one."""
    return F.xxhash64(F.lit(seed), F.col(id_col).isNull(), F.col(id_col).cast("string"), source_col, F.col(text_col).isNull(), text_col)


@dataclass(frozen=True)
class MixPlan:
    """Tables of a mix: ``sized`` has the rows, ``sources`` one row a source, ``placement`` one a block that is taken
    (with a struct of epoch and shard for each time), ``chosen`` the rows taken of the blocks that targets cut."""

    sized: DataFrame
    sources: DataFrame
    placement: DataFrame
    chosen: DataFrame


# The block of a row: equal ranges of the upper 31 bits of its hash.
_BLOCK = "shiftright(shiftrightunsigned(u, 33) * n_blocks, 31)"


def plan_mix(docs: DataFrame, params: MixParams, id_col: str, text_col: str, source_col: str) -> MixPlan:
    seed = params.seed
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _row_hash(id_col, text_col, source_col, seed).alias("u"))
    sized = written(rows, "mix-sizes")
    targets = source_targets(sized).withColumn("source_no", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
    n_blocks = F.ceil(F.col("n_docs") / params.block_docs).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = written(targets.withColumn("n_blocks", n_blocks).withColumn("whole", whole).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    placed = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"]).withColumn("block", F.expr(_BLOCK))
    sums = placed.groupBy("source_no", "block").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source_no").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    cut = sums.withColumn("before", before).join(targets.select("source_no", "extra"), "source_no").where("before <= extra and before + words > extra")
    cut = written(cut.select("source_no", F.col("block").alias("cut_block"), (F.col("extra") - F.col("before")).alias("room")), "mix-cuts")
    # In the cut block (about block_docs documents): in the order of the hash, take what still fits, then the
    # smallest one left if that ends nearer.
    members = placed.join(cut, "source_no").where("block = cut_block").groupBy("source_no", "room", "u").agg(F.sum("size").alias("size"))
    listed = members.groupBy("source_no", "room").agg(F.sort_array(F.collect_list(F.struct("u", "size"))).alias("m"))
    fitted = listed.select("source_no", "m", F.expr("aggregate(m, named_struct('room', room, 'us', cast(array() as array<bigint>)), (s, x) -> if(x.size <= s.room, named_struct('room', s.room - x.size, 'us', array_append(s.us, x.u)), s))").alias("fit"))
    last = F.expr("sort_array(transform(filter(m, x -> not array_contains(fit.us, x.u)), x -> struct(x.size as size, x.u as u)))")
    fitted = fitted.withColumn("last", F.try_element_at(last, F.lit(1)))
    chosen = written(fitted.select("source_no", F.explode(F.expr("if(last is not null and last.size - fit.room < fit.room, array_append(fit.us, last.u), fit.us)")).alias("u")).withColumn("chosen", F.lit(True)), "mix-chosen")
    # Exact numbers of blocks: every epoch's, and those up to the cut in the last.
    quotas = targets.join(cut, "source_no", "left").withColumn("cut_block", F.coalesce("cut_block", F.lit(-1).cast("long"))).withColumn("blocks", F.col("whole") * F.col("n_blocks") + F.col("cut_block") + 1)
    sources = written(quotas.select("source", "source_no", "source_size", "target", "n_blocks", "whole", "cut_block", "blocks"), "mix-sources")
    total = sized.agg(F.sum("size")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1, total / params.shard_words))))
    leaves = splitting_tree(sources.select("source_no", "blocks"), depth, seed).where("blocks > 0")
    ends = F.sum("blocks").over(Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = leaves.withColumn("end", ends).select("source_no", "shard", F.explode(F.expr("sequence(end - blocks, end - 1)")).alias("at"))
    moved = f"if(epoch < whole, pmod(at % n_blocks - pmod(xxhash64({seed}, source_no, epoch), n_blocks), n_blocks), at % n_blocks)"
    each = runs.join(sources.select("source_no", "n_blocks", "whole"), "source_no").withColumn("epoch", F.expr("at div n_blocks")).withColumn("block", F.expr(moved))
    placement = written(each.groupBy("source_no", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("at")), "mix-placement")
    drop(targets, cut)
    return MixPlan(sized, sources, placement, chosen)


def with_draws(rows: DataFrame, plan: MixPlan, seed: int) -> DataFrame:
    """``rows`` (with source and u) and source_size, target and draws (epoch, shard, place)."""
    of_source = plan.sources.select(F.col("source").alias("_source"), "source_no", "source_size", "target", "n_blocks", "whole", "cut_block")
    found = rows.join(of_source, rows["source"].eqNullSafe(of_source["_source"])).withColumn("block", F.expr(_BLOCK))
    found = found.join(plan.placement, ["source_no", "block"], "left").join(plan.chosen, ["source_no", "u"], "left")
    taken = "filter(coalesce(at, array()), x -> x.epoch < whole or block < cut_block or chosen is not null)"
    draws = F.expr(f"transform({taken}, x -> named_struct('epoch', x.epoch, 'shard', x.shard, 'place', xxhash64({seed}, x.epoch, u)))")
    return found.select(*[rows[c] for c in rows.columns], "source_size", "target", draws.alias("draws"))


def mix(docs: DataFrame, params: MixParams | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source, source_size, target and draws of every row.

    ``draws`` has a struct (epoch, shard, place) for each copy that the mix takes; a shard's documents
    in the order of ``place`` are the output. Sizes are words; null texts, like texts without words,
    have size 0 and are taken in whole epochs only. Null is a source of its own, after all others.
    Rows with the same id, source and text are taken together, each as often as the other, null ids like any id; nothing
    depends on other columns or on the order of rows, so reruns agree. An empty table gives no rows. Targets
    are found over one row a source in one task.
    """
    params = params or MixParams()
    plan = plan_mix(docs, params, id_col, text_col, source_col)
    return with_draws(plan.sized, plan, params.seed).drop("u")


def mixed_documents(docs: DataFrame, params: MixParams | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, once for each copy the mix takes, shard by shard and shuffled within
    (columns _shard and _place lead). Rows are judged one by one, with repeated and with null ids too."""
    params = params or MixParams()
    plan = plan_mix(docs, params, id_col, text_col, source_col)
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all")
    rows = docs.select(every, F.col(source_col).alias("source"), _row_hash(id_col, text_col, source_col, params.seed).alias("u"))
    out = with_draws(rows, plan, params.seed).select("_all", F.explode("draws").alias("_draw"))
    out = out.select(F.col("_draw.shard").alias("_shard"), F.col("_draw.place").alias("_place"), *[F.col("_all")[c].alias(c) for c in docs.columns])
    return out.repartitionByRange("_shard", "_place").sortWithinPartitions("_shard", "_place")


def taken(mixed: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken: the words of all of a document's draws."""
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), F.size("draws").cast("long").alias("copies"))
