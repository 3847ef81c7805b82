"""Merkle manifest of a dataset: a tree a group of rows, and a tree over the groups' roots.

Bottom up, runs of ``fanout`` nodes become one; every level is written with the digests of each node's children. Top down, each
level is joined with its parents' proofs: a child puts its siblings before the proof that it inherits. So no tree, group
or level is in one task, and a proof is as long as its tree is high. Digests are lowercase hex of SHA-256; a parent's
is that of its children's, as text, one behind the other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import in_order, numbered, starts
from .storage import drop, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class MerkleParams:
    fanout: int = 16

    def __post_init__(self):
        if self.fanout < 2:
            raise ValueError("fanout must be at least 2")


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value: no two rows have one encoding."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return sha(F.concat(*map(encoded, values)))


def group_key(value: Column) -> Column:
    """A group's name as a string that isn't null; null comes first, the others in the order of their bytes."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _height(most: int, fanout: int) -> int:
    """Levels above the leaves of a tree of ``most`` nodes; at least one."""
    height = 1
    while fanout**height < most:
        height += 1
    return height


def _levels(nodes: DataFrame, height: int, fanout: int, name: str, keep: tuple[str, ...] = ()) -> list[DataFrame]:
    """Written levels above ``nodes`` (group, pos, n: nodes of the group, digest, and ``keep``), from below: group, pos, n, digest, alone
    and children (pos, digest, and ``keep`` at the first). A node that is alone in its group isn't hashed again: it is its own parent.
    """
    out: list[DataFrame] = []
    for k in range(height):
        kept = keep if k == 0 else ()
        run = F.floor(F.col("pos") / fanout).cast("long").alias("run")
        runs = nodes.select("group", run, "n", F.struct("pos", "digest", *kept).alias("child")).groupBy("group", "run", "n").agg(F.array_sort(F.collect_list("child")).alias("children"))
        joined = sha(F.array_join("children.digest", ""))
        level = runs.select("group", F.col("run").alias("pos"), F.ceil(F.col("n") / fanout).cast("long").alias("n"), F.when(F.col("n") == 1, F.col("children")[0]["digest"]).otherwise(joined).alias("digest"), (F.col("n") == 1).alias("alone"), "children")
        nodes = written(level, f"{name}-level")
        out.append(nodes)
    return out


def _pushed(level: DataFrame, proofs: DataFrame) -> DataFrame:
    """group, pos, proof of the children of ``level``, whose own proofs are (group, pos, proof and what else is carried): an array of the siblings
    before and behind, from the lowest level up."""
    both = level.select("group", "pos", "alone", "children").join(proofs, ["group", "pos"])
    rest = [c for c in proofs.columns if c not in ("group", "pos", "proof")]
    each = both.select("group", "alone", "proof", *rest, "children", F.posexplode("children").alias("i", "child"))
    digests = F.col("children.digest")
    before, behind = F.array_join(F.slice(digests, F.lit(1), F.col("i")), ""), F.array_join(F.slice(digests, F.col("i") + 2, F.size("children")), "")
    own = F.array(F.struct(before.alias("before"), behind.alias("behind")))
    return each.select("group", *rest, F.when(F.col("alone"), F.col("proof")).otherwise(F.concat(own, F.col("proof"))).alias("proof"), "child")


NO_PROOF = "cast(array() as array<struct<before:string,behind:string>>)"


def proof_digest(proof: Column) -> Column:
    """H of all siblings, level by level."""
    return sha(F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["behind"])), ""))


def folded(leaf_digest: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf_digest, lambda acc, p: sha(F.concat(p["before"], acc, p["behind"])))


@dataclass
class Manifest:
    """``levels``: above the rows, group by group; ``top``: above the groups' roots; tables of ``_levels``, from below. ``root``: null without rows."""

    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def build(leaves: DataFrame, order: tuple[str, ...], params: MerkleParams | None = None, keep: tuple[str, ...] = ()) -> Manifest:
    """The trees over ``leaves`` (group, digest, ``order`` and ``keep``): leaves of a group in ``order``, equal ones by digest; groups by name."""
    params = params or MerkleParams()
    spark, fanout = leaves.sparkSession, params.fanout
    rows = written(in_order(leaves, "group", *order, "digest"), "merkle-leaves")
    first = written(starts(rows, "group"), "merkle-starts")
    sizes = first.groupBy("group").agg(F.sum("rows").alias("n"))
    most = sizes.agg(F.max("n")).first()[0]
    if most is None:
        return Manifest([], [], None)
    # Sizes come with the starts: a part knows how many rows its whole group has.
    known = first.join(sizes, "group")
    nodes = numbered(rows, known, "group", "pos", ("n",))
    levels = _levels(nodes.select("group", "pos", "n", "digest", *keep), _height(most, fanout), fanout, "merkle", keep)
    drop(rows)
    groups = written(in_order(levels[-1].select(F.col("group").alias("name"), "digest"), "name").withColumn("group", F.lit("")), "merkle-groups")
    count = groups.count()
    placed = numbered(groups, starts(groups, "group"), "group", "pos").withColumn("n", F.lit(count).cast("long"))
    top = _levels(placed.select("group", "pos", "n", "digest", "name"), _height(count, fanout), fanout, "merkle-top", ("name",))
    drop(groups, first)
    return Manifest(levels, top, top[-1].first()["digest"])


def proofs(manifest: Manifest) -> DataFrame:
    """child (a leaf with what was kept), subroot and proof of every leaf."""
    top, levels = manifest.top, manifest.levels
    above = top[-1].select("group", "pos", F.expr(NO_PROOF).alias("proof"))
    for level in reversed(top[1:]):
        above = _pushed(level, above).select("group", "child.pos", "proof")
    groups = _pushed(top[0], above).select(F.col("child.name").alias("group"), F.lit(0).cast("long").alias("pos"), "proof", F.col("child.digest").alias("subroot"))
    above = written(groups, "merkle-proofs")
    for level in reversed(levels[1:]):
        after = written(_pushed(level, above).select("group", "child.pos", "proof", "subroot"), "merkle-proofs")
        drop(above)
        above = after
    return _pushed(levels[0], above).select("child", "subroot", "proof")


def tampered_text(id_col: Column, text: Column) -> Column:
    """What tampering makes of a text: A-Z lowered where 5 divides the crc32 of the id in decimals."""
    return F.when(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.translate(text, _UPPER, _UPPER.lower())).otherwise(text)


def merkle_report(docs: DataFrame, params: MerkleParams | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs`` (``FIELDS``).

    A leaf is H of the row's fields; leaves of a source ascend by doc_id (null first), rows of one id by their digests; equal
    rows have equal leaves and places side by side. A null source is a group of its own, before all others. folded_root comes
    from the tampered leaf and the untampered proof; a tampered text without capitals, null or empty, still verifies. An empty table
    has no rows and no root. Other columns are ignored.
    """
    cols = {c: F.col(c) for c in FIELDS}
    other = leaf([*[cols[c] for c in FIELDS[:-1]], tampered_text(cols["doc_id"], cols["text"])])
    harmed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    leaves = docs.select(group_key(F.col("source")).alias("group"), "doc_id", leaf(list(cols.values())).alias("digest"), F.when(harmed, other).alias("claimed"))
    manifest = build(leaves, ("doc_id",), params, ("doc_id", "claimed"))
    if manifest.root is None:
        return docs.limit(0).select("doc_id", *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(False).alias("verified"))
    root = F.lit(manifest.root)
    rows = proofs(manifest).select(F.col("child.doc_id").alias("doc_id"), F.col("child.digest").alias("leaf"), "subroot", root.alias("root"), proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.coalesce("child.claimed", "child.digest"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == root)


def oracle_sql(params: MerkleParams | None = None, height: int = 8) -> str:
    """DuckDB SQL for the rows of ``merkle_report``: trees of up to fanout ** height leaves a source, and as many sources."""
    fan = (params or MerkleParams()).fanout
    field = lambda c: f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || {c}, '-')"
    h = lambda text: f"sha256({' || '.join(map(field, [*FIELDS[:-1], text]))})"
    crc = "xor(4294967295, list_reduce(list_transform(regexp_extract_all(cast(doc_id as varchar), '.'), lambda x: cast(ascii(x) as bigint)), lambda c, x: xor(c >> 8, crc[1 + (xor(c, x) & 255)]), 4294967295))"
    steps = [
        "bits as (select list(list_reduce(range(8), lambda c, x: xor(c >> 1, (c & 1) * 3988292384), v) order by v) as crc from range(256) as r(v))",
        f"leaves as (select coalesce('=' || source, '') as g, doc_id, {h('text')} as leaf, case when {crc} % 5 = 0 then {h(f'''translate(text, '{_UPPER}', '{_UPPER.lower()}')''')} end as claimed from documents, bits)",
        "a0 as (select g, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by g) as n, leaf as digest, doc_id, claimed from leaves)",
    ]

    def tree(name: str) -> None:
        for k in range(height):
            steps.append(f"{name}r{k} as (select g, pos // {fan} as pos, any_value(n) as n, list(digest order by pos) as d from {name}{k} group by g, pos // {fan})")
            steps.append(f"{name}{k + 1} as (select g, pos, (n + {fan - 1}) // {fan} as n, case when n = 1 then d[1] else sha256(array_to_string(d, '')) end as digest from {name}r{k})")

    tree("a")
    steps.append(f"b0 as (select '' as g, row_number() over (order by g) - 1 as pos, count(*) over () as n, digest, g as name from a{height})")
    tree("b")
    steps.append(f"p0 as (select a.g, a.pos, b.pos as top, a.doc_id, a.digest as leaf, b.digest as subroot, '' as proof, coalesce(a.claimed, a.digest) as acc from a0 a join b0 b on b.name = a.g)")
    k = 0
    for name, pos, group in (("a", "pos", "p.g"), ("b", "top", "''")):
        for level in range(height):
            i = f"p.{pos} // {fan**level} % {fan}"
            before, behind = f"array_to_string(r.d[1 : {i}], '')", f"array_to_string(r.d[{i} + 2 : ], '')"
            steps.append(f"p{k + 1} as (select p.* exclude (proof, acc), case when r.n = 1 then proof else proof || {before} || {behind} end as proof, case when r.n = 1 then acc else sha256({before} || acc || {behind}) end as acc from p{k} p join {name}r{level} r on r.g = {group} and r.pos = p.{pos} // {fan ** (level + 1)})")
            k += 1
    return f"with {', '.join(steps)}\nselect doc_id, leaf, subroot, b.digest as root, sha256(proof) as proof_sha256, acc as folded_root, acc = b.digest as verified from p{k}, b{height} b"
