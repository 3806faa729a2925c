"""From shared table keys to verified groups, without all pairs of a group.

Every two items that share a key are candidates.  Verifying all of them would
square a large group, so the work follows the groups as they form:

1. every item is verified against the smallest item it shares a key with;
2. keys whose members are by then all in one group are done.  For the members
   of the others, ``refine`` may add columns that bound a pair's similarity
   from above; items that can't reach any partner leave;
3. within each key, the best member of every group is verified against the best
   member of the key (``order``);
4. items of one key that are still in different groups are compared in full,
   as far as the bound allows.

No pair is verified twice.  Step 4 leaves no candidate pair between two groups unverified unless the bound
excludes it, so the groups equal those of verifying every candidate pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusrank.llm.common import alone, compacted
from corpusrank.llm.graph import components, roots

SLICE = 512


def _grouped(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of keys that hold more than one group, with their group and their number."""
    m = (members.join(comp.select(F.col("id").alias("_i"), "component"), F.col("id") == F.col("_i"), "left")
         .withColumn("component", F.coalesce("component", "id")).drop("_i"))
    mixed = (m.groupBy("key").agg(F.min("component").alias("first"), F.max("component").alias("last"), F.count(F.lit(1)).alias("n_members"))
             .where("first <> last").select("key", "first", "n_members"))
    return m.join(compacted(mixed, "mixed-keys"), "key")


def _with(df: DataFrame, items: DataFrame, attrs: list[str], id_col: str = "id", prefix: str = "") -> DataFrame:
    """``df`` with the attributes of the item that ``id_col`` names."""
    own = items.select(F.col("id").alias(id_col), *[F.col(c).alias(f"{prefix}{c}") for c in attrs])
    return df.join(own, id_col)


def _joined(links: DataFrame, comp: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and groups after ``more`` links, which join groups: only the groups
    are followed, not their members."""
    if more.isEmpty():
        return links, comp
    of = comp.select(F.col("id").alias("_i"), F.col("component").alias("_c"))
    edge = more
    for end in ("a", "b"):
        edge = (edge.join(of, edge[end] == of["_i"], "left").withColumn(end, F.coalesce("_c", end)).drop("_i", "_c"))
    merged = alone(lambda: components(edge.distinct()), "merged")
    known = comp.unionByName(merged.select("id", F.col("id").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
    new = merged.select(F.col("id").alias("component"), F.col("component").alias("_to"))
    out = known.join(new, "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
    return links.unionByName(more), compacted(out, "components")


def link(keyed: DataFrame, items: DataFrame, attrs: list[str], compatible: Callable[[str, str], Column],
         verify: Callable[[DataFrame], DataFrame], refine: Callable[[DataFrame], DataFrame] | None = None,
         refined: list[str] = (), bound: Callable[[str, str], Column] | None = None,
         viable: Column | None = None, order: str = "id", once: Callable[[str, str], Column] | None = None,
         once_attrs: list[str] = (), last: Callable[[str, str], Column] | None = None,
         last_attrs: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``(components, links)`` of ``keyed(key, id)``; ``items(id, *attrs)`` has
    each id once.

    ``compatible(x, y)`` is a cheap necessary condition, given the prefixes of
    two items' attribute columns; ``verify`` gets a written table of pairs
    ``(a, b)`` and returns those that hold.  ``refine`` maps ``(id)`` to ``(id, *refined)``, on which
    ``bound(x, y)`` and ``viable`` are further necessary conditions and
    ``order`` (an expression, small first) chooses the best member.  ``once``,
    over ``key`` and the items' ``once_attrs``, holds for one shared key of a
    pair, so that step 4 makes a pair once and not for each key it shares.
    ``last(x, y)``, over ``last_attrs`` of ``refine``, is one more necessary condition
    for step 4 alone, whose wider columns the other steps do not carry.  As it may be
    costly, the pairs of a key are then dealt in slices of about ``SLICE`` members
    against all."""
    pair = [F.least("id", "lead_id").alias("a"), F.greatest("id", "lead_id").alias("b")]
    # written tables on both sides keep the joins splittable where a key is hot
    lead = compacted(keyed.groupBy("key").agg(F.min("id").alias("lead_id"), F.max("id").alias("_last"))
                 .where("lead_id <> _last").drop("_last"), "leads")
    members = compacted(_with(keyed.join(lead, "key"), items, attrs), "members")
    first = _with(members.where("id <> lead_id").select("id", "lead_id", *attrs).distinct(), items, attrs, "lead_id", "lead_")
    first = first.where(compatible("", "lead_")).groupBy("id").agg(F.min("lead_id").alias("lead_id"))
    done = compacted(first.select(*pair), "pairs")
    links = alone(lambda: verify(done), "verified")
    comp = alone(lambda: roots(links.select(F.col("b").alias("id"), F.col("a").alias("parent"))), "components")
    members = compacted(_grouped(members.select("key", "id", *attrs), comp).drop("first", "n_members"), "mixed")
    if members.isEmpty():
        return comp, links
    if refine is not None:
        extra = alone(lambda: refine(members.select("id").distinct()), "refined")
        members = members.join(extra.select("id", *refined), "id")
        members = compacted(members.where(viable) if viable is not None else members, "viable")
    attrs = [*attrs, *refined]
    fits = compatible if bound is None else lambda x, y: compatible(x, y) & bound(x, y)

    m = _grouped(members.drop("component"), comp).drop("n_members")
    best = F.min(F.struct(F.expr(order).alias("_order"), "id", *attrs))
    reps = compacted(m.groupBy("key", "component").agg(best.alias("me"))
                 .select("key", "component", *[F.col(f"me.{c}").alias(c) for c in ("_order", "id", *attrs)]), "reps")
    heads = compacted(reps.groupBy("key").agg(F.min(F.struct("_order", "id", "component", *attrs)).alias("head"))
                  .select("key", *[F.col(f"head.{c}").alias(f"lead_{c}") for c in ("component", "id", *attrs)]), "heads")
    tried = (reps.join(heads, "key").where((F.col("component") != F.col("lead_component")) & fits("", "lead_"))
             .select(*pair).distinct())
    tried = compacted(tried.join(done, ["a", "b"], "left_anti"), "pairs")
    links, comp = _joined(links, comp, alone(lambda: verify(tried), "verified"))
    m = _with(_grouped(members.drop("component"), comp).drop("first"), items, list(once_attrs))
    m = compacted(_with(m, extra, list(last_attrs)) if last_attrs else m, "mixed")
    attrs = [*attrs, *once_attrs, *last_attrs]
    x = m.select("key", "n_members", *[F.col(c).alias(f"x_{c}") for c in ("component", "id", *attrs)])
    y = m.select("key", "n_members", *[F.col(c).alias(f"y_{c}") for c in ("component", "id", *attrs)])
    same = (x["key"] == y["key"]) & (x["x_component"] < y["y_component"])
    if once is not None:
        same = same & once(x["key"], "x_", "y_")
    same = same & fits("x_", "y_")
    if last is not None:
        slices = F.expr(f"int(1 + n_members DIV {SLICE})")
        x = x.withColumn("x_slice", F.pmod(F.hash("x_id"), slices))
        y = y.withColumn("y_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        same = same & (x["x_slice"] == y["y_slice"]) & last("x_", "y_")
    cross = (x.join(y, same)
             .select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct())
    cross = compacted(cross.join(done.unionByName(tried), ["a", "b"], "left_anti"), "pairs")
    return tuple(reversed(_joined(links, comp, alone(lambda: verify(cross), "verified"))))
